"""The named category specs (points and segments), generated by rule.

Each builder returns a plain spec dict that :func:`build_frame` compiles.
Lanes are ``cpu`` or ``pid``; an event "tick" is a short vertical mark at
the event time, a "span" a horizontal segment from the event to the next
related event.
"""

from __future__ import annotations

from ..vars import DEFAULT_VARS

# Colour of each default event in the event-tick recipes.
EVENT_COLORS = {
    "EXEC": "#e41a1c",
    "EXIT": "#377eb8",
    "WAKEUP": "#4daf4a",
    "WAKEUP_NEW": "#984ea3",
    "BLOCK": "#ff7f00",
    "BLOCK_IO": "#ffff33",
    "WAIT_FUTEX": "#a65628",
    "WAKE_FUTEX": "#f781bf",
    "WAKER_FUTEX": "#999999",
    "FORK": "#66c2a5",
    "TICK": "#fc8d62",
    "CTX_SWITCH": "#8da0cb",
    "MIGRATE": "#a6d854",
    "RQ_SIZE": "#ffd92f",
    "IDL_BLN_FAIR_BEG": "#e5c494",
    "IDL_BLN_FAIR_END": "#ffffb3",
    "PER_BLN_FAIR_BEG": "#fb8072",
    "PER_BLN_FAIR_END": "#fdb462",
}

# Frequency band edges (kHz) and band colours.
FREQ_EDGES = [1200000, 1700000, 2100000, 2600000]
FREQ_COLORS_V1 = ["#8cd0f5", "#8ded6d", "#d6ed6d", "#e09e24", "#e02424"]
FREQ_COLORS_V2 = ["#8cd0f5", "#8ded6d", "#d6ed6d", "#e03030", "#f00000"]
ROLLING_WINDOWS = [160, 1600, 16000, 32000]
ROLLING_COLORS = ["#e02424", "#e09e24", "#d6ed6d", "#8ded6d", "#8cd0f5"]

NXT_TS_CPU = "nxt_timestamp_of_same_evt_on_same_cpu"
BLK_WKP = "nxt_blk_wkp_of_same_pid"
PRV_FRQ = "prv_frq_on_same_cpu"

SEGMENT_OUT = ["x0", "y0", "x1", "y1", "c", "pid", "arg0", "arg1"]
TRACE_IN = ["timestamp", "cpu", "event", "pid", "arg0", "arg1"]


def _cat(label, color, pipes, hide=None):
    c = {"label": label, "color": color, "concatenate": pipes}
    if hide is not None:
        c["hide_hovertool"] = hide
    return c


def tick(query, lane, delta=False):
    steps = [["query", query], ["=", "x0", "timestamp"], ["=", "x1", "timestamp"]]
    if delta:
        steps.append(["=", "delta", ["-", "x1", "x0"]])
    steps += [["=", "y0", ["+", lane, 0.0]], ["=", "y1", ["+", lane, 0.5]]]
    return [steps]


def span(query, x1, lane, delta=False):
    steps = [["query", query], ["=", "x0", "timestamp"], ["=", "x1", x1]]
    if delta:
        steps.append(["=", "delta", ["-", "x1", "x0"]])
    steps += [["=", "y0", ["+", lane, 0.0]], ["=", "y1", ["+", lane, 0.0]]]
    return [steps]


def is_event(name):
    return f"event==${name}"


def event_ticks(names, lane, labels=None, colors=None):
    labels = labels or {}
    colors = colors or {}
    return [_cat(labels.get(n, n), colors.get(n, EVENT_COLORS.get(n, "#999999")),
                 tick(is_event(n), lane)) for n in names]


def run_queue_cats():
    return [
        _cat("RQ_SIZE = 1", "#444444", span("event==$RQ_SIZE & arg0==1", NXT_TS_CPU, "cpu"), True),
        _cat("RQ_SIZE > 1", "#ff0000", span("event==$RQ_SIZE & arg0>1", NXT_TS_CPU, "cpu"), True),
        _cat("RQ_SIZE Lim", "#444444", tick("event==$RQ_SIZE", "cpu")),
    ]


def band_queries(column, edges, closed="right"):
    """Half-open bands over ``edges``: ``(lo, hi]`` (right) or ``[lo, hi)`` (left)."""
    lo_op, hi_op = (">", "<=") if closed == "right" else (">=", "<")
    qs = []
    bounds = [None] + list(edges) + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        parts = []
        if lo is not None:
            parts.append(f"{column}{lo_op}{lo}")
        if hi is not None:
            parts.append(f"{column}{hi_op}{hi}")
        qs.append(" & ".join(parts))
    return qs


def band_labels(edges, style):
    ghz = [0.0] + [e / 1e6 for e in edges] + [float("inf")]
    out = []
    for lo, hi in zip(ghz[:-1], ghz[1:]):
        hi_s = "inf" if hi == float("inf") else f"{hi:.1f}"
        out.append(f"{style[0]}{lo:.1f}, {hi_s}{style[1]} GHz")
    return out


def freq_band_cats(colors, label_style):
    labels = band_labels(FREQ_EDGES, label_style)
    return [_cat(lbl, col, tick(f"event==$TICK & {q}", "cpu"))
            for lbl, col, q in zip(labels, colors, band_queries("arg1", FREQ_EDGES))]


DEFAULT_EVENTS = list(DEFAULT_VARS)
SPLIT_EVENT_LABELS = {"EXEC": "EXEC_EVT", "EXIT": "EXIT_EVT"}
COMMON_EVENTS = ["EXEC", "EXIT", "WAKEUP", "WAKEUP_NEW", "BLOCK", "BLOCK_IO", "WAIT_FUTEX",
                 "WAKE_FUTEX", "WAKER_FUTEX", "FORK", "CTX_SWITCH", "MIGRATE"]


def balancing_cats(with_ipa):
    pairs = [("IDL_LB_BEG", "#a6d854", "IDL_BLN_FAIR_BEG", "IDL_BLN_IPA_BEG"),
             ("IDL_LB_END", "#a65628", "IDL_BLN_FAIR_END", "IDL_BLN_IPA_END"),
             ("LB_BEG", "#f781bf", "PER_BLN_FAIR_BEG", "PER_BLN_IPA_BEG"),
             ("LB_END", "#a65628", "PER_BLN_FAIR_END", "PER_BLN_IPA_END")]
    out = []
    for label, color, fair, ipa in pairs:
        q = f"{is_event(fair)} | {is_event(ipa)}" if with_ipa else is_event(fair)
        out.append(_cat(label, color, tick(q, "cpu")))
    return out


def spec_events_per_cpu():
    """REC1: every default event as a tick per CPU + run-queue spans."""
    return {"input": TRACE_IN + [NXT_TS_CPU], "output": SEGMENT_OUT,
            "c": event_ticks(DEFAULT_EVENTS, "cpu") + run_queue_cats()}


def spec_freq():
    """REC2: event ticks + frequency bands (lo, hi] of TICK arg1."""
    return {"input": TRACE_IN, "output": SEGMENT_OUT,
            "c": event_ticks(DEFAULT_EVENTS, "cpu") + freq_band_cats(FREQ_COLORS_V1, "(]")}


def _freq_new(with_ipa):
    cats = event_ticks(COMMON_EVENTS, "cpu", SPLIT_EVENT_LABELS, {"MIGRATE": "#999999"})
    cats += balancing_cats(with_ipa)
    if with_ipa:
        cats += [_cat("UNBLOCK_PREPARE_IPA_BEG", "#f781bf", tick(is_event("UNBLOCK_PREPARE_IPA_BEG"), "cpu")),
                 _cat("UNBLOCK_PREPARE_IPA_END", "#ff7f00", tick(is_event("UNBLOCK_PREPARE_IPA_END"), "cpu"))]
    cats += run_queue_cats() + freq_band_cats(FREQ_COLORS_V2, "[]")
    return {"input": TRACE_IN + [NXT_TS_CPU], "output": SEGMENT_OUT, "c": cats}


def spec_freq_balancing():
    """REC3: + idle/periodic balancing begin/end, FAIR or IPA."""
    return _freq_new(True)


def spec_freq_balancing_fair():
    """REC4: FAIR-only balancing variant."""
    return _freq_new(False)


def spec_pull_back():
    """REC5: kernel-build view with WAIT_PID and DEBUG_EVT marks."""
    names = ["EXEC", "EXIT", "WAKEUP", "WAKEUP_NEW", "BLOCK", "BLOCK_IO"]
    cats = event_ticks(names, "cpu", SPLIT_EVENT_LABELS)
    cats += [_cat("WAIT_PID", "#999999", tick(is_event("WAIT_PID"), "cpu"))]
    cats += event_ticks(["FORK", "CTX_SWITCH"], "cpu")
    cats += balancing_cats(False)[:2]
    cats += [_cat("DEBUG", "#f781bf", tick(is_event("DEBUG_EVT"), "cpu")),
             _cat("MIGRATE", "#f781bf", tick(is_event("MIGRATE"), "cpu"))]
    cats += run_queue_cats() + freq_band_cats(FREQ_COLORS_V2, "[]")
    return {"input": TRACE_IN + [NXT_TS_CPU], "output": SEGMENT_OUT, "c": cats}


def spec_events_per_pid():
    """REC6: every default event as a tick per pid lane."""
    return {"input": ["timestamp", "event", "pid"], "output": ["x0", "y0", "x1", "y1", "c"],
            "c": event_ticks(DEFAULT_EVENTS, "pid")}


def spec_run_queue():
    """REC7: idle / busy / overloaded run-queue spans per CPU with durations."""
    def rq(label, color, cond, hide=None):
        return _cat(label, color, span(f"event==$RQ_SIZE{cond}", NXT_TS_CPU, "cpu", delta=True), hide)
    return {"input": ["timestamp", "cpu", "event", "arg0", "arg1", NXT_TS_CPU],
            "output": ["x0", "y0", "x1", "y1", "c", "arg0", "arg1", "delta"],
            "c": [_cat("RQ_SIZE", "#000000", tick("event==$RQ_SIZE", "cpu", delta=True)),
                  rq("RQ_SIZE == 1", "#00ff00", " & arg0==1"),
                  rq("RQ_SIZE > 1", "#ff0000", " & arg0>1"),
                  rq("RQ_SIZE==0", "#000000", " & arg0==0"),
                  rq("ALL RQ_SIZE", "#0000ff", "", True)]}


def spec_block_wakeup():
    """REC8: blocked and runnable spans per pid."""
    cats = []
    for kind in ("tick", "span"):
        for name, color in (("WAKEUP", "#4daf4a"), ("BLOCK", "#ff7f00")):
            pipe = (tick(is_event(name), "pid", delta=True) if kind == "tick"
                    else span(is_event(name), BLK_WKP, "pid", delta=True))
            cats.append(_cat(name, color, pipe))
    return {"input": ["timestamp", "event", "pid", BLK_WKP],
            "output": ["x0", "y0", "x1", "y1", "c", "delta"], "c": cats}


def spec_idle_balancing():
    """REC9: load-balancing spans (FAIR and IPA idle balancing)."""
    cats = [_cat("TICK", "#fc8d62", tick(is_event("TICK"), "cpu", delta=True))]
    for tag, beg, end in (("fair", "IDL_BLN_FAIR_BEG", "IDL_BLN_FAIR_END"),
                          ("ipa", "IDL_BLN_IPA_BEG", "IDL_BLN_IPA_END")):
        nxt = f"nxt_timestamp_of_({beg}|{end})_on_same_cpu"
        cats += [_cat(f"LB {tag}", "#000000", span(is_event(beg), nxt, "cpu", delta=True)),
                 _cat(f"LB {tag} beg", "#000000", tick(is_event(beg), "cpu", delta=True)),
                 _cat(f"LB {tag} end", "#000000", tick(is_event(end), "cpu", delta=True))]
    return {"input": TRACE_IN + ["nxt_timestamp_of_(IDL_BLN_FAIR_BEG|IDL_BLN_FAIR_END)_on_same_cpu",
                                 "nxt_timestamp_of_(IDL_BLN_IPA_BEG|IDL_BLN_IPA_END)_on_same_cpu"],
            "output": SEGMENT_OUT + ["delta"], "c": cats}


def spec_user_events_per_cpu():
    """REC10: user events per CPU."""
    return {"input": TRACE_IN + [NXT_TS_CPU], "output": SEGMENT_OUT,
            "c": [_cat("job", "#000000", tick(is_event("USER_EVT"), "cpu"))]}


def spec_user_jobs_per_pid():
    """REC11: user job spans -- consecutive user events with equal arguments."""
    same = "arg0==nxt_arg0_of_same_evt_on_same_pid & arg1==nxt_arg1_of_same_evt_on_same_pid"
    lim = tick(is_event("USER_EVT"), "pid")
    lim[0].append(["=", "delta", ["-", "x1", "x0"]])
    job = span(f"{is_event('USER_EVT')} & {same}", "nxt_timestamp_of_same_evt_on_same_pid", "pid")
    job[0].append(["=", "delta", ["-", "x1", "x0"]])
    return {"input": TRACE_IN + ["nxt_timestamp_of_same_evt_on_same_pid",
                                 "nxt_arg0_of_same_evt_on_same_pid", "nxt_arg1_of_same_evt_on_same_pid"],
            "output": SEGMENT_OUT + ["delta"],
            "c": [_cat("job lim", "#000000", lim), _cat("job", "#000000", job)]}


def _freq_points():
    return [["query", "event == $TICK"], ["=", "x", "timestamp"], ["=", "y", "arg1"]]


def spec_freq_points():
    """REC12: frequency over time."""
    return {"input": ["timestamp", "event", "arg1"], "output": ["x", "y", "c"],
            "c": [_cat("Freq (GHz)", "#000000", [_freq_points()])]}


def spec_freq_rolling_mean():
    """REC13: frequency and its rolling means over TICK rows."""
    cats = [_cat("Freq (GHz)", ROLLING_COLORS[0], [_freq_points()])]
    for w, color in zip(ROLLING_WINDOWS, ROLLING_COLORS[1:]):
        cats.append(_cat(f"Freq.rolling({w}).mean() (GHz)", color, [[
            ["query", "event == $TICK"],
            ["=", "x", ["rolling", w, "mean", "timestamp"]],
            ["=", "y", ["rolling", w, "mean", "arg1"]]]]))
    return {"input": ["timestamp", "event", "arg1"], "output": ["x", "y", "c"], "c": cats}


def _rank_pipe(query, duration):
    return [["query", query], ["=", "x", duration],
            ["=", "y", ["argsort", "x"]], ["=", "y", ["argsort", "y"]]]


def spec_block_wakeup_rank():
    """REC14: distribution (rank plot) of block and run durations."""
    d = ["-", BLK_WKP, "timestamp"]
    return {"input": ["timestamp", "event", BLK_WKP], "output": ["x", "y", "c"],
            "c": [_cat("WAKEUP", "#00ff00", [_rank_pipe("event == $WAKEUP", d)], True),
                  _cat("BLOCK", "#ff0000", [_rank_pipe("event == $BLOCK", d)], True)]}


def spec_run_queue_rank():
    """REC15: distribution of run-queue state durations."""
    d = ["-", NXT_TS_CPU, "timestamp"]
    conds = [("RQ_SIZE == 1", "#00ff00", " & arg0==1"), ("RQ_SIZE > 1", "#ff0000", " & arg0>1"),
             ("RQ_SIZE == 0", "#000000", " & arg0==0"), ("RQ_SIZE > 0", "#000000", " & arg0>0"),
             ("ALL RQ_SIZE", "#0000ff", "")]
    return {"input": ["timestamp", "event", "arg0", NXT_TS_CPU], "output": ["x", "y", "c"],
            "c": [_cat(l, col, [_rank_pipe(f"event == $RQ_SIZE{q}", d)], True) for l, col, q in conds]}


def spec_run_queue_freq():
    """REC16: frequency band vs rank of busy-queue durations."""
    head = [["query", "event == $RQ_SIZE & arg0>=1"],
            ["=", "delta", ["-", NXT_TS_CPU, "timestamp"]],
            ["query", "delta <= 1000000000"],
            ["=", "y", ["argsort", "delta"]], ["=", "y", ["argsort", "y"]]]
    cats = [_cat("Time Interval (RQ_SIZE >= 1)", "#000000", [head + [["=", "x", "delta"]]], False)]
    edges = [e + 0.0 for e in FREQ_EDGES]
    for label, color, q in zip(band_labels(FREQ_EDGES, "[]"), FREQ_COLORS_V2,
                               band_queries("x", edges, closed="left")):
        cats.append(_cat(label, color, [head + [["=", "x", PRV_FRQ], ["query", q]]], False))
    return {"input": ["timestamp", "event", "arg0", NXT_TS_CPU, PRV_FRQ],
            "output": ["x", "y", "c", "delta", PRV_FRQ], "c": cats}


RECIPES = {
    "events_per_cpu": spec_events_per_cpu,
    "freq": spec_freq,
    "freq_balancing": spec_freq_balancing,
    "freq_balancing_fair": spec_freq_balancing_fair,
    "pull_back": spec_pull_back,
    "events_per_pid": spec_events_per_pid,
    "run_queue": spec_run_queue,
    "block_wakeup": spec_block_wakeup,
    "idle_balancing": spec_idle_balancing,
    "user_events_per_cpu": spec_user_events_per_cpu,
    "user_jobs_per_pid": spec_user_jobs_per_pid,
    "freq_points": spec_freq_points,
    "freq_rolling_mean": spec_freq_rolling_mean,
    "block_wakeup_rank": spec_block_wakeup_rank,
    "run_queue_rank": spec_run_queue_rank,
    "run_queue_freq": spec_run_queue_freq,
}
