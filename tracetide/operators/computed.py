"""Computed trace columns (registry of name -> window plan).

Families (all built on the block + carry helpers, one window stage per
family and partition key):

* ``nxt_{key}_of_same_evt_on_same_{loc}``: next value of ``key`` among rows
  of the same event and cpu|pid; the last row keeps its own value.
* ``nxt_{key}_of_({A}|{B})_on_same_{loc}``: same, restricted to rows whose
  event is A or B; other rows keep their own value.
* ``nxt_blk_wkp_of_same_pid``: the BLOCK|WAKEUP timestamp column on pid.
* ``prv_frq_on_same_cpu``: arg1 of the latest TICK at or before the row on
  the same cpu; NULL before the first TICK.
* ``addr``, ``comm``: ingest columns (command address / command id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import conf_int
from ..functions.scalar import comm_from_addr
from ..trace import with_addr
from ..vars import DEFAULT_VARS
from .blocks import last_non_null_in_group, next_in_group, running_max_by_time
from .order import with_position

KEYS = ("timestamp", "arg0", "arg1")
LOCATIONS = ("cpu", "pid")

# Event pairs that delimit spans (begin|end).
EVENT_PAIRS = (
    ("BLOCK", "WAKEUP"),
    ("IDL_BLN_FAIR_BEG", "IDL_BLN_FAIR_END"),
    ("PER_BLN_FAIR_BEG", "PER_BLN_FAIR_END"),
    ("IDL_BLN_IPA_BEG", "IDL_BLN_IPA_END"),
    ("PER_BLN_IPA_BEG", "PER_BLN_IPA_END"),
)


@dataclass(frozen=True)
class Computed:
    family: tuple   # grouping key: names of one family are built together
    key: str | None
    deps: tuple


REGISTRY: dict = {}


def register(name: str, family: tuple, key: str | None, deps: tuple) -> None:
    if name in REGISTRY:  # first registration wins
        return
    REGISTRY[name] = Computed(family, key, deps)


for _key in KEYS:
    for _loc in LOCATIONS:
        register(f"nxt_{_key}_of_same_evt_on_same_{_loc}", ("same_evt", _loc), _key,
                 (_key, "event", _loc))
for _a, _b in EVENT_PAIRS:
    for _key in KEYS:
        for _loc in LOCATIONS:
            register(f"nxt_{_key}_of_({_a}|{_b})_on_same_{_loc}", ("pair", _a, _b, _loc), _key,
                     (_key, "event", _loc))
register("nxt_blk_wkp_of_same_pid", ("pair", "BLOCK", "WAKEUP", "pid"), "timestamp",
         ("timestamp", "event", "pid"))
register("prv_frq_on_same_cpu", ("prv_frq",), "arg1", ("arg1", "event", "cpu"))
register("addr", ("addr",), None, ("arg0", "arg1"))
register("comm", ("comm",), None, ("timestamp", "pid", "event", "arg0", "arg1"))


USER_BUILDERS: dict = {}


def register_computed(name: str, deps, builder) -> None:
    """UDF2: register ``builder(df, variables) -> df`` adding column ``name``.

    Dependencies (stored or computable) are added first; the first
    registration of a name wins.
    """
    if name in REGISTRY:
        import warnings
        warnings.warn(f"{name} already registered; keeping the first")
        return
    register(name, ("user", name), None, tuple(deps))
    USER_BUILDERS[name] = builder


def _code(variables: dict, name: str) -> int:
    if name not in variables:
        raise KeyError(f"event {name!r} is not in the trace dictionary")
    return int(variables[name])


def with_computed(df: DataFrame, names, variables: dict | None = None,
                  block_rows: int | None = None) -> DataFrame:
    """Add the requested computed columns that are not stored yet (SRC3, CMP8)."""
    variables = variables or DEFAULT_VARS
    spark = df.sparkSession
    block_rows = block_rows or conf_int(spark, "tracetide.block.rows")
    todo = [n for n in dict.fromkeys(names) if n not in df.columns]
    unknown = [n for n in todo if n not in REGISTRY]
    if unknown:
        raise KeyError(f"columns {unknown} are neither stored nor computable")
    # computable dependencies first (memoised: each is added once)
    deps = [d for n in todo for d in REGISTRY[n].deps if d not in df.columns and d in REGISTRY]
    if deps:
        df = with_computed(df, deps, variables, block_rows)
    families: dict = {}
    for n in todo:
        spec = REGISTRY[n]
        missing = [d for d in spec.deps if d not in df.columns]
        if missing:
            raise KeyError(f"{n} needs columns {missing}")
        fam = spec.family
        if fam[0] == "pair":  # pairs are disjoint event sets: one window per lane
            fam = ("pairs", fam[3])
        families.setdefault(fam, []).append(n)
    for family, members in families.items():
        kind = family[0]
        if kind == "same_evt":
            loc = family[1]
            df = next_in_group(df, ["event", loc], {n: REGISTRY[n].key for n in members},
                               block_rows=block_rows)
        elif kind == "pairs":
            loc = family[1]
            pairs = sorted({REGISTRY[n].family[1:3] for n in members})
            group = F.lit(None).cast("int")
            for j, (a, b) in reversed(list(enumerate(pairs))):
                group = F.when(F.col("event").isin(_code(variables, a), _code(variables, b)),
                               F.lit(j)).otherwise(group)
            df = df.withColumn("_tt_pair", group)
            use = {n: F.col("_tt_pair") == pairs.index(REGISTRY[n].family[1:3]) for n in members}
            df = next_in_group(df, [loc, "_tt_pair"], {n: REGISTRY[n].key for n in members},
                               block_rows=block_rows, use_next=use).drop("_tt_pair")
        elif kind == "prv_frq":
            tick = _code(variables, "TICK")
            df = last_non_null_in_group(
                df, ["cpu"], F.when(F.col("event") == tick, F.col("arg1").cast("double")),
                "prv_frq_on_same_cpu", block_rows=block_rows)
        elif kind == "addr":
            df = with_addr(df)
        elif kind == "comm":
            df = with_comm(df, variables, block_rows=block_rows)
        elif kind == "user":
            df = USER_BUILDERS[family[1]](df, variables)
    return df


def comm_dictionary(df: DataFrame, variables: dict | None = None) -> DataFrame:
    """CMP6: distinct command addresses of EXEC rows, ids 1..n by address; 0 = unknown."""
    variables = variables or DEFAULT_VARS
    exec_code = _code(variables, "EXEC")
    addrs = with_addr(df.where(F.col("event") == exec_code)).select("addr").distinct()
    ranked = with_position(addrs, ["addr"], "_tt_p")
    return ranked.select((F.col("_tt_p") + 1).cast("bigint").alias("comm_id"),
                         F.col("addr"), comm_from_addr(F.col("addr")).alias("comm"))


def with_comm(df: DataFrame, variables: dict | None = None, dictionary: DataFrame | None = None,
              block_rows: int | None = None) -> DataFrame:
    """CMP7: command id of the latest EXEC of the same pid at or before the row's
    timestamp (equal timestamps included); 0 when none."""
    variables = variables or DEFAULT_VARS
    exec_code = _code(variables, "EXEC")
    if dictionary is None:
        dictionary = comm_dictionary(df, variables)
    addr = F.shiftleft(F.col("arg0").cast("bigint"), 32).bitwiseOR(F.col("arg1").cast("bigint"))
    latest = F.when(F.col("event") == exec_code,
                    F.struct(F.col("timestamp"), F.col("idx"), addr.alias("a")))
    block_rows = block_rows or conf_int(df.sparkSession, "tracetide.block.rows")
    staged = running_max_by_time(df, ["pid"], latest, "_tt_exec", block_rows=block_rows)
    staged = staged.withColumn("_tt_addr", F.col("_tt_exec.a")).drop("_tt_exec")
    ids = dictionary.select(F.col("addr").alias("_tt_addr"), F.col("comm_id").alias("_tt_cid"))
    return (staged.join(ids, on="_tt_addr", how="left")
                  .withColumn("comm", F.coalesce(F.col("_tt_cid"), F.lit(0)).cast("bigint"))
                  .drop("_tt_addr", "_tt_cid"))
