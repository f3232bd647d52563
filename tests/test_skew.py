"""A hot key holding a third of the rows, processed with tiny blocks and
buckets, must give exactly what a straightforward pandas computation gives."""

import numpy as np
import pandas as pd
import pytest

from tracetide.operators import order
from tracetide.operators.computed import with_computed
from tracetide.operators.search import next_same_event_pattern, search
from tracetide.trace import TRACE_SCHEMA


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    n = 3000
    pid = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 40, n))
    cpu = np.where(pid == 0, 0, rng.integers(0, 4, n))
    pdf = pd.DataFrame({
        "idx": np.arange(n), "timestamp": np.arange(n) * 10 + rng.integers(0, 3, n).cumsum(),
        "cpu": cpu, "pid": pid, "event": rng.choice([2, 4, 10, 13], n),
        "arg0": rng.integers(0, 4, n), "arg1": rng.integers(0, 50, n) * 1000,
    })
    df = spark.createDataFrame([tuple(int(v) for v in r) for r in pdf.itertuples(index=False)], TRACE_SCHEMA)
    return pdf, df


def expected_next(pdf, keys, col):
    nxt = pdf.groupby(keys)[col].shift(-1)
    return nxt.fillna(pdf[col]).astype("int64")


def test_next_same_event_on_hot_pid(skewed):
    pdf, df = skewed
    got = with_computed(df, ["nxt_timestamp_of_same_evt_on_same_pid"], block_rows=29).toPandas()
    got = got.set_index("idx").sort_index()["nxt_timestamp_of_same_evt_on_same_pid"]
    assert (got.to_numpy() == expected_next(pdf, ["event", "pid"], "timestamp").to_numpy()).all()


def test_block_wakeup_pairs_on_hot_pid(skewed):
    pdf, df = skewed
    got = with_computed(df, ["nxt_blk_wkp_of_same_pid"], block_rows=17).toPandas().set_index("idx").sort_index()
    sel = pdf["event"].isin([2, 4])
    exp = pdf["timestamp"].copy()
    exp[sel] = expected_next(pdf[sel], ["pid"], "timestamp")
    assert (got["nxt_blk_wkp_of_same_pid"].to_numpy() == exp.to_numpy()).all()


def test_previous_tick_on_hot_cpu(skewed):
    pdf, df = skewed
    got = with_computed(df, ["prv_frq_on_same_cpu"], block_rows=23).toPandas().set_index("idx").sort_index()
    tick = pdf["arg1"].where(pdf["event"] == 10)
    exp = tick.groupby(pdf["cpu"]).ffill()
    a, b = got["prv_frq_on_same_cpu"].to_numpy(dtype=float), exp.to_numpy(dtype=float)
    assert np.array_equal(np.isnan(a), np.isnan(b)) and np.allclose(a[~np.isnan(a)], b[~np.isnan(b)])


def test_search_on_hot_pid(skewed):
    pdf, df = skewed
    res = search(df, next_same_event_pattern("pid"), block_rows=31).toPandas().set_index("a").sort_index()
    nxt = pdf.groupby(["pid", "event"])["idx"].shift(-1).fillna(pdf["idx"]).astype("int64")
    assert (res["b"].to_numpy() == nxt.to_numpy()).all()


def test_rank_with_hot_key_value(skewed):
    pdf, df = skewed
    # a key where one value holds a third of the rows: ties split by idx across buckets
    keyed = df.withColumn("k", (df["pid"] == 0).cast("long") * 0 + df["arg0"] * (df["pid"] != 0).cast("long"))
    got = order.rank(keyed, "k", "r", bucket_rows=97).toPandas().set_index("idx").sort_index()["r"]
    k = np.where(pdf["pid"] == 0, 0, pdf["arg0"])
    exp = pd.Series(np.lexsort((pdf["idx"].to_numpy(), k))).sort_values().index.to_numpy()
    assert (got.to_numpy() == exp).all()
