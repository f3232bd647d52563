"""Rolling sums of doubles that are no short decimals: exact, whatever the window."""

import math
import random

import numpy as np
import pytest

from tracetide.operators.order import _exact_window_sums, rolling

KINDS = {
    "tiny": lambda r: r.uniform(-1, 1) * 1e-12,
    "huge": lambda r: r.uniform(-1, 1) * 1e30,
    "mixed": lambda r: r.uniform(-1, 1) * 10.0 ** r.randint(-30, 30),
    "wide": lambda r: math.ldexp(r.uniform(-1, 1), r.randint(-1070, 900)),
    "cancel": lambda r: r.choice([1e30, -1e30, 1e-12, -1e-12, 1.0, 0.0, -0.0]),
    "ties": lambda r: r.choice([2.0**53, 1.0, -1.0, 2.0**-60, -(2.0**53), 0.5]),
    "subnormal": lambda r: r.randint(-99, 99) * 5e-324,
    "zero": lambda r: 0.0,
}


@pytest.mark.parametrize("kind", sorted(KINDS))
@pytest.mark.parametrize("w", [1, 2, 7, 100])
def test_window_sums_are_correctly_rounded(kind, w):
    rng = random.Random(w)
    x = np.array([KINDS[kind](rng) for _ in range(400)])
    want = [math.fsum(x[i:i + w]) for i in range(len(x) - w + 1)]
    assert _exact_window_sums(x, w).tolist() == want


def test_time_does_not_grow_with_the_window():
    import time
    x = np.random.default_rng(0).standard_normal(200_000) * 10.0 ** np.random.default_rng(1).integers(-12, 12, 200_000)
    took = {}
    for w in (160, 32_000):
        t = time.perf_counter()
        _exact_window_sums(x, w)
        took[w] = time.perf_counter() - t
    assert took[32_000] < 2 * took[160] + 0.2


@pytest.mark.parametrize("op", ["sum", "mean"])
def test_rolling_over_blocks(spark, tiny_blocks, op):
    rng = random.Random(5)
    x = [KINDS["mixed"](rng) for _ in range(400)]
    x[50], x[120], x[200] = None, float("nan"), float("inf")
    df = spark.createDataFrame(list(enumerate(x)), "idx bigint, v double").repartition(3)
    got = [r.o for r in rolling(df, 30, op, "v", "o").orderBy("idx").collect()]
    for i, g in enumerate(got):
        part = x[max(0, i - 29):i + 1]
        if len(part) < 30 or any(v is None or not math.isfinite(v) for v in part):
            assert g is None
        else:
            assert g == math.fsum(part) / (30 if op == "mean" else 1)
