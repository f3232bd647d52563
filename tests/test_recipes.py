"""The named recipes: category counts, outputs and validation."""

import pytest

from tracetide.operators.spec import validate_spec
from tracetide.plans.recipes import RECIPES

# categories per recipe
CATEGORIES = {
    "events_per_cpu": 21, "freq": 23, "freq_balancing": 26, "freq_balancing_fair": 24,
    "pull_back": 21, "events_per_pid": 18, "run_queue": 5, "block_wakeup": 4,
    "idle_balancing": 7, "user_events_per_cpu": 1, "user_jobs_per_pid": 2, "freq_points": 1,
    "freq_rolling_mean": 5, "block_wakeup_rank": 2, "run_queue_rank": 5, "run_queue_freq": 6,
}


@pytest.mark.parametrize("name", sorted(RECIPES))
def test_recipe_shape(name):
    spec = RECIPES[name]()
    validate_spec(spec)
    assert len(spec["c"]) == CATEGORIES[name]
    assert "c" in spec["output"]
    points = {"x", "y"} <= set(spec["output"])
    segments = {"x0", "y0", "x1", "y1"} <= set(spec["output"])
    assert points != segments


def test_band_labels_and_queries():
    spec = RECIPES["freq"]()
    bands = [c for c in spec["c"] if "GHz" in c["label"]]
    assert [c["label"] for c in bands] == ["(0.0, 1.2] GHz", "(1.2, 1.7] GHz", "(1.7, 2.1] GHz",
                                           "(2.1, 2.6] GHz", "(2.6, inf] GHz"]
    assert bands[1]["concatenate"][0][0] == ["query", "event==$TICK & arg1>1200000 & arg1<=1700000"]
