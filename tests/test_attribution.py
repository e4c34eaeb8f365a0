"""Attribution shares against plain sums, and draws against weighted sums account by account."""

import numpy as np
import pytest

from amberline.operators import attribution
from amberline.operators.bootstrap import Weights

ROWS = [("a", 1, 1, 0.5, -0.25, 0.25), ("a", 2, 1, -0.5, 0.25, 1.0), ("b", 1, 1, 0.1, 0.1, -0.6), ("b", 4, 1, 1.0, 0.0, 0.0),
        ("c", 3, 0, 9.0, 9.0, 9.0), ("c", 9, 1, 9.0, 9.0, 9.0), (None, 2, 1, 0.2, 0.2, 0.2)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "account_id string, to_npa int, went_bad int, c_x double, c_y double, c_z double").repartition(3)


def test_shares_of_absolute_and_net_contributions(rows):
    found = {(r.bucket, r.family): r for r in attribution.attribution_intervals(rows, {"f": ("c_x", "c_y"), "g": ("c_z",)}, [(1, 2), (3, 4)], 50).collect()}
    own = np.array([r[3:] for r in ROWS if r[1] in (1, 2) and r[2] == 1])
    f, g = np.abs(own[:, :2]).sum(), np.abs(own[:, 2]).sum()
    assert found["1-2", "f"].n == 4 and found["1-2", "f"].share == pytest.approx(f / (f + g))
    nets = own[:, :2].sum(), own[:, 2].sum()
    assert found["1-2", "f"].signed_share == pytest.approx(nets[0] / (abs(nets[0]) + abs(nets[1])))
    assert found["3-4", "f"].share == 1.0 and found["3-4", "g"].share == 0.0 and found["3-4", "g"].n == 1
    assert len(found) == 4 and all(r.lo <= r.hi for r in found.values())


def test_draws_are_weighted_sums(spark):
    frame = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 4.0), ("l", "b", 8.0), ("l", "c", None)], "key string, account_id string, v double").repartition(4)
    weights = Weights(20)
    found = {(r.key, r.replicate): r.v for r in attribution.replicate_sums(frame, ("key",), ("v",), 20).collect()}
    assert found == {(k, i): v for i in range(20) for k, v in (("k", 3.0 * weights["a"][i] + 4.0 * weights["b"][i]), ("l", 8.0 * weights["b"][i]))}


def test_no_rows(rows):
    assert attribution.attribution_intervals(rows.limit(0), {"f": ("c_x",)}, [(1, 2)], 10).count() == 0
