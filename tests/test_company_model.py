"""Company-year model: industry and age, bins against pandas, splits counted over the saved trees, reasons of examples."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from amberline.operators import company_model, model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 600
    frame = pd.DataFrame({c: rng.normal(size=n) for c in company_model.NUMERIC})
    frame["loss_flag"], frame["neg_networth"] = (rng.random(n) < 0.4).astype(float), 0.0
    frame.loc[rng.random(n) < 0.1, "age"] = np.nan
    frame["went_bad"] = ((frame.loss_flag > 0) & (rng.random(n) < 0.8) | (frame.borrow_to_income > 1.2)).astype(int)
    frame["company"], frame["year"], frame["nic"] = [f"c{i // 3}" for i in range(n)], 1990 + np.arange(n) % 3, np.where(np.arange(n) % 2, "10", "NA")
    found = spark.createDataFrame(frame)
    return found.withColumn("age", F.nanvl("age", F.lit(None).cast("double")))


@pytest.fixture(scope="module")
def fitted(rows):
    trees = model.fit_trees(rows, list(company_model.NUMERIC), list(company_model.CATEGORICAL), iterations=3)
    return trees, model.score(trees, rows, list(company_model.NUMERIC), "p").cache()


def test_industry_and_age(spark):
    years = spark.createDataFrame([("a", 2000), ("b", 2000), ("c", 2000), ("d", 2000)], "company string, year int")
    ids = spark.createDataFrame([("a", "10", 1990), ("b", None, 1995), ("c", "20", None), ("a", "11", 1992)], "company string, nic string, incorporated int")
    found = {r.company: (r.nic, r.age) for r in company_model.with_profile(years, ids).collect()}
    assert found["a"][1] == 10.0 and found["b"] == ("NA", 5.0) and found["c"] == ("20", None) and found["d"] == ("NA", None)
    assert company_model.with_profile(years, ids).count() == 4


def test_bins_are_those_of_equal_count(fitted):
    scored = fitted[1].select("p", "went_bad").toPandas()
    cut = pd.qcut(scored.p, 10, duplicates="drop")
    expected = scored.groupby(cut, observed=True).agg(n=("p", "size"), predicted=("p", "mean"), observed=("went_bad", "mean")).reset_index(drop=True)
    found = company_model.reliability(fitted[1]).orderBy("bin").toPandas()
    assert found.n.tolist() == expected.n.tolist()
    assert np.allclose(found[["predicted", "observed"]], expected[["predicted", "observed"]])


def test_importances_count_splits(fitted):
    asked = [r.feature for r in model.tree_nodes(fitted[0]).where("feature IS NOT NULL").collect()]
    names = [*company_model.NUMERIC, *company_model.NUMERIC, *company_model.CATEGORICAL]
    counts = pd.Series([company_model.LABELS[names[i]] for i in asked]).value_counts()
    found = {r.feature: r.importance for r in company_model.split_importance(fitted[0], k=100).collect()}
    assert found == counts.to_dict()
    assert company_model.split_importance(fitted[0], k=2).count() == 2


def test_examples_are_the_extremes(fitted):
    found = company_model.examples(*fitted).orderBy("example").collect()
    assert [r.example for r in found] == [f"company-{i:03d}" for i in range(1, 8)]
    assert [r.outcome for r in found] == ["defaulted within 2 years"] * 5 + ["no default"] * 2
    scored = fitted[1].select("p", "went_bad").toPandas()
    assert [r.pd for r in found[:5]] == scored[scored.went_bad == 1].p.sort_values(ascending=False).head(5).round(3).tolist()
    assert [r.pd for r in found[5:]] == scored[scored.went_bad == 0].p.sort_values().head(2).round(3).tolist()
    assert all("loss in the year" in r.reasons or "debt above" in r.reasons for r in found[:5])
    assert {r.industry for r in found} <= {"Other", "Food products"}


def test_no_rows(spark, rows):
    one = company_model.profile(rows.limit(0)).first()
    assert (one.n_companies, one.n_company_years, one.n_defaults, one.default_rate, one.first_year) == (0, 0, 0, 0.0, None)
    assert company_model.reliability(rows.limit(0).withColumn("p", F.lit(0.5))).count() == 0
