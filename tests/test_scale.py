"""Work that must not grow faster than the rows: counted, not timed."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from amberline.operators import aggregates, bootstrap, company, graph, model
from amberline.plans import models
from amberline.plans.registry import Tables
from amberline.sources import company as company_files


@pytest.fixture
def written(monkeypatch):
    """Rows of every table the bootstrap writes, by name."""
    found, write = {}, bootstrap.materialise

    def spied(df, name):
        out = write(df, name)
        found[name] = out.count()
        return out

    monkeypatch.setattr(bootstrap, "materialise", spied)
    return found


def rows_of(spark):
    rng = random.Random(5)
    rows = [(i % 60, "ab"[i % 2], "xyz"[i % 3] if i % 7 else None, rng.random(), int(rng.random() < 0.3)) for i in range(400)]
    return spark.createDataFrame(rows, "account_id long, part string, kind string, p double, went_bad int")


def test_rows_are_counted_once_for_all_cuts(spark, written):
    """F1: an account's score is one row whatever the number of cuts, with the intervals of cuts counted one by one."""
    df = rows_of(spark)
    cuts = {"part": F.col("part"), "kind": F.col("kind"), "whole": F.lit(1)}
    got = {(r.cut, r.level): r for r in bootstrap.cut_auc_intervals(df, "p", 20, cuts).collect()}
    assert written["bootstrap-cells"] == df.count()
    long = aggregates.stack_levels(df, cuts, "account_id", "p", "went_bad")
    want = {(r.cut, r.level): r for r in bootstrap.auc_interval(long, "p", 20, groups=("cut", "level")).collect()}
    assert got.keys() == want.keys() and len(got) == 7
    for key, r in want.items():
        assert (got[key].lo, got[key].hi, got[key].replicates) == (pytest.approx(r.lo), pytest.approx(r.hi), r.replicates)


@pytest.mark.parametrize("hot", [False, True])
def test_full_buckets_are_split_by_score(spark, written, monkeypatch, hot):
    """F2-F5, F15-F18: a bucket with many rows is not written out a row a score; only a score that has as many itself is."""
    df = rows_of(spark).withColumn("p", F.when(F.col("account_id") < (25 if hot else 0), 0.001).otherwise(F.col("p") / 100))
    cuts = {"part": F.col("part"), "kind": F.col("kind")}
    plain = {(r.replicate, r.cut, r.level): r for r in bootstrap.replicate_metrics(df, ("p",), 20, cuts=cuts).collect()}
    assert "bootstrap-parts" not in written
    monkeypatch.setattr(bootstrap, "SPLIT_ROWS", 20)
    got = {(r.replicate, r.cut, r.level): r for r in bootstrap.replicate_metrics(df, ("p",), 20, cuts=cuts).collect()}
    assert written["bootstrap-splits"] > 1 and got.keys() == plain.keys()
    assert written.get("bootstrap-parts", 0) <= (12 * 6 if hot else 0)
    for key, r in plain.items():
        assert (got[key].n, got[key].n_bad, got[key].auc, got[key].brier) == (r.n, r.n_bad, pytest.approx(r.auc), pytest.approx(r.brier))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_tree_fit_reads_bounded_partitions(spark, monkeypatch):
    """F6-F14: what a task keeps for a fit goes by FIT_ROWS, not by the table's size over the cores."""
    parts, flagged = [], model.with_missing_flags
    monkeypatch.setattr(model, "with_missing_flags", lambda df, numeric: (parts.append(df.rdd.getNumPartitions()), flagged(df, numeric))[1])
    df = rows_of(spark).withColumn("x", F.col("p") * 2).coalesce(1)
    model.fit_trees(df, ["x"], ["part"], iterations=1)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(model, "FIT_ROWS", 400 // (cores + 3))
    model.fit_trees(df, ["x"], ["part"], iterations=1)
    assert parts[0] == 1 and parts[1] > cores + 2


def test_models_over_parts_of_the_inputs_fill_them_once(spark, monkeypatch):
    """F2-F5: each fit looked for medians and levels again and filled every row in each of its passes; the models are the same."""
    made, stages = [], model.assembler
    monkeypatch.setattr(model, "assembler", lambda *args: (made.append(args), stages(*args))[1])
    rng = random.Random(11)
    rows = [(i, "train" if i % 3 else "test", int(rng.random() < 0.2 + 0.6 * (i % 7 == 1)), rng.choice([None, float(i % 7)]), i % 5 if i % 11 else None, rng.choice(["x", "y", None, f"z{i % 90}"]))
            for i in range(900)]
    df = spark.createDataFrame(rows, "account_id long, side string, went_bad int, a double, b long, k string")
    train, test = (df.where(F.col("side") == side) for side in ("train", "test"))
    inputs = model.with_inputs(df, F.col("side") == "train", ["a", "b"], ["k"], ("account_id", "side", "went_bad"))
    own_train, own_test = (inputs.where(F.col("side") == side) for side in ("train", "test"))
    assert len(made) == 1
    for numeric, levels in ((["a", "b"], ["k"]), (["b"], ["k"]), (["a", "b"], [])):
        plain, own = model.fit_trees(train, numeric, levels, iterations=3), model.fit_trees(own_train, numeric, levels, iterations=3)
        assert plain.stages[-1].getMaxBins() == own.stages[-1].getMaxBins()
        was = {r["account_id"]: r["p"] for r in model.score(plain, test, numeric, "p").collect()}
        assert was == {r["account_id"]: r["p"] for r in model.score(own, own_test, numeric, "p").collect()} and len(was) == 300
    assert len(made) == 4


@pytest.mark.parametrize("query", ["_ablation", "_variants"])
def test_queries_of_several_trees_fill_their_inputs_once(spark, monkeypatch, query):
    """F2-F5: ten and three fits, one look for medians and levels."""
    made, fits, stages, fit = [], [], model.assembler, model.fit_trees
    monkeypatch.setattr(model, "assembler", lambda *args: (made.append(args), stages(*args))[1])
    monkeypatch.setattr(model, "fit_trees", lambda *args, **kw: (fits.append(args), fit(*args, **kw | {"iterations": 1}))[1])
    monkeypatch.setattr(models, "_compared", lambda scored, names: (scored.columns, names))
    columns, names = getattr(models, query)(Tables(spark, "/root/testdata/sf0.001"))
    assert len(made) == 1 and len(fits) == len(names) == sum(c.startswith("p_") for c in columns)


def test_links_are_deduplicated_before_they_are_turned_round(spark):
    """one shuffle of single links, not of both directions."""
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("a", "c"), (None, "a")], "src string, dst string")
    got = graph.symmetric_edges(edges)
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("a", "c"), ("b", "a"), ("c", "a")]
    assert plan(got).index("Generate") < plan(got).index("Aggregate")


def test_cells_of_wide_files_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """one shuffle by company and year, in as many tasks as the cells need."""
    for name, lines in {"head": ["", "", "", "", ",Mar 2001,Mar 2001", "Company Name,PAT,PBT"], "body": [f"C{i},{i},-" for i in range(40)]}.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / name))
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(company_files, "CELLS", 120 // (cores + 1))
    got = company_files.read_wide_financials(spark, [str(tmp_path)])
    years = company.company_years(got)
    assert years.count() == 40 and years.where("pat is not null and pbt is null").count() == 40
    assert any(f"RepartitionByExpression [company, year], {n}" in re.sub(r"#\d+", "", plan(years)) for n in range(cores + 1, 121))
