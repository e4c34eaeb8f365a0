"""Account-level bootstrap through replicate weights, a column a draw.

Each account draws a Poisson(1) weight per replicate from a hash of its id, the
large-sample equivalent of drawing accounts with replacement. Rows are first
combined to (account, score), at most one per period, and dealt to narrow score
buckets; a bucket with many rows is split into narrower ones, and only a slot of some
hundred scores that has many rows itself is dealt on by account. The draws are columns,
so no row is repeated by draw. A task takes a bucket's rows in order of score and keeps
running totals per draw; where single scores are asked for, a matrix has a row per score,
at most SCORES. What leaves a bucket is its totals per draw, and ranks are completed by
adding up the buckets below.

The matrices are numpy's, in Arrow batches that Spark deals and sorts; sums of weighted
columns in Spark's own aggregates took three times as long.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from amberline.config import SCORE_DECIMALS
from amberline.functions.hashing import POISSON1_STEPS
from amberline.functions.numeric import wilson_high, wilson_low
from amberline.session import materialise

DRAWS_PER_HASH = 8  # eight 16-bit draws in one md5
BUCKETS = 128  # score buckets: each holds at most SCORES scores
SCORES = 10**SCORE_DECIMALS // BUCKETS + 2
SLOTS = 64  # slots of a bucket, where it can be split
SPLIT_ROWS = 200_000  # rows of a bucket that one task takes
BLOCK = 4_096  # rows weighted at once
LEVELS = "_levels"  # a row's levels in all cuts
KNOWN = 50_000  # accounts whose weights a task remembers


# the weight of every 16-bit draw
POISSON1 = np.searchsorted(POISSON1_STEPS, np.arange(1 << 16), side="right").astype(np.int8)


class Weights(dict):
    """An account's Poisson(1) weights by its id's text."""

    def __init__(self, replicates: int):
        super().__init__()
        self.replicates = replicates
        self.hashes = [f"|{k}".encode() for k in range(-(-replicates // DRAWS_PER_HASH))]

    def __missing__(self, account: str) -> np.ndarray:
        name = str(account).encode()
        hashes = b"".join([hashlib.md5(name + k).digest() for k in self.hashes])
        found = POISSON1[np.frombuffer(hashes, ">u2")[:self.replicates]]
        if len(self) < KNOWN:
            self[account] = found
        return found

    def rows(self, accounts: pa.Array) -> np.ndarray:
        """A row of weights per account; an account that comes again is looked up once."""
        coded = accounts.dictionary_encode(null_encoding="encode")
        return np.stack([self[a] for a in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]


class Bucket:
    """Good and bad weight per score (row) and draw (column)."""

    def __init__(self, replicates: int):
        self.place: dict[float, int] = {}
        self.good, self.bad = np.zeros((8, replicates)), np.zeros((8, replicates))

    def add(self, scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> None:
        """Rows of weighted counts, any number a score."""
        order = np.argsort(scores, kind="stable")
        values, begin = np.unique(scores[order], return_index=True)
        rows = np.array([self.place.setdefault(v, len(self.place)) for v in values.tolist()])
        while len(self.place) > len(self.good):
            self.good, self.bad = (np.concatenate([m, np.zeros_like(m)]) for m in (self.good, self.bad))
        self.good[rows] += np.add.reduceat(good[order], begin, 0)
        self.bad[rows] += np.add.reduceat(bad[order], begin, 0)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scores = np.fromiter(self.place, float, len(self.place))
        order = np.argsort(scores)
        return scores[order], self.good[order], self.bad[order]


class Running:
    """Totals per draw over rows that come in ascending order of score; the last score stays open for rows that tie with it."""

    def __init__(self, replicates: int):
        self.score: float | None = None
        self.good, self.bad, self.below, self.n_bad, self.pairs, self.error = np.zeros((6, replicates))

    def add(self, scores: np.ndarray, good: np.ndarray, bad: np.ndarray) -> None:
        begin = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
        scores, good, bad = scores[begin], np.add.reduceat(good, begin, 0), np.add.reduceat(bad, begin, 0)
        self.error += scores ** 2 @ good + (1 - scores) ** 2 @ bad
        self.n_bad += bad.sum(0)
        if scores[0] == self.score:
            good[0] += self.good
            bad[0] += self.bad
        else:
            self.pairs += self.bad * (self.below + self.good / 2)
            self.below = self.below + self.good
        below = self.below + np.cumsum(good, 0) - good
        self.pairs += (bad[:-1] * (below[:-1] + good[:-1] / 2)).sum(0)
        self.score, self.below, self.good, self.bad = scores[-1], below[-1], good[-1], bad[-1]

    def totals(self) -> list[np.ndarray]:
        """Per draw: good, bad, pairs of a bad over a good row inside the bucket (ties half), squared error."""
        return [self.below + self.good, self.n_bad, self.pairs + self.bad * (self.below + self.good / 2), self.error]


class Levels:
    """A bucket of ``make`` per cut and level, from rows with a level in every cut; a row's weights serve all cuts."""

    def __init__(self, make: Callable[[], Bucket | Running], cuts: int):
        self.cuts, self.found = cuts, defaultdict(make)

    def add(self, scores: np.ndarray, good: np.ndarray, bad: np.ndarray, levels: pa.Array) -> None:
        coded = levels.flatten().dictionary_encode(null_encoding="encode")
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy().reshape(-1, self.cuts)
        for cut in range(self.cuts):
            order = np.argsort(codes[:, cut], kind="stable")
            own = codes[order, cut]
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1), len(own)]
            for begin, end in zip(edges, edges[1:]):
                at = order[begin:end]
                self.found[cut, names[own[begin]]].add(scores[at], good[at], bad[at])


def _keys(df: DataFrame, groups: tuple[str, ...]) -> list[StructField]:
    return [StructField("model", StringType()), *[df.schema[g] for g in groups], StructField("bucket", LongType())]


def _cells(df: DataFrame, scores: tuple[str, ...], outcome: str, account: str, groups: tuple[str, ...], carried: tuple[str, ...] = ()) -> DataFrame:
    """(model, *groups, bucket, account, score, good, bad, *carried, _parts, _part): an account's scores, counted and dealt.

    A bucket of more than SPLIT_ROWS rows is split where its slots' rows add up to as
    many, so that higher numbers still mean higher scores. A slot with more rows than that
    is a bucket of its own, in parts by account.
    """
    long = df.select(F.col(account).cast("string").alias("account"), *groups, *carried, F.col(outcome).alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("model"), F.round(s, SCORE_DECIMALS).alias("score")) for s in scores])).alias("m"))
    cells = long.where(F.col("m.score").isNotNull()).groupBy("account", *groups, *carried, F.col("m.model").alias("model"), F.col("m.score").cast("double").alias("score")).agg(
        F.count("*").alias("n"), F.sum("_y").cast("long").alias("bad"))
    keys = ["model", *groups, "bucket"]
    cells = cells.withColumns({"bucket": F.floor(F.col("score") * BUCKETS), "_slot": F.floor(F.col("score") * (BUCKETS * SLOTS))})
    cells = materialise(cells.select(*keys, "_slot", "account", "score", (F.col("n") - F.col("bad")).alias("good"), "bad", *carried), "bootstrap-cells")
    own = W.partitionBy(*keys)
    below = F.sum("_n").over(own.orderBy("_slot")) - F.col("_n")
    slots = cells.groupBy(*keys, "_slot").agg(F.count("*").alias("_n")).withColumns({
        "_all": F.sum("_n").over(own), "_parts": F.ceil(F.col("_n") / SPLIT_ROWS).cast("int"), "_sub": 2 * F.floor(below / SPLIT_ROWS) + (F.col("_n") > SPLIT_ROWS).cast("int")})
    full = materialise(slots.where(F.col("_all") > SPLIT_ROWS).select(*keys, "_slot", "_sub", "_parts"), "bootstrap-splits")
    same = [cells[k].eqNullSafe(full[k]) for k in (*keys, "_slot")]
    bucket = cells["bucket"] * (1 << 32) + F.coalesce("_sub", F.lit(0))
    dealt = cells.join(full, same, "left").select(*[cells[k] for k in keys[:-1]], bucket.alias("bucket"), "account", "score", "good", "bad", *carried, F.coalesce("_parts", F.lit(1)).alias("_parts"))
    return dealt.withColumn("_part", F.pmod(F.xxhash64("account"), F.col("_parts")).cast("int"))


def _buckets(rows: DataFrame, keys: list[str], replicates: int, make, add, done, schema: StructType) -> DataFrame:
    """``done(key, bucket)`` of every run of equal keys; ``add(bucket, columns)`` puts rows in, in order of score."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "score")
    arrow, width = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, None
        weights = Weights(replicates)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*(c.to_pylist() for c in batch.columns[:width])))
            edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for begin, end in zip(edges, edges[1:]):
                if own[begin] != at:
                    if bucket is not None:
                        yield from written(done(at, bucket))
                    at, bucket = own[begin], make()
                for block in range(begin, end, BLOCK):
                    add(bucket, batch.slice(block, min(BLOCK, end - block)).columns[width:], weights)
        if bucket is not None:
            yield from written(done(at, bucket))

    def written(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)


def _vectors(column: pa.Array, replicates: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, replicates)


def _add_counts(bucket: Bucket | Running | Levels, columns: list[pa.Array], weights: Weights) -> None:
    drawn = weights.rows(columns[0])
    score, good, bad = (c.to_numpy(zero_copy_only=False) for c in columns[1:4])
    bucket.add(score, drawn * good[:, None].astype(np.float64), drawn * bad[:, None].astype(np.float64), *columns[4:])


def _add_vectors(replicates: int):
    def add(bucket: Bucket | Running, columns: list[pa.Array], _: Weights) -> None:
        bucket.add(columns[0].to_numpy(zero_copy_only=False), _vectors(columns[1], replicates), _vectors(columns[2], replicates))
    return add


def _by_score(key: tuple, bucket: Bucket) -> Iterator[tuple]:
    for row in zip(*bucket.sorted()):
        yield *key, *row


def _of_bucket(key: tuple, bucket: Running) -> Iterator[tuple]:
    yield *key, *bucket.totals()


def _of_levels(cuts: tuple[str, ...], done):
    """``done`` of every level; the cut and the level come after the model in its key."""
    def of(key: tuple, levels: Levels) -> Iterator[tuple]:
        for (cut, level), bucket in levels.found.items():
            yield from done((key[0], cuts[cut], level, *key[1:]), bucket)
    return of


def _replicated(df: DataFrame, scores: tuple[str, ...], replicates: int, outcome: str, account: str, groups: tuple[str, ...], make, done, names: tuple[str, ...],
                cuts: tuple[str, ...] = ()) -> DataFrame:
    """``done``'s rows of every bucket of ``make``: its keys and ``names``. A split slot's parts meet as one row a score.

    With ``cuts``, every row has an array of its levels in them, and the rows' groups are (cut, level).
    """
    carried = (LEVELS,) if cuts else ()
    cells = _cells(df, scores, outcome, account, groups, carried)
    keys, counts = ["model", *groups, "bucket"], ["account", "score", "good", "bad", *carried]
    out = _keys(df, groups)
    if cuts:
        out[1:1] = [StructField("cut", StringType()), StructField("level", StringType())]

    def first(make, done):
        return (lambda: Levels(make, len(cuts)), _of_levels(cuts, done)) if cuts else (make, done)

    vectors = lambda names: [StructField(n, DoubleType() if n == "score" else ArrayType(DoubleType())) for n in names]
    schema = StructType([*out, *vectors(names)])
    own = lambda kind: lambda: kind(replicates)
    made, told = first(own(make), done)
    found = _buckets(cells.where("_parts = 1").select(*keys, *counts), keys, replicates, made, _add_counts, told, schema)
    split = cells.where("_parts > 1").select(*keys, "_part", *counts)
    if split.isEmpty():
        return found
    parts = StructType([*out, StructField("_part", IntegerType()), *vectors(("score", "good", "bad"))])
    made, told = first(own(Bucket), _by_score)
    parts = materialise(_buckets(split, [*keys, "_part"], replicates, made, _add_counts, told, parts).drop("_part"), "bootstrap-parts")
    return found.unionByName(_buckets(parts, [f.name for f in out], replicates, own(make), _add_vectors(replicates), done, schema))


def replicate_scores(df: DataFrame, scores: tuple[str, ...], replicates: int, outcome: str = "went_bad",
                     account: str = "account_id", groups: tuple[str, ...] = ()) -> DataFrame:
    """(model, *groups, bucket, score, good, bad): weight per score, arrays of all draws; all models share the weights."""
    return _replicated(df, scores, replicates, outcome, account, groups, Bucket, _by_score, ("score", "good", "bad"))


def replicate_buckets(df: DataFrame, scores: tuple[str, ...], replicates: int, outcome: str = "went_bad",
                      account: str = "account_id", groups: tuple[str, ...] = (), cuts: dict[str, Column] | None = None) -> DataFrame:
    """(replicate, model, *groups, bucket, good, bad, pairs, error) of every draw and bucket.

    ``cuts`` count every row once in each cut, under its level; they take the place of groups: (cut, level).
    """
    names = ("good", "bad", "pairs", "error")
    if cuts:
        df, groups = df.withColumn(LEVELS, F.array(*[c.cast("string") for c in cuts.values()])), ()
    found = _replicated(df, scores, replicates, outcome, account, groups, Running, _of_bucket, names, tuple(cuts or ()))
    groups = ("cut", "level") if cuts else groups
    rows = found.select("model", *groups, "bucket", F.posexplode(F.arrays_zip(*names)).alias("at", "d")).select(
        (F.col("at") + 1).alias("replicate"), "model", *groups, "bucket", *[F.col(f"d.{n}").alias(n) for n in names])
    return materialise(rows, "replicate-buckets")


def replicate_metrics(df: DataFrame, scores: tuple[str, ...], replicates: int, outcome: str = "went_bad",
                      account: str = "account_id", groups: tuple[str, ...] = (), cuts: dict[str, Column] | None = None) -> DataFrame:
    """(replicate, model, groups, n, n_bad, auc, brier) of every draw; NULL AUC for a single class."""
    cells = replicate_buckets(df, scores, replicates, outcome, account, groups, cuts)
    own = ["replicate", "model", *(("cut", "level") if cuts else groups)]
    below = F.sum("good").over(W.partitionBy(*own).orderBy("bucket")) - F.col("good")
    out = cells.withColumn("_below", below).groupBy(*own).agg(
        F.sum("bad").alias("n_bad"), F.sum("good").alias("_good"), F.sum(F.col("pairs") + F.col("bad") * F.col("_below")).alias("_pairs"), F.sum("error").alias("_error"))
    auc = F.when((F.col("n_bad") > 0) & (F.col("_good") > 0), F.col("_pairs") / (F.col("n_bad") * F.col("_good")))
    n = F.col("n_bad") + F.col("_good")
    return out.where(n > 0).select(*own, n.cast("long").alias("n"), F.col("n_bad").cast("long").alias("n_bad"), auc.alias("auc"), (F.col("_error") / n).alias("brier"))


def interval(stats: DataFrame, column: str, level: float = 0.95, groups: tuple[str, ...] = ()) -> DataFrame:
    """Percentile interval of a statistic over replicates (a few hundred rows per group)."""
    tail = (1 - level) / 2
    return stats.where(F.col(column).isNotNull()).groupBy(*groups).agg(
        F.percentile(column, tail).alias("lo"), F.percentile(column, 1 - tail).alias("hi"), F.count("*").alias("replicates"))


def auc_interval(df: DataFrame, score: str, replicates: int, groups: tuple[str, ...] = (), **kw) -> DataFrame:
    return interval(replicate_metrics(df, (score,), replicates, groups=groups, **kw), "auc", groups=groups)


def cut_auc_intervals(df: DataFrame, score: str, replicates: int, cuts: dict[str, Column], **kw) -> DataFrame:
    """(cut, level, lo, hi, replicates) of the AUC among the rows of every level of every cut."""
    return interval(replicate_metrics(df, (score,), replicates, cuts=cuts, **kw), "auc", groups=("cut", "level"))


def paired_delta_intervals(df: DataFrame, base: str, others: tuple[str, ...], replicates: int, **kw) -> DataFrame:
    """Intervals of AUC and Brier of each other score minus the base, on the same draws."""
    stats = materialise(replicate_metrics(df, (base, *others), replicates, **kw), "replicate-metrics").unpivot(
        ["replicate", "model"], ["auc", "brier"], "metric", "value")
    of_base = stats.where(F.col("model") == base).select("replicate", "metric", F.col("value").alias("_base"))
    deltas = stats.where(F.col("model") != base).join(of_base, ["replicate", "metric"]).withColumn("delta", F.col("value") - F.col("_base"))
    return interval(deltas, "delta", groups=("model", "metric"))


def paired_delta_interval(df: DataFrame, base: str, other: str, replicates: int, **kw) -> DataFrame:
    return paired_delta_intervals(df, base, (other,), replicates, **kw).drop("model")


def ratio_interval(df: DataFrame, score: str, split: str, top: str, bottom: str, replicates: int, **kw) -> DataFrame:
    """Interval of AUC on one split divided by AUC on another, same accounts drawn in both."""
    stats = replicate_metrics(df, (score,), replicates, groups=(split,), **kw)

    def auc(level: str) -> Column:
        return F.max(F.when(F.col(split) == level, F.col("auc")))

    return interval(stats.groupBy("replicate").agg(F.try_divide(auc(top), auc(bottom)).alias("ratio")), "ratio")


def spread_over_runs(results: DataFrame, value: str, groups: tuple[str, ...] = (), level: float = 0.95) -> DataFrame:
    """Percentile spread and width of a metric over repeated runs."""
    out = interval(results, value, level, groups).withColumnRenamed("replicates", "runs")
    return out.withColumn("width", F.col("hi") - F.col("lo"))


def replicate_deciles(df: DataFrame, score: str, replicates: int, outcome: str = "went_bad", **kw) -> DataFrame:
    """(replicate, decile, n, bad) of every draw, from weighted decile bounds.

    A bound is a number of rows from the lowest score. Bucket totals say in which
    bucket it lies, and only that bucket's scores are looked at for that draw. Rows with
    equal scores on a bound are shared in proportion, the mean over all their orders.
    """
    hist = materialise(replicate_scores(df, (score,), replicates, outcome, **kw).select("bucket", "score", "good", "bad"), "replicate-scores")
    one = hist.select("bucket", "score", F.posexplode(F.arrays_zip("good", "bad")).alias("at", "d"))
    n, bad = F.col("d.good") + F.col("d.bad"), F.col("d.bad")
    own = W.partitionBy("replicate").orderBy("bucket")
    cells = one.groupBy((F.col("at") + 1).alias("replicate"), "bucket").agg(F.sum(n).alias("n"), F.sum(bad).alias("b"))
    cells = materialise(cells.withColumns({
        "n_below": F.sum("n").over(own) - F.col("n"), "b_below": F.sum("b").over(own) - F.col("b"),
        "n_all": F.sum("n").over(W.partitionBy("replicate")), "b_all": F.sum("b").over(W.partitionBy("replicate"))}), "replicate-buckets")
    inside = (F.col("n_below") <= F.col("place")) & (F.col("place") < F.col("n_below") + F.col("n"))
    bounds = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn("place", F.floor(F.col("k") * F.col("n_all") / 10)).where(inside)
    looked = bounds.select("replicate", "bucket", "k", "place", "n_below", "b_below").join(hist, "bucket")
    good, bad = (F.get(c, F.col("replicate") - 1) for c in ("good", "bad"))
    upto = W.partitionBy("replicate", "k").orderBy("score")
    looked = looked.select("replicate", "k", "place", "n_below", "b_below", "score", (good + bad).alias("n"), bad.alias("b")).withColumns({
        "n_below": F.col("n_below") + F.sum("n").over(upto) - F.col("n"), "b_below": F.col("b_below") + F.sum("b").over(upto) - F.col("b")})
    found = looked.where(inside).select(
        "replicate", "k", F.col("place").cast("double").alias("place"), (F.col("b_below") + F.col("b") * (F.col("place") - F.col("n_below")) / F.col("n")).alias("upto"))
    ends = cells.select("replicate", F.lit(10).alias("k"), F.col("n_all").alias("place"), F.col("b_all").alias("upto")).distinct()
    by = W.partitionBy("replicate").orderBy("k")
    return found.unionByName(ends).select(
        "replicate", (F.col("k") - 1).alias("decile"), (F.col("place") - F.coalesce(F.lag("place").over(by), F.lit(0.0))).alias("n"),
        (F.col("upto") - F.coalesce(F.lag("upto").over(by), F.lit(0.0))).alias("bad")).where("n > 0")


def decile_stability(df: DataFrame, score: str, replicates: int, outcome: str = "went_bad", **kw) -> DataFrame:
    """Two readings of the decile steps that hold, as a share of all, over account resamples.

    (reading, replicates, mean, p05, p95, lowest, highest, share_passing). ``strict``
    counts steps whose rate does not fall; ``interval`` also counts a fall whose Wilson
    intervals overlap. A draw passes where nine steps in ten hold.
    """
    cells = replicate_deciles(df, score, replicates, outcome, **kw)
    by = W.partitionBy("replicate").orderBy("decile")
    cells = cells.withColumns({"rate": F.round(F.col("bad") / F.col("n"), 4), "lo": F.round(wilson_low(F.col("bad"), F.col("n")), 4),
                               "hi": F.round(wilson_high(F.col("bad"), F.col("n")), 4)})
    first, strict = F.lag("rate").over(by), F.col("rate") >= F.lag("rate").over(by)
    steps = cells.withColumns({"strict": strict, "interval": strict | (F.col("hi") >= F.lag("lo").over(by)), "_step": first.isNotNull()}).where("_step")
    per = steps.groupBy("replicate").agg(*[F.avg(F.col(k).cast("double")).alias(k) for k in ("strict", "interval")])
    return per.unpivot(["replicate"], ["strict", "interval"], "reading", "held").groupBy("reading").agg(
        F.count("*").alias("replicates"), F.avg("held").alias("mean"), F.percentile("held", 0.05).alias("p05"), F.percentile("held", 0.95).alias("p95"),
        F.min("held").alias("lowest"), F.max("held").alias("highest"), F.avg((F.col("held") >= 0.9).cast("double")).alias("share_passing"))
