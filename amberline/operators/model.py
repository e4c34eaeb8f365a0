"""Models on Spark ML. Fits read a stored feature table; scoring is one transform."""

from __future__ import annotations

import os
import uuid

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from amberline.config import FEATURE_FAMILIES
from amberline.operators.histogram import rank_metrics, score_histogram
from amberline.session import materialise, spread, work_dir

# fixed values: never features
NOT_FEATURES = ("account_id", "period", "month_idx", "date", "vintage_months", "went_bad", "default_within_12m", "sma2_within_6m",
                "labelable", "months_to_npa", "to_npa", "npa_period", "months_since_moratorium_end")

FIT_ROWS = 250_000  # training rows that one task of a tree fit keeps and reads again for every level of a tree
INPUTS = "inputs"  # the vector of all inputs of several tree models


def feature_columns(df: DataFrame, extra_excluded: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns: everything but ids, time and outcomes."""
    out = set(NOT_FEATURES) | set(extra_excluded)
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if c not in out and kinds[c] not in ("string", "date", "timestamp", "boolean")]
    return numeric, [c for c in df.columns if c not in out and kinds[c] == "string"]


def with_missing_flags(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Doubles plus a 0/1 flag per numeric feature that says it was not observed."""
    return df.withColumns({c: F.col(c).cast("double") for c in numeric} | {
        f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric})


def _input_names(numeric: list[str], categorical: list[str]) -> list[str]:
    return [f"{c}_filled" for c in numeric] + [f"{c}_missing" for c in numeric] + [f"{c}_idx" for c in categorical]


def assembler(numeric: list[str], categorical: list[str], output: str = "features") -> list:
    """Stages: levels to indices (unseen kept apart), medians for gaps, one feature vector."""
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}_filled" for c in numeric])]
    if categorical:
        stages.append(StringIndexer(inputCols=categorical, outputCols=[f"{c}_idx" for c in categorical], handleInvalid="keep"))
    return [*stages, VectorAssembler(inputCols=_input_names(numeric, categorical), outputCol=output)]


def with_inputs(df: DataFrame, train: Column, numeric: list[str], categorical: list[str], keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns of ``df`` and a vector of all inputs, written once for several tree models over parts of them.

    Gaps are filled and levels numbered as in the ``train`` rows. :func:`fit_trees` takes
    its inputs from the vector where there is one, so that a fit neither looks for medians
    and levels again nor fills and numbers every row in each of its passes.
    """
    rows = with_missing_flags(df, list(numeric))
    filled = Pipeline(stages=assembler(list(numeric), list(categorical), INPUTS)).fit(rows.where(train)).transform(rows)
    return materialise(filled.select(*keep, INPUTS), "inputs")


def fit_trees(df: DataFrame, numeric: list[str], categorical: list[str] = (), label: str = "went_bad", iterations: int = 10,
              depth: int = 4, seed: int = 7, least_rows: int = 1) -> PipelineModel:
    """Boosted trees of the named columns, of rows as they are or with the vector of :func:`with_inputs`, which then has to be in scored rows too."""
    prepared = INPUTS in df.columns
    # a tree needs a bin for every level of a column, and one for levels it has not seen
    if prepared:
        rows, names = df.count(), _input_names(list(numeric), list(categorical))
        levels = max((len(a["vals"]) - 1 for a in df.schema[INPUTS].metadata["ml_attr"]["attrs"].get("nominal", ()) if a["name"] in names), default=0)
    else:
        rows, *counts = df.agg(F.count("*"), *[F.count_distinct(c) for c in categorical]).first()
        levels = max(counts, default=0)
    trees = GBTClassifier(labelCol=label, featuresCol="features", maxIter=iterations, maxDepth=depth, seed=seed, maxBins=max(64, levels + 2),
                          minInstancesPerNode=least_rows)
    if prepared:
        return Pipeline(stages=[VectorSlicer(inputCol=INPUTS, outputCol="features", names=names), trees]).fit(spread(df.select(label, INPUTS), rows, most=FIT_ROWS))
    return Pipeline(stages=[*assembler(list(numeric), list(categorical)), trees]).fit(with_missing_flags(spread(df, rows, most=FIT_ROWS), list(numeric)))


def balanced_weights(df: DataFrame, label: str = "went_bad") -> DataFrame:
    """Add ``weight`` so both classes carry the same total."""
    share = df.agg(F.avg(label)).scalar()
    w = F.when(F.col(label) == 1, F.try_divide(F.lit(0.5), F.col("_s"))).otherwise(F.try_divide(F.lit(0.5), 1 - F.col("_s")))
    return df.withColumn("_s", share).withColumn("weight", F.coalesce(w, F.lit(1.0))).drop("_s")


def fit_scorecard(df: DataFrame, numeric: list[str], label: str = "went_bad", regularisation: float = 0.0,
                  balanced: bool = True) -> PipelineModel:
    """Median impute, scale, logistic regression."""
    filled = [f"{c}_filled" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
              VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
              LogisticRegression(labelCol=label, featuresCol="features", maxIter=100, regParam=regularisation,
                                 **({"weightCol": "weight"} if balanced else {}))]
    rows = with_missing_flags(df, list(numeric))
    return Pipeline(stages=stages).fit(balanced_weights(rows, label) if balanced else rows)


def score(model: PipelineModel, df: DataFrame, numeric: list[str], name: str = "pd") -> DataFrame:
    """Probability of going bad from a fitted or saved pipeline, to six decimals."""
    scored = model.transform(df if INPUTS in df.columns else with_missing_flags(df, list(numeric)))
    return scored.withColumn(name, F.round(vector_to_array("probability")[1], 6)).select(*df.columns, name)


def isotonic_map(df: DataFrame, score_column: str = "decision_score", label: str = "went_bad") -> DataFrame | None:
    """Isotonic calibration as a table (boundary, prediction); None for a single class.

    Fitted on the score histogram with counts as weights: a million points at
    most, whatever the number of rows.
    """
    hist = materialise(score_histogram(df, score_column, label), "isotonic").withColumn("rate", F.col("bad") / F.col("n")) \
        .withColumn("weight", F.col("n").cast("double"))
    total = hist.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total.n or total.bad in (0, total.n):
        return None
    fit = IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="weight").fit(hist)
    points = pa.table({"boundary": fit.boundaries.toArray(), "prediction": fit.predictions.toArray()})
    return materialise(df.sparkSession.createDataFrame(points), "isotonic-map")


def scorecard_contributions(model: PipelineModel, df: DataFrame, numeric: list[str]) -> DataFrame:
    """Exact contribution of each feature to the log-odds, one column ``c_<feature>`` each.

    Features are centred by the scaler, so the contributions and the intercept add up to the log-odds.
    """
    scored = model.transform(with_missing_flags(df, list(numeric)))
    coefficients = model.stages[-1].coefficients.toArray()
    x = vector_to_array("features")
    return scored.withColumn("_x", x).withColumns({
        f"c_{c}": F.col("_x")[i] * float(coefficients[i]) for i, c in enumerate(numeric)}).select(*df.columns, *[f"c_{c}" for c in numeric])


def tree_nodes(model: PipelineModel) -> DataFrame:
    """The fitted ensemble as a table: (tree, weight, id, prediction, left, right, feature, threshold, categories).

    Leaves have no feature. ``categories`` are the levels that go left, NULL for a
    threshold. The table has at most ``trees x 2^(depth + 1)`` rows.
    """
    spark = SparkSession.active()
    path = os.path.join(work_dir(spark), f"trees-{uuid.uuid4().hex}")
    model.stages[-1].write().save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.stages[-1].treeWeights)], "tree int, weight double")
    n = F.col("nodeData")
    leaf, numeric = n["leftChild"] < 0, n["split"]["numCategories"] < 0
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        F.when(~leaf, n["split"]["featureIndex"]).alias("feature"), F.when(~leaf & numeric, n["split"]["leftCategoriesOrThreshold"][0]).alias("threshold"),
        F.when(~leaf & ~numeric, n["split"]["leftCategoriesOrThreshold"]).alias("categories"))
    return nodes.join(weights, "tree")


def tree_contributions(model: PipelineModel, df: DataFrame, numeric: list[str], categorical: list[str] = (), groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Exact contribution of each group of features to a tree model's log-odds, ``c_<group>`` each, with ``bias`` and ``log_odds``.

    A step down a path changes the node's mean, and the change belongs to the feature
    that was asked. A leaf's path fixes all its shares, so a tree is one choice among its
    leaves' arrays; the contributions and the bias add up to the log-odds of every row.
    Groups default to single features.
    """
    groups = groups or {c: (c,) for c in [*numeric, *categorical]}
    inputs = [*numeric, *numeric, *categorical]  # as assembled: filled, missing flags, levels
    place = {c: i for i, columns in enumerate(groups.values()) for c in columns}
    trees: dict[int, dict[int, Row]] = {}
    for row in tree_nodes(model).collect():
        trees.setdefault(row["tree"], {})[row["id"]] = row
    x = F.col("_x")

    def choice(nodes: dict[int, Row], at: int, so_far: list[float]) -> Column:
        node = nodes[at]
        if node["feature"] is None:
            return F.array(*map(F.lit, so_far))
        value = x[node["feature"]]
        left = value <= node["threshold"] if node["categories"] is None else value.isin([float(c) for c in node["categories"]])

        def down(child: int) -> Column:
            shares = list(so_far)
            if (own := place.get(inputs[node["feature"]])) is not None:
                shares[own] += 2 * node["weight"] * (nodes[child]["prediction"] - node["prediction"])
            else:
                shares[-1] += 2 * node["weight"] * (nodes[child]["prediction"] - node["prediction"])
            return choice(nodes, child, shares)

        return F.when(left, down(node["left"])).otherwise(down(node["right"]))

    width = len(groups) + 1  # the last place: features in no group
    parts = [choice(nodes, 0, [0.0] * width) for nodes in trees.values()]
    bias = sum(2 * nodes[0]["weight"] * nodes[0]["prediction"] for nodes in trees.values())
    scored = model.transform(with_missing_flags(df, list(numeric))).select(
        *df.columns, vector_to_array("features").alias("_x"), (2 * vector_to_array("rawPrediction")[1]).alias("log_odds"))
    found = scored.withColumn("_parts", F.array(*parts))
    def summed(at: int) -> Column:
        return F.aggregate("_parts", F.lit(0.0), lambda total, part: total + part[at])

    sums = [summed(i) for i in range(width)]
    return found.select(*df.columns, F.lit(bias).alias("bias"), *[s.alias(f"c_{g}") for g, s in zip(groups, sums)], sums[-1].alias("c_other"), "log_odds")


def attribution_share(df: DataFrame, contributions: dict[str, str], buckets: list[tuple[int, int]], merge: tuple[str, ...] = ()) -> DataFrame:
    """Share of mean absolute contribution per family and lead bucket.

    ``contributions`` maps a column to its family. Families in ``merge`` are
    read as one (the alternative reading).
    """
    bucket = F.lit(None).cast("string")
    for lo, hi in reversed(buckets):
        bucket = F.when(F.col("to_npa").between(lo, hi), f"{lo}-{hi}").otherwise(bucket)
    cells = F.array(*[F.struct(F.lit(merge[0] if fam in merge else fam).alias("family"), F.abs(F.col(c)).alias("v")) for c, fam in contributions.items()])
    rows = df.where(F.col("went_bad") == 1).withColumn("bucket", bucket).where(F.col("bucket").isNotNull())
    n = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    sums = rows.select("bucket", F.explode(cells).alias("c")).groupBy("bucket", F.col("c.family").alias("family")).agg(F.sum("c.v").alias("v"))
    total = sums.groupBy("bucket").agg(F.sum("v").alias("total"))
    return sums.join(total, "bucket").join(n, "bucket").select(
        "bucket", "family", "n", F.coalesce(F.try_divide("v", "total"), F.lit(0.0)).alias("share"))


def attribution_coverage(shares: DataFrame) -> DataFrame:
    """Families shown, total per bucket and the worst distance from 100 %."""
    per = shares.groupBy("bucket").agg(F.sum(F.col("share") * 100).alias("total"), F.count_distinct("family").alias("families"))
    return per.agg(F.max("families").alias("families"), F.max(F.abs(100 - F.col("total"))).alias("worst_gap"))


def feature_importance(model: PipelineModel, numeric: list[str], categorical: list[str], k: int = 9, labels: dict[str, str] | None = None) -> DataFrame:
    """The ``k`` most used inputs of a tree model (one number per input column), by their readable names where given."""
    shown = labels or {}
    names = [*(shown.get(c, c) for c in numeric), *[f"{shown.get(c, c)} (missing)" for c in numeric], *(shown.get(c, c) for c in categorical)]
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, (float(v) for v in values)), key=lambda r: (-r[1], r[0]))[:k]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def auc_of(df: DataFrame, score_column: str, label: str = "went_bad") -> DataFrame:
    return rank_metrics(score_histogram(df, score_column, label))


def missing_odds(df: DataFrame, columns: list[str], portfolio: str = "portfolio", label: str = "went_bad") -> DataFrame:
    """Odds ratio of the label for each missing flag, given portfolio (unpenalised logistic regression)."""
    rows = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in columns})
    indexer = StringIndexer(inputCol=portfolio, outputCol="_p", handleInvalid="keep").fit(rows)
    levels = len(indexer.labels)
    dummies = {f"_d{i}": (F.col("_p") == i).cast("double") for i in range(1, levels)}
    flags = [f"{c}_missing" for c in columns]
    wide = VectorAssembler(inputCols=[*flags, *dummies], outputCol="features").transform(indexer.transform(rows).withColumns(dummies))
    fit = LogisticRegression(labelCol=label, featuresCol="features", maxIter=100, regParam=0.0).fit(wide)
    beta = fit.coefficients.toArray()
    return df.sparkSession.createDataFrame([(c, float(beta[i])) for i, c in enumerate(columns)], "column string, log_odds double") \
        .withColumn("odds_ratio", F.exp("log_odds"))


def availability(columns: DataFrame, families: dict[str, tuple[str, ...]] = FEATURE_FAMILIES) -> DataFrame:
    """Family of every scored column; a column without one is an orphan."""
    table = F.create_map(*[F.lit(x) for fam, cols in families.items() for c in cols for x in (c, fam)])
    family = F.element_at(table, F.col("column"))
    return columns.withColumn("family", family).withColumn("orphan", F.col("family").isNull())
