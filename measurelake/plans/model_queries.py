"""Queries whose leaf is an iterative or linear-algebra fit; SQL where a closed form exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import fitting, grouped, inference, relational, resampling
from .frames import deltas, rounded, specimens, survival, table


def meta_reml_hk(spark: SparkSession, d: str) -> DataFrame:
    effects = inference.paired_effects(deltas(spark, d), ["cohort", "probe"])
    return grouped.reml(effects, ["probe"], "mean", "se")


def _wide(spark: SparkSession, d: str, features: int = 4) -> DataFrame:
    pick = [F.max(F.when(F.col("probe") == i, F.col("delta"))).alias(f"f{i}") for i in range(features)]
    return deltas(spark, d).groupBy("cohort", "patient").agg(*pick)


def cluster_ols(spark: SparkSession, d: str) -> DataFrame:
    rows = specimens(spark, d).filter("tissue in ('T', 'H')").withColumn("x", (F.col("tissue") == "T").cast("int"))
    return grouped.regression(rows, ["probe"], "beta", "x", cluster="patient")


def ols_hc3(spark: SparkSession, d: str) -> DataFrame:
    rows = specimens(spark, d).filter("tissue in ('T', 'H')").withColumn("x", (F.col("tissue") == "T").cast("int"))
    rows = rows.withColumn("age", (F.col("patient") % 50).cast("double")).withColumn("reps", F.col("n_replicates").cast("double"))
    return grouped.regression(rows, ["cohort", "probe"], "beta", "x", ["age", "reps"], z_score=True)


def partial_spearman(spark: SparkSession, d: str) -> DataFrame:
    return grouped.rank_correlation(_wide(spark, d), ["cohort"], "f0", "f1", ["f2", "f3"])


def bca_ci(spark: SparkSession, d: str) -> DataFrame:
    return grouped.paired_summary(deltas(spark, d), ["cohort", "probe"], "patient", "delta", draws=500)


def pc1_axis(spark: SparkSession, d: str) -> DataFrame:
    return grouped.principal_axis(_wide(spark, d), ["cohort"], "patient", [f"f{i}" for i in range(4)])


def block_permutation(spark: SparkSession, d: str) -> DataFrame:
    return grouped.block_permutation(_wide(spark, d), ["cohort"], "patient", {"a": ["f0", "f1"], "b": ["f2", "f3"]}, draws=99)


def _features(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    x = [F.get("embedding", i).cast("double").alias(f"g{i}") for i in range(n)]
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), *x)


GENES = [f"g{i}" for i in range(10)]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, y and x: all components."""
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("y"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.filter("y IS NOT NULL AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL OR isnan(v))")


WIDTH = 64
RIDGE = (fitting.Family("ridge"),)


def nested_cv_ridge(spark: SparkSession, d: str) -> DataFrame:
    """AUC of each of 20 repeats of 5-fold cross-validation, penalties tuned on 4 inner folds, all components."""
    rows = _vectors(spark, d)
    return inference.auc(fitting.nested_cv(rows, "vec_id", WIDTH, families=RIDGE).oof(rows, "vec_id"), ["repeat"], "y", "score")


def nested_cv_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric block of every family and repeat."""
    rows = _vectors(spark, d)
    return fitting.metric_block(fitting.nested_cv(rows, "vec_id", WIDTH).oof(rows, "vec_id"), ["family", "repeat"])


def panel_subset_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Every subset of a panel of ten components; subsets are few by definition, units are not."""
    subsets = relational.all_subsets(spark, GENES)
    place = {g: i for i, g in enumerate(GENES)}
    wanted = [(r["id"], tuple(place[m] for m in r["members"].split(";"))) for r in subsets.select("id", "members").collect()]
    panel = _vectors(spark, d).withColumn("x", F.slice("x", 1, len(GENES)))
    return F.broadcast(subsets).join(fitting.subset_sweep(panel, "vec_id", wanted, len(GENES)), "id")


def optimism_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    drawn = fitting.optimism(_vectors(spark, d), "vec_id", WIDTH, draws=100)
    return drawn.agg(F.count(F.lit(1)).alias("n_draws"), F.avg(F.col("apparent") - F.col("original")).alias("optimism"))


def random_forest(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold random-forest scores by Spark ML."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = _features(spark, d)
    folds = resampling.kfolds(rows.select("vec_id"), "vec_id", 3, 1, 31).select("vec_id", "fold")
    data = VectorAssembler(inputCols=GENES, outputCol="x").transform(rows.join(folds, "vec_id")).select("vec_id", "y", "x", "fold").cache()
    model = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=20, maxDepth=4, seed=1)
    out = None
    for f in range(3):
        fitted = model.fit(data.filter(F.col("fold") != f))
        part = fitted.transform(data.filter(F.col("fold") == f)).select("fold", "y", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return inference.auc(out, ["fold"], "y", "score")


COEFFICIENTS = {"g0": 0.7, "g1": -0.4, "g2": 0.25}


def folded_score(spark: SparkSession, d: str) -> DataFrame:
    """Standardised coefficients folded to raw space: one dot product per row, no scaling pass over it."""
    rows = _features(spark, d, 3)
    stats = rows.agg(*[f(c).alias(f"{c}_{n}") for c in COEFFICIENTS for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    raw = {c: b / stats[f"{c}_s"] for c, b in COEFFICIENTS.items()}
    intercept = 0.1 - sum(b * stats[f"{c}_m"] for c, b in raw.items())
    score = F.lit(intercept)
    for c, b in raw.items():
        score = score + F.col(c) * b
    return rounded(rows.select("vec_id", score.alias("score")), "score")


FOLDED = """WITH r AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
SELECT vec_id, round(0.1 + 0.7 * (a - avg(a) OVER ()) / stddev_pop(a) OVER () - 0.4 * (b - avg(b) OVER ()) / stddev_pop(b) OVER () + 0.25 * (c - avg(c) OVER ()) / stddev_pop(c) OVER (), 6) + 0.0 AS score FROM r"""


def cox_univariable(spark: SparkSession, d: str) -> DataFrame:
    return grouped.cox_model(survival(spark, d), ["fold"], ["score"])


QUERIES = {
    "meta_reml_hk": (meta_reml_hk, None),
    "cluster_ols": (cluster_ols, None),
    "ols_hc3": (ols_hc3, None),
    "partial_spearman": (partial_spearman, None),
    "bca_ci": (bca_ci, None),
    "pc1_axis": (pc1_axis, None),
    "block_permutation": (block_permutation, None),
    "nested_cv_ridge": (nested_cv_ridge, None),
    "nested_cv_metrics": (nested_cv_metrics, None),
    "panel_subset_sweep": (panel_subset_sweep, None),
    "optimism_bootstrap": (optimism_bootstrap, None),
    "random_forest": (random_forest, None),
    "folded_score": (folded_score, FOLDED),
    "cox_univariable": (cox_univariable, None),
}
