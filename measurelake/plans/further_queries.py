"""Further inference, structure and model queries: dispatch, shared draws, policies, calibration, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import comparison, fitting, grouped, inference, ranking, relational, resampling, structure, survival as sv
from .frames import DELTA, SPEC, SURV, deltas, rounded, specimens, survival, table
from .model_queries import GENES, _features, _vectors, _wide

CONTRASTS = (("T", "N"), ("T", "H"), ("N", "H"), ("H", "A"))


def contrast_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Method of each planned contrast: paired, clustered or unpaired, by the patients that both arms share."""
    rows = specimens(spark, d).filter("beta is not null").select("cohort", "patient", "tissue", "probe").distinct()
    per = rows.groupBy("cohort", "probe", "patient").agg(F.collect_set("tissue").alias("arms"))
    plan = F.explode(F.array(*[F.struct(F.lit(h).alias("high"), F.lit(low).alias("low")) for h, low in CONTRASTS])).alias("c")
    each = per.select("cohort", "probe", "arms", plan).select("cohort", "probe", "c.high", "c.low", F.array_contains("arms", F.col("c.high")).alias("a"), F.array_contains("arms", F.col("c.low")).alias("b"))
    s = each.groupBy("cohort", "probe", "high", "low").agg(F.count_if("a").alias("n_high"), F.count_if("b").alias("n_low"), F.count_if(F.col("a") & F.col("b")).alias("n_shared"))
    paired = (F.col("high") == "T") & (F.col("low") == "N") & (F.col("n_shared") >= 3)
    return s.withColumn("method", F.when(paired, "paired_t").when(F.col("n_shared") > 0, "cluster_ols").otherwise("welch"))


DISPATCH = f"""WITH {SPEC}, p AS (SELECT cohort, probe, patient, list(DISTINCT tissue) AS arms FROM spec WHERE beta IS NOT NULL GROUP BY 1, 2, 3),
c(high, low) AS (VALUES ('T', 'N'), ('T', 'H'), ('N', 'H'), ('H', 'A')), s AS (SELECT cohort, probe, high, low, count(*) FILTER (list_contains(arms, high)) AS n_high, count(*) FILTER (list_contains(arms, low)) AS n_low,
count(*) FILTER (list_contains(arms, high) AND list_contains(arms, low)) AS n_shared FROM p CROSS JOIN c GROUP BY 1, 2, 3, 4)
SELECT *, CASE WHEN high = 'T' AND low = 'N' AND n_shared >= 3 THEN 'paired_t' WHEN n_shared > 0 THEN 'cluster_ols' ELSE 'welch' END AS method FROM s"""


def vector_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Whole patients drawn once for all probes: intervals that keep the dependence between probes."""
    values = deltas(spark, d).select("cohort", "patient", "probe", "delta")
    # A patient's probes travel with the patient.
    patients = values.groupBy("cohort", "patient").agg(F.collect_list(F.struct("probe", "delta")).alias("own"))
    weights = resampling.bootstrap_weights(patients, ["cohort"], "patient", 100, 13)
    drawn = weights.select("cohort", "draw", "weight", F.inline("own")).groupBy("cohort", "probe", "draw").agg(
        (F.sum(F.col("weight") * F.col("delta")) / F.sum("weight")).alias("m"), F.sum("weight").alias("n")
    )
    valid = F.when(F.col("n") >= 3, F.col("m"))
    enough = F.count(valid) >= 95
    out = drawn.groupBy("cohort", "probe").agg(F.count(valid).alias("n_valid"), F.when(enough, F.percentile(valid, F.lit(0.025))).alias("low"), F.when(enough, F.percentile(valid, F.lit(0.975))).alias("high"))
    return rounded(out, "low", "high")


VECTOR = f"""WITH {SPEC}, {DELTA}, u AS (SELECT cohort, patient, row_number() OVER (PARTITION BY cohort ORDER BY patient) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM (SELECT DISTINCT cohort, patient FROM delta)),
k AS (SELECT cohort, dr AS draw, CAST('0x' || substr(md5('13|' || dr || '|' || cohort || '|' || i), 1, 8) AS BIGINT) % n AS j FROM u CROSS JOIN range(100) r(dr)),
w AS (SELECT k.cohort, draw, patient FROM k JOIN u ON u.cohort = k.cohort AND u.i = k.j),
m AS (SELECT w.cohort, probe, draw, avg(delta) AS m, count(*) AS n FROM w JOIN delta USING (cohort, patient) GROUP BY 1, 2, 3), v AS (SELECT *, CASE WHEN n >= 3 THEN m END AS x FROM m)
SELECT cohort, probe, count(x) AS n_valid, CASE WHEN count(x) >= 95 THEN round(quantile_cont(x, 0.025), 6) + 0.0 END AS low, CASE WHEN count(x) >= 95 THEN round(quantile_cont(x, 0.975), 6) + 0.0 END AS high FROM v GROUP BY 1, 2"""


def auc_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """AUC of tumour against normal values over resampled patients; draws carry weights, ranks are never redone per row."""
    rows = specimens(spark, d).filter("tissue in ('T', 'N') and beta is not null").select("cohort", "patient", "tissue", F.round("beta", 9).alias("beta"))
    weights = resampling.bootstrap_weights(rows.select("cohort", "patient").distinct(), ["cohort"], "patient", 50, 19)
    levels = weights.join(rows, ["cohort", "patient"]).groupBy("cohort", "draw", "beta").agg(
        F.sum(F.when(F.col("tissue") == "T", F.col("weight")).otherwise(0)).alias("p"), F.sum(F.when(F.col("tissue") == "N", F.col("weight")).otherwise(0)).alias("n")
    )
    below = Window.partitionBy("cohort", "draw").orderBy("beta").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2.0)
    auc = levels.withColumn("u", won).groupBy("cohort", "draw").agg(F.try_divide(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc"))
    return rounded(auc, "auc")


AUC_BOOT = f"""WITH {SPEC}, s AS (SELECT cohort, patient, tissue, round(beta, 9) AS b FROM spec WHERE tissue IN ('T', 'N') AND beta IS NOT NULL),
u AS (SELECT cohort, patient, row_number() OVER (PARTITION BY cohort ORDER BY patient) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM (SELECT DISTINCT cohort, patient FROM s)),
k AS (SELECT cohort, dr AS draw, CAST('0x' || substr(md5('19|' || dr || '|' || cohort || '|' || i), 1, 8) AS BIGINT) % n AS j FROM u CROSS JOIN range(50) r(dr)),
w AS (SELECT k.cohort, draw, u.patient FROM k JOIN u ON u.cohort = k.cohort AND u.i = k.j),
r AS (SELECT w.cohort, draw, tissue, rank() OVER (PARTITION BY w.cohort, draw ORDER BY b) + (count(*) OVER (PARTITION BY w.cohort, draw, b) - 1) / 2.0 AS r FROM w JOIN s USING (cohort, patient))
SELECT cohort, CAST(draw AS INTEGER) AS draw, round((sum(r) FILTER (tissue = 'T') - count(*) FILTER (tissue = 'T') * (count(*) FILTER (tissue = 'T') + 1) / 2.0) / (count(*) FILTER (tissue = 'T') * count(*) FILTER (tissue = 'N')), 6) + 0.0 AS auc FROM r GROUP BY 1, 2"""


def draw_aligned_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Paired differences of two probes' bootstrap means, draw by draw."""
    values = deltas(spark, d).filter("probe in (0, 1)").select("probe", "patient", "delta")
    patients = values.groupBy("patient").agg(F.collect_list(F.struct("probe", "delta")).alias("own")).withColumn("g", F.lit(0))
    weights = resampling.bootstrap_weights(patients, ["g"], "patient", 100, 37)
    means = weights.select("draw", "weight", F.inline("own")).groupBy("draw", "probe").agg((F.sum(F.col("weight") * F.col("delta")) / F.sum("weight")).alias("m"))
    a, b = means.filter("probe = 0").select("draw", F.col("m").alias("a")), means.filter("probe = 1").select("draw", F.col("m").alias("b"))
    return rounded(a.join(b, "draw").select("draw", (F.col("a") - F.col("b")).alias("difference")), "difference")


ALIGNED = f"""WITH {SPEC}, {DELTA}, s AS (SELECT * FROM delta WHERE probe IN (0, 1)), u AS (SELECT patient, row_number() OVER (ORDER BY patient) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT patient FROM s)),
k AS (SELECT dr AS draw, CAST('0x' || substr(md5('37|' || dr || '|0|' || i), 1, 8) AS BIGINT) % n AS j FROM u CROSS JOIN range(100) r(dr)),
m AS (SELECT draw, probe, avg(delta) AS m FROM k JOIN u ON u.i = k.j JOIN s USING (patient) GROUP BY 1, 2)
SELECT CAST(a.draw AS INTEGER) AS draw, round(a.m - b.m, 6) + 0.0 AS difference FROM m a JOIN m b ON a.draw = b.draw AND a.probe = 0 AND b.probe = 1"""


def mean_policies(spark: SparkSession, d: str) -> DataFrame:
    """Means where a missing value makes the mean missing, beside means that skip it, and a weighted mean."""
    x = specimens(spark, d).withColumn("v", F.when(F.col("n_replicates") >= 2, F.col("beta")))
    out = x.groupBy("cohort", "patient", "tissue").agg(
        relational.gated_mean(F.col("v"), "all").alias("all_or_null"), relational.gated_mean(F.col("v"), "skip").alias("skipped"), F.try_divide(F.sum(F.col("beta") * F.col("n_replicates")), F.sum("n_replicates")).alias("weighted")
    )
    return rounded(out, "all_or_null", "skipped", "weighted", digits=10)


POLICIES = f"""WITH {SPEC}, x AS (SELECT *, CASE WHEN n_replicates >= 2 THEN beta END AS v FROM spec)
SELECT cohort, patient, tissue, CASE WHEN count(v) = count(*) THEN round(avg(v), 10) + 0.0 END AS all_or_null, round(avg(v), 10) + 0.0 AS skipped,
round(sum(beta * n_replicates) / nullif(sum(n_replicates), 0), 10) + 0.0 AS weighted FROM x GROUP BY 1, 2, 3"""


def quintile_flags(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative count within the customer and whether the order is in the top fifth of its priority."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    cut = orders.groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.lit(0.8)).alias("cut"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return orders.join(F.broadcast(cut), "o_orderpriority").select("o_orderkey", nth.alias("nth"), (F.col("o_totalprice") >= F.col("cut")).alias("top"))


QUINTILE = """WITH c AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.8) AS cut FROM orders GROUP BY 1)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS nth, o_totalprice >= cut AS top FROM orders JOIN c USING (o_orderpriority)"""


def label_normalisers(spark: SparkSession, d: str) -> DataFrame:
    """Free text to categories, dates to durations, counts with a level for what is missing."""
    text = F.lower(F.trim("p_name"))
    size = F.when(text.rlike(r"\b(small|mini)\b"), "small").when(text.rlike(r"\b(large|big|jumbo)\b"), "large")
    colour = F.when(text.contains("red"), "warm").when(text.contains("blue") | text.contains("green"), "cold")
    parts = table(spark, d, "part").select(F.coalesce(size, F.lit("missing")).alias("size_class"), F.coalesce(colour, F.lit("missing")).alias("colour_class"))
    return parts.groupBy("size_class", "colour_class").agg(F.count(F.lit(1)).alias("n"))


NORMALISERS = r"""SELECT CASE WHEN regexp_matches(lower(p_name), '\b(small|mini)\b') THEN 'small' WHEN regexp_matches(lower(p_name), '\b(large|big|jumbo)\b') THEN 'large' ELSE 'missing' END AS size_class,
CASE WHEN contains(lower(p_name), 'red') THEN 'warm' WHEN contains(lower(p_name), 'blue') OR contains(lower(p_name), 'green') THEN 'cold' ELSE 'missing' END AS colour_class, count(*) AS n FROM part GROUP BY 1, 2"""


def coordination_policies(spark: SparkSession, d: str) -> DataFrame:
    """Between-probe correlation of differences over complete cases and over all pairs that exist."""
    values = deltas(spark, d).select("cohort", "patient", "probe", "delta")
    own = Window.partitionBy("cohort", "patient")
    marked = values.withColumn("k", F.count(F.lit(1)).over(own))
    out = None
    for policy, rows in (("complete", marked.filter("k = 6")), ("pairwise", marked)):
        a = rows.select("cohort", "patient", F.col("probe").alias("i"), F.col("delta").alias("x"))
        b = rows.select("cohort", "patient", F.col("probe").alias("j"), F.col("delta").alias("y"))
        pairs = a.join(b, ["cohort", "patient"]).filter("i < j")
        ranked = pairs.withColumn("rx", ranking.midrank(F.col("x"), ["cohort", "i", "j"])).withColumn("ry", ranking.midrank(F.col("y"), ["cohort", "i", "j"]))
        rho = ranked.groupBy("cohort", "i", "j").agg(F.corr("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n")).withColumn("policy", F.lit(policy))
        out = rho if out is None else out.unionByName(rho)
    return rounded(out, "rho")


COORDINATION = f"""WITH {SPEC}, {DELTA}, m AS (SELECT cohort, patient, probe, delta, count(*) OVER (PARTITION BY cohort, patient) AS k FROM delta),
q AS (SELECT 'pairwise' AS policy, * FROM m UNION ALL SELECT 'complete', * FROM m WHERE k = 6),
p AS (SELECT a.policy, a.cohort, a.probe AS i, b.probe AS j, a.delta AS x, b.delta AS y FROM q a JOIN q b ON a.policy = b.policy AND a.cohort = b.cohort AND a.patient = b.patient AND a.probe < b.probe),
r AS (SELECT policy, cohort, i, j, rank() OVER (PARTITION BY policy, cohort, i, j ORDER BY x) + (count(*) OVER (PARTITION BY policy, cohort, i, j, x) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY policy, cohort, i, j ORDER BY y) + (count(*) OVER (PARTITION BY policy, cohort, i, j, y) - 1) / 2.0 AS ry FROM p)
SELECT policy, cohort, i, j, round(corr(rx, ry), 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY 1, 2, 3, 4"""


def leave_own_group_score(spark: SparkSession, d: str) -> DataFrame:
    """For each group of components, the common score of all the others: the total less the group's own sum."""
    long = table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), F.posexplode("embedding").alias("probe", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))
    ranks = structure.unit_ranks(long, "probe", "unit", "v").withColumn("g", F.floor(F.col("probe") / 4))
    own = ranks.groupBy("unit", "g").agg(F.sum("r").alias("own"))
    rest = own.withColumn("rest", F.sum("own").over(Window.partitionBy("unit")) - F.col("own"))
    return rounded(rest.select("unit", "g", "rest"), "rest")


LEAVE_OWN = """WITH m AS (SELECT unit, probe, round(CAST(raw AS DOUBLE), 6) AS v FROM (SELECT vec_id AS unit, unnest(range(0, len(embedding))) AS probe, unnest(embedding) AS raw FROM embeddings)),
k AS (SELECT unit, probe, rank() OVER (PARTITION BY probe ORDER BY v) + (count(*) OVER (PARTITION BY probe, v) - 1) / 2.0 AS r FROM m), c AS (SELECT unit, probe, r - avg(r) OVER (PARTITION BY probe) AS r FROM k),
u AS (SELECT unit, probe, r / sqrt(sum(r * r) OVER (PARTITION BY probe)) AS r FROM c), o AS (SELECT unit, probe // 4 AS g, sum(r) AS own FROM u GROUP BY 1, 2)
SELECT unit, g, round(sum(own) OVER (PARTITION BY unit) - own, 6) + 0.0 AS rest FROM o"""


def cutoff_stability(spark: SparkSession, d: str) -> DataFrame:
    """Cut-offs of the normal values with each patient left out: smallest and largest, by probe."""
    normal = specimens(spark, d).filter("tissue = 'N' and beta is not null").select("cohort", "patient", "probe", "beta")
    out = inference.cutoff_leave_one_out(normal, ["cohort", "probe"], "beta")
    return rounded(out, "q95_low", "q95_high", "mean25_low", "mean25_high", digits=10)


STABILITY = f"""WITH {SPEC}, s AS (SELECT * FROM spec WHERE tissue = 'N' AND beta IS NOT NULL), j AS (SELECT a.cohort, a.probe, a.patient AS o, b.beta, row_number() OVER (PARTITION BY a.cohort, a.probe, a.patient ORDER BY b.beta) AS r, count(*) OVER (PARTITION BY a.cohort, a.probe, a.patient) AS n
FROM s a JOIN s b ON a.cohort = b.cohort AND a.probe = b.probe AND a.patient <> b.patient), c AS (SELECT cohort, probe, o, max(CASE WHEN r = ceil((n - 1) * 0.95 - 1e-9) + 1 THEN beta END) AS q95, 2.5 * avg(beta) AS m FROM j GROUP BY 1, 2, 3)
SELECT cohort, probe, count(*) AS n_left_out, round(min(q95), 10) + 0.0 AS q95_low, round(max(q95), 10) + 0.0 AS q95_high, round(min(m), 10) + 0.0 AS mean25_low, round(max(m), 10) + 0.0 AS mean25_high FROM c GROUP BY 1, 2"""


def survival_strata(spark: SparkSession, d: str) -> DataFrame:
    """Curves of low and high scores split at each fold's own 95 % order statistic."""
    rows = survival(spark, d)
    # The order statistic over counts: the first score whose running count reaches the place.
    up = Window.partitionBy("fold").orderBy("score")
    levels = rows.groupBy("fold", "score").agg(F.sum("n").alias("n"))
    placed = levels.withColumn("c", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("fold")))
    cut = placed.filter(F.col("c") >= F.ceil((F.col("all") - 1) * F.lit(0.95) - 1e-9) + 1).groupBy("fold").agg(F.min("score").alias("cut"))
    marked = rows.join(F.broadcast(cut), "fold").withColumn("high", F.col("score") >= F.col("cut"))
    curve = sv.kaplan_meier(marked, ["fold", "high"])
    return rounded(curve.filter("t in (12, 36, 60)").select("fold", "high", "t", "n_risk", "surv"), "surv")


STRATA = f"""WITH {SURV}, l AS (SELECT fold, score, sum(n) AS n FROM surv GROUP BY 1, 2), p AS (SELECT *, sum(n) OVER (PARTITION BY fold ORDER BY score) AS c, sum(n) OVER (PARTITION BY fold) AS a FROM l),
k AS (SELECT fold, min(score) AS cut FROM p WHERE c >= ceil((a - 1) * 0.95 - 1e-9) + 1 GROUP BY 1), m AS (SELECT s.fold, score >= cut AS high, t, event, n FROM surv s JOIN k USING (fold)),
e AS (SELECT fold, high, t, sum(n) AS leave, sum(CASE WHEN event = 1 THEN n ELSE 0 END) AS ne FROM m GROUP BY 1, 2, 3), r AS (SELECT *, sum(leave) OVER (PARTITION BY fold, high ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n_risk FROM e),
q AS (SELECT fold, high, t, CAST(n_risk AS BIGINT) AS n_risk, CASE WHEN max(CAST(ne = n_risk AS INTEGER)) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN ne < n_risk THEN ln(1 - ne / n_risk) ELSE 0.0 END) OVER w) END AS surv FROM r WINDOW w AS (PARTITION BY fold, high ORDER BY t ROWS UNBOUNDED PRECEDING))
SELECT fold, high, t, n_risk, round(surv, 6) + 0.0 AS surv FROM q WHERE t IN (12, 36, 60)"""


def promoter_against_full(spark: SparkSession, d: str) -> DataFrame:
    """Two exposures against one outcome on the same complete cases."""
    wide = _wide(spark, d).dropna()
    one = grouped.rank_correlation(wide, ["cohort"], "f0", "f2", ["f3"]).withColumn("exposure", F.lit("f0"))
    two = grouped.rank_correlation(wide, ["cohort"], "f1", "f2", ["f3"]).withColumn("exposure", F.lit("f1"))
    return one.unionByName(two)


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Of a score of two components, over all units at once."""
    rows = _features(spark, d, 2).withColumn("score", F.col("g0") * 2 - F.col("g1"))
    return fitting.calibration(rows.withColumn("g", F.lit(0)), ["g"], "y", "score")


def elastic_net_and_svm(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold AUC of four kinds of model on the same folds."""
    rows = _vectors(spark, d).withColumn("x", F.slice("x", 1, len(GENES)))
    folds = resampling.kfolds(rows.select("vec_id"), "vec_id", 4, 1, 41)
    return comparison.compare(rows.join(folds, "vec_id"), 4, len(GENES)).withColumn("repeat", F.lit(0)).select("repeat", "held", "model", "n", "auc")


QUERIES = {
    "contrast_dispatch": (contrast_dispatch, DISPATCH),
    "vector_bootstrap": (vector_bootstrap, VECTOR),
    "auc_bootstrap": (auc_bootstrap, AUC_BOOT),
    "draw_aligned_deltas": (draw_aligned_deltas, ALIGNED),
    "mean_policies": (mean_policies, POLICIES),
    "quintile_flags": (quintile_flags, QUINTILE),
    "label_normalisers": (label_normalisers, NORMALISERS),
    "coordination_policies": (coordination_policies, COORDINATION),
    "leave_own_group_score": (leave_own_group_score, LEAVE_OWN),
    "cutoff_stability": (cutoff_stability, STABILITY),
    "survival_strata": (survival_strata, STRATA),
    "promoter_against_full": (promoter_against_full, None),
    "calibration": (calibration, None),
    "elastic_net_and_svm": (elastic_net_and_svm, None),
}
