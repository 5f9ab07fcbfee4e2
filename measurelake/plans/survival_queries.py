"""Censored survival and correlation structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ranking, structure, survival as sv
from .frames import SPEC, SURV, rounded, specimens, survival, table

HORIZON = 36
BY = ["fold"]


def _km_sql(of: int, name: str = "km") -> str:
    return f"""{name} AS (SELECT fold, t, n_risk, n_event, CASE WHEN ended = 1 THEN 0.0 ELSE exp(logs) END AS surv,
  coalesce(lag(CASE WHEN ended = 1 THEN 0.0 ELSE exp(logs) END) OVER (PARTITION BY fold ORDER BY t), 1.0) AS surv_before FROM (
  SELECT fold, t, n_risk, n_event, sum(CASE WHEN n_event < n_risk THEN ln(1 - n_event / n_risk) ELSE 0.0 END) OVER w AS logs, max(CAST(n_event = n_risk AS INTEGER)) OVER w AS ended FROM (
    SELECT fold, t, ne AS n_event, CAST(sum(leave) OVER (PARTITION BY fold ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_risk FROM (
      SELECT fold, t, sum(n) AS leave, CAST(sum(CASE WHEN event = {of} THEN n ELSE 0 END) AS BIGINT) AS ne FROM surv GROUP BY 1, 2))
  WINDOW w AS (PARTITION BY fold ORDER BY t ROWS UNBOUNDED PRECEDING)))"""


def km_event(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.kaplan_meier(survival(spark, d), BY), "surv", "surv_before")


def km_censor(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.kaplan_meier(survival(spark, d), BY, of=0), "surv", "surv_before")


def _km_query(of: int) -> str:
    return f"WITH {SURV}, {_km_sql(of)} SELECT fold, t, n_risk, n_event, round(surv, 6) + 0.0 AS surv, round(surv_before, 6) + 0.0 AS surv_before FROM km"


def reverse_km(spark: SparkSession, d: str) -> DataFrame:
    curve = sv.kaplan_meier(survival(spark, d), BY, of=0)
    parts = [sv.curve_quantile(curve, BY, q, n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return parts[0].join(parts[1], BY).join(parts[2], BY)


REVERSE = f"""WITH {SURV}, {_km_sql(0)} SELECT fold, min(CASE WHEN surv <= 0.75 + 1e-12 THEN t END) AS q25, min(CASE WHEN surv <= 0.5 + 1e-12 THEN t END) AS q50,
min(CASE WHEN surv <= 0.25 + 1e-12 THEN t END) AS q75 FROM km GROUP BY 1"""


def breslow_cumhaz(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.breslow(survival(spark, d), BY, F.exp(F.col("score") * 0.1)), "hazard", "cumhaz")


BRESLOW = f"""WITH {SURV}, s AS (SELECT fold, t, sum(n * exp(score * 0.1)) AS r, CAST(sum(CASE WHEN event = 1 THEN n ELSE 0 END) AS BIGINT) AS n_event FROM surv GROUP BY 1, 2),
h AS (SELECT *, n_event / sum(r) OVER (PARTITION BY fold ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS hazard FROM s),
c AS (SELECT *, sum(hazard) OVER (PARTITION BY fold ORDER BY t ROWS UNBOUNDED PRECEDING) AS cumhaz FROM h)
SELECT fold, t, n_event, round(hazard, 6) + 0.0 AS hazard, round(cumhaz, 6) + 0.0 AS cumhaz FROM c WHERE n_event > 0"""


def _c(ipcw: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = sv.concordance(survival(spark, d), BY, ipcw, horizon=HORIZON if ipcw else None)
        return rounded(out, "numerator", "denominator", "c_index", digits=4).withColumn("c_index", F.round("c_index", 4))

    return run


def _c_sql(ipcw: bool) -> str:
    w = "n / (surv_before * surv_before)" if ipcw else "CAST(n AS DOUBLE)"
    bad = "max(CAST(surv_before <= 0.1 AS INTEGER))" if ipcw else "0"
    limit = f"AND t < {HORIZON}" if ipcw else ""
    return f"""WITH {SURV}, {_km_sql(0)}, e AS (SELECT s.fold, s.t, s.score, {w} AS w, surv_before FROM surv s JOIN km USING (fold, t) WHERE event = 1 {limit.replace('t <', 's.t <')}),
l AS (SELECT fold, t, score, sum(n) AS m FROM surv GROUP BY 1, 2, 3),
p AS (SELECT e.fold, sum(w * m * CASE WHEN e.score > l.score THEN 1.0 WHEN e.score = l.score THEN 0.5 ELSE 0.0 END) AS a, sum(w * m) AS b, {bad} AS bad FROM e JOIN l ON e.fold = l.fold AND e.t < l.t GROUP BY 1)
SELECT fold, CASE WHEN bad = 0 THEN round(a, 4) + 0.0 END AS numerator, CASE WHEN bad = 0 THEN round(b, 4) + 0.0 END AS denominator, CASE WHEN bad = 0 THEN round(a / b, 4) + 0.0 END AS c_index FROM p"""


def time_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.time_auc(survival(spark, d), BY, HORIZON), "auc")


TIME_AUC = f"""WITH {SURV}, {_km_sql(0)}, e AS (SELECT s.fold, s.score, sum(n / surv_before) AS w, min(surv_before) AS least FROM surv s JOIN km USING (fold, t) WHERE event = 1 AND t <= {HORIZON} GROUP BY 1, 2),
l AS (SELECT fold, score, sum(n) AS m FROM surv WHERE t > {HORIZON} GROUP BY 1, 2)
SELECT e.fold, CASE WHEN min(least) > 0.1 THEN round(sum(w * m * CASE WHEN e.score > l.score THEN 1.0 WHEN e.score = l.score THEN 0.5 ELSE 0.0 END) / sum(w * m), 6) + 0.0 END AS auc FROM e JOIN l ON e.fold = l.fold GROUP BY 1"""


def ipcw_brier(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sv.ipcw_brier(survival(spark, d), BY, (F.col("score") + 1) / 14.0, HORIZON), "brier")


BRIER = f"""WITH {SURV}, {_km_sql(0)}, g AS (SELECT fold, min(surv) AS gh FROM km WHERE t <= {HORIZON} GROUP BY 1),
x AS (SELECT s.fold, n, CASE WHEN event = 1 AND t <= {HORIZON} THEN n * pow(1 - (score + 1) / 14.0, 2) / surv_before WHEN t > {HORIZON} THEN n * pow((score + 1) / 14.0, 2) / gh ELSE 0.0 END AS v,
least(CASE WHEN event = 1 AND t <= {HORIZON} THEN surv_before ELSE 1.0 END, CASE WHEN t > {HORIZON} THEN gh ELSE 1.0 END) AS used FROM surv s JOIN km USING (fold, t) JOIN g USING (fold))
SELECT fold, CASE WHEN min(used) > 0.1 THEN round(sum(v) / sum(n), 6) + 0.0 END AS brier FROM x GROUP BY 1"""


def integrated_brier(spark: SparkSession, d: str) -> DataFrame:
    """Null-model Brier scores S(1 - S) over the months, integrated by trapezoids."""
    curve = sv.kaplan_meier(survival(spark, d), BY).filter(F.col("t") <= 60)
    curve = curve.withColumn("b", F.col("surv") * (1 - F.col("surv"))).withColumn("t", F.col("t").cast("double"))
    return rounded(ranking.trapezoid(curve, BY, "t", "b", "ibs"), "ibs")


IBS = f"""WITH {SURV}, {_km_sql(1)}, b AS (SELECT fold, t, surv * (1 - surv) AS b FROM km WHERE t <= 60),
s AS (SELECT fold, t, (lead(t) OVER w - t) * (lead(b) OVER w + b) / 2.0 AS a FROM b WINDOW w AS (PARTITION BY fold ORDER BY t))
SELECT fold, round(sum(a) / (max(t) - min(t)), 6) + 0.0 AS ibs FROM s GROUP BY 1"""


def horizon_support(spark: SparkSession, d: str) -> DataFrame:
    return sv.horizon_support(survival(spark, d), BY, [12, 36, 60])


SUPPORT = f"""WITH {SURV} SELECT fold, h AS horizon, CAST(sum(CASE WHEN event = 1 AND t <= h THEN n ELSE 0 END) AS BIGINT) AS n_events, CAST(sum(CASE WHEN t > h THEN n ELSE 0 END) AS BIGINT) AS n_at_risk,
CAST(sum(CASE WHEN event = 0 AND t <= h THEN n ELSE 0 END) AS BIGINT) AS n_censored FROM surv CROSS JOIN (VALUES (12), (36), (60)) v(h) GROUP BY 1, 2"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a long matrix: unit, probe (component) and value."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("unit"), "label", F.posexplode("embedding").alias("probe", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


_LONG = """m AS (SELECT unit, probe, v FROM (SELECT vec_id AS unit, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS probe, unnest(embedding) AS raw FROM embeddings), LATERAL (SELECT round(CAST(raw AS DOUBLE), 6) AS v))"""
_UNIT = f"""{_LONG}, k AS (SELECT unit, probe, rank() OVER (PARTITION BY probe ORDER BY v) + (count(*) OVER (PARTITION BY probe, v) - 1) / 2.0 AS r FROM m),
c AS (SELECT unit, probe, r - avg(r) OVER (PARTITION BY probe) AS r FROM k), u AS (SELECT unit, probe, r / sqrt(sum(r * r) OVER (PARTITION BY probe)) AS r FROM c)"""


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return structure.unit_ranks(_vectors(spark, d), "probe", "unit", "v")


def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.spearman_pairs(_ranks(spark, d)), "rho")


RHO = f"""WITH {_UNIT} SELECT a.probe AS probe_i, b.probe AS probe_j, round(sum(a.r * b.r), 6) + 0.0 AS rho, count(*) AS n FROM u a JOIN u b ON a.unit = b.unit AND a.probe < b.probe GROUP BY 1, 2"""


def _group(probe):
    return F.floor(probe / 4)


def balanced_median_rho(spark: SparkSession, d: str) -> DataFrame:
    return rounded(structure.balanced_median(structure.spearman_pairs(_ranks(spark, d)), _group), "balanced", "weighted")


BALANCED = f"""WITH {_UNIT}, r AS (SELECT a.probe // 4 AS gi, b.probe // 4 AS gj, sum(a.r * b.r) AS rho FROM u a JOIN u b ON a.unit = b.unit AND a.probe < b.probe GROUP BY a.probe, b.probe),
x AS (SELECT * FROM r WHERE gi <> gj), g AS (SELECT median(rho) AS m FROM x GROUP BY gi, gj)
SELECT round((SELECT median(m) FROM g), 6) + 0.0 AS balanced, (SELECT count(*) FROM g) AS n_group_pairs, round((SELECT median(rho) FROM x), 6) + 0.0 AS weighted, (SELECT count(*) FROM x) AS n_probe_pairs"""


def conditioned_rho(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of the first sixty components given a common score of the last four."""
    ranks = _ranks(spark, d)
    score = structure.common_score(ranks.filter("probe >= 60"), lambda p: F.floor(p / 2))
    kept = structure.condition_on(ranks.filter("probe < 60"), score)
    return rounded(structure.spearman_pairs(kept), "rho")


CONDITIONED = f"""WITH {_UNIT}, g AS (SELECT probe // 2 AS g, unit, avg(r) AS m FROM u WHERE probe >= 60 GROUP BY 1, 2), h AS (SELECT g, unit, m / sqrt(sum(m * m) OVER (PARTITION BY g)) AS m FROM g),
w AS (SELECT unit, avg(m) AS v FROM h GROUP BY 1), q AS (SELECT unit, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM w), q2 AS (SELECT unit, r - avg(r) OVER () AS r FROM q),
s AS (SELECT unit, r / sqrt(sum(r * r) OVER ()) AS s FROM q2), e AS (SELECT u.unit, probe, r - s * sum(r * s) OVER (PARTITION BY probe) AS r FROM u JOIN s USING (unit) WHERE probe < 60),
f AS (SELECT unit, probe, r / sqrt(sum(r * r) OVER (PARTITION BY probe)) AS r FROM e)
SELECT a.probe AS probe_i, b.probe AS probe_j, round(sum(a.r * b.r), 6) + 0.0 AS rho, count(*) AS n FROM f a JOIN f b ON a.unit = b.unit AND a.probe < b.probe GROUP BY 1, 2"""


def covariance_decomposition(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda t, p: F.max(F.when((F.col("tissue") == t) & (F.col("probe") == p), F.col("beta")))
    wide = specimens(spark, d).groupBy("cohort", "patient").agg(pick("T", 0).alias("ti"), pick("N", 0).alias("ni"), pick("T", 1).alias("tj"), pick("N", 1).alias("nj")).na.drop()
    return rounded(structure.covariance_parts(wide, ["cohort"], "ti", "ni", "tj", "nj"), "cov_high", "cov_low", "cov_cross", "cov_delta", digits=9)


COVARIANCE = f"""WITH {SPEC}, w AS (SELECT cohort, patient, max(beta) FILTER (tissue = 'T' AND probe = 0) AS ti, max(beta) FILTER (tissue = 'N' AND probe = 0) AS ni, max(beta) FILTER (tissue = 'T' AND probe = 1) AS tj,
max(beta) FILTER (tissue = 'N' AND probe = 1) AS nj FROM spec GROUP BY 1, 2)
SELECT cohort, count(*) AS n, round(covar_samp(ti, tj), 9) + 0.0 AS cov_high, round(covar_samp(ni, nj), 9) + 0.0 AS cov_low, round(covar_samp(ti, nj) + covar_samp(ni, tj), 9) + 0.0 AS cov_cross,
round(covar_samp(ti - ni, tj - nj), 9) + 0.0 AS cov_delta, true AS identity_ok FROM w WHERE ti IS NOT NULL AND ni IS NOT NULL AND tj IS NOT NULL AND nj IS NOT NULL GROUP BY 1"""


def reference_set_position(spark: SparkSession, d: str) -> DataFrame:
    """256 random sets of four of the sixty-four components from hashed draws; where the first four stand among them."""
    from ..functions.scalar import counter_random

    rho = structure.spearman_pairs(_ranks(spark, d))
    sets = spark.range(256).select(F.col("id").cast("int").alias("set_id"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("probe"))
    sets = ranking.top_k(sets.withColumn("h", counter_random(9, "set_id", "probe")), "set_id", [F.col("h"), F.col("probe")], 4).select("set_id", "probe")
    sets = sets.union(spark.range(4).select(F.lit(-1).alias("set_id"), F.col("id").cast("int").alias("probe")))
    a, b = sets.withColumnRenamed("probe", "probe_i"), sets.withColumnRenamed("probe", "probe_j")
    pairs = a.join(b, "set_id").filter("probe_i < probe_j").join(rho, ["probe_i", "probe_j"])
    value = pairs.groupBy("set_id").agg(F.median("rho").alias("m"))
    own = value.filter("set_id = -1").select(F.col("m").alias("candidate"))
    out = value.filter("set_id >= 0").crossJoin(F.broadcast(own)).groupBy().agg(
        F.max("candidate").alias("candidate"), F.count(F.lit(1)).alias("n_sets"), F.count_if(F.round("m", 9) >= F.round("candidate", 9)).alias("n_at_least"), F.median("m").alias("median")
    )
    return rounded(out, "candidate", "median")


REFERENCE = f"""WITH {_UNIT}, r AS (SELECT a.probe AS pi, b.probe AS pj, sum(a.r * b.r) AS rho FROM u a JOIN u b ON a.unit = b.unit AND a.probe < b.probe GROUP BY 1, 2),
d AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY CAST('0x' || substr(md5('9|' || s || '|' || p), 1, 8) AS BIGINT), p) AS k FROM range(256) a(s) CROSS JOIN range(64) b(p)),
z AS (SELECT s, p FROM d WHERE k <= 4 UNION ALL SELECT -1, p FROM range(4) b(p)),
v AS (SELECT a.s, median(rho) AS m FROM z a JOIN z b ON a.s = b.s AND a.p < b.p JOIN r ON r.pi = a.p AND r.pj = b.p GROUP BY 1), cand AS (SELECT m AS candidate FROM v WHERE s = -1)
SELECT round(max(candidate), 6) + 0.0 AS candidate, count(*) AS n_sets, count(*) FILTER (round(m, 9) >= round(candidate, 9)) AS n_at_least, round(median(m), 6) + 0.0 AS median FROM v CROSS JOIN cand WHERE s >= 0"""


QUERIES = {
    "km_event": (km_event, _km_query(1)),
    "km_censor": (km_censor, _km_query(0)),
    "reverse_km": (reverse_km, REVERSE),
    "breslow_cumhaz": (breslow_cumhaz, BRESLOW),
    "harrell_c": (_c(False), _c_sql(False)),
    "uno_c": (_c(True), _c_sql(True)),
    "time_auc": (time_auc, TIME_AUC),
    "ipcw_brier": (ipcw_brier, BRIER),
    "integrated_brier": (integrated_brier, IBS),
    "horizon_support": (horizon_support, SUPPORT),
    "spearman_pairs": (spearman_pairs, RHO),
    "balanced_median_rho": (balanced_median_rho, BALANCED),
    "conditioned_rho": (conditioned_rho, CONDITIONED),
    "covariance_decomposition": (covariance_decomposition, COVARIANCE),
    "reference_set_position": (reference_set_position, REFERENCE),
}
