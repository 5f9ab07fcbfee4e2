"""Ranks, multiple testing, contrasts, meta-analysis and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar
from ..operators import concordance, inference, ranking, relational, resampling
from .frames import DELTA, PROBES, SPEC, deltas, rounded, specimens, table

T_TAIL = """CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (atan(abs(t) / sqrt(df)) + sin(atan(abs(t) / sqrt(df))) * coalesce(list_sum(list_transform(range(1, (df - 1) // 2 + 1),
lambda k: pow(cos(atan(abs(t) / sqrt(df))), 2 * k - 1) * exp(lgamma(k) - lgamma(k + 0.5)) * sqrt(pi()) / 2)), 0))
ELSE 1 - sin(atan(abs(t) / sqrt(df))) * list_sum(list_transform(range(0, df // 2),
lambda k: pow(cos(atan(abs(t) / sqrt(df))), 2 * k) * exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()))) END"""


def _paired(by: str) -> str:
    return f"""pe AS (SELECT {by}, count(*) AS n, avg(delta * 100.0) AS mean, stddev_samp(delta * 100.0) AS sd, median(delta * 100.0) AS median,
count(*) FILTER (delta > 0) AS n_pos, count(*) FILTER (delta < 0) AS n_neg FROM delta GROUP BY {by}),
pt AS (SELECT *, sd / sqrt(n) AS se, mean / (sd / sqrt(n)) AS t, n - 1 AS df FROM pe), pp AS (SELECT *, {T_TAIL} AS p FROM pt)"""


def _effects(spark: SparkSession, d: str, by: list[str]) -> DataFrame:
    return inference.paired_effects(deltas(spark, d), by)


def paired_contrast_planned(spark: SparkSession, d: str) -> DataFrame:
    """Planned rows, paired t and BH over the planned family (1 for what has no estimate)."""
    planned = spark.range(PROBES).select(F.col("id").cast("int").alias("probe"))
    rows = relational.planned_rows(planned, _effects(spark, d, ["probe"]), ["probe"])
    out = ranking.bh_adjust(rows.withColumn("family", F.lit("T-N")), "p_for_bh", "family", "q", denominator=PROBES)
    return rounded(
        out.select("probe", "status", F.coalesce("n", F.lit(0)).alias("n"), "mean", "sd", "median", "se", "t", "p", "p_for_bh", "q", "n_pos", "n_neg"),
        "mean", "sd", "median", "se", "t", "p", "p_for_bh", "q",
    )


PLANNED = f"""WITH {SPEC}, {DELTA}, {_paired('probe')}, pl AS (SELECT CAST(p AS INTEGER) AS probe FROM range({PROBES}) r(p)),
j AS (SELECT pl.probe, pp.* EXCLUDE (probe), coalesce(p, 1.0) AS p_for_bh FROM pl LEFT JOIN pp USING (probe)),
r AS (SELECT *, row_number() OVER (ORDER BY p_for_bh) AS rk FROM j),
b AS (SELECT *, least(1.0, min(p_for_bh * {PROBES} / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT probe, CASE WHEN n IS NULL THEN 'missing' ELSE 'estimated' END AS status, coalesce(n, 0) AS n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd,
round(median, 6) + 0.0 AS median, round(se, 6) + 0.0 AS se, round(t, 6) + 0.0 AS t, round(p, 6) + 0.0 AS p, round(p_for_bh, 6) + 0.0 AS p_for_bh, round(q, 6) + 0.0 AS q, n_pos, n_neg FROM b"""


def _families(spark: SparkSession, d: str) -> DataFrame:
    return _effects(spark, d, ["cohort", "probe"]).select("cohort", "probe", F.when((F.col("cohort") + F.col("probe")) % 4 != 0, F.col("p")).alias("p"))


FAMILIES = f"""WITH {SPEC}, {DELTA}, {_paired('cohort, probe')}, fam AS (SELECT cohort, probe, CASE WHEN (cohort + probe) % 4 <> 0 THEN p END AS p FROM pp)"""


def _bh(denominator, nulls, out_digits=6):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(ranking.bh_adjust(_families(spark, d), "p", "cohort", "q", denominator, nulls), "p", "q")

    return run


def _bh_sql(p: str, m: str) -> str:
    return f"""{FAMILIES}, c AS (SELECT *, {p} AS x FROM fam), r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY x NULLS LAST) AS rk, {m} AS m FROM c),
b AS (SELECT *, CASE WHEN x IS NOT NULL THEN least(1.0, min(x * m / rk) OVER (PARTITION BY cohort ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM r)
SELECT cohort, probe, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM b"""


def bh_eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = _effects(spark, d, ["cohort", "probe"]).select("cohort", "probe", "p", "n")
    return rounded(ranking.bh_adjust(rows, "p", "cohort", "q", "all", "keep", F.col("probe") != 3), "p", "q").drop("n")


BH_ELIGIBLE = f"""WITH {SPEC}, {DELTA}, {_paired('cohort, probe')}, c AS (SELECT cohort, probe, p, CASE WHEN probe <> 3 THEN p ELSE 1.0 END AS x FROM pp),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY x) AS rk, count(*) OVER (PARTITION BY cohort) AS m FROM c),
b AS (SELECT *, least(1.0, min(x * m / rk) OVER (PARTITION BY cohort ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT cohort, probe, round(p, 6) + 0.0 AS p, CASE WHEN probe <> 3 THEN round(q, 6) + 0.0 END AS q FROM b"""


def holm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranking.holm_adjust(_families(spark, d), "p", "cohort"), "p", "p_holm")


HOLM = f"""{FAMILIES}, r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY p NULLS LAST) AS rk, count(p) OVER (PARTITION BY cohort) AS m FROM fam)
SELECT cohort, probe, round(p, 6) + 0.0 AS p, CASE WHEN p IS NOT NULL THEN round(max(least(1.0, p * (m - rk + 1))) OVER (PARTITION BY cohort ORDER BY rk ROWS UNBOUNDED PRECEDING), 6) + 0.0 END AS p_holm FROM r"""


def midrank(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return lines.select("l_orderkey", "l_linenumber", ranking.midrank(F.col("l_quantity"), "l_suppkey").alias("rank"))


MIDRANK = """SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rank FROM lineitem"""


def jackknife_loo(spark: SparkSession, d: str) -> DataFrame:
    out = deltas(spark, d).select("cohort", "patient", "probe", ranking.leave_one_out_mean(F.col("delta"), ["cohort", "probe"]).alias("loo"))
    return rounded(out, "loo", digits=10)


LOO = f"""WITH {SPEC}, {DELTA} SELECT cohort, patient, probe, round(CASE WHEN count(*) OVER w > 1 THEN (sum(delta) OVER w - delta) / (count(*) OVER w - 1) END, 10) + 0.0 AS loo
FROM delta WINDOW w AS (PARTITION BY cohort, probe)"""


def quantile_linear(spark: SparkSession, d: str) -> DataFrame:
    shares = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    return rounded(ranking.quantile_linear(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", shares), *shares)


QLINEAR = """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 6) + 0.0 AS q05, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS q50,
round(quantile_cont(l_extendedprice, 0.95), 6) + 0.0 AS q95 FROM lineitem GROUP BY 1, 2"""


def quantile_higher(spark: SparkSession, d: str) -> DataFrame:
    return ranking.quantile_higher(table(spark, d, "lineitem"), "l_extendedprice", ["l_suppkey"], 0.95, "q95")


QHIGHER = """SELECT l_suppkey, l_extendedprice AS q95 FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem
WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice)) WHERE r = CAST(ceil((n - 1) * 0.95 - 1e-9) AS BIGINT) + 1"""


def genomic_window_features(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("v"))
    out = ranking.window_features(parts, "p_brand", "p_partkey", "v", 5, apart=40)
    return rounded(out.select("p_brand", "p_partkey", "window_mean", "span", "max_gap", "clusters", F.col("median_gap").cast("double").alias("median_gap")), "window_mean", "median_gap")


WINDOWS = """WITH g AS (SELECT p_brand, p_partkey, p_size, p_partkey - lag(p_partkey) OVER w AS gap, row_number() OVER w AS i FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
f AS (SELECT *, avg(p_size) OVER r AS window_mean, p_partkey - first_value(p_partkey) OVER r AS span, max(gap) OVER q AS max_gap, median(gap) OVER q AS median_gap, 1 + count(*) FILTER (gap > 40) OVER q AS clusters FROM g
WINDOW r AS (PARTITION BY p_brand ORDER BY p_partkey ROWS 4 PRECEDING), q AS (PARTITION BY p_brand ORDER BY p_partkey ROWS 3 PRECEDING))
SELECT p_brand, p_partkey, round(window_mean, 6) + 0.0 AS window_mean, span, max_gap, clusters, round(median_gap, 6) + 0.0 AS median_gap FROM f WHERE i >= 5"""


def topk_controls(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice", "p_brand")
    centre = parts.groupBy("p_type").agg(F.avg("p_size").alias("a"), F.stddev_pop("p_size").alias("sa"), F.avg("p_retailprice").alias("b"), F.stddev_pop("p_retailprice").alias("sb"))
    z = lambda x, m, s: (F.col(x) - F.col(m)) / F.col(s)
    scored = parts.join(F.broadcast(centre), "p_type").withColumn("distance", F.round(F.sqrt((z("p_size", "a", "sa") ** 2 + z("p_retailprice", "b", "sb") ** 2) / 2), 9))
    out = ranking.top_k(scored, "p_type", [F.col("distance"), F.col("p_brand"), F.col("p_partkey")], 20)
    return rounded(out.select("p_type", "rank", "p_partkey", "distance"), "distance")


TOPK = """WITH c AS (SELECT p_type, avg(p_size) AS a, stddev_pop(p_size) AS sa, avg(p_retailprice) AS b, stddev_pop(p_retailprice) AS sb FROM part GROUP BY 1),
s AS (SELECT p.p_type, p_partkey, p_brand, round(sqrt((pow((p_size - a) / sa, 2) + pow((p_retailprice - b) / sb, 2)) / 2), 9) AS distance FROM part p JOIN c USING (p_type))
SELECT p_type, CAST(rank AS INTEGER) AS rank, p_partkey, round(distance, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY distance, p_brand, p_partkey) AS rank FROM s) WHERE rank <= 20"""


def welch_contrast(spark: SparkSession, d: str) -> DataFrame:
    out = inference.welch(specimens(spark, d), ["cohort", "probe"], "tissue", "beta", "H", "A")
    return rounded(out, "diff", "se", "t", "df")


WELCH = f"""WITH {SPEC}, s AS (SELECT cohort, probe, count(beta) FILTER (tissue = 'H') AS n_high, count(beta) FILTER (tissue = 'A') AS n_low,
avg(beta) FILTER (tissue = 'H') AS m1, avg(beta) FILTER (tissue = 'A') AS m0, var_samp(beta) FILTER (tissue = 'H') AS v1, var_samp(beta) FILTER (tissue = 'A') AS v0
FROM spec WHERE tissue IN ('H', 'A') GROUP BY 1, 2), e AS (SELECT *, v1 / n_high AS a, v0 / n_low AS b FROM s)
SELECT cohort, probe, n_high, n_low, round(m1 - m0, 6) + 0.0 AS diff, round(sqrt(a + b), 6) + 0.0 AS se, round((m1 - m0) / sqrt(a + b), 6) + 0.0 AS t,
round((a + b) * (a + b) / (a * a / (n_high - 1) + b * b / (n_low - 1)), 6) + 0.0 AS df FROM e"""


def mannwhitney_u(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.mann_whitney(specimens(spark, d), ["probe"], "tissue", "beta", "T", "H"), "rank_biserial", "z")


_RANKED = "rank() OVER (PARTITION BY probe ORDER BY beta) + (count(*) OVER (PARTITION BY probe, beta) - 1) / 2.0"
MWU = f"""WITH {SPEC}, r AS (SELECT *, {_RANKED} AS r FROM spec WHERE tissue IN ('T', 'H') AND beta IS NOT NULL),
t AS (SELECT probe, sum(c * c * c - c) AS ties FROM (SELECT probe, beta, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT probe, count(*) FILTER (tissue = 'T') AS n_high, count(*) FILTER (tissue = 'H') AS n_low, sum(r) FILTER (tissue = 'T') AS w, count(*) AS n FROM r GROUP BY 1),
u AS (SELECT *, w - n_high * (n_high + 1) / 2.0 AS u FROM s JOIN t USING (probe))
SELECT probe, n_high, n_low, u, round(2 * u / (n_high * n_low) - 1, 6) + 0.0 AS rank_biserial,
round((u - n_high * n_low / 2.0) / sqrt(n_high * n_low / 12.0 * ((n + 1) - ties / (1.0 * n * (n - 1)))), 6) + 0.0 AS z FROM u"""


def kruskal_h(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.kruskal(specimens(spark, d), ["probe"], "tissue", "beta"), "h", "epsilon2")


KRUSKAL = f"""WITH {SPEC}, r AS (SELECT *, {_RANKED} AS r FROM spec WHERE beta IS NOT NULL),
t AS (SELECT probe, sum(c * c * c - c) AS ties FROM (SELECT probe, beta, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT probe, tissue, sum(r) AS s, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT probe, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, sum(s * s / n) AS q FROM a GROUP BY 1),
x AS (SELECT *, (12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - ties / (1.0 * n * n * n - n)) AS h FROM h JOIN t USING (probe))
SELECT probe, n, k, round(h, 6) + 0.0 AS h, round((h - k + 1) / (n - k), 6) + 0.0 AS epsilon2 FROM x"""


def wilcoxon_w(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.wilcoxon(deltas(spark, d), ["probe"]), "z")


WILCOXON = f"""WITH {SPEC}, {DELTA}, r AS (SELECT probe, delta, abs(delta) AS a, rank() OVER (PARTITION BY probe ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY probe, abs(delta)) - 1) / 2.0 AS r FROM delta WHERE delta <> 0),
t AS (SELECT probe, sum(c * c * c - c) AS ties FROM (SELECT probe, a, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT probe, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0.0 END) AS w_pos, sum(CASE WHEN delta < 0 THEN r ELSE 0.0 END) AS w_neg FROM r GROUP BY 1)
SELECT probe, n, CAST(w_pos AS DOUBLE) AS w_pos, CAST(w_neg AS DOUBLE) AS w_neg, round((least(w_pos, w_neg) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0), 6) + 0.0 AS z FROM s JOIN t USING (probe)"""


def meta_fixed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.fixed_effect_meta(_effects(spark, d, ["cohort", "probe"]), ["probe"]), "fixed_effect", "fixed_se", "q", "i2")


META = f"""WITH {SPEC}, {DELTA}, {_paired('cohort, probe')}, s AS (SELECT probe, count(*) AS k, sum(1 / (se * se)) AS w, sum(mean / (se * se)) AS wx, sum(mean * mean / (se * se)) AS wxx FROM pp WHERE se > 0 AND n >= 3 GROUP BY 1),
q AS (SELECT *, greatest(wxx - wx * wx / w, 0.0) AS q FROM s)
SELECT probe, k, CASE WHEN k >= 3 THEN round(wx / w, 6) + 0.0 END AS fixed_effect, CASE WHEN k >= 3 THEN round(1 / sqrt(w), 6) + 0.0 END AS fixed_se, CASE WHEN k >= 3 THEN round(q, 6) + 0.0 END AS q,
CASE WHEN k >= 3 THEN round(CASE WHEN q > 0 THEN greatest(0.0, (q - (k - 1)) / q * 100) ELSE 0.0 END, 6) + 0.0 END AS i2 FROM q"""


def cutoff_rules(spark: SparkSession, d: str) -> DataFrame:
    normal = specimens(spark, d).filter("tissue = 'N'")
    return rounded(inference.cutoff_rules(normal, ["probe"], "beta"), "q95", "q975", "mean25", "mean3", "mean4sd")


CUTOFFS = f"""WITH {SPEC}, o AS (SELECT probe, beta, row_number() OVER (PARTITION BY probe ORDER BY beta) AS r, count(*) OVER (PARTITION BY probe) AS n FROM spec WHERE tissue = 'N' AND beta IS NOT NULL)
SELECT probe, count(*) AS n, round(max(CASE WHEN r = ceil((n - 1) * 0.95 - 1e-9) + 1 THEN beta END), 6) + 0.0 AS q95, round(max(CASE WHEN r = ceil((n - 1) * 0.975 - 1e-9) + 1 THEN beta END), 6) + 0.0 AS q975,
round(2.5 * avg(beta), 6) + 0.0 AS mean25, round(3 * avg(beta), 6) + 0.0 AS mean3, round(avg(beta) + 4 * stddev_samp(beta), 6) + 0.0 AS mean4sd FROM o GROUP BY 1"""


def youden(spark: SparkSession, d: str) -> DataFrame:
    rows = specimens(spark, d).filter("tissue in ('T', 'N')").withColumn("y", (F.col("tissue") == "T").cast("int"))
    return rounded(inference.youden(rows.withColumn("beta", F.round("beta", 9)), ["probe"], "y", "beta"), "cut", "j")


YOUDEN = f"""WITH {SPEC}, l AS (SELECT probe, round(beta, 9) AS cut, count(*) FILTER (tissue = 'T') AS p, count(*) FILTER (tissue = 'N') AS n FROM spec WHERE tissue IN ('T', 'N') AND beta IS NOT NULL GROUP BY 1, 2),
j AS (SELECT probe, cut, round(sum(p) OVER d / sum(p) OVER (PARTITION BY probe) - sum(n) OVER d / sum(n) OVER (PARTITION BY probe), 12) AS j FROM l WINDOW d AS (PARTITION BY probe ORDER BY cut DESC ROWS UNBOUNDED PRECEDING))
SELECT probe, round(max(cut), 6) + 0.0 AS cut, round(max(j), 6) + 0.0 AS j FROM (SELECT *, max(j) OVER (PARTITION BY probe) AS top FROM j) WHERE j = top GROUP BY 1"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("score", F.log1p("n_chars") / 12.0)


def auc_midrank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(inference.auc(_scores(spark, d), ["lang"], "quality", "score"), "auc")


AUC = """WITH s AS (SELECT lang, quality, n_chars, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id))
SELECT lang, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg,
round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0), 6) + 0.0 AS auc FROM s GROUP BY 1"""


def confusion_brier(spark: SparkSession, d: str) -> DataFrame:
    out = inference.confusion(_scores(spark, d), ["lang"], "quality", F.col("score") >= 0.6, F.col("score"))
    return rounded(out, "sensitivity", "specificity", "balanced_accuracy", "brier")


CONFUSION = """WITH s AS (SELECT lang, quality AS y, ln(1 + n_chars) / 12.0 AS p FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (y = 1 AND p >= 0.6) AS tp, count(*) FILTER (y = 0 AND p >= 0.6) AS fp, count(*) FILTER (y = 0 AND p < 0.6) AS tn, count(*) FILTER (y = 1 AND p < 0.6) AS fn, avg((p - y) * (p - y)) AS b FROM s GROUP BY 1)
SELECT lang, tp, fp, tn, fn, round(tp / nullif(tp + fn, 0), 6) + 0.0 AS sensitivity, round(tn / nullif(tn + fp, 0), 6) + 0.0 AS specificity,
round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) + 0.0 AS balanced_accuracy, round(b, 6) + 0.0 AS brier FROM c"""


DRAWS = 200


def md5_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    values = deltas(spark, d).select("probe", "patient", "delta")
    return rounded(resampling.bootstrap_mean(values, ["probe"], "patient", "delta", DRAWS, 11), "low", "high")


BOOTSTRAP = f"""WITH {SPEC}, {DELTA}, u AS (SELECT probe, patient, delta, row_number() OVER (PARTITION BY probe ORDER BY patient) - 1 AS i, count(*) OVER (PARTITION BY probe) AS n FROM delta),
k AS (SELECT probe, dr AS draw, CAST('0x' || substr(md5('11|' || dr || '|' || probe || '|' || i), 1, 8) AS BIGINT) % n AS j FROM u CROSS JOIN range({DRAWS}) r(dr)),
m AS (SELECT k.probe, draw, avg(u.delta) AS m FROM k JOIN u ON u.probe = k.probe AND u.i = k.j GROUP BY 1, 2)
SELECT probe, count(*) AS n_draws, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM m GROUP BY 1"""


def cluster_weights_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Concordance of the first two probes' differences, bootstrapped over patients of each cohort."""
    wide = deltas(spark, d).groupBy("cohort", "patient").agg(F.max(F.when(F.col("probe") == 0, F.col("delta"))).alias("x"), F.max(F.when(F.col("probe") == 1, F.col("delta"))).alias("y")).na.drop()
    weights = resampling.bootstrap_weights(wide.select("cohort", "patient"), ["cohort"], "patient", 20, 5)
    drawn = weights.join(wide, ["cohort", "patient"])
    out = concordance.weighted_concordance(drawn, ["cohort", "draw"], "x", "y", "weight")
    return rounded(out.filter(F.col("ratio").isNotNull()).select("cohort", "draw", "ratio"), "ratio")


RATIO = f"""WITH {SPEC}, {DELTA}, w AS (SELECT cohort, patient, max(CASE WHEN probe = 0 THEN delta END) AS x, max(CASE WHEN probe = 1 THEN delta END) AS y FROM delta GROUP BY 1, 2),
u AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY patient) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM w WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT cohort, dr AS draw, CAST('0x' || substr(md5('5|' || dr || '|' || cohort || '|' || i), 1, 8) AS BIGINT) % n AS j, count(*) AS wt FROM u CROSS JOIN range(20) r(dr) GROUP BY 1, 2, 3),
z AS (SELECT k.cohort, draw, wt, u.* EXCLUDE (cohort) FROM k JOIN u ON u.cohort = k.cohort AND u.i = k.j)
SELECT a.cohort, CAST(a.draw AS INTEGER) AS draw, round(sum(CASE WHEN (a.x - b.x) * (a.y - b.y) > 0 THEN a.wt * b.wt ELSE 0 END) / sum(a.wt * b.wt), 6) + 0.0 AS ratio
FROM z a JOIN z b ON a.cohort = b.cohort AND a.draw = b.draw AND a.patient < b.patient GROUP BY 1, 2"""


def permutation_addone(spark: SparkSession, d: str) -> DataFrame:
    values = deltas(spark, d).select("probe", "patient", "delta")
    return rounded(resampling.sign_flip(values, ["probe"], "patient", "delta", 199, 3), "observed", "p")


FLIP = f"""WITH {SPEC}, {DELTA}, f AS (SELECT probe, dr AS draw, avg(CASE WHEN CAST('0x' || substr(md5('3|' || dr || '|' || patient), 1, 8) AS BIGINT) % 2 = 1 THEN -delta ELSE delta END) AS m FROM delta CROSS JOIN range(199) r(dr) GROUP BY 1, 2),
o AS (SELECT probe, avg(delta) AS observed FROM delta GROUP BY 1)
SELECT probe, round(max(observed), 6) + 0.0 AS observed, count(*) FILTER (abs(m) >= abs(observed) - 1e-12) AS n_extreme,
round((count(*) FILTER (abs(m) >= abs(observed) - 1e-12) + 1) / 200.0, 6) + 0.0 AS p FROM f JOIN o USING (probe) GROUP BY 1"""


def patient_kfolds(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "events").select(F.col("user_id").alias("patient")).distinct()
    return resampling.kfolds(units, "patient", 5, 3, 17)


FOLDS = """SELECT repeat, patient, CAST(ntile(5) OVER (PARTITION BY repeat ORDER BY md5('17|' || repeat || '|' || patient), patient) - 1 AS INTEGER) AS fold
FROM (SELECT DISTINCT user_id AS patient FROM events) CROSS JOIN (SELECT CAST(r AS INTEGER) AS repeat FROM range(3) t(r))"""


def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "labels").select("doc_id", "quality")
    return resampling.kfolds(units, "doc_id", 4, 2, 23, ["quality"])


STRATIFIED = """SELECT repeat, quality, doc_id, CAST((row_number() OVER (PARTITION BY repeat, quality ORDER BY md5('23|' || repeat || '|' || doc_id), doc_id) - 1) % 4 AS INTEGER) AS fold
FROM labels CROSS JOIN (SELECT CAST(r AS INTEGER) AS repeat FROM range(2) t(r))"""


def flagged_exclusion_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Two probes flagged: their p counts as 1 in the unchanged family."""
    rows = _effects(spark, d, ["cohort", "probe"]).withColumn("flagged", F.col("probe").isin(1, 4))
    rows = rows.withColumn("p_used", F.when(F.col("flagged"), 1.0).otherwise(F.col("p")))
    out = ranking.bh_adjust(rows, "p_used", "cohort", "q").groupBy("cohort").agg(
        F.count_if(F.col("q") < 0.5).alias("n_below"), F.count_if("flagged").alias("n_flagged"), F.min("q").alias("least_q")
    )
    return rounded(out, "least_q")


FLAGGED = f"""WITH {SPEC}, {DELTA}, {_paired('cohort, probe')}, c AS (SELECT cohort, probe, probe IN (1, 4) AS flagged, CASE WHEN probe IN (1, 4) THEN 1.0 ELSE p END AS x FROM pp),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY x) AS rk, count(*) OVER (PARTITION BY cohort) AS m FROM c),
b AS (SELECT *, least(1.0, min(x * m / rk) OVER (PARTITION BY cohort ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT cohort, count(*) FILTER (q < 0.5) AS n_below, count(*) FILTER (flagged) AS n_flagged, round(min(q), 6) + 0.0 AS least_q FROM b GROUP BY 1"""


def threshold_rule_grid(spark: SparkSession, d: str) -> DataFrame:
    """Marker rules: at least m probes above a threshold; prevalence by cohort."""
    tumour = specimens(spark, d).filter("tissue = 'T'")
    cut = F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.2)])).alias("threshold")
    above = tumour.select("cohort", "patient", "beta", cut).groupBy("cohort", "patient", "threshold").agg(F.count_if(F.col("beta") >= F.col("threshold")).alias("k"))
    need = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("needed")
    out = above.select("cohort", "threshold", "k", need).groupBy("cohort", "threshold", "needed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") >= F.col("needed")).alias("n_positive")
    )
    return rounded(out.withColumn("prevalence", F.col("n_positive") / F.col("n")), "prevalence")


GRID = f"""WITH {SPEC}, a AS (SELECT cohort, patient, threshold, count(*) FILTER (beta >= threshold) AS k FROM spec CROSS JOIN (VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) t(threshold) WHERE tissue = 'T' GROUP BY ALL)
SELECT cohort, threshold, needed, count(*) AS n, count(*) FILTER (k >= needed) AS n_positive, round(count(*) FILTER (k >= needed) / count(*), 6) + 0.0 AS prevalence
FROM a CROSS JOIN (VALUES (1), (2), (3)) r(needed) GROUP BY ALL"""


QUERIES = {
    "paired_contrast_planned": (paired_contrast_planned, PLANNED),
    "bh_fixed_family": (_bh(7, "keep"), _bh_sql("p", "7")),
    "bh_finite_only": (_bh("finite", "keep"), _bh_sql("p", "count(x) OVER (PARTITION BY cohort)")),
    "bh_all_rows": (_bh("all", "keep"), _bh_sql("p", "count(*) OVER (PARTITION BY cohort)")),
    "bh_null_one": (_bh("all", "one"), _bh_sql("coalesce(p, 1.0)", "count(*) OVER (PARTITION BY cohort)")),
    "bh_eligible": (bh_eligible, BH_ELIGIBLE),
    "holm": (holm, HOLM),
    "midrank": (midrank, MIDRANK),
    "jackknife_loo": (jackknife_loo, LOO),
    "quantile_linear": (quantile_linear, QLINEAR),
    "quantile_higher": (quantile_higher, QHIGHER),
    "genomic_window_features": (genomic_window_features, WINDOWS),
    "topk_controls": (topk_controls, TOPK),
    "welch_contrast": (welch_contrast, WELCH),
    "mannwhitney_u": (mannwhitney_u, MWU),
    "kruskal_h": (kruskal_h, KRUSKAL),
    "wilcoxon_w": (wilcoxon_w, WILCOXON),
    "meta_fixed": (meta_fixed, META),
    "cutoff_rules": (cutoff_rules, CUTOFFS),
    "youden": (youden, YOUDEN),
    "auc_midrank": (auc_midrank, AUC),
    "confusion_brier": (confusion_brier, CONFUSION),
    "md5_bootstrap_mean": (md5_bootstrap_mean, BOOTSTRAP),
    "cluster_weights_ratio": (cluster_weights_ratio, RATIO),
    "permutation_addone": (permutation_addone, FLIP),
    "patient_kfolds": (patient_kfolds, FOLDS),
    "stratified_folds": (stratified_folds, STRATIFIED),
    "flagged_exclusion_sensitivity": (flagged_exclusion_sensitivity, FLAGGED),
    "threshold_rule_grid": (threshold_rule_grid, GRID),
}
