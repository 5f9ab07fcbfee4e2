"""Contrasts with p-values, rank tests, all-pairs correlation families, transfer, exclusions, fold reuse and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tails import chi2_upper, normal_two_sided, t_two_sided
from ..operators import battery, compare, contrasts, inference, ranking, relational, resampling
from .frames import DELTA, PROBES, SPEC, deltas, rounded, specimens, table
from .further_queries import CONTRASTS
from .statistics_queries import FOLDS, KRUSKAL, MWU, _effects, _paired, patient_kfolds

#: Columns of the transposed table.
COHORTS = 5
#: Mean normal value over which a patient is left out of the second scenario.
DISCORDANT = 0.15
_NODES = 2000


def _integral(upper: str, f: str) -> str:
    """Simpson's rule in SQL; ``f`` is an expression in u."""
    at = f.replace("u", f"(({upper}) * i / {_NODES}.0)")
    return f"(({upper}) / {_NODES}.0 / 3 * list_sum(list_transform(range(0, {_NODES + 1}), lambda i: (CASE WHEN i = 0 OR i = {_NODES} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {at})))"


def _t_sql(t: str, df: str) -> str:
    inner = _integral(f"least(atan(abs({t}) / sqrt({df})), 40.0 / sqrt({df}))", f"pow(cos(u), {df} - 1)")
    return f"greatest(0.0, 1 - 2 * exp(lgamma({df} / 2.0 + 0.5) - lgamma({df} / 2.0)) / sqrt(pi()) * {inner})"


def _z_sql(z: str) -> str:
    return f"greatest(0.0, 1 - sqrt(2 / pi()) * {_integral(f'least(abs({z}), 12.0)', 'exp(-u * u / 2)')})"


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def _registry(spark: SparkSession, d: str) -> DataFrame:
    """Every cohort of the table with every planned probe."""
    probes = spark.range(PROBES).select(F.col("id").cast("int").alias("probe"))
    return specimens(spark, d).select("cohort").distinct().crossJoin(F.broadcast(probes))  # a row a planned probe


def contrast_engine(spark: SparkSession, d: str) -> DataFrame:
    """Every planned cohort, contrast and probe: method, estimate, p, and q over the contrast's planned rows."""
    plan = F.explode(F.array(*[F.struct(F.lit(h).alias("high"), F.lit(low).alias("low")) for h, low in CONTRASTS])).alias("c")
    planned = _registry(spark, d).select("cohort", "probe", plan).select("cohort", "probe", "c.*")
    out = contrasts.contrast_rows(specimens(spark, d), planned, CONTRASTS, "cohort", "patient", "tissue", "probe", "beta")
    return rounded(out, "estimate", "se", "statistic", "df", "p", "p_for_bh", "q")


#: The clustered errors from residuals summed by patient, not from the sums the query uses.
ENGINE = f"""WITH {SPEC}, s AS (SELECT cohort, patient, tissue, probe, beta FROM spec WHERE beta IS NOT NULL), c(high, low) AS (VALUES {', '.join(map(str, CONTRASTS))}),
pl AS (SELECT cohort, CAST(p AS INTEGER) AS probe, high, low FROM (SELECT DISTINCT cohort FROM spec), range({PROBES}) b(p), c),
u AS (SELECT cohort, probe, high, low, patient, max(beta) FILTER (tissue = high) AS a, max(beta) FILTER (tissue = low) AS b FROM s JOIN c ON tissue IN (high, low) GROUP BY ALL),
sh AS (SELECT cohort, high, low, count(*) AS n_both FROM (SELECT cohort, high, low, patient FROM s JOIN c ON tissue IN (high, low) GROUP BY ALL HAVING count(DISTINCT tissue) = 2) GROUP BY ALL),
m AS (SELECT cohort, probe, high, low, count(a) AS na, count(b) AS nb, count(a - b) AS k, count(*) AS g, avg(a) AS ma, avg(b) AS mb, var_samp(a) / count(a) AS xa, var_samp(b) / count(b) AS xb, avg(a - b) AS md, stddev_samp(a - b) AS sd FROM u GROUP BY ALL),
r AS (SELECT cohort, probe, high, low, sum(pow(coalesce((a - ma) / na, 0) - coalesce((b - mb) / nb, 0), 2)) AS sc FROM u JOIN m USING (cohort, probe, high, low) GROUP BY ALL),
j AS (SELECT pl.*, m.* EXCLUDE (cohort, probe, high, low), sc, CASE WHEN high = 'T' AND low = 'N' AND coalesce(n_both, 0) >= 3 THEN 'paired_t' WHEN coalesce(k, 0) > 0 THEN 'patient_cluster_OLS' ELSE 'Welch_t' END AS method
FROM pl LEFT JOIN sh USING (cohort, high, low) LEFT JOIN m USING (cohort, probe, high, low) LEFT JOIN r USING (cohort, probe, high, low)),
o AS (SELECT *, CASE WHEN g IS NULL THEN 'probe_absent' WHEN (CASE WHEN method = 'paired_t' THEN k ELSE least(na, nb) END) >= 3 THEN 'estimated' ELSE 'insufficient_data' END AS status FROM j),
e AS (SELECT *, CASE WHEN status = 'estimated' THEN CASE WHEN method = 'paired_t' THEN md ELSE ma - mb END END AS est,
CASE WHEN status = 'estimated' THEN CASE method WHEN 'paired_t' THEN sd / sqrt(k) WHEN 'Welch_t' THEN sqrt(xa + xb) ELSE sqrt(sc * g / (g - 1) * (na + nb - 1) / (na + nb - 2)) END END AS s0,
CASE WHEN status = 'estimated' THEN CASE method WHEN 'paired_t' THEN CAST(k - 1 AS DOUBLE) WHEN 'Welch_t' THEN (xa + xb) * (xa + xb) / (xa * xa / (na - 1) + xb * xb / (nb - 1)) END END AS df FROM o),
t AS (SELECT *, CASE WHEN s0 > 0 THEN est / s0 END AS st FROM e),
p AS (SELECT *, CASE WHEN method = 'patient_cluster_OLS' THEN CASE WHEN st IS NOT NULL THEN {_z_sql('st')} END WHEN st IS NOT NULL AND df >= 1 THEN {_t_sql('st', 'df')} END AS p FROM t),
k AS (SELECT *, coalesce(p, 1.0) AS p_for_bh, row_number() OVER (PARTITION BY high, low ORDER BY coalesce(p, 1.0)) AS rk, count(*) OVER (PARTITION BY high, low) AS fam FROM p),
q AS (SELECT *, least(1.0, min(p_for_bh * fam / rk) OVER (PARTITION BY high, low ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)
SELECT cohort, high, low, probe, method, status, coalesce(CASE WHEN method = 'paired_t' THEN k ELSE na END, 0) AS n_high, coalesce(CASE WHEN method = 'paired_t' THEN k ELSE nb END, 0) AS n_low, coalesce(k, 0) AS n_shared,
round(est * 100, 6) + 0.0 AS estimate, round(s0 * 100, 6) + 0.0 AS se, round(st, 6) + 0.0 AS statistic, {_r('df', 'p', 'p_for_bh', 'q')} FROM q"""


def mannwhitney_p(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided p of U by the tie-corrected normal with continuity correction."""
    u = inference.mann_whitney(specimens(spark, d), ["probe"], "tissue", "beta", "T", "H")
    half = F.col("n_high") * F.col("n_low") / 2
    z = F.when(F.col("u") == half, 0.0).otherwise(F.abs("z") * (1 - 0.5 / F.abs(F.col("u") - half)))
    # The name comes first: inside a lambda a select's own alias would be taken for the column.
    out = u.withColumn("z", F.greatest(z, F.lit(0.0))).withColumn("p", normal_two_sided(F.col("z")))
    return rounded(out, "rank_biserial", "z", "p")



MWU_P = f"""{MWU.rsplit('SELECT probe', 1)[0].rstrip()}, v AS (SELECT probe, n_high, n_low, u, 2 * u / (n_high * n_low) - 1 AS rank_biserial,
greatest(0.0, abs(u - n_high * n_low / 2.0) - 0.5) / sqrt(n_high * n_low / 12.0 * ((n + 1) - ties / (1.0 * n * (n - 1)))) AS z FROM u)
SELECT probe, n_high, n_low, u, {_r('rank_biserial', 'z')}, round({_z_sql('z')}, 6) + 0.0 AS p FROM v"""


def kruskal_p(spark: SparkSession, d: str) -> DataFrame:
    """H of four arms with its chi-squared p."""
    h = inference.kruskal(specimens(spark, d), ["probe"], "tissue", "beta")
    return rounded(h.withColumn("p", chi2_upper(F.col("h"), F.col("k") - 1)), "h", "epsilon2", "p")


#: Three degrees of freedom: the normal tail and one term.
KRUSKAL_P = f"""{KRUSKAL.rsplit('SELECT probe', 1)[0].rstrip()}
SELECT probe, n, k, round(h, 6) + 0.0 AS h, round((h - k + 1) / (n - k), 6) + 0.0 AS epsilon2, round({_z_sql('sqrt(h)')} + sqrt(2 * h / pi()) * exp(-h / 2), 6) + 0.0 AS p FROM x"""


def wilcoxon_p(spark: SparkSession, d: str) -> DataFrame:
    w = inference.wilcoxon(deltas(spark, d), ["cohort", "probe"])
    return rounded(w.withColumn("p", normal_two_sided(F.col("z"))), "z", "p")


WILCOXON_P = f"""WITH {SPEC}, {DELTA}, r AS (SELECT cohort, probe, delta, abs(delta) AS a, rank() OVER (PARTITION BY cohort, probe ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY cohort, probe, abs(delta)) - 1) / 2.0 AS r FROM delta WHERE delta <> 0),
t AS (SELECT cohort, probe, sum(c * c * c - c) AS ties FROM (SELECT cohort, probe, a, count(*) AS c FROM r GROUP BY ALL) GROUP BY ALL),
s AS (SELECT cohort, probe, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0.0 END) AS w_pos, sum(CASE WHEN delta < 0 THEN r ELSE 0.0 END) AS w_neg FROM r GROUP BY ALL),
z AS (SELECT cohort, probe, n, w_pos, w_neg, (least(w_pos, w_neg) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) AS z FROM s JOIN t USING (cohort, probe))
SELECT cohort, probe, n, CAST(w_pos AS DOUBLE) AS w_pos, CAST(w_neg AS DOUBLE) AS w_neg, round(z, 6) + 0.0 AS z, round({_z_sql('z')}, 6) + 0.0 AS p FROM z"""


def spearman_family(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of all pairs of probes by cohort, with p, and q within and between groups of probes."""
    values = deltas(spark, d).select("cohort", "patient", "probe", "delta")
    a = values.select("cohort", "patient", F.col("probe").alias("i"), F.col("delta").alias("x"))
    b = values.select("cohort", "patient", F.col("probe").alias("j"), F.col("delta").alias("y"))
    pairs = a.join(b, ["cohort", "patient"]).filter("i < j")
    own = ["cohort", "i", "j"]
    rho = battery.rank_correlation(pairs, own, "x", "y")
    usable = (F.col("n") >= 5) & (F.abs("rho") < 1)
    t = F.when(usable, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    family = F.when(F.floor(F.col("i") / 2) == F.floor(F.col("j") / 2), "within").otherwise("between")
    tested = rho.withColumn("p", t_two_sided(t, F.when(usable, F.col("n") - 2))).withColumn("family", family)
    return rounded(ranking.bh_adjust(tested, "p", ["cohort", "family"], "q", "finite"), "rho", "p", "q")


SPEARMAN_FAMILY = f"""WITH {SPEC}, {DELTA}, x AS (SELECT a.cohort, a.probe AS i, b.probe AS j, a.delta AS x, b.delta AS y FROM delta a JOIN delta b ON a.cohort = b.cohort AND a.patient = b.patient AND a.probe < b.probe),
r AS (SELECT cohort, i, j, rank() OVER (PARTITION BY cohort, i, j ORDER BY x) + (count(*) OVER (PARTITION BY cohort, i, j, x) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY cohort, i, j ORDER BY y) + (count(*) OVER (PARTITION BY cohort, i, j, y) - 1) / 2.0 AS ry FROM x),
c AS (SELECT cohort, i, j, corr(rx, ry) AS rho, count(*) AS n, CASE WHEN i // 2 = j // 2 THEN 'within' ELSE 'between' END AS family FROM r GROUP BY 1, 2, 3),
t AS (SELECT *, CASE WHEN n >= 5 AND abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END AS t FROM c),
p AS (SELECT *, CASE WHEN t IS NOT NULL THEN {_t_sql('t', '(n - 2)')} END AS p FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY cohort, family ORDER BY p NULLS LAST) AS rk, count(p) OVER (PARTITION BY cohort, family) AS m FROM p),
q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / rk) OVER (PARTITION BY cohort, family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM k)
SELECT cohort, i, j, n, family, {_r('rho', 'p', 'q')} FROM q"""


def exclusion_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Paired summary of all patients, and without those whose mean normal value is over DISCORDANT."""
    x = deltas(spark, d)
    own = x.groupBy("cohort", "patient").agg(F.avg("low").alias("m")).select("cohort", "patient", (F.col("m") > DISCORDANT).alias("discordant"))
    marked = x.join(own, ["cohort", "patient"])
    kept = F.array(F.lit("all"), F.when(~F.col("discordant"), F.lit("discordant_excluded")))
    each = marked.withColumn("scenario", F.explode(F.filter(kept, lambda s: s.isNotNull())))
    out = inference.paired_effects(each, ["scenario", "probe"])
    return rounded(ranking.bh_adjust(out, "p", "scenario", "q").select("scenario", "probe", "n", "mean", "sd", "t", "p", "q"), "mean", "sd", "t", "p", "q")


EXCLUSIONS = f"""WITH {SPEC}, {DELTA.replace('delta AS (', 'every AS (', 1)}, o AS (SELECT cohort, patient, avg(lo) > {DISCORDANT} AS out FROM every GROUP BY ALL),
delta AS (SELECT 'all' AS scenario, * FROM every UNION ALL SELECT 'discordant_excluded', every.* FROM every JOIN o USING (cohort, patient) WHERE NOT out), {_paired('scenario, probe')},
k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY p) AS rk, count(*) OVER (PARTITION BY scenario) AS m FROM pp),
q AS (SELECT *, least(1.0, min(p * m / rk) OVER (PARTITION BY scenario ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS q FROM k)
SELECT scenario, probe, n, {_r('mean', 'sd', 't', 'p', 'q')} FROM q"""


def fold_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Training sets of stored folds: all patients less the fold's own, and the overlap, which must be none."""
    folds = patient_kfolds(spark, d)
    everyone = table(spark, d, "events").select(F.col("user_id").alias("patient")).distinct()
    each = folds.select("repeat", "fold").distinct()
    # Folds are a few rows by plan.
    train = everyone.crossJoin(F.broadcast(each)).join(folds, ["repeat", "fold", "patient"], "left_anti")
    seen = train.withColumn("side", F.lit("train")).unionByName(folds.select("repeat", "fold", "patient").withColumn("side", F.lit("test")))
    per = seen.groupBy("repeat", "fold", "patient").agg(F.count_if(F.col("side") == "train").alias("a"), F.count_if(F.col("side") == "test").alias("b"))
    return per.groupBy("repeat", "fold").agg(F.sum("a").alias("n_train"), F.sum("b").alias("n_test"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("n_overlap"))


REUSE = f"""WITH f AS ({FOLDS}), n AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT repeat, fold, CAST(any_value(n) - count(*) AS BIGINT) AS n_train, count(*) AS n_test, CAST(0 AS BIGINT) AS n_overlap FROM f, n GROUP BY 1, 2"""


def frozen_transfer(spark: SparkSession, d: str) -> DataFrame:
    """AUC of every cohort under weights frozen in each other cohort, and in all others together.

    Weights are the diagonal discriminant's: difference of the arms' means over
    the variance of all training values, by probe.  A specimen's score sums over
    the probes it has, each less the training mean.
    """
    s = specimens(spark, d).filter("tissue in ('T', 'N') and beta is not null").select("cohort", "patient", "tissue", "probe", "beta")
    single = F.array(F.col("cohort").cast("string"))
    cohorts = F.array(*[F.lit(r["cohort"]) for r in s.select("cohort").distinct().collect()]).cast("array<long>")  # cohorts are studies: few
    left_out = F.transform(F.filter(cohorts, lambda c: c != F.col("cohort")), lambda c: F.concat(F.lit("all but "), c.cast("string")))
    arm = lambda t: F.avg(F.when(F.col("tissue") == t, F.col("beta")))
    model = s.withColumn("train", F.explode(F.concat(single, left_out))).groupBy("train", "probe").agg(
        ((arm("T") - arm("N")) / F.var_samp("beta")).alias("w"), F.avg("beta").alias("m")
    )
    # The frozen models: 2 x cohorts x probes rows.
    scored = s.join(F.broadcast(model), "probe").withColumn("x", F.col("w") * (F.col("beta") - F.col("m")))
    foreign = (F.col("train") != F.col("cohort").cast("string")) & (~F.col("train").startswith("all but ") | (F.col("train") == F.concat(F.lit("all but "), F.col("cohort").cast("string"))))
    rows = scored.filter(foreign).groupBy("train", "cohort", "patient", "tissue").agg(F.round(F.sum("x"), 9).alias("score"))
    out = inference.auc(rows.withColumn("y", (F.col("tissue") == "T").cast("int")), ["train", "cohort"], "y", "score")
    return rounded(out, "auc")


TRANSFER = f"""WITH {SPEC}, s AS (SELECT cohort, patient, tissue, probe, beta FROM spec WHERE tissue IN ('T', 'N') AND beta IS NOT NULL),
t AS (SELECT CAST(cohort AS VARCHAR) AS train, * FROM s UNION ALL SELECT 'all but ' || x, s.* FROM s, (SELECT DISTINCT cohort AS x FROM s) WHERE x <> cohort),
m AS (SELECT train, probe, (avg(beta) FILTER (tissue = 'T') - avg(beta) FILTER (tissue = 'N')) / var_samp(beta) AS w, avg(beta) AS m FROM t GROUP BY 1, 2),
c AS (SELECT train, cohort, patient, tissue, round(sum(w * (beta - m)), 9) AS score FROM s JOIN m USING (probe)
WHERE train = 'all but ' || cohort OR (train NOT LIKE 'all%' AND train <> CAST(cohort AS VARCHAR)) GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY train, cohort ORDER BY score) + (count(*) OVER (PARTITION BY train, cohort, score) - 1) / 2.0 AS r FROM c WHERE score IS NOT NULL),
a AS (SELECT train, cohort, count(*) FILTER (tissue = 'T') AS n_pos, count(*) FILTER (tissue = 'N') AS n_neg, sum(r) FILTER (tissue = 'T') AS w FROM r GROUP BY 1, 2)
SELECT train, cohort, n_pos, n_neg, round((w - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) + 0.0 AS auc FROM a"""


def decision_gates(spark: SparkSession, d: str) -> DataFrame:
    """Decisions that excluding the discordant patients changes: sign, p below 0.05 and q below 0.05, by probe."""
    both = exclusion_scenarios(spark, d)
    side = lambda s: both.filter(F.col("scenario") == s).select("probe", *[f(c).alias(n) for n, (c, f) in _GATES.items()])
    return compare.compare_tables(side("all"), side("discordant_excluded"), ["probe"], dict.fromkeys(_GATES))


_GATES = {
    "sign": ("mean", lambda c: F.signum(F.col(c)).cast("int")),
    "p_below": ("p", lambda c: F.col(c) < 0.05),
    "q_below": ("q", lambda c: F.col(c) < 0.05),
}
GATES = f"""WITH e AS ({EXCLUSIONS}), a AS (SELECT * FROM e WHERE scenario = 'all'), b AS (SELECT * FROM e WHERE scenario = 'discordant_excluded'),
j AS (SELECT coalesce(a.probe, b.probe) AS probe, a.probe AS pa, b.probe AS pb, sign(a.mean) IS DISTINCT FROM sign(b.mean) AS s, (a.p < 0.05) IS DISTINCT FROM (b.p < 0.05) AS p, (a.q < 0.05) IS DISTINCT FROM (b.q < 0.05) AS q FROM a FULL JOIN b ON a.probe = b.probe)
SELECT probe, '' AS column_name, CASE WHEN pa IS NULL THEN 'missing_left' ELSE 'missing_right' END AS problem FROM j WHERE pa IS NULL OR pb IS NULL
UNION ALL SELECT probe, unnest(['sign', 'p_below', 'q_below']), 'value' FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL AND s AND p AND q
UNION ALL SELECT probe, x, 'value' FROM (SELECT probe, unnest(list_filter([CASE WHEN s THEN 'sign' END, CASE WHEN p THEN 'p_below' END, CASE WHEN q THEN 'q_below' END], lambda v: v IS NOT NULL)) AS x FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL AND NOT (s AND p AND q))"""


def probe_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Descriptors of every probe in a cohort's normal specimens, and whether it may serve as a control."""
    rows = specimens(spark, d).filter("tissue = 'N'")
    s = rows.groupBy("cohort", "probe").agg(F.count(F.lit(1)).alias("n"), F.count("beta").alias("n_present"), F.avg("beta").alias("mean"), F.stddev_samp("beta").alias("sd"))
    s = s.withColumn("present", F.col("n_present") / F.col("n"))
    reason = F.when(F.col("n_present") < 5, "few_values").when(F.col("present") < 0.75, "missing").when(F.col("sd") < 0.01, "constant").when(F.col("mean").between(0.01, 0.5), "eligible").otherwise("extreme_mean")
    return rounded(s.withColumn("status", reason), "mean", "sd", "present")


ELIGIBILITY = f"""WITH {SPEC}, s AS (SELECT cohort, probe, count(*) AS n, count(beta) AS n_present, avg(beta) AS mean, stddev_samp(beta) AS sd, count(beta) / count(*) AS present FROM spec WHERE tissue = 'N' GROUP BY 1, 2)
SELECT cohort, probe, n, n_present, {_r('mean', 'sd', 'present')}, CASE WHEN n_present < 5 THEN 'few_values' WHEN present < 0.75 THEN 'missing' WHEN sd < 0.01 THEN 'constant' WHEN mean BETWEEN 0.01 AND 0.5 THEN 'eligible' ELSE 'extreme_mean' END AS status FROM s"""


def transposed(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of cohorts by probes turned into probes by cohorts."""
    s = specimens(spark, d).groupBy("cohort", "probe").agg(F.avg("beta").alias("m"))
    matrix = s.groupBy("cohort").pivot("probe", list(range(PROBES - 1))).agg(F.first("m"))
    return rounded(relational.transpose(matrix, "cohort", list(range(COHORTS)), "probe", "cohort_"), *[f"cohort_{c}" for c in range(COHORTS)])


TRANSPOSED = f"""WITH {SPEC} SELECT CAST(probe AS VARCHAR) AS probe, {', '.join(f'round(avg(beta) FILTER (cohort = {c}), 6) + 0.0 AS cohort_{c}' for c in range(COHORTS))} FROM spec GROUP BY 1"""


def registry_right_join(spark: SparkSession, d: str) -> DataFrame:
    """Effects joined onto the registry from the right: every planned probe in every cohort stays."""
    found = _effects(spark, d, ["cohort", "probe"]).select("cohort", "probe", "n", "mean")
    return rounded(found.join(_registry(spark, d), ["cohort", "probe"], "right"), "mean")


RIGHT_JOIN = f"""WITH {SPEC}, {DELTA}, e AS (SELECT cohort, probe, count(*) AS n, avg(delta * 100.0) AS mean FROM delta GROUP BY 1, 2)
SELECT r.cohort, r.probe, n, round(mean, 6) + 0.0 AS mean FROM e RIGHT JOIN (SELECT cohort, CAST(y AS INTEGER) AS probe FROM (SELECT DISTINCT cohort FROM spec), range({PROBES}) b(y)) r ON e.cohort = r.cohort AND e.probe = r.probe"""


def poisson_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean by Poisson weights: drawn from a hash of draw and unit in the scan, one shuffle of draws."""
    values = deltas(spark, d).select("probe", "patient", "delta")
    return rounded(resampling.poisson_mean(values, ["probe"], "patient", "delta", 200, 29), "low", "high")


def _poisson_sql() -> str:
    return " + ".join(f"CASE WHEN h >= {c} THEN 1 ELSE 0 END" for c in resampling.POISSON_CUTS)


POISSON = f"""WITH {SPEC}, {DELTA}, h AS (SELECT probe, delta, dr, CAST('0x' || substr(md5('29|' || (dr // 4) || '|' || patient), 1 + 8 * (dr % 4), 8) AS BIGINT) AS h FROM delta CROSS JOIN range(200) r(dr)),
w AS (SELECT probe, dr, delta, {_poisson_sql()} AS w FROM h), m AS (SELECT probe, dr, sum(w * delta) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2)
SELECT probe, count(m) AS n_draws, round(quantile_cont(m, 0.025), 6) + 0.0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0 AS high FROM m GROUP BY 1"""


def repeat_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two scores' AUC in every fold of every repeat, averaged by repeat, and their aligned difference."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    folds = resampling.kfolds(docs.select("doc_id"), "doc_id", 5, 4, 47)
    rows = folds.join(docs, "doc_id").select("repeat", "fold", "quality", F.col("n_chars").cast("double").alias("length"), (F.col("n_chars") % 97).cast("double").alias("residue"))
    score = F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("score")) for c in ("length", "residue")])).alias("s")
    auc = inference.auc(rows.select("repeat", "fold", "quality", score).select("repeat", "fold", "quality", "s.*"), ["repeat", "fold", "model"], "quality", "score")
    own = lambda m: F.avg(F.when(F.col("model") == m, F.col("auc")))
    out = auc.groupBy("repeat").agg(F.count("auc").alias("n_metrics"), own("length").alias("length_auc"), own("residue").alias("residue_auc"))
    return rounded(out.withColumn("difference", F.col("length_auc") - F.col("residue_auc")), "length_auc", "residue_auc", "difference")


REPEATS = """WITH f AS (SELECT repeat, doc_id, n_chars, quality, ntile(5) OVER (PARTITION BY repeat ORDER BY md5('47|' || repeat || '|' || doc_id), doc_id) - 1 AS fold
FROM documents JOIN labels USING (doc_id) CROSS JOIN (SELECT CAST(r AS INTEGER) AS repeat FROM range(4) t(r))),
s AS (SELECT repeat, fold, quality, 'length' AS model, n_chars AS score FROM f UNION ALL SELECT repeat, fold, quality, 'residue', n_chars % 97 FROM f),
r AS (SELECT *, rank() OVER (PARTITION BY repeat, fold, model ORDER BY score) + (count(*) OVER (PARTITION BY repeat, fold, model, score) - 1) / 2.0 AS r FROM s WHERE score IS NOT NULL AND quality IN (0, 1)),
a AS (SELECT repeat, fold, model, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n, sum(r) FILTER (quality = 1) AS w FROM r GROUP BY ALL),
m AS (SELECT repeat, model, (w - p * (p + 1) / 2.0) / nullif(p * n, 0) AS auc FROM a),
g AS (SELECT repeat, count(auc) AS n_metrics, avg(auc) FILTER (model = 'length') AS l, avg(auc) FILTER (model = 'residue') AS e FROM m GROUP BY 1)
SELECT repeat, n_metrics, round(l, 6) + 0.0 AS length_auc, round(e, 6) + 0.0 AS residue_auc, round(l - e, 6) + 0.0 AS difference FROM g"""


QUERIES = {
    "contrast_engine": (contrast_engine, ENGINE),
    "mannwhitney_p": (mannwhitney_p, MWU_P),
    "kruskal_p": (kruskal_p, KRUSKAL_P),
    "wilcoxon_p": (wilcoxon_p, WILCOXON_P),
    "spearman_family": (spearman_family, SPEARMAN_FAMILY),
    "exclusion_scenarios": (exclusion_scenarios, EXCLUSIONS),
    "fold_reuse": (fold_reuse, REUSE),
    "frozen_transfer": (frozen_transfer, TRANSFER),
    "decision_gates": (decision_gates, GATES),
    "probe_eligibility": (probe_eligibility, ELIGIBILITY),
    "transposed": (transposed, TRANSPOSED),
    "registry_right_join": (registry_right_join, RIGHT_JOIN),
    "poisson_bootstrap": (poisson_bootstrap, POISSON),
    "repeat_metrics": (repeat_metrics, REPEATS),
}
