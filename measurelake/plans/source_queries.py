"""Readers and sinks as queries: every one writes files from the given tables and reads them back by the engine's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import readers, sinks
from .frames import rounded, table

SAMPLES = ["size01", "price01", "mixed"]


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """probe and three samples in [0, 1]; every seventh size is missing."""
    size = F.col("p_size") / 50.0
    price = F.round(F.col("p_retailprice") / 10000.0, 8)
    cells = [F.when(F.col("p_size") % 7 == 0, "NA").otherwise(size.cast("string")), price.cast("string"), F.round(size * price, 8).cast("string")]
    return table(spark, d, "part").select(F.format_string("cg%08d", "p_partkey").alias("probe"), *[c.alias(n) for c, n in zip(cells, SAMPLES)])


def _written(spark: SparkSession, d: str) -> str:
    path = sinks.work_folder(spark, "matrix")
    sinks.write_text_table(_matrix(spark, d), path, ["probe"])
    return path


MATRIX = """m AS (SELECT format('cg{:08d}', p_partkey) AS probe, p_brand, CASE WHEN p_size % 7 <> 0 THEN p_size / 50.0 END AS size01,
round(p_retailprice / 10000.0, 8) AS price01, round(p_size / 50.0 * round(p_retailprice / 10000.0, 8), 8) AS mixed FROM part),
l AS (SELECT probe, p_brand, sample, beta FROM m UNPIVOT INCLUDE NULLS (beta FOR sample IN (size01, price01, mixed)))"""


def delimited_scan(spark: SparkSession, d: str) -> DataFrame:
    """The text table read with its schema; the missing token stays text."""
    out = readers.read_delimited(spark, _written(spark, d), "probe string, size01 string, price01 double, mixed double")
    return out.select("probe", (F.col("size01") == "NA").alias("missing"), F.col("price01"), F.col("mixed"))


DELIMITED = f"WITH {MATRIX} SELECT probe, size01 IS NULL AS missing, price01, mixed FROM m"


def strict_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(readers.strict_matrix(spark, _written(spark, d)), "beta", digits=8)


STRICT = f"WITH {MATRIX} SELECT probe, sample, round(beta, 8) + 0.0 AS beta FROM l"


def cohort_loader(spark: SparkSession, d: str) -> DataFrame:
    """Matrix and sample table, aligned by their keys."""
    samples = spark.createDataFrame([(s, i) for i, s in enumerate(SAMPLES)], "sample string, place int")
    loaded = readers.load_cohort(readers.strict_matrix(spark, _written(spark, d)), samples)
    return rounded(loaded.groupBy("sample", "place").agg(F.count("beta").alias("n"), F.sum("beta").alias("total")), "total")


COHORT = f"WITH {MATRIX} SELECT sample, CASE sample WHEN 'size01' THEN 0 WHEN 'price01' THEN 1 ELSE 2 END AS place, count(beta) AS n, round(sum(beta), 6) + 0.0 AS total FROM l GROUP BY 1, 2"


def class_mean_scan(spark: SparkSession, d: str) -> DataFrame:
    """Means by class of probes while the matrix is scanned: a proxy for each class and sample."""
    classes = table(spark, d, "part").select(F.format_string("cg%08d", "p_partkey").alias("probe"), F.col("p_brand").alias("class"))
    return rounded(readers.class_means(readers.strict_matrix(spark, _written(spark, d)), classes), "mean")


CLASS_MEANS = f"WITH {MATRIX} SELECT sample, p_brand AS class, count(beta) AS n, round(avg(beta), 6) + 0.0 AS mean FROM l GROUP BY 1, 2"


def _defective(spark: SparkSession, d: str) -> str:
    """A matrix with a cell too few in every 50th line, a bad token in every 30th and every 97th line twice."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size"))
    cells = F.concat_ws("\t", F.format_string("cg%08d", "k"), F.col("p_size").cast("string"), F.when(F.col("k") % 30 == 0, "oops").otherwise("NA"))
    full = F.concat_ws("\t", cells, F.lit("0.5"))
    line = F.when(F.col("k") % 50 == 0, cells).otherwise(full)
    lines = parts.withColumn("line", line).withColumn("again", F.explode(F.when(F.col("k") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    path = sinks.work_folder(spark, "raw")
    lines.select(F.lit("probe\ta\tb\tc").alias("line")).limit(1).unionByName(lines.select("line")).coalesce(1).write.text(path)
    return path


def audited_scan(spark: SparkSession, d: str) -> DataFrame:
    """Kept lines per target with what the same pass has found in all lines."""
    targets = table(spark, d, "part").filter("p_size <= 10").select(F.format_string("cg%08d", "p_partkey").alias("key"))
    kept, audit = readers.audited_scan(spark, _defective(spark, d), targets, sinks.work_folder(spark, "kept"))
    seen = [F.lit(n).cast("long").alias(c) for c, n in (("lines", audit.lines), ("characters", audit.characters), ("ragged", audit.ragged), ("bad_tokens", audit.bad_tokens))]
    return kept.select("key", F.size("cells").alias("n_cells"), "n_lines", *seen)


AUDITED = """WITH p AS (SELECT format('cg{:08d}', p_partkey) AS key, p_partkey AS k, p_size FROM part), r AS (SELECT *, CASE WHEN k % 97 = 0 THEN 2 ELSE 1 END AS n_lines, CASE WHEN k % 50 = 0 THEN 3 ELSE 4 END AS n_cells FROM p),
c AS (SELECT *, length(key) + 1 + length(CAST(p_size AS VARCHAR)) + 1 + CASE WHEN k % 30 = 0 THEN 4 ELSE 2 END + CASE WHEN n_cells = 4 THEN 4 ELSE 0 END AS ch FROM r),
t AS (SELECT CAST(sum(n_lines) AS BIGINT) AS lines, CAST(sum(ch * n_lines) AS BIGINT) AS characters, CAST(coalesce(sum(n_lines) FILTER (k % 50 = 0), 0) AS BIGINT) AS ragged, CAST(coalesce(sum(n_lines) FILTER (k % 30 = 0), 0) AS BIGINT) AS bad_tokens FROM c)
SELECT key, n_cells, CAST(n_lines AS BIGINT) AS n_lines, t.* FROM (SELECT c.*, unnest(range(n_lines)) FROM c WHERE p_size <= 10) JOIN t ON true"""


def value_p_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Values beside detection p in alternating columns; a value counts below the limit."""
    parts = table(spark, d, "part")
    p = lambda k: ((F.col("p_partkey") * k) % 100) / 1000.0
    wide = parts.select("p_partkey", (F.col("p_size") / 50.0).alias("a"), p(3).alias("a Detection Pval"), (F.col("p_retailprice") / 10000.0).alias("b"), p(7).alias("b Detection Pval"))
    path = sinks.work_folder(spark, "pairs")
    sinks.write_text_table(wide, path, ["p_partkey"])
    schema = "p_partkey long, a double, `a Detection Pval` double, b double, `b Detection Pval` double"
    return rounded(readers.read_value_p_pairs(readers.read_delimited(spark, path, schema), "p_partkey", ["a", "b"]), "beta", digits=8)


PAIRS = """SELECT p_partkey AS probe, 'a' AS sample, CASE WHEN (p_partkey * 3) % 100 < 10 THEN round(p_size / 50.0, 8) + 0.0 END AS beta FROM part
UNION ALL SELECT p_partkey, 'b', CASE WHEN (p_partkey * 7) % 100 < 10 THEN round(p_retailprice / 10000.0, 8) + 0.0 END FROM part"""


def series_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Values of a series matrix with the characteristic of their samples."""
    q = lambda *cells: F.concat_ws("\t", *[F.concat(F.lit('"'), c, F.lit('"')) for c in cells])
    head = ['!Series_title\t"x"', '!Sample_geo_accession\t"G1"\t"G2"', '!Sample_characteristics_ch1\t"tissue: T"\t"tissue: N"', "!series_matrix_table_begin", '"ID_REF"\t"G1"\t"G2"']
    body = table(spark, d, "supplier").select(q(F.format_string("cg%08d", "s_suppkey"), F.col("s_acctbal").cast("string"), F.when(F.col("s_nationkey") % 5 == 0, "").otherwise(F.col("s_nationkey").cast("string"))).alias("line"))
    path = sinks.work_folder(spark, "series")
    spark.createDataFrame([(h,) for h in head], "line string").unionByName(body).write.text(path)
    meta, values = readers.read_series_matrix(spark, path)
    return rounded(values.join(meta.filter("field = 'tissue'").select("sample", F.col("value").alias("tissue")), "sample"), "value")


SERIES = """SELECT 'G1' AS sample, format('cg{:08d}', s_suppkey) AS probe, round(s_acctbal, 6) + 0.0 AS value, 'T' AS tissue FROM supplier
UNION ALL SELECT 'G2', format('cg{:08d}', s_suppkey), CASE WHEN s_nationkey % 5 <> 0 THEN CAST(s_nationkey AS DOUBLE) END, 'N' FROM supplier"""


def annotation_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Probes of a platform annotation with one symbol of a wanted set; several different symbols are none."""
    s = F.upper(F.regexp_replace("c_mktsegment", "[^A-Za-z]", ""))
    cell = F.when(F.col("c_custkey") % 3 == 0, F.concat(s, F.lit(" /// "), s)).when(F.col("c_custkey") % 3 == 1, F.concat(s, F.lit(" /// OTHER"))).otherwise(s)
    body = table(spark, d, "customer").select(F.concat_ws("\t", F.format_string("p%07d", "c_custkey"), F.lit("x"), cell).alias("line"))
    path = sinks.work_folder(spark, "platform")
    spark.createDataFrame([("#comment",), ("ID\tOther\tGene Symbol",)], "line string").unionByName(body).write.text(path)
    return readers.read_annotation(spark, path, "ID", "Gene Symbol", ["BUILDING", "MACHINERY"])


ANNOTATION = """SELECT format('p{:07d}', c_custkey) AS probe, upper(c_mktsegment) AS symbol FROM customer WHERE c_custkey % 3 <> 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY')"""


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.struct("s_nationkey", "s_acctbal").alias("about"))
    path = sinks.work_folder(spark, "json")
    rows.write.json(path)
    return readers.read_json(spark, path, "s_suppkey long, s_name string, about struct<s_nationkey: int, s_acctbal: double>").select("s_suppkey", "s_name", "about.s_nationkey", "about.s_acctbal")


JSON = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


def manifest_guard(spark: SparkSession, d: str) -> DataFrame:
    """What a guard finds after the files of one brand were written anew: its old file is missing, its new one unlisted."""
    parts = table(spark, d, "part").select(F.regexp_replace("p_brand", "[^0-9]", "").alias("brand"), "p_partkey", "p_size").repartition("brand")
    path = sinks.work_folder(spark, "guarded")
    parts.write.partitionBy("brand").parquet(path)
    guard = readers.SourceGuard(spark, path, sinks.work_folder(spark, "manifest"))
    parts.filter("brand = '13'").drop("brand").coalesce(1).write.mode("overwrite").parquet(f"{path}/brand=13")
    found = guard.differences().filter("name LIKE '%.parquet'")
    return found.groupBy(F.regexp_extract("name", "brand=([0-9]+)", 1).alias("brand"), "problem").agg(F.count(F.lit(1)).alias("n"))


GUARD = "SELECT '13' AS brand, problem, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT p_brand FROM part WHERE regexp_replace(p_brand, '[^0-9]', '', 'g') = '13') JOIN (VALUES ('missing'), ('unlisted')) v(problem) ON true"


def checkpoint_reuse(spark: SparkSession, d: str) -> DataFrame:
    """A second run under the same key reads what the first has written, whatever it would write itself."""
    folder = sinks.work_folder(spark, "keyed")
    totals = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    sinks.keyed_checkpoint(totals, folder, {"rule": 1})
    return sinks.keyed_checkpoint(totals.limit(0), folder, {"rule": 1})


REUSE = "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1"


def markdown_table(spark: SparkSession, d: str) -> DataFrame:
    """A markdown line per nation and region, in the order of keys."""
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("|x")).alias("name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    return sinks.markdown_lines(rows, ["n_nationkey"])


MARKDOWN = "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || n_name || chr(92) || '|x | ' || coalesce(CAST(nullif(n_regionkey, 0) AS VARCHAR), '') || ' |' AS line FROM nation"

QUERIES = {
    "delimited_scan": (delimited_scan, DELIMITED),
    "strict_matrix": (strict_matrix, STRICT),
    "cohort_loader": (cohort_loader, COHORT),
    "class_mean_scan": (class_mean_scan, CLASS_MEANS),
    "audited_scan": (audited_scan, AUDITED),
    "value_p_pairs": (value_p_pairs, PAIRS),
    "series_matrix": (series_matrix, SERIES),
    "annotation_symbols": (annotation_symbols, ANNOTATION),
    "json_round_trip": (json_round_trip, JSON),
    "manifest_guard": (manifest_guard, GUARD),
    "checkpoint_reuse": (checkpoint_reuse, REUSE),
    "markdown_table": (markdown_table, MARKDOWN),
}
