"""Readers of measurement matrices and archives, as distributed scans."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from ..contracts import ContractError
from ..functions.scalar import out_of_range, token_to_double


def read_delimited(spark: SparkSession, path: str, schema, sep: str = "\t") -> DataFrame:
    """A TSV or CSV (gzip too) with a given schema; only empty cells are missing, "NA" is text."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, nullValue="", enforceSchema=False, mode="FAILFAST")


def matrix_header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """The header cells, checked for duplicates before anything is parsed."""
    first = spark.read.text(path).limit(1).first()
    cells = first[0].rstrip("\r\n").split(sep) if first else []
    if len(set(cells)) != len(cells):
        raise ContractError(f"duplicate columns: {sorted({c for c in cells if cells.count(c) > 1})}")
    return cells


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", probe: str = "probe") -> DataFrame:
    """A wide matrix in long form: probe, sample, beta and error (a bad token or a value out of range).

    Cells stay text until ``token_to_double``; an error column lets the caller
    report all bad cells instead of the first.
    """
    samples = matrix_header(spark, path, sep)[1:]
    schema = ", ".join(f"`{c}` string" for c in [probe, *samples])
    wide = spark.read.csv(path, sep=sep, header=True, schema=schema, nullValue="\u0000")
    long = wide.unpivot([probe], samples, "sample", "cell") if samples else wide.withColumns({"sample": F.lit(""), "cell": F.lit("")}).limit(0)
    cell = token_to_double(F.coalesce("cell", F.lit("")))
    value = out_of_range(cell["value"], tolerance=0.0)
    return long.select(F.col(probe).alias("probe"), "sample", value["value"].alias("beta"), (cell["error"] | value["error"]).alias("error"))


def strict_matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """``read_matrix`` that raises on a bad cell or a probe on several lines."""
    long = read_matrix(spark, path, sep)
    if bad := long.filter("error").head(3):
        raise ContractError(f"bad cells: {[r.asDict() for r in bad]}")
    if twice := long.groupBy("probe", "sample").count().filter("count > 1").head(3):
        raise ContractError(f"duplicate probes: {[r.probe for r in twice]}")
    return long.drop("error")


def load_cohort(matrix: DataFrame, samples: DataFrame) -> DataFrame:
    """Matrix and metadata joined; raises unless their sample sets are equal."""
    from ..contracts import assert_equal_keys, validated_join

    assert_equal_keys(matrix, samples, ["sample"])
    return validated_join(matrix, samples, ["sample"], validate="m:1")


def scan_targets(spark: SparkSession, path: str, targets: list[str], sep: str = "\t") -> DataFrame:
    """Lines of a wide text matrix whose first cell is a target: key, cells, and the line's cell count."""
    lines = spark.read.text(path)
    key = F.substring_index("value", sep, 1)
    kept = lines.filter(key.isin(*targets)).select(key.alias("key"), F.split("value", sep).alias("cells"))
    return kept.withColumn("n_cells", F.size("cells")).withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy("key")))


@dataclass(frozen=True)
class Audit:
    """What one pass over a text matrix has seen: lines under the header, their characters, defects, and an order-free digest."""

    lines: int
    characters: int
    ragged: int
    bad_tokens: int
    digest: str

    def problems(self, expected: dict[str, object]) -> list[str]:
        """Every difference from what is expected, and every defect."""
        found = [f"{k}: {getattr(self, k)}, expected {v}" for k, v in expected.items() if getattr(self, k) != v]
        return found + [f"{n} {what}" for what, n in (("ragged lines", self.ragged), ("bad tokens", self.bad_tokens)) if n]


def audited_scan(spark: SparkSession, path: str, targets: DataFrame, into: str, sep: str = "\t") -> tuple[DataFrame, Audit]:
    """Lines of a wide text matrix whose key is in ``targets`` (column key), kept in one pass that also audits every line.

    The pass writes key, cells and the key's number of lines to ``into``; counts
    of lines, characters, ragged lines and bad tokens and a digest (the sum of
    the lines' hashes, whatever their order and file) are observed on the way,
    before the filter.  The header's line may stand in every file.
    """
    header = matrix_header(spark, path, sep)
    width = len(header)
    lines = spark.read.text(path).filter(F.col("value") != sep.join(header))
    cells = F.split("value", sep, -1)
    bad = F.size(F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: token_to_double(c)["error"]))
    metrics = [
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("characters"),
        F.count_if(F.size(cells) != width).alias("ragged"),
        F.coalesce(F.sum(bad), F.lit(0)).alias("bad_tokens"),
        F.coalesce(F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"),
    ]
    seen = Observation("audit")
    observed = lines.observe(seen, *metrics)
    keyed = observed.select(F.substring_index("value", sep, 1).alias("key"), cells.alias("cells"))
    keyed.join(targets.select("key").distinct(), "key", "left_semi").write.parquet(into)
    kept = spark.read.parquet(into)
    twice = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"))
    try:
        found = seen.get
    except Py4JJavaError:  # a scan that no target can match is left out by the planner: the audit is then a pass of its own
        found = lines.agg(*metrics).first().asDict()
    return kept.join(twice, "key"), Audit(**found)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; anything else in them, NaN included, raises when it is read."""
    options = {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}
    return spark.read.schema(schema).options(**options).json(path)


def class_means(long: DataFrame, classes: DataFrame, value: str = "beta") -> DataFrame:
    """Mean and count of each sample's probes by class (probe, class), in one pass over the matrix."""
    return long.join(F.broadcast(classes), "probe").groupBy("sample", "class").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def read_value_p_pairs(wide: DataFrame, probe: str, samples: list[str], limit: float = 0.01, suffix: str = " Detection Pval") -> DataFrame:
    """Alternating value and detection-p columns: probe, sample and the value where p is below the limit."""
    pairs = F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").cast("double").alias("v"), F.col(f"`{s}{suffix}`").cast("double").alias("p")) for s in samples])
    long = wide.select(F.col(probe).alias("probe"), F.explode(pairs).alias("x"))
    return long.select("probe", "x.sample", F.when(F.col("x.p") < limit, F.col("x.v")).alias("beta"))


def read_series_matrix(spark: SparkSession, path: str, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A series-matrix text: sample metadata (sample, field, value) and the table (probe, sample, value).

    The metadata lines are few and are keyed by position; the table's lines are
    split where they lie, with the header's accessions known from metadata.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    cells = F.transform(F.split("line", "\t"), lambda c: F.regexp_replace(c, '^"|"$', ""))
    meta = lines.filter("line like '!Sample_%'").select(cells.alias("c"))
    fields = meta.select(F.regexp_replace(F.get("c", 0), "^!Sample_", "").alias("key"), F.posexplode(F.slice("c", 2, F.size("c"))).alias("at", "value"))
    names = fields.filter("key = 'geo_accession'").select("at", F.col("value").alias("sample"))
    keyed = F.regexp_extract("value", r"^([^:]+):\s*(.*)$", 1)
    rows = fields.join(F.broadcast(names), "at").filter("key <> 'geo_accession'")
    rows = rows.select(
        "sample",
        F.when((F.col("key") == "characteristics_ch1") & (keyed != ""), F.lower(F.trim(keyed))).otherwise(F.col("key")).alias("field"),
        F.when((F.col("key") == "characteristics_ch1") & (keyed != ""), F.regexp_extract("value", r"^([^:]+):\s*(.*)$", 2)).otherwise(F.col("value")).alias("value"),
    )
    body = lines.filter("line not like '!%' and line <> ''").select(cells.alias("c")).filter(F.get("c", 0) != "ID_REF")
    if wanted is not None:
        body = body.filter(F.get("c", 0).isin(*wanted))
    values = body.select(F.get("c", 0).alias("probe"), F.posexplode(F.slice("c", 2, F.size("c"))).alias("at", "cell"))
    table = values.join(F.broadcast(names), "at").select("probe", "sample", token_to_double(F.col("cell"))["value"].alias("value"))
    return rows, table


def read_annotation(spark: SparkSession, path: str, id_col: str, symbol_col: str, symbols: list[str]) -> DataFrame:
    """Probe and symbol of a platform annotation: comment lines before the header, unique symbols of a wanted set."""
    from ..functions.scalar import symbol

    lines = spark.read.text(path).filter("value not like '#%' and value not like '!%' and value not like '^%' and value <> ''")
    header = lines.filter(F.col("value").contains(id_col) & F.col("value").contains(symbol_col)).limit(1).first()[0].split("\t")
    c = F.split("value", "\t")
    rows = lines.select(F.get(c, header.index(id_col)).alias("probe"), symbol(F.get(c, header.index(symbol_col))).alias("symbol"))
    return rows.filter(F.col("symbol").isin(*symbols))


def read_zip_members(spark: SparkSession, path: str, wanted: list[str], sep: str = "\t") -> DataFrame:
    """member, key and value of wanted keys in every two-column text member of the archives at ``path``.

    One archive is one task; members are streamed and left early when all wanted keys are found.
    """
    targets = set(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        rows = []
                        with archive.open(member) as lines:
                            for line in io.TextIOWrapper(lines, "utf-8"):
                                key, _, value = line.rstrip("\r\n").partition(sep)
                                if key in targets:
                                    rows.append((member, key, value))
                                    if len(rows) == len(targets):
                                        break
                        yield pd.DataFrame(rows, columns=["member", "key", "value"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "member string, key string, value string")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """name (the path below ``path``), bytes and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = "/" + path.rstrip("/").rsplit("/", 1)[-1] + "/"
    return files.select(F.substring_index("path", below, -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name and problem: missing, unlisted or changed."""
    both = found.join(expected.select("name", F.col("sha256").alias("wanted")), "name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("wanted").isNull(), "unlisted").when(F.col("sha256") != F.col("wanted"), "changed")
    return both.select("name", problem.alias("problem")).filter("problem is not null")


class SourceGuard:
    """Holds what files were before a run; ``verify`` raises if any has changed, gone or come since."""

    def __init__(self, spark: SparkSession, path: str, into: str):
        self._spark, self._path = spark, path
        # Written out: a lazy manifest would be taken after the run.
        file_manifest(spark, path).write.parquet(into)
        self._before = spark.read.parquet(into)

    def differences(self) -> DataFrame:
        return manifest_differences(file_manifest(self._spark, self._path), self._before)

    def verify(self) -> None:
        if found := self.differences().orderBy("name").head(5):
            raise ContractError(f"sources changed: {[(r.name, r.problem) for r in found]}")
