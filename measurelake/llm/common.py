"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session, or the folder that the
    program has set.  Where there is neither, a local master (tests) gets a
    folder of our own; a cluster raises, for its executors would write to their
    own disks.  The session's settings stay as they are.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _LOCAL_FALLBACK).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends at the written files, so a lost executor costs a re-read and
    not a recomputation, and row ids made before the write stay fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, _UPPER, _UPPER.lower())


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


#: What a text counts for in a sample besides its characters, so that the number of texts is bounded too.
SAMPLE_TEXT = 16


def text_keys(text: Column) -> list[Column]:
    """What `bounded_sample` needs of a text: its hash ``t`` and its length ``n``."""
    return [F.xxhash64(text).alias("t"), F.length(text).alias("n")]


def bounded_sample(keys: DataFrame, texts: DataFrame, seed: str, most: int, total: int | None = None) -> DataFrame:
    """Distinct (group, mark, text), for each group at most ``most`` characters, ``SAMPLE_TEXT`` more a text.

    ``keys`` has group, mark and the `text_keys` of the texts to draw from,
    ``texts`` the texts themselves (column text): only those that are drawn are
    ever shuffled.  Texts are taken in order of a hash of mark and text if they
    fit into what is left; ids, repeats and the order of rows do not matter.
    ``total`` bounds all groups together, in equal shares.  Where no text of a
    group fits, the first one gives its first characters.  What reaches the driver
    is bounded like the sample.
    """
    spark = keys.sparkSession
    keyed = keys.withColumn("h", F.xxhash64(F.lit(seed), "mark", "t"))
    sizes = keyed.groupBy("group", "h").agg((F.max("n") + SAMPLE_TEXT).alias("n"), F.min("mark").alias("mark"), F.min("t").alias("t"))
    sizes = stage_table(sizes, f"sample-{seed}")
    sums = {r["group"]: r["n"] for r in sizes.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    most = min(most, total // max(len(sums), 1)) if total is not None else most
    parts = 1 << 52
    share = F.lit(0)
    for group, n in sums.items():  # three times what fits, so that there are enough to fill with
        share = F.when(F.col("group").eqNullSafe(F.lit(group)), F.lit(int(min(1.0, 3 * most / max(n, 1)) * parts))).otherwise(share)
    draw = F.pmod("h", F.lit(parts))
    by_draw = Window.partitionBy("group").orderBy(draw, "h")
    near = sizes.filter(draw < share).withColumn("k", F.row_number().over(by_draw)).filter(F.col("k") <= most // SAMPLE_TEXT + 1)
    left: dict = {}
    chosen, first = [], {}
    for r in sorted(near.collect(), key=lambda r: r["k"]):
        room = left.setdefault(r["group"], most)
        first.setdefault(r["group"], r)
        if r["n"] <= room:
            left[r["group"]] -= r["n"]
            chosen.append((r["group"], r["mark"], r["t"], r["n"]))
    filled = {group for group, *_ in chosen}
    chosen += [(group, r["mark"], r["t"], most) for group, r in first.items() if group not in filled]
    # Groups of which the draw has no text at all: their shortest one.
    missing = [group for group in sums if group not in first]
    if missing:
        rest = sizes.filter(F.col("group").isin(missing)).groupBy("group").agg(F.min(F.struct("n", "h", "mark", "t")).alias("s"))
        chosen += [(r["group"], r["s"]["mark"], r["s"]["t"], min(r["s"]["n"], most)) for r in rest.collect()]
    kinds = {c: keys.schema[c].dataType.simpleString() for c in ("group", "mark")}
    wanted = spark.createDataFrame(chosen, f"group {kinds['group']}, mark {kinds['mark']}, t long, n long")
    drawn = texts.select("text", F.xxhash64("text").alias("t")).join(F.broadcast(wanted.select("t").distinct()), "t", "left_semi")
    found = drawn.groupBy("t").agg(F.min("text").alias("text")).join(F.broadcast(wanted), "t")
    return found.select("group", "mark", F.substring("text", F.lit(1), (F.col("n") - SAMPLE_TEXT).cast("int")).alias("text"))


def _scans_files(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of files, filtered and projected at most."""
    kinds = []
    node = df._jdf.queryExecution().optimizedPlan()
    while True:
        kinds.append(node.nodeName())
        below = node.children()
        if below.size() != 1:
            break
        node = below.head()
    return bool(re.match("Relation|LogicalRelation|HadoopFsRelation", kinds[-1])) and set(kinds[:-1]) <= {"Project", "Filter"}


def with_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a key for each row that is the same in every use of the result.

    A scan of files keys its rows by their file (two hashes of its path, 96 bits
    in all) and their place in it, which no packing of files into partitions
    changes; anything else is numbered and written out once.
    """
    if _scans_files(df):
        try:
            path = F.col("_metadata.file_path")
            key = F.struct(F.xxhash64(path).alias("f"), F.hash(path).alias("g"), F.col("_metadata.row_index").alias("i"))
            keyed = df.withColumn(name, key)
            keyed.schema
            return keyed
        except AnalysisException:  # a column called _metadata, or a source without row indexes
            pass
    return stage_table(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with some ``most`` bytes in a string column (one row may have more)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(sizes + 64) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
