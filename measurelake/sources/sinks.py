"""Sinks: deterministic text tables, markdown, atomic keyed checkpoints, safe restore."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import ContractError


def write_text_table(df: DataFrame, path: str, order: list[str], sep: str = "\t") -> None:
    """A distributed CSV write; rows are range-partitioned by ``order``, so files in name order are sorted."""
    df.orderBy(*order).write.csv(path, sep=sep, header=True, mode="errorifexists")


def write_small_gzip(df: DataFrame, path: str, order: list[str], sep: str = "\t", limit: int = 1_000_000) -> str:
    """One byte-for-byte reproducible gzip file of a small result; returns its SHA-256."""
    frame = df.orderBy(*order).limit(limit + 1).toPandas()
    if len(frame) > limit:
        raise ValueError(f"more than {limit} rows; use write_text_table")
    data = gzip.compress(frame.to_csv(sep=sep, index=False, float_format="%.10g", lineterminator="\n").encode(), mtime=0)
    temporary = f"{path}.tmp"
    Path(temporary).write_bytes(data)
    os.replace(temporary, path)
    return hashlib.sha256(data).hexdigest()


def to_markdown(df: DataFrame, order: list[str], limit: int = 1000) -> str:
    """A markdown table of a small result; more than ``limit`` rows raise."""
    rows = df.orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"over {limit} rows")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)]) + "\n"


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """``order`` and line: the rows of a markdown table of any size, built where the rows are; the header is `markdown_header`."""
    cell = lambda c: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    return df.select(*order, F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("line"))


def markdown_header(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that driver and executors share; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="measurelake-")
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_json(value: dict, path: str) -> None:
    """JSON without NaN or infinities, written whole or not at all."""
    temporary = f"{path}.tmp"
    Path(temporary).write_text(json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n")
    os.replace(temporary, path)


def keyed_checkpoint(df: DataFrame, folder: str, key: dict) -> DataFrame:
    """``df`` written once under a digest of ``key`` and read back; a run with the same key reuses it.

    The write commits by Spark's protocol: a folder without _SUCCESS is not used.
    """
    spark: SparkSession = df.sparkSession
    digest = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:24]
    path = f"{folder}/{digest}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def restore(catalog: list[dict], source: str, target: str) -> list[str]:
    """Copy catalogued files (package_path, source_path, sha256) under ``target``.

    Refuses paths that leave their folder, links, changed content and targets
    that exist with other content; nothing is written unless all checks pass.
    """
    root, base = Path(source).resolve(), Path(target).resolve()
    plan = []
    for row in catalog:
        for part in (row["package_path"], row["source_path"]):
            pure = PurePosixPath(part)
            if pure.is_absolute() or ".." in pure.parts:
                raise ContractError(f"path leaves its folder: {part}")
        origin, goal = root / row["package_path"], base / row["source_path"]
        if origin.is_symlink() or root not in origin.resolve().parents or base not in goal.resolve().parents:
            raise ContractError(f"path leaves its folder: {row['package_path']}")
        if hashlib.sha256(origin.read_bytes()).hexdigest() != row["sha256"]:
            raise ContractError(f"checksum differs: {row['package_path']}")
        if goal.exists() and hashlib.sha256(goal.read_bytes()).hexdigest() != row["sha256"]:
            raise ContractError(f"target exists with other content: {row['source_path']}")
        plan.append((origin, goal))
    for origin, goal in plan:
        goal.parent.mkdir(parents=True, exist_ok=True)
        if not goal.exists():
            shutil.copyfile(origin, goal)
    return [str(goal) for _, goal in plan]
