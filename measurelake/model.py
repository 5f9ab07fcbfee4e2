"""Canonical schemas and the registry dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MEASUREMENT = T.StructType(
    [
        T.StructField("cohort", T.StringType(), False),
        T.StructField("probe", T.StringType(), False),
        T.StructField("sample", T.StringType(), False),
        T.StructField("beta", T.DoubleType(), True),
    ]
)
SAMPLE = T.StructType(
    [
        T.StructField("cohort", T.StringType(), False),
        T.StructField("sample", T.StringType(), False),
        T.StructField("patient", T.StringType(), False),
        T.StructField("tissue", T.StringType(), False),
        T.StructField("pair_verified", T.BooleanType(), True),
        T.StructField("age", T.IntegerType(), True),
        T.StructField("sex", T.StringType(), True),
        T.StructField("site", T.StringType(), True),
    ]
)
SURVIVAL = T.StructType(
    [
        T.StructField("study_id", T.StringType(), False),
        T.StructField("duration", T.LongType(), False),
        T.StructField("event", T.IntegerType(), False),
    ]
)


def registry_rows(spark: SparkSession, registry: dict[str, list[str]]) -> DataFrame:
    """gene, probe and the probe's place within its gene, in the registry's order."""
    one = spark.createDataFrame([(registry,)], "m map<string,array<string>>")
    genes = one.select(F.explode("m").alias("gene", "probes"))
    return genes.select("gene", F.posexplode("probes").alias("gene_probe_index", "probe"))
