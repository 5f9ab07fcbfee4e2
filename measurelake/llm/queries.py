"""The contract queries of the training-data operators: thin digests of their real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import brown_lm, decontaminate, html_extract, langid, licenses, packing, pattern_packing, pii, quality_cnn, ranked, sessions, simhash, voronoi_knn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.knn_join(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scores_of(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_of(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != pii.TERM)

    def number(kind: str):
        # A lambda with two arguments would be given the index as the second one.
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(kind) for kind, _ in pii.KINDS],
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessionise(_table(spark, sf_dir, "clicks"))
    digest = F.sha2(F.col("path").cast("binary"), 256).alias("path_sha256")
    names = {"client": "client_id", "session": "session_id", "start": "start_us", "last": "end_us", "n_clicks": "n_clicks", "n_late": "n_late", "cents": "value_cents", "closed_by": "closed_by"}
    return found.select(*[F.col(a).alias(b) for a, b in names.items()], digest)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked.build_index(_table(spark, sf_dir, "documents"))
    found = ranked.search(index, _table(spark, sf_dir, "benchmark"), k=10)
    return found.withColumnRenamed("query_id", "item_id")


def op13_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack_patterns(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_voronoi_knn": op2_voronoi_knn,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_packing": op5_packing,
        "op6_brown_lm": op6_brown_lm,
        "op7_license_scan": op7_license_scan,
        "op8_quality": op8_quality,
        "op9_pii": op9_pii,
        "op10_simhash": op10_simhash,
        "op11_sessions": op11_sessions,
        "op12_ranked_search": op12_ranked_search,
        "op13_pattern_packing": op13_pattern_packing,
    }


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{decontaminate.WORD}')"

#: Every pair of a query and a candidate; sums of products of whole numbers are exact in doubles.
OP2 = """WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM w q JOIN w c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

#: Every run of words of every document against every window.
OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(0, greatest(len(w) - 10, 0) + 1), lambda s: array_to_string(w[s + 1:s + 10], ' '))) AS ws FROM i WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda s: {{'s': s, 'ws': array_to_string(w[s + 1:s + n], ' ')}})) AS x FROM d, l WHERE len(w) >= n),
h AS (SELECT DISTINCT doc_id, dw.x.s AS s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.x.ws = iw.ws),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; the others are tested against brute force."""
    return {"op2_voronoi_knn": OP2, "op3_decontamination": OP3, "op7_license_scan": licenses.oracle_sql(), "op11_sessions": sessions.ORACLE_SQL, "op12_ranked_search": ranked.ORACLE_SQL}
