"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Words are runs of letters and digits after lower-casing A-Z.  An item's
windows are its runs of ``window`` words; an item of fewer words is one window.
A window occurs in a document if all its words stand there in order.

The documents are read, split and hashed once.  Of their shingle positions only
those are kept whose shingle is in some window, each with the words that a
window there could cover; they and one row per document are written out, and
all that follows reads that table.

Containment means that every shingle of a window must be in the document, so
one shingle is a sufficient prefix: shingles are ordered by how rarely they
occur in the corpus and each window is joined on its rarest one.  A join hit at
document position p and window offset o proposes the start p - o; the
positional bound (the start is not negative) and the length bound (the window
fits before the document's end) prune it, and comparing the window's words
with the document's verifies it exactly.  Only verified occurrences are shuffled.

The shingles of the benchmark are broadcast up to ``BROADCAST_KEYS`` and the
window table up to ``BROADCAST_BYTES``.  Beyond that the words are written out
with row numbers, positions are joined by shuffling (row, position, shingle),
which adaptive execution splits where a shingle is hot, and the words are
fetched for the positions that remain.

Defined cases: null or empty texts have no words, so no windows and no hits;
items with equal windows all count; repeated rows are judged row by row; an
empty benchmark leaves every document clean; windows of items with a null id
count as hits, only the id is not listed; long texts
are dealt with in blocks of ``BLOCK_WORDS`` words; other columns of either table, whatever their names, do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stage_table

#: What a word is made of, as the contract states it; texts are split at everything else.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ASCII = "".join(map(chr, range(128)))
_SPLIT = "".join(c.lower() if c.isalnum() else " " for c in _ASCII)
#: Keys are longs, some 30 bytes each in a hash relation.
BROADCAST_KEYS = 2_000_000
BROADCAST_BYTES = 64_000_000
BLOCK_WORDS = 512


def words_of(text: Column) -> Column:
    """The words of a text: characters are mapped once, then split at a single one."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _ASCII, _SPLIT), " "), "")


def _shingle(words: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from zero-based position ``at``."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(width)])


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """item_id, n (words in the window) and ws (its words) of every distinct window of every item."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words"))
    items = items.filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = items.select("item_id", "words", F.explode(starts).alias("s"))
    ws = F.slice("words", F.col("s") + 1, F.lit(window))
    return windows.select("item_id", ws.alias("ws")).distinct().withColumn("n", F.size("ws"))


def _placed(windows: DataFrame, width: int) -> DataFrame:
    """Every shingle of every window: item_id, ws, n, width, o (its offset) and shingle.

    Windows of fewer than ``width`` words have shingles of one word.
    """
    size = F.when(F.col("n") < width, 1).otherwise(width)
    placed = windows.select("*", size.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("o"))
    wide, single = (_shingle(F.col("ws"), F.col("o"), w) for w in (width, 1))
    return placed.withColumn("shingle", F.when(F.col("width") == width, wide).otherwise(single))


def _blocks(window: int) -> Column:
    """The document in blocks of ``BLOCK_WORDS`` words, each with the words that windows reach on either side.

    base is the block's first position, low that of its first word in ws.  A row
    for a position thus never carries more than a block.
    """
    words, n = F.col("words"), F.size("words")
    count = F.greatest(F.ceil(n / F.lit(BLOCK_WORDS)).cast("int"), F.lit(1))

    def block(b):
        base = b * BLOCK_WORDS
        low = F.greatest(base - (window - 1), F.lit(0))
        ws = F.slice(words, low + 1, base + (BLOCK_WORDS + window - 1) - low)
        return F.struct(base.alias("base"), low.alias("low"), ws.alias("ws"))

    return F.transform(F.sequence(F.lit(0), count - 1), block)


def _positions(base: DataFrame, keys: DataFrame, widths: list[int], n_keys: int, window: int) -> DataFrame:
    """One row per document (p is -1) and one per position with a shingle of the benchmark.

    Columns: row, doc_id, n_words, p, a column h<width> for each width of
    shingles, and near.  ``base`` has row, doc_id and words.
    """
    small = n_keys <= BROADCAST_KEYS
    blocks = base.select("row", "doc_id", F.size("words").alias("n_words"), F.explode(_blocks(window)).alias("b"))
    blocks = blocks.select("row", "doc_id", "n_words", "b.base", "b.low", "b.ws")
    if not small:
        blocks = stage_table(blocks, "decontaminate-words")
    first = F.when(F.col("base") == 0, -1).otherwise(F.col("base"))
    last = F.greatest(F.least(F.col("base") + BLOCK_WORDS, F.col("n_words")) - 1, first)
    every = blocks.select("*", F.explode(F.sequence(first, last)).alias("p"))
    p, q = F.col("p"), F.col("p") - F.col("low")
    flat = every.select("*", *[F.when(p >= 0, _shingle(F.col("ws"), q, w)).alias(f"k{w}") for w in widths])
    near = _near(F.col("ws"), q, window)
    if not small:
        flat = flat.drop("ws", "doc_id", "low")
    for w in widths:
        own = keys.filter(F.col("width") == w).select(F.col("shingle").alias(f"k{w}"), F.col("shingle").alias(f"h{w}"))
        flat = flat.join(F.broadcast(own) if small else own, f"k{w}", "left")
    known = [f"h{w}" for w in widths]
    # Plain predicates only: rows leave the generated loop after this filter, with ``near`` and not the block.
    found = F.coalesce(*known).isNotNull()
    if small:
        out = flat.filter((p == -1) | found).select("row", F.when(p == -1, F.col("doc_id")).alias("doc_id"), "n_words", "p", *known, F.when(p >= 0, near).alias("near"))
    else:
        kept = flat.filter((p >= 0) & found).select("row", "base", "p", *known).join(blocks.drop("doc_id"), ["row", "base"])
        kept = kept.select("row", F.lit(None).alias("doc_id"), "n_words", "p", *known, near.alias("near"))
        alone = blocks.filter("base = 0").select("row", "doc_id", "n_words", F.lit(-1).alias("p"), *[F.lit(None).alias(k) for k in known], F.lit(None).alias("near"))
        out = alone.union(kept)
    return stage_table(out, "decontaminate-positions")


def _near(words: Column, q: Column, window: int) -> Column:
    """The words that a window with a shingle at place ``q`` may cover."""
    low = F.greatest(q - (window - 1), F.lit(0))
    return F.slice(words, low + 1, q + window - low)


def occurrences(positions: DataFrame, windows: DataFrame, width: int, window: int) -> DataFrame:
    """row, start, n and items of every occurrence of a window."""
    placed = _placed(windows, width)
    shingles = F.array(*[F.struct(F.lit(int(k[1:])).alias("width"), F.col(k).alias("shingle")) for k in positions.columns if k[0] == "h"])
    at = positions.filter("p >= 0").select("row", "n_words", "p", "near", F.explode(shingles).alias("h"))
    at = at.select("row", "n_words", "p", "near", "h.width", "h.shingle").filter("shingle is not null")
    # Rarity: how often each benchmark shingle occurs in the corpus.
    rarity = at.groupBy("width", "shingle").agg(F.count("*").alias("df"))
    # A window of which some shingle never occurs cannot occur itself: the left join finds it.
    ranked = placed.join(rarity, ["width", "shingle"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = ranked.groupBy("ws", "n", "width").agg(
        F.min_by(F.struct("shingle", "o"), F.struct("df", "o")).alias("rarest"),
        F.min("df").alias("least"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    prefix = prefix.filter("least > 0").select("width", "rarest.shingle", "rarest.o", "ws", "n", "items")
    prefix = stage_table(prefix, "decontaminate-prefix")
    octets = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16)
    size = prefix.agg(F.sum(octets("ws") + octets("items") + 64)).first()[0] or 0
    start = F.col("p") - F.col("o")
    low = F.greatest(F.col("p") - (window - 1), F.lit(0))
    bounds = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.slice("near", F.greatest(start - low, F.lit(0)) + 1, F.col("n")) == F.col("ws")
    joined = at.join(F.broadcast(prefix) if size <= BROADCAST_BYTES else prefix, ["width", "shingle"])
    return joined.filter(bounds).filter(same).select("row", start.alias("start"), "n", "items")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle_width: int = 3,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids) and contaminated of every row of ``docs``."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    windows = stage_table(item_windows(benchmark, item_id_col, item_text_col, window), "decontaminate-windows")
    keys = stage_table(_placed(windows, shingle_width).select("width", "shingle").distinct(), "decontaminate-keys")
    sizes = {r["width"]: r["count"] for r in keys.groupBy("width").count().collect()}
    # The row numbers are made in the pass that writes this table and never again.
    positions = _positions(base, keys, sorted(sizes) or [shingle_width], sum(sizes.values()), window)
    hits = occurrences(positions, windows, shingle_width, window)
    none = F.array().cast("array<string>")
    spans = hits.groupBy("row", "start").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    per_doc = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Length of the union of the spans, in order of their starts.
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["covered"] + F.greatest(s["start"] + s["n"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("covered"),
            F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
        ),
    )["covered"]
    per_doc = per_doc.select("row", union.cast("long").alias("n_hit"), "items")
    merged = positions.filter("p = -1").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")).join(per_doc, "row", "left")
    merged = merged.select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items")
    )
    return merged.select(
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.col("n_hit") > 0).alias("contaminated"),
    )
