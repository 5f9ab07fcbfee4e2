"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only.

Base spans come from four patterns (e-mail, IP address, card, phone), each
found leftmost and without overlap; matches that fail their test are dropped
and not retried.  Those values are the protected entities.

The sanitisation asks how much a term (a run of two or more letters and digits)
near an entity tells about it.  Every mention has a context: the terms that
stand whole within ``CONTEXT_CHARS`` characters on either side, whatever else is
mentioned there.  Equal contexts of an entity count once, so copies of a text are
no evidence.  With N corpus windows of that size, n_e contexts of entity e, n_et
of them with term t and n_t occurrences of t in the whole corpus, the pointwise
mutual information is PMI = log2(n_et * N / (n_e * n_t)) and the entity's
information content is IC = log2(N / n_e), the largest value PMI can take.
Small counts are discounted (Pantel and Lin) by n_et / (n_et + 1) times
m / (m + 1), m the smaller of n_e and n_t.  A term whose discounted PMI reaches
``DISCLOSURE`` * IC discloses e; its occurrences in documents that mention e
become spans of kind "term", to be generalised with the rest.  In a single
context every word that occurs nowhere else would reach IC, so pairs are tested
from two different contexts on.

Patterns are written so that the regular-expression engine neither recurses
per character nor rescans a run from each of its characters.

Defined cases: null text is empty text and has no spans; repeated rows are
judged row by row; positions are code points, ends exclusive; a term inside a
base span is not listed again; of spans with one start the kinds come in the
order of ``KINDS``, terms last; long texts are searched whole; other columns of
the input, whatever their names, do not matter; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage_table, with_rows

_LOCAL = "[A-Za-z0-9._%+-]"
#: (kind, pattern); \G lets a match start right where the one before ended.
KINDS = (
    ("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TERM = "term"
CONTEXT_CHARS = 100
DISCLOSURE = 0.4
#: Candidate terms are broadcast up to this many (some tens of bytes each).
BROADCAST_TERMS = 200_000
_TERM_WORD = r"[\p{L}\p{N}]{2,}+"
#: What a context's edge cuts: the rest of a word, or the one character beyond the edge.
_CUT = r"(?:[\p{L}\p{N}]++|[^\p{L}\p{N}])"


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's test."""

    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(part, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(value, r"\."), small))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
        .otherwise(n.between(10, 15))
    )


_MATCH = "struct<kind:string,i:int,gap:int,value:string>"


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Matches of one kind in order: kind, i, gap (characters since the match before) and value."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), x["m"].alias("value")),
    )


def _may_hold(text: Column) -> dict[str, Column]:
    """Cheap conditions without which a text has no match of the kind."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}


def _mentions(docs: DataFrame) -> DataFrame:
    """One row per valid match, and one with null kind per row: row, doc_id, n_chars, kind, value, start, end."""
    text = F.col("text")
    may = _may_hold(text)
    columns = [F.when(may[kind], _found(text, kind, pattern)).alias(kind) for kind, pattern in KINDS]
    wide = docs.select("row", "doc_id", F.length("text").alias("n_chars"), *columns)
    parts = F.concat(F.array(F.lit(None).cast(_MATCH)), *[F.coalesce(k, F.array().cast(f"array<{_MATCH}>")) for k, _ in KINDS])
    long = wide.select("row", "doc_id", "n_chars", F.explode(parts).alias("x")).select("row", "doc_id", "n_chars", "x.*")
    own = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(own).cast("long")
    placed = long.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.filter(F.col("kind").isNull() | _valid(F.col("kind"), F.col("value"))).drop("i", "gap")


def _contexts(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, row and near (the distinct terms around it, sorted) of every mention."""
    may = _may_hold(F.col("text"))
    texts = docs.filter(may["email"] | may["card"] | may["phone"]).select("row", "text")
    own = mentions.filter("kind is not null").select("row", F.concat_ws(":", "kind", F.lower("value")).alias("entity"), "start", "end")
    both = own.join(texts, "row")
    start, end, reach = F.col("start").cast("int"), F.col("end").cast("int"), F.lit(CONTEXT_CHARS)
    text = F.col("text")
    # One character more than the context tells whether its edge cuts a word.
    left = F.substring(text, F.greatest(start - reach, F.lit(1)), F.least(start, reach + 1))
    left = F.when(start > reach, F.regexp_replace(left, f"^{_CUT}", "")).otherwise(left)
    right = F.substring(text, end + 1, reach + 1)
    right = F.when(F.length(right) > reach, F.regexp_replace(right, f"{_CUT}$", "")).otherwise(right)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_TERM_WORD), F.lit(0))
    return both.select("entity", "row", F.array_sort(F.array_distinct(F.concat(words(left), words(right)))).alias("near"))


def _disclosing(mentions: DataFrame, docs: DataFrame, n_chars: int) -> DataFrame | None:
    """(row, term): which terms are to go in which rows; None if no term comes into question."""
    named = stage_table(_contexts(mentions, docs), "pii-contexts")
    contexts = named.groupBy("entity", F.xxhash64("near").alias("context")).agg(F.first("near").alias("near"))
    sizes = contexts.groupBy("entity").agg(F.count("*").alias("n_e")).filter("n_e > 1")
    pairs = contexts.select("entity", F.explode("near").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et")).filter("n_et > 1")
    joint = stage_table(joint.join(sizes, "entity"), "pii-joint")
    terms = joint.select("term").distinct()
    size = terms.count()
    if not size:
        return None
    hint = F.broadcast if size <= BROADCAST_TERMS else (lambda frame: frame)
    every = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_TERM_WORD), F.lit(0))).alias("term"))
    counts = every.join(hint(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    windows = max(2.0, n_chars / (2 * CONTEXT_CHARS))
    n_e, n_et, n_t = (F.col(c).cast("double") for c in ("n_e", "n_et", "n_t"))
    low = F.least(n_e, n_t)
    pmi = F.log2(n_et * windows / (n_e * F.greatest(n_t, n_et))) * n_et / (n_et + 1) * low / (low + 1)
    content = F.log2(F.lit(windows) / n_e)
    told = joint.join(counts, "term").filter((content > 0) & (pmi >= content * DISCLOSURE)).select("entity", "term")
    told = stage_table(told, "pii-terms")
    few = told.count() <= BROADCAST_TERMS
    # An entity on every page is a hot key of this join: it is broadcast or left to adaptive skew handling.
    return named.select("entity", "row").distinct().join(F.broadcast(told) if few else told, "entity").select("row", "term").distinct()


def _term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """row, kind, start and end of the occurrences of the disclosing terms."""
    concerned = docs.join(told.select("row").distinct(), "row", "left_semi")
    word = F.regexp_extract_all("text", F.lit(_TERM_WORD), F.lit(0))
    gaps = F.split("text", _TERM_WORD, -1)
    pairs = F.arrays_zip(word.alias("w"), F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))).alias("g"))
    every = concerned.select("row", F.posexplode(pairs).alias("i", "x"))
    own = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("x.g") + F.length("x.w")).over(own).cast("long")
    placed = every.select("row", F.lower("x.w").alias("term"), end.alias("end"), F.length("x.w").alias("n"))
    return placed.join(told, ["row", "term"], "left_semi").select(
        "row", F.lit(TERM).alias("kind"), (F.col("end") - F.col("n")).alias("start"), "end"
    )


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id and spans - an array of (start, rank, kind, end), sorted - of every row of ``docs``.

    ``row`` numbers the rows of ``docs`` as read; ``numbered`` gives the same numbers.
    """
    docs = numbered(docs, id_col, text_col)
    mentions = stage_table(_mentions(docs), "pii-mentions")
    n_chars = mentions.filter("kind is null").agg(F.sum("n_chars")).first()[0]
    rank = F.array_position(F.array(*[F.lit(k) for k, _ in KINDS], F.lit(TERM)), F.col("kind")).cast("int")
    base = mentions.select("row", "doc_id", "kind", "start", "end")
    told = _disclosing(mentions, docs, n_chars or 0)
    if told is not None:
        told = stage_table(told, "pii-told")
        added = _term_spans(docs, told).select("row", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end")
        base = base.union(added)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "kind", "end"))
    gathered = base.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    basic = F.filter("spans", lambda s: s["kind"] != TERM)
    clear = lambda s: (s["kind"] != TERM) | ~F.exists(basic, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return gathered.select("row", "doc_id", F.filter("spans", clear).alias("spans"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id and text (null: empty) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return with_rows(docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))).select("row", "doc_id", "text")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def generalise(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def merge(done, s):
        last = F.element_at(done, -1)
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = (F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] <= s["start"])
        return F.when(apart, F.concat(done, F.array(new))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        )

    merged = F.aggregate(spans, empty, merge)

    def piece(s, i):
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(merged, i - 1)["end"])
        kept = F.substring(text, (before + 1).cast("int"), (s["start"] - before).cast("int"))
        return F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))

    tail = F.substring(text, (F.element_at(merged, -1)["end"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(merged, piece), ""), tail))
