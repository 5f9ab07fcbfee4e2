"""Licence scan by the Dice coefficient over word bigrams, in DataFrame operations only.

Texts are normalised (A-Z lower-cased, everything but letters and digits one
space).  The units compared are a text's lines, its paragraphs (parted by empty
lines), the text as a whole, and windows over its words: for every anchor bigram
of a template that occurs, the run of as many words as the template has that
puts the bigram at the template's place.  So a notice is found within a longer
line or paragraph, wrapped or not.  A unit with bigram set A matches a template
with bigram set B if 2|A n B| / (|A| + |B|) >= threshold.  The threshold bounds
the size: |A| must lie between |B| t/(2-t) and |B| (2-t)/t, which prunes
templates before any intersection.  It also bounds the overlap from below, so a
matching unit has at least one of any |B| - overlap + 1 bigrams of the template:
the rarest ones among the templates are the anchors and form one pattern that
whole texts are screened with, which loses no match.

Everything happens within a row; there is no shuffle.

Defined cases: null or empty texts, and units of fewer than two words, match
nothing; equal scores go to the licence first in order; units that are equal
after normalising count once; windows that a text's edge cuts are shorter;
repeated rows repeat; long texts are compared whole; other columns of the input,
whatever their names, do not matter; without templates nothing matches.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower
from .license_templates import TEMPLATES

THRESHOLD = 0.8
_OTHER = r"[^0-9a-z\x80-\x{10FFFF}]+"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), _OTHER, " "))


def _plain(text: str) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.sub("[^0-9a-z\x80-\U0010ffff]+", " ", low).split()


def template_bigrams(text: str) -> list[str]:
    words = _plain(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def prefix_bigrams(templates: list[tuple[str, list[str]]], threshold: float) -> list[list[str]]:
    """For each template, bigrams of which every match must have one; rare ones first."""
    seen: dict[str, int] = {}
    for _, bigrams in templates:
        for b in bigrams:
            seen[b] = seen.get(b, 0) + 1
    out = []
    for _, bigrams in templates:
        # overlap >= t/2 (|A| + |B|) and |A| >= |B| t/(2-t)
        overlap = math.ceil(len(bigrams) * threshold / (2 - threshold) - 1e-9)
        rare = sorted(bigrams, key=lambda b: (seen[b], -len(b), b))
        out.append(rare[: len(bigrams) - overlap + 1])
    return out


def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> list[tuple[str, int, int]]:
    """(bigram, number of the template among those with bigrams, first place in it) of all prefix bigrams."""
    words = [w for _, text in templates if len(w := _plain(text)) > 1]
    known = [("", list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))) for w in words]
    pairs = [[f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    return [(b, t, pairs[t].index(b)) for t, own in enumerate(prefix_bigrams(known, threshold)) for b in own]


def screen_pattern(bigrams: set[str]) -> str:
    """A pattern for any of the bigrams between spaces, as a tree of letters and words."""
    tree: dict[str, dict[str, set[str]]] = {}
    for b in sorted(bigrams):
        first, second = b.split(" ")
        tree.setdefault(first[0], {}).setdefault(first[1:], set()).add(second)
    any_of = lambda parts: "(?:" + "|".join(parts) + ")"
    letters = [
        letter + any_of(f"{rest} {any_of(sorted(seconds))}" for rest, seconds in sorted(firsts.items()))
        for letter, firsts in sorted(tree.items())
    ]
    return " " + any_of(letters) + " "


def _bigrams(unit: Column) -> Column:
    words = F.split(unit, " ")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_units (matching lines, paragraphs, texts), n_windows (matching windows), hits (array of dice, license) of every row."""
    known = [(name, template_bigrams(text)) for name, text in templates]
    lengths = [len(_plain(text)) for (_, text), (_, bigrams) in zip(templates, known) if bigrams]
    known = [(name, bigrams) for name, bigrams in known if bigrams]
    if not known:
        none = F.array().cast("array<struct<dice:double,license:string>>").alias("hits")
        zero = F.lit(0).cast("long")
        return docs.select(F.col(id_col).alias("doc_id"), zero.alias("n_units"), zero.alias("n_windows"), none)
    prefixes = prefix_bigrams(known, threshold)
    pattern = screen_pattern({b for own in prefixes for b in own})
    table = F.array(
        *[
            F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, bigrams)).alias("b"), F.lit(len(bigrams)).alias("n"), F.lit(size).alias("words"))
            for (name, bigrams), size in zip(known, lengths)
        ]
    )
    places: dict[str, list[Column]] = {}
    for bigram, t, o in anchors(templates, threshold):
        places.setdefault(bigram, []).append(F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")))
    anchor = F.create_map(*[c for b, own in places.items() for c in (F.lit(b), F.array(*own))])
    text = F.coalesce(F.col(text_col), F.lit(""))
    padded = lambda unit: F.concat(F.lit(" "), unit, F.lit(" "))
    units = F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t\r]*\n", -1), F.array(text))
    units = F.filter(F.array_distinct(F.transform(units, _normal)), lambda u: padded(u).rlike(pattern))

    def matches(unit):
        def judge(own):
            n = F.size(own)
            near = F.filter(
                table,
                lambda t: (n >= F.ceil(t["n"] * (threshold / (2 - threshold)) - 1e-9))
                & (n <= F.floor(t["n"] * ((2 - threshold) / threshold) + 1e-9)),
            )
            scored = F.transform(
                near,
                lambda t: F.struct(
                    (F.size(F.array_intersect(own, t["b"])) * 2.0 / (n + t["n"])).alias("dice"), t["license"].alias("license")
                ),
            )
            return F.filter(scored, lambda s: s["dice"] >= threshold - 1e-9)

        # A one-element array binds the unit's bigrams once for all templates.
        return F.flatten(F.transform(F.array(_bigrams(unit)), judge))

    def windows(words):
        """dice and license of every window that matches its template."""
        bigram = lambda p: F.concat(F.get(words, p), F.lit(" "), F.get(words, p + 1))
        at = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))),
            lambda p: F.transform(
                F.coalesce(F.try_element_at(anchor, F.coalesce(bigram(p), F.lit(""))), F.array().cast("array<struct<t:int,o:int>>")),
                lambda x: F.struct(F.greatest(p - x["o"], F.lit(0)).alias("start"), x["t"].alias("t")),
            ),
        )

        def judge(x):
            template = F.get(table, x["t"])
            own = F.array_distinct(
                F.transform(
                    F.sequence(x["start"], F.least(x["start"] + template["words"], F.size(words)) - 2),
                    lambda p: bigram(p),
                )
            )
            return F.transform(
                F.array(own),
                lambda a: F.struct(
                    (F.size(F.array_intersect(a, template["b"])) * 2.0 / (F.size(a) + template["n"])).alias("dice"),
                    template["license"].alias("license"),
                ),
            )

        scored = F.flatten(F.transform(F.array_distinct(F.flatten(at)), judge))
        return F.filter(scored, lambda s: s["dice"] >= threshold - 1e-9)

    hit = "array<struct<dice:double,license:string>>"
    per_unit = F.filter(F.transform(units, matches), lambda hits: F.size(hits) > 0)
    screened = padded(_normal(text)).rlike(pattern)
    found = F.when(screened, per_unit).otherwise(F.array().cast(f"array<{hit}>"))
    slid = F.when(screened, F.flatten(F.transform(F.array(F.split(_normal(text), " ")), windows))).otherwise(F.array().cast(hit))
    scanned = docs.select(F.col(id_col).alias("doc_id"), found.alias("found"), slid.alias("slid"))
    return scanned.select(
        "doc_id",
        F.size("found").cast("long").alias("n_units"),
        F.size("slid").cast("long").alias("n_windows"),
        F.concat(F.flatten("found"), "slid").alias("hits"),
    )


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_units, n_windows, licenses (sorted, comma-joined), best_license and best_dice (null: no match)."""
    ordered = F.array_sort(F.transform("hits", lambda h: F.struct((-h["dice"]).alias("d"), h["license"].alias("license"))))
    best = F.get(ordered, 0)
    return scanned.select(
        "doc_id",
        "n_units",
        "n_windows",
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
        best["license"].alias("best_license"),
        F.round(-best["d"], 6).alias("best_dice"),
    )


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result in DuckDB SQL, every unit against every template, every window against its own."""
    places = ", ".join(f"('{b}', {t}, {o})" for b, t, o in anchors(templates, threshold))
    rows = ", ".join(f"({n}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for n, (name, text) in enumerate(templates))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    normal = lambda x: f"trim(regexp_replace(translate({x}, '{upper}', '{upper.lower()}'), '[^0-9a-z\\x80-\\x{{10FFFF}}]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT row_number() OVER (ORDER BY k) - 1 AS t, license, {pairs} AS b, len(w) AS words FROM
        (SELECT k, license, string_split({normal('txt')}, ' ') AS w FROM (VALUES {rows}) v(k, license, txt)) WHERE len(w) > 1),
a AS (SELECT * FROM (VALUES {places}) v(bigram, t, o)),
dw AS (SELECT doc_id, string_split({normal('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL),
dp AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: {{'p': i - 1, 'bigram': w[i] || ' ' || w[i + 1]}})) AS x FROM dw),
ds AS (SELECT DISTINCT doc_id, a.t, greatest(dp.x.p - o, 0) AS s FROM dp JOIN a ON dp.x.bigram = a.bigram),
dv AS (SELECT doc_id, t, s, license, b, {pairs} AS own FROM (SELECT doc_id, t, s, license, b, dw.w[s + 1:s + words] AS w FROM ds JOIN dw USING (doc_id) JOIN t USING (t))),
wm AS (SELECT doc_id, license, 2.0 * len(list_intersect(own, b)) / (len(own) + len(b)) AS dice FROM dv),
wh AS (SELECT * FROM wm WHERE dice >= {threshold} - 1e-9),
u AS (SELECT DISTINCT doc_id, {normal('piece')} AS unit FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS piece FROM documents UNION ALL
        SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents UNION ALL
        SELECT doc_id, text FROM documents)),
g AS (SELECT doc_id, unit, {pairs} AS a FROM (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM u) WHERE len(w) > 1),
m AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
      FROM g JOIN t ON len(a) BETWEEN ceil(len(b) * {threshold / (2 - threshold)} - 1e-9) AND floor(len(b) * {(2 - threshold) / threshold} + 1e-9)),
h AS (SELECT * FROM m WHERE dice >= {threshold} - 1e-9),
s AS (SELECT doc_id, count(DISTINCT unit) AS n_units, count(*) FILTER (unit IS NULL) AS n_windows,
             string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
             min(struct_pack(d := -dice, license := license)) AS best
      FROM (SELECT doc_id, unit, license, dice FROM h UNION ALL SELECT doc_id, NULL, license, dice FROM wh) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(s.n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(s.n_windows, 0) AS BIGINT) AS n_windows, coalesce(s.licenses, '') AS licenses,
       s.best.license AS best_license, round(-s.best.d, 6) AS best_dice
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""
