"""Scalar column functions: text normalisers, tolerant parsing, numeric transforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Tokens that stand for a missing measurement; a tissue code "NA" is not among a code column's.
MISSING_TOKENS = ("", "NA", "NaN", "nan", "NAN", "null", "NULL")
_TRUE, _FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def null_if_nan(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def parse_bool_lenient(x: Column) -> Column:
    """true, 1 and yes are true; everything else, missing too, is false."""
    return F.coalesce(F.lower(F.trim(x)).isin("true", "1", "yes"), F.lit(False))


def parse_bool_strict(x: Column) -> Column:
    """true/t/yes/y/1 and false/f/no/n/0; null for anything else, which contracts report."""
    low = F.lower(F.trim(x))
    return F.when(low.isin(*_TRUE), F.lit(True)).when(low.isin(*_FALSE), F.lit(False))


def token_to_double(x: Column) -> Column:
    """A struct (value, error): missing tokens are null, other non-numeric or infinite cells errors."""
    number = F.trim(x).try_cast("double")
    missing = x.isNull() | F.trim(x).isin(*MISSING_TOKENS)
    good = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.struct(F.when(~missing & good, number).alias("value"), (~missing & ~F.coalesce(good, F.lit(False))).alias("error"))


def out_of_range(x: Column, low: float = 0.0, high: float = 1.0, tolerance: float = 0.1) -> Column:
    """A struct (value, error): slightly outside becomes null, beyond the tolerance is an error."""
    inside = x.between(low, high)
    error = F.coalesce((x < low - tolerance) | (x > high + tolerance), F.lit(False))
    return F.struct(F.when(inside, x).alias("value"), error.alias("error"))


def first_number(x: Column) -> Column:
    """The first numeric token of a text."""
    return F.regexp_extract(x, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


def symbol(x: Column, separators: str = r"[/;,|\s]+") -> Column:
    """The one distinct symbol of a multi-separator list, or an empty text."""
    parts = F.array_distinct(F.filter(F.split(F.upper(F.trim(x)), separators), lambda p: p != ""))
    return F.when(F.size(parts) == 1, F.get(parts, 0)).otherwise(F.lit(""))


def tokens(x: Column, separator: str = ";") -> Column:
    """Trimmed, distinct, non-empty members of a joined list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(x, separator), lambda p: F.trim(p)), lambda p: p != ""))


def location_category(names: Column, groups: Column, name: str, promoter: tuple[str, ...], body: tuple[str, ...]) -> Column:
    """promoter, body or other for ``name`` from two aligned lists; null if they do not align."""
    zipped = F.arrays_zip(F.split(names, ";").alias("n"), F.split(groups, ";").alias("g"))
    mine = F.filter(zipped, lambda z: z["n"] == name)
    within = lambda kinds: F.exists(mine, lambda z: z["g"].isin(*kinds))
    aligned = F.size(F.split(names, ";")) == F.size(F.split(groups, ";"))
    return F.when(~aligned, F.lit(None)).when(within(promoter), "promoter").when(within(body), "body").otherwise("other")


def chromosome(x: Column) -> Column:
    """Chromosome names without prefix, upper-case, M for the mitochondrion; empty is null."""
    bare = F.upper(F.regexp_replace(F.trim(x), "(?i)^chr", ""))
    return F.when(bare == "", F.lit(None)).when(bare == "MT", "M").otherwise(bare)


def coordinates_agree(chr_a: Column, pos_one_based: Column, chr_b: Column, start_zero_based: Column) -> Column:
    """Whether a one-based and a zero-based position agree; null if either is unknown."""
    return (chromosome(chr_a) == chromosome(chr_b)) & (pos_one_based - 1 == start_zero_based)


def tnm(x: Column) -> Column:
    """A struct (t, n, m) of a strictly written TNM code; nulls if it does not match."""
    grammar = r"^p?T(is|[0-4][ab]?)N([0-2][abc]?)M([01][abc]?)$"
    part = lambda i: F.when(F.trim(x).rlike(grammar), F.regexp_extract(F.trim(x), grammar, i))
    return F.struct(part(1).alias("t"), part(2).alias("n"), part(3).alias("m"))


def stable_seed(seed: int, *parts: Column) -> Column:
    """(seed + first eight hex digits of the SHA-256 of the joined parts) modulo 2^32."""
    digest = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return (F.lit(seed).cast("long") + F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")) % F.lit(1 << 32)


def m_to_beta(m: Column) -> Column:
    return F.pow(F.lit(2.0), m) / (1 + F.pow(F.lit(2.0), m))


def signal_to_beta(methylated: Column, unmethylated: Column, detection_p: Column, limit: float = 0.01, offset: float = 100.0) -> Column:
    return F.when(detection_p < limit, methylated / (methylated + unmethylated + offset))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_close(a: Column, b: Column, rel: float = 1e-12, absolute: float = 1e-12) -> Column:
    """Nulls are close to nulls only."""
    both = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(absolute))
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(both, F.lit(False)))


def median_of(values: Column) -> Column:
    """Median of an array without nulls."""
    ordered, n = F.array_sort(values), F.size(values)
    middle = F.floor((n - 1) / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, middle) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0)


def counter_random(seed: int | Column, *parts: Column | str) -> Column:
    """A 32-bit number from md5 of the joined parts: the same draw in every engine and order."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    joined = F.concat_ws("|", first, *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")
