"""Extraction, decontamination, licences and personal data against brute force."""

import hashlib
import html as htmllib
import re

import pytest
from pyspark.sql import functions as F

from measurelake.llm import decontaminate, html_extract, licenses, pii, queries

from ..oracle import check

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clash(df, *names):
    """Columns of any kind under names that operators use inside."""
    return df.withColumns({n: F.lit("x") for n in names if n not in df.columns})


# --- HTML


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op1_html_extraction(spark, SF).collect()}
    assert len(got) == pages.count()
    for row in pages.collect():
        article = re.search("<article>(.*)</article>", row.html, re.S)[1]
        parts = re.split("</?p>|</?h1>", article)
        parts = [" ".join(htmllib.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        want = "\n\n".join(p for p in parts if p)
        assert (got[row.page_id].text, got[row.page_id].n_chars, got[row.page_id].url) == (want, len(want), row.url)


LONG = "Some long paragraph with many words that goes on for quite a while, as articles do."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; bare", "plain & bare"),
        ("<p>one", "one"),
        ("<nav>only</nav><script>x</script>", ""),
        (f"<article><p>{LONG}<p>Short.</article><div class='comments'><p>{LONG}{LONG}</div>", f"{LONG}\n\nShort."),
        (f"<main><h1>T</h1><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form></main><footer>f</footer>", f"T\n\n{LONG}"),
        (f"<body class=has-sidebar><header>{LONG}</header><div id=c><h2>T</h2><p>{LONG}</p><p>x&nbsp; y</p><p>{LONG}</p></div><div id=sidebar>{LONG}</div>", f"T\n\n{LONG}\n\nx y\n\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='ad-banner'>buy</div><ul><li>a<li>b</ul></article>", f"{LONG}\n\na\n\nb"),
        (f"<div class='page has-header overflow-hidden'><article><div class=article-header><h1>T</h1></div><p>{LONG}</p></article></div>", f"T\n\n{LONG}"),
        (f"<![foo x<article><p>{LONG}</article>", LONG),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_extraction_cases(page, want):
    assert html_extract.extract_main_text(page).split("[foo x\n\n")[-1] == want


MENU = "".join(f"<td><a href=/{w}>{w}</a></td>" for w in ("Home", "News", "Sport", "About"))
CELLS = f"<table><tr>{MENU}</tr></table><table><tr><td><a href=x>Home</a><br><a href=y>Archive</a></td><td><h2>Title</h2><p>{LONG}</p><p>Short one.</p><p>{LONG} {LONG}</p></td></tr></table><p>Imprint</p>"
FARM = "<div><div>" + "".join(f"<p><a href=/{i}>Linked words number {i}</a></p>" for i in range(40)) + f"</div><div><h1>Head</h1><p>{LONG}</p><p>No.</p><p>{LONG}</p></div></div>"
WIDE = f"<div><span>12 May</span> | <span>3 min</span> | <span>Log in</span></div><div><div><h1>Head</h1><p>{LONG}</p><p>No.</p><p>{LONG}</p></div><div><a href=a>{LONG[:30]}</a> <a href=b>{LONG[:25]}</a></div></div>"


@pytest.mark.parametrize(
    "page, want",
    [
        (CELLS, f"Title\n\n{LONG}\n\nShort one.\n\n{LONG} {LONG}"),
        (FARM, f"Head\n\n{LONG}\n\nNo.\n\n{LONG}"),
        (WIDE, f"Head\n\n{LONG}\n\nNo.\n\n{LONG}"),
        (f"<article><h1>T</h1><p>{LONG}</p><section class='search-results'><p>{LONG}</p></section><p class='related-work'>{LONG}</p><div class='share-prices'>{LONG}</div></article>", "\n\n".join(["T", *[LONG] * 4])),
        (f"<div class=content><p>{LONG}</p><div class='reply-to-critics'><p>{LONG}</p></div><p>{LONG}</p></div>", "\n\n".join([LONG] * 3)),
        (f"<article><p>{LONG}</p><div class='related-reading'><a href=1>One thing</a> <a href=2>Other</a></div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div></article>", LONG),
    ],
)
def test_regions_by_ratio(page, want):
    assert html_extract.extract_main_text(page) == want


def test_clustering_decides(monkeypatch):
    """Without the clusters pages without semantic elements come out differently."""
    import numpy as np

    menu = "<nav>" + "<li><a href=x>y</a></li>" * 8 + "</nav>"
    doubtful = f"{menu}<article><p>{LONG}</p><p>{LONG}</p><div class='share-tools'><b>Tell</b> <i>us</i></div></article>"
    pages = [FARM, doubtful]
    right = [html_extract.extract_main_text(p) for p in pages]
    monkeypatch.setattr(html_extract, "content_lines", lambda ratios: (np.ones(len(ratios), bool), 0.0))
    assert all(html_extract.extract_main_text(p) != r for p, r in zip(pages, right))


def paragraphs(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


SHORT = ["Yes.", "No.", "Hm.", "Ok.", "End.", "Fin."]
POEM = ["Roses are red", "Violets are blue", "Sugar is sweet", "And so are you"]
AROUND = "<div><ul>" + "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(6)) + "</ul></div>", "<div>&copy; 2024 Site</div>"


@pytest.mark.parametrize("before, behind", [("", ""), AROUND])
@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div id=c><h1>T</h1>{paragraphs(LONG, LONG, LONG, *SHORT)}</div>", ["T", LONG, LONG, LONG, *SHORT]),
        (f"<div id=c><h1>T</h1>{paragraphs('By A B', *SHORT[:4], LONG, LONG, LONG)}</div>", ["T", "By A B", *SHORT[:4], LONG, LONG, LONG]),
        (f"<div id=c><h1>T</h1><p>{LONG}</p><ul>{''.join(f'<li>w{i}' for i in range(8))}</ul></div>", ["T", LONG, *[f"w{i}" for i in range(8)]]),
        (f"<div id=c><h1>T</h1>{paragraphs(*POEM)}</div><div>{LONG * 4}</div>", ["T", *POEM]),
        (f"<div id=c><h1>T</h1>{paragraphs(*POEM)}<div>{LONG * 4}</div></div>", ["T", *POEM, LONG * 4]),
    ],
)
def test_region_is_kept_whole(page, want, before, behind):
    assert html_extract.extract_main_text(before + page + behind) == "\n\n".join(want)


@pytest.mark.parametrize("name", ["search", "share", "responses", "social", "promotion", "widget"])
def test_subjects_are_no_boilerplate(name):
    page = f"<article><h1>T</h1><p>{LONG}</p><section id={name}><h2>S</h2><p>{LONG}</p></section></article>"
    assert html_extract.extract_main_text(page) == f"T\n\n{LONG}\n\nS\n\n{LONG}"
    links = f"<article><h1>T</h1><p>{LONG}</p><div class={name}><a href=1>One thing</a> <a href=2>Other</a></div></article>"
    assert html_extract.extract_main_text(links) == f"T\n\n{LONG}"


def test_stray_tags_are_linear():
    import time

    start = time.perf_counter()
    for page in ("<b>" * 100_000 + "</i>" * 100_000 + "x", "<a href=x>" + "<b>y" * 50_000 + "</i>z" * 50_000, "<ul><li>" + "<b>" * 50_000 + "<i></u>" * 50_000):
        html_extract.extract_main_text(page)
    assert time.perf_counter() - start < 30


def test_pages_without_names(spark, monkeypatch):
    """The table's pages without semantic elements, classes and ids: the ratios alone find the article."""
    import numpy as np

    def bare(html):
        html = re.sub(r"<(/?)(article|nav|footer|aside|header|main|section)\b[^>]*>", r"<\1div>", html)
        return re.sub(r'\s(class|id|role)="[^"]*"', "", html)

    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]

    def right():
        return sum(html_extract.extract_main_text(bare(h)) == html_extract.extract_main_text(h) for h in pages)

    assert right() >= 245 * len(pages) / 250
    keep = html_extract.content_lines
    monkeypatch.setattr(html_extract, "content_lines", lambda r: (np.ones(len(r), bool), 0.0))
    assert right() <= 240 * len(pages) / 250
    monkeypatch.setattr(html_extract, "content_lines", lambda r: (~keep(r)[0], keep(r)[1]))
    assert right() <= 20


def test_extraction_frames(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (1, None, None), (None, "u", "<p>" + "word " * 100_000)]
    got = html_extract.extract_pages(clash(spark.createDataFrame(rows, schema), "text", "n_chars")).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 499_999]
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_smoothing_short_pages():
    import numpy as np

    for n in range(1, 8):
        assert html_extract.smooth(np.ones(n)) == pytest.approx(np.ones(n))


# --- decontamination


def brute_contamination(docs, items):
    word = re.compile(decontaminate.WORD)
    windows = {}
    for item, text in items:
        w = word.findall((text or "").translate(LOWER))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def contamination(docs, bench):
    found = decontaminate.contamination(docs, bench)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated").collect()), key=str)


def test_contamination_table(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in queries.op3_decontamination(spark, SF).collect()), key=str)
    assert got == brute_contamination(docs.select("doc_id", "text").collect(), bench.select("item_id", "text").collect())
    assert any(r[5] for r in got)


DOCS = [(1, "a b c d e f g h i j k a b c d e f g h i j"), (2, None), (3, ""), (1, "Foo bar baz"), (1, "Foo bar baz"), (None, "foo, BAR"), (5, "x " * 500), (6, "é É one"), (7, "word " * 50_000 + "foo bar")]
ITEMS = [(1, "a b c d e f g h i j k"), (2, "foo bar"), (2, "foo bar"), (3, None), (4, "a b c d e f g h i j k l"), (5, "x " * 12), (6, "é"), (6, "É"), (8, "")]


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_KEYS, 0])
def test_contamination_cases(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", broadcast)
    docs = clash(spark.createDataFrame(DOCS, "doc_id long, text string"), "row", "words", "n", "start", "shingle")
    bench = clash(spark.createDataFrame(ITEMS, "item_id long, text string"), "words", "row")
    assert contamination(docs, bench) == brute_contamination(DOCS, ITEMS)
    assert contamination(docs, bench.limit(0)) == brute_contamination(DOCS, [])
    assert contamination(docs.limit(0), bench) == []


# --- licences


def test_licenses_sql(spark):
    check(spark, SF, queries.op7_license_scan, queries.oracle_sql()["op7_license_scan"])


def test_license_cases(spark):
    mit = licenses.TEMPLATES[3][1]
    rows = [(1, None), (2, ""), (3, "x\nReleased under the MIT license!\ny"), (3, "word"), (4, mit), (5, mit.replace(", including", ",\nincluding")), (6, "the cat sat on the licensed mat " * 20_000), (7, "All rights\nreserved.")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "found", "hits")
    got = [(r.doc_id, r.licenses, r.best_dice) for r in licenses.summary(licenses.scan(df)).collect()]
    assert got == [(1, "", None), (2, "", None), (3, "MIT", 1.0), (3, "", None), (4, "MIT", 1.0), (5, "MIT", 1.0), (6, "", None), (7, "LicenseRef-AllRightsReserved", 1.0)]
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_windows(spark):
    """Notices within longer lines and wrapped paragraphs, whole licences with another line around them."""
    fill = "one two three four five six seven eight nine ten " * 8
    body = next(t for n, t in licenses.TEMPLATES if n == "BSD-2-Clause")
    wrapped = "\n".join("# " + body[i : i + 60] for i in range(0, len(body), 60))
    rows = [(1, f"{fill}Released under the MIT License. {fill}"), (2, f"Copyright 2020 somebody or other\n{wrapped}\n{fill}{fill}"), (3, fill), (4, None), (5, f"{fill} Licensed under CC BY 4.0, {fill}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(df)).collect()}
    assert "MIT" in got[1].licenses and got[1].n_units == 0 and got[1].n_windows > 0
    assert "BSD-2-Clause" in got[2].licenses
    assert got[3].licenses == got[4].licenses == "" and "CC-BY-4.0" in got[5].licenses
    assert licenses.scan(df, templates=()).filter("n_units + n_windows > 0").count() == 0
    # Brute force: every window of every template's length.
    for doc, text in rows:
        words, found = licenses._plain(text or ""), set()
        for name, template in licenses.TEMPLATES:
            want, size = set(licenses.template_bigrams(template)), len(licenses._plain(template))
            for a in range(max(1, len(words) - size + 1)):
                own = {f"{x} {y}" for x, y in zip(words[a : a + size], words[a + 1 : a + size])}
                if want and own and 2 * len(own & want) / (len(own) + len(want)) >= licenses.THRESHOLD:
                    found.add(name)
        assert set(filter(None, got[doc].licenses.split(","))) == found


def test_prefix_loses_no_match():
    """Any bigram set that reaches the threshold shares a prefix bigram."""
    import random

    known = [(n, licenses.template_bigrams(t)) for n, t in licenses.TEMPLATES]
    prefix = {b for own in licenses.prefix_bigrams(known, 0.8) for b in own}
    rng = random.Random(3)
    for _, bigrams in known:
        for _ in range(200):
            own = set(rng.sample(bigrams, rng.randint(1, len(bigrams)))) | {f"q{i} q" for i in range(rng.randint(0, len(bigrams) // 2))}
            if 2 * len(own & set(bigrams)) / (len(own) + len(bigrams)) >= 0.8:
                assert own & prefix


# --- personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute_spans(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def base_spans(df):
    found = pii.find_spans(df).orderBy("row")
    return [r[0] for r in found.select(pii.listed(F.filter("spans", lambda s: s["kind"] != pii.TERM))).collect()]


def test_pii_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op9_pii(spark, SF).collect():
        want = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(re.findall(rf"\b{k}:", want)) for k, _ in PATTERNS]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


TEXTS = [
    "a@b.c%d@e.f +1 (487) 555-7209x 1.2.3.4.5.6.7.8 4111 1111 1111 1111 é a@b@c.d @x.y",
    None,
    "",
    "1" * 30_000 + " x",
    "a1.2." * 5000,
    "a" * 50_000 + "@",
    "4111-1111-1111-1111,4111111111111111 +4111111111111111 300.1.1.1 001.02.03.0004",
    "+1 2 3 4 5 6 7 8 9 0 a +12345678901 ()()",
    "x@y.zz",
    "x@y.zz",
    "😀 x@y.zz 1.1.1.1",
]


def test_pii_cases(spark):
    rows = [(i % 8, t) for i, t in enumerate(TEXTS)] + [(None, "q@r.st")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "row", "spans", "kind", "term", "start").coalesce(1)
    assert base_spans(df) == [brute_spans(t) for _, t in rows]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    """A word that always stands by an address discloses it; common words and words seen elsewhere do not."""
    names = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    rows = [(i, f"the {n} Zorblatt wrote {n} from zed@corp.example and the {n} letter") for i, n in enumerate(names)]
    rows += [(100 + i, f"the {n} cat wrote and the {n} dog sat far from the letter " * 20) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = pii.find_spans(df).select("doc_id", "row", "spans")
    spans = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    for i, n in enumerate(names):
        text = rows[i][1]
        assert {text[a:b] for k, a, b in spans[i] if k == "term"} == {"Zorblatt"}
        assert not spans[100 + i]
    joined = pii.numbered(df).join(found.select("row", "spans"), "row")
    clean = {r.doc_id: r.t for r in joined.select("doc_id", pii.generalise(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert clean[0] == "the alpha [TERM] wrote alpha from [EMAIL] and the alpha letter" and clean[100] == rows[6][1]


def brute_terms(rows):
    """The disclosing terms of every row, from the definition."""
    from math import log2

    word = re.compile(r"[^\W_]{2,}")
    reach, entities, near = pii.CONTEXT_CHARS, {}, {}
    total = sum(len(t or "") for _, t in rows)
    for n, (_, text) in enumerate(rows):
        for kind, p in PATTERNS:
            for m in re.finditer(p, text or ""):
                if valid(kind, m.group()):
                    a, b = m.span()
                    inside = lambda x: a - reach <= x.start() and x.end() <= a or b <= x.start() and x.end() <= b + reach
                    # A word may touch the mention: it ends or begins there.
                    parts = [x for piece in (re.finditer(word, text[:a]), word.finditer(text, b)) for x in piece]
                    entity = f"{kind}:{m.group().lower()}"
                    entities.setdefault(entity, set()).add(n)
                    near.setdefault(entity, set()).add(frozenset(x.group().lower() for x in parts if inside(x)))
    counts = {}
    for _, text in rows:
        for x in word.findall((text or "").lower()):
            counts[x] = counts.get(x, 0) + 1
    windows = max(2.0, total / (2 * reach))
    out = [set() for _ in rows]
    for entity, contexts in near.items():
        n_e = len(contexts)
        for term in set().union(*contexts):
            n_et, n_t = sum(term in c for c in contexts), counts.get(term, 0)
            low = min(n_e, n_t)
            if n_et < 2 or not n_t or n_e >= windows:
                continue
            score = log2(n_et * windows / (n_e * max(n_t, n_et))) * n_et / (n_et + 1) * low / (low + 1)
            if score >= pii.DISCLOSURE * log2(windows / n_e):
                for n in entities[entity]:
                    out[n].add(term)
    return out


def check_terms(df):
    rows = [(r.doc_id, r.text) for r in pii.numbered(df).orderBy("row").collect()]
    want = brute_terms(rows)
    found = pii.find_spans(df).orderBy("row").select("spans").collect()
    number = 0
    for (_, text), terms, (spans,) in zip(rows, want, found):
        text = text or ""
        base = [(s.start, s.end) for s in spans if s.kind != pii.TERM]
        free = lambda m: not any(a < m.end() and m.start() < b for a, b in base)
        got = [(s.start, s.end) for s in spans if s.kind == pii.TERM]
        assert got == [m.span() for m in re.finditer(r"[^\W_]{2,}", text) if m.group().lower() in terms and free(m)]
        number += len(got)
    return number


def test_terms_against_brute_force(spark):
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot"]
    rows = [(i, f"{w} " * (3 * i) + f"Ann7 of {w} mailed zed@corp.example, ip 10.0.0.1 or 10.0.0.1x Zorblatt9 {w} " + f"{w} " * 30 + "end") for i, w in enumerate(words)]
    rows += [(50, rows[0][1]), (51, None), (52, ""), (53, "twice Qux met 10.0.0.1 here"), (54, "then Qux saw 10.0.0.1 there"), (55, "once Lone met 10.0.0.2")]
    rows += [(100 + i, f"the {w} cat mailed the dog " * 40) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert check_terms(df) > 10
    keyed = df.withColumn("doc_id", F.struct("doc_id", F.lit("x").alias("x")))
    assert pii.find_spans(keyed).filter("doc_id is null").count() == 0
    assert "qux" in brute_terms(rows)[9] and "lone" not in brute_terms(rows)[11]


def test_terms_of_the_table(spark):
    check_terms(spark.read.parquet(f"{SF}/documents.parquet"))
