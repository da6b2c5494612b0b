"""Vector codes, the audit of filter orders and main texts: brute force, golden pages and odd rows."""

from __future__ import annotations

import hashlib
import re
import time
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapewright.llm import filteraudit, htmltext, vectorcodes

SF = "/root/testdata/sf0.001"


# ---- vector codes


def floor256(x: float) -> int:
    import math

    return max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x)))


def coded_by_hand(rows: list[tuple]) -> tuple[list[tuple], str]:
    """The contract of op11 row by row; rows are (vec_id, embedding, label)."""
    kept = [(i, [floor256(c) for c in e], lab) for i, e, lab in rows if e is not None and all(c is not None and abs(c) < float("inf") for c in e)]
    width = -(-max(len(v) for _, v, _ in kept) // 16)
    parts = [[(v + [0] * 16 * width)[p * width : (p + 1) * width] for p in range(16)] for _, v, _ in kept]
    first: dict = {}
    for (i, v, _), own in zip(kept, parts, strict=True):
        if i is not None and (i not in first or v < first[i][0]):
            first[i] = (v, own)
    books = [[list(first[i][1][p]) for i in sorted(first)[:64]] or [[0] * width] for p in range(16)]

    def near(x: list[int], book: list[list[int]]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(2):
        for p in range(16):
            met = defaultdict(list)
            for own in parts:
                met[near(own[p], books[p])[1]].append(own[p])
            for k, xs in met.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[near(own[p], books[p]) for p in range(16)] for own in parts]
    errors = [min(sum(d for d, _ in f), (1 << 63) - 1) for f in found]
    by_label = Counter()
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    said = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in f), e, min(by_label[lab], (1 << 63) - 1)) for (i, _, lab), f, e in zip(kept, found, errors, strict=True)], said


def check_codes(spark, rows: list[tuple]) -> None:
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, v string").repartition(3)
    got = vectorcodes.code_vectors(df).collect()
    want, said = coded_by_hand(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=lambda r: (*key((r[0],)), r)) == sorted(want, key=lambda r: (*key((r[0],)), r))
    assert {r["codebooks_sha256"] for r in got} == {said}


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 32) / 64], int(i) % 3 if i % 7 else None) for i in rng.permutation(300)]  # many ties
    rows += [(1000, None, 1), (1001, [0.5, None], 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] * 32, 1), (None, [0.25] * 32, 2), (5, rows[0][1], 2), rows[3], rows[3], (1004, [0.1] * 5, 9), (1005, [], 9)]
    check_codes(spark, rows)


def test_codes_of_few_and_of_large_components(spark):
    check_codes(spark, [(1, [0.1 * i for i in range(7)], 1), (None, [1.0], None)])
    check_codes(spark, [(None, [1.0, -2.0], None)])
    check_codes(spark, [(i, [(-1.0) ** i * 2.0 ** (20 + 4 * i + k) for k in range(16)], i % 2) for i in range(12)])
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    out = vectorcodes.code_vectors(empty)
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-9, 9), min_size=3, max_size=3), min_size=1, max_size=70), st.lists(st.lists(st.integers(-12, 12), min_size=3, max_size=3), min_size=1, max_size=40))
def test_tree_finds_the_lowest_nearest(entries, rows):
    code, d = vectorcodes.Tree(np.array(entries)).nearest(np.array(rows))
    want = [min((sum((a - b) ** 2 for a, b in zip(r, e, strict=True)), i) for i, e in enumerate(entries)) for r in rows]
    assert list(zip(d.tolist(), code.tolist(), strict=True)) == want


# ---- audit of filters


def audited_by_hand(docs: list[tuple], labels: list[tuple]) -> dict:
    """The contract of op12 document by document; docs are (doc_id, text, lang)."""
    first: dict = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = Counter()
    for i, t, lang in docs:
        t = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels if x[0] is not None) for k in (1, 2))
        for order in permutations("ABCDE"):
            order = "".join(order)
            at = next((s for s, f in enumerate(order, 1) if fails[f]), 6)
            for s, f in enumerate(order, 1):
                key = (lang or "", order, s)
                for name, hit in (("kept", at > s), ("removed", at == s), ("redundant", at < s and fails[f]), ("unique_fails", fails[f] and sum(fails.values()) == 1), ("good_lost", at == s and good), ("toxic_lost", at == s and toxic)):
                    out[key, name] += hit
                out[lang or "", f] += at == s
    return out


def test_audit_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(1, long, "en"), (2, long, "de"), (2, long, "de"), (3, "A B", "en"), (4, None, None), (5, "", ""), (6, "", "en"), (None, long, "en"), (7, "x " * 250, "fr"), (8, long + " $", "en"), (9, long + " A" * 90, "en"), (10, "é\U0001f600Z" * 9, "xx"), (11, "a\x85b\x0bc", "en")]
    docs += [(20 + i, "copy of one text", "en") for i in range(40)]
    labels = [(1, 1, 0), (2, 1, None), (2, 0, 1), (3, None, 1), (None, 1, 1), (8, 1, 1), (99, 1, 1), (25, 1, 1)]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, part string, bits int").repartition(4)
    lab = spark.createDataFrame([(*x, 3) for x in labels], "doc_id long, quality int, toxic int, good int")
    want = audited_by_hand(docs, labels)
    got = filteraudit.audit(df, lab).collect()
    assert len(got) == 600 * len({d[2] or "" for d in docs})
    for r in got:
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == want[(r["part"], r["filter_order"], r["step"]), name], (r, name)
        assert r["shapley"] == want[r["part"], r["filter_order"][r["step"] - 1]]
    assert filteraudit.audit(df.limit(0), lab).count() == 0
    assert filteraudit.audit(df, lab.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# ---- main texts

PROSE = "The cat and the dog of it were in the house and that was all there is to be said for them. "


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body class='has-sidebar'>{body}</body></html>"


ARTICLE = f"<h1>Head &amp; line</h1><p>{PROSE * 3}<p>Short.<br>two &lt;b&gt;&nbsp; c</p><ul><li>one<li>two <b>bo</b>ld</ul><pre>x\n  y</pre>"
WANT = ["Head & line", (PROSE * 3).strip(), "Short. two <b> c", "one", "two bold", "x y"]
AROUND = [
    "<nav><ul><li><a href=/>Home</a></ul></nav>",
    f"<header><h1>Site</h1><p>{PROSE * 3}</p></header>",
    f"<div class='ad-box'><p>{PROSE * 4}</p></div>",
    f"<div id=cookieNotice>{PROSE * 3}</div>",
    f"<aside><p>{PROSE * 3}</p></aside>",
    f"<div class='left sidebar'><p>{PROSE * 3}</p></div>",
    f"<form action=x><label>Name</label><input name=n><textarea>{PROSE * 2}</textarea></form>",
    f"<section id=comments><article class=comment><p>{PROSE * 3}</p></article></section>",
    "<footer>&copy; me</footer>",
    f"<!-- <p>{PROSE * 3}</p> -->",
    f"<noscript>{PROSE * 3}</noscript>",
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", "<div id=content>{}</div>", "<div role=main>{}</div>", "<table><tr><td>{}</table>", "<form id=aspnet><main>{}</main></form>"])
def test_article_among_boilerplate(wrap):
    html = page("".join(AROUND[:4]) + wrap.format(ARTICLE) + "".join(AROUND[4:]))
    assert htmltext.main_text(html) == "\n\n".join(WANT)


def test_boilerplate_inside_an_article():
    inside = "".join(x for x in AROUND if not x.startswith("<header"))
    html = page(f"<article><header><h1>Own</h1></header><p>{PROSE * 2}</p>{inside}<p title='some hidden thing'>Last.</p></article>")
    assert htmltext.main_text(html) == "\n\n".join(["Own", (PROSE * 2).strip(), "Last."])


def test_odd_pages():
    f = htmltext.main_text
    assert [f(None), f(""), f("  \n"), f("<a <b"), f("<!-- x"), f("<script>x")] == [""] * 6
    assert f("<p>Hi there.</p>") == "Hi there." and f("a < b &amp;amp; &#0; &reg") == "a < b &amp; � ®"
    assert f("<article><h1>Be.</h1><p>Erin.</article><footer>x</footer>") == "Be.\n\nErin."
    assert f("<article><p>co<wbr>op <x-y>in</x-y>line<script>1</script>d</p></article>") == "coop inlined"
    assert f(f"<p>{'日本語。' * 60}</p><p><a href=x>短</a></p>") == "日本語。" * 60
    assert f("<p><a href=/1>" + PROSE * 2 + "</a></p><p>" + PROSE * 2 + "</p>") == (PROSE * 2).strip()


def test_time_follows_length():
    for unit in ("<div>x", "<b class=ad>x", "<a x=\"'>", "<!--", "</", "<p>a", "&amp", "<ul><li>", "<div class=sidebar><article>z"):
        began = time.perf_counter()
        htmltext.main_text(unit * 50_000)
        assert time.perf_counter() - began < 10, unit


def test_main_text_of_rows(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>"), "x", 3), (1, "u", page(f"<article>{ARTICLE}</article>"), "x", 3), (None, None, None, "x", 3), (2, "u2", "", "x", 3), (3, "u3", "<p>" + "word " * 500_000, "x", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()), key=lambda r: r[0])
    said = "\n\n".join(WANT)
    assert got == [(0, "", 0), (1, said, len(said)), (1, said, len(said)), (2, "", 0), (3, "word " * 499_999 + "word", 2_499_999)]
    assert htmltext.extract(df.limit(0)).count() == 0


# ---- shared helpers


def test_bit_maps_lose_no_key(spark):
    from tapewright.llm import common

    rows = spark.range(2000).selectExpr("if(id % 50 = 0, null, id) as id", "cast(id % 7 as string) as t", "id % 3 = 0 as fine")
    keys = spark.range(0, 2000, 9).selectExpr("id", "cast(id % 7 as string) as t").unionByName(spark.createDataFrame([(None, "1")], "id long, t string"))
    words = common.bit_map(keys, "id", "t")
    assert words.count() <= common.BITS // 64
    met, others = common.by_bit_map(rows, words, "id", "t")
    asked = {(r["id"], r["t"]) for r in keys.collect()}
    inside, outside = [(r["id"], r["t"]) for r in met.collect()], [(r["id"], r["t"]) for r in others.collect()]
    assert len(inside) + len(outside) == 2000 and not asked & set(outside) and len(inside) < 300
    fine, rest = common.by_bit_map(rows, words, "id", "t", also=F.col("fine"))
    assert fine.where("not fine").count() == 0 and fine.count() + rest.count() == 2000
    none = common.bit_map(keys.limit(0), "id", "t")
    assert common.by_bit_map(rows, none, "id", "t")[0].count() == 0


def test_captures_without_a_day_have_no_decision(spark):
    from tapewright.llm import urlfilter

    captures = spark.createDataFrame([(1, "http://a.org/x", None), (2, "http://a.org/x", "2024-02-01")], "page_id long, url string, day string").selectExpr("page_id", "url", "cast(day as date) as fetch_day")
    entries = spark.createDataFrame([("a.org", "2024-01-01", "block")], "domain string, day string, action string").selectExpr("domain", "cast(day as date) as day", "action")
    assert {r["page_id"]: r["action"] for r in urlfilter.evaluate(captures, entries).collect()} == {1: None, 2: "block"}
