"""Tokenising, HTML extraction, mixing, and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import cases
from tests.llm.test_dedup import brute_near
from turnlens.llm import bpe, html_extract, mixing, toxicity
from turnlens.llm.common import WORD
from turnlens.llm.entry import byte_bpe


@pytest.fixture(scope="module")
def model():
    return byte_bpe()


@pytest.fixture(scope="module")
def reference(model):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(model.tokens)}, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(model):
    slots = [model.hash.candidate(t) for t in model.tokens]
    assert slots == list(range(len(model.tokens))) and sorted(model.hash.ids) == slots
    assert model.token_id(b"surely no token of it") == -1 and bpe.PerfectHash([b"a"]).candidate(b"a") == 0


@pytest.mark.parametrize("make", [cases.documents, cases.empty, lambda s: s.read.parquet(f"{DATA}/sf0.001/documents.parquet")])
def test_bpe(spark, model, reference, make):
    docs = make(spark)
    rows = sorted(((r["doc_id"], (r["text"] or "")) for r in docs.collect()), key=str)
    got = sorted(((r["doc_id"], bytes(r["decoded"]).decode(), bytes(r["ids"])) for r in bpe.encode(docs, model).collect()), key=str)
    assert [(i, t) for i, t, _ in got] == rows
    for _, t, ids in got:
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)


def test_bpe_merges_long_pieces(model, reference):
    known = bpe.Ranks(model)
    for piece in ("a" * 3000, "abc" * 700, "ßüö" * 300, "漢字" * 200, "x"):
        assert np.frombuffer(bpe.Memo(model).bpe.encode_piece(piece, known), "<u4").tolist() == reference.encode_ordinary(piece)


PAGES = [
    (1, None, ""), (2, "", ""), (3, "<p>", ""), (4, "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three</p><p>Sh is.</article><footer>f</footer>", "T & U\nOne two three\nSh is."),
    (5, "<article><!-- no --><p>a<script>var x='<p>no</p>'</script>b</p><style>p{}</style><p>&eacute;&#x6f22;&nbsp;</article>", "ab\né漢"),
    (6, "<body><div class='cookie-notice'><p>We use cookies on this site and many more words to fill the line</p></div><main><p>Short.</p><div id=comments><p>a reader says quite a lot of words here about the text above</p></div></main>", "Short."),
    (7, "<article><p>cut off <b>in the mid", "cut off in the mid"), (8, "<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
]


def test_html(spark):
    rows = spark.createDataFrame([(i, f"u{i}", h) for i, h, _ in PAGES], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()}
    assert got == {i: want for i, _, want in PAGES}
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_html_keeps_whole_articles(spark):
    """Held against a plain cut at the article's tags on real pages."""
    import html

    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_html_tree_holds_out():
    pages = html_extract.labelled_pages()
    tree = html_extract.train([p for i, p in enumerate(pages) if i % 3])
    right = [(b.text in want) == keep for i, (p, want) in enumerate(pages) if i % 3 == 0 for f in [html_extract.blocks(p)] for b, keep in zip(f, tree.predict(html_extract.features(f)) >= 0.5, strict=True)]
    assert np.mean(right) > 0.97


LONG_TEXT = " ".join("the quiet river runs below an old stone bridge where people meet on market days and sell fruit".split() * 3)


def test_html_keeps_articles_full_of_links_and_short_pages():
    tree = html_extract.train()
    say = lambda n, mark: " ".join(f"{mark}{i}" for i in range(n))
    link = lambda words: f'<a href="/x">{words}</a>'
    head = f"<article><h1>T</h1><p>{link(say(12, 'w'))}</p><p>{say(40, 'v')}</p><ul><li>{link('ref one')}<li>{link('ref two')}</ul></article>"
    assert html_extract.main_text(head, tree) == f"T\n{say(12, 'w')}\n{say(40, 'v')}\nref one\nref two"
    recipe = "<html><body><nav>" + link("Home") + "</nav><h1>Recipe</h1><p>Boil the egg for ten minutes.</p><p>Eat it.</p></body></html>"
    assert html_extract.main_text(recipe, tree) == "Recipe\nBoil the egg for ten minutes.\nEat it."
    math = f"<article><p>We see <math><mi>x</mi><mo>=</mo></math> {say(30, 'w')}</p></article>"
    assert html_extract.main_text(math, tree) == f"We see x= {say(30, 'w')}"
    items = [f"item number {i}" for i in range(5)]
    index = "<nav>" + link("Home") + "</nav><article><ul>" + "".join(f"<li>{link(x)}</li>" for x in items) + "</ul></article><footer>c</footer>"
    assert html_extract.main_text(index, tree) == "\n".join(items)
    cited = [f"{say(20, f'p{i}_')} {link(f'a{i}')} {say(10, 'q')} {link(f'b{i}')}" for i in range(4)]
    page = "<article><h1>Head</h1>" + "".join(f"<p>{c}</p>" for c in cited) + "<p>End.</p></article>"
    assert html_extract.main_text(page, tree).count("\n") == 5
    only_side = "<nav>" + link("Home") + "</nav><div>" + link("About") + "</div><footer>c</footer>"
    assert html_extract.main_text(only_side, tree) == ""


def test_html_keeps_content_of_marked_wrappers_and_short_ends():
    tree = html_extract.train()
    body = f"<h1>The title of it</h1><p>{LONG_TEXT}</p><p>Short end.</p>"
    want = f"The title of it\n{LONG_TEXT}\nShort end."
    for page in (f'<div class="layout has-sidebar"><article>{body}</article></div>', f'<section class="related follow"><main>{body}</main></section>'):
        assert html_extract.main_text(page, tree) == want
    plain = f'<body><nav><a href="/">Home</a></nav><div><p>{LONG_TEXT}</p><p>Short end.</p><p>{LONG_TEXT}</p><p>Short end.</p></div><div><a href="/a">one two</a> <a href="/b">three four</a></div></body>'
    assert html_extract.main_text(plain, tree) == f"{LONG_TEXT}\nShort end.\n{LONG_TEXT}\nShort end."
    assert any(html_extract.FEATURES[f].endswith("link_density") for f, *_ in tree.nodes if f >= 0)


def test_html_scan_is_linear():
    import time

    tree = html_extract.train()
    for page in ("<a " * 300_000 + '"', "<b>" * 120_000 + "</i>" * 120_000, "<u><div>" + "<i>" * 100_000 + "</u>" * 100_000, "<p a='" * 150_000, "<li>" * 200_000, "<" * 1_000_000, "<!--" * 200_000):
        start = time.perf_counter()
        html_extract.main_text(page, tree)
        assert time.perf_counter() - start < 4


def size_of(text):
    return len(re.findall(WORD, text or ""))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    got = mixing.taken(docs).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(size_of(texts[i]) == s for i, s in zip(got.doc_id, got["size"], strict=True))
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), source_size=("source_size", "first"))
    assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) <= 0.03 * by.target + 30).all()
    assert abs(by.target.sum() - got["size"].sum()) < 1e-3
    again = mixing.taken(docs.repartition(7)).toPandas().sort_values("doc_id")
    assert (again.taken.to_numpy() == got.sort_values("doc_id").taken.to_numpy()).all()


def test_mixing_goes_on_behind_a_long_document(spark, monkeypatch):
    """A long document on the threshold of a source of short ones is skipped, and later short ones are taken, each once."""
    place = F.when(F.col("doc_id") == 5000, 900).otherwise(F.col("doc_id")).cast("long")
    monkeypatch.setattr(mixing, "_order", lambda seed: F.call_function("shiftleft", place, F.lit(50)))
    sizes = {k: 16 + k * 37 % 48 for k in range(2000)} | {5000: 30_000}
    rows = [(k, n, "a") for k, n in sizes.items()] + [(10_000 + k, 50, "b") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string").select("doc_id", F.expr("array_join(array_repeat('w', n), ' ')").alias("text"), "source")
    got = {r["doc_id"]: r for r in mixing.taken(docs, weights={"a": 1, "b": 2}).filter("source = 'a'").collect()}
    target, left, want = got[0]["target"], round(got[0]["target"]), set()
    for k in sorted(sizes, key=lambda k: 900 if k == 5000 else k):
        if sizes[k] <= left:
            want.add(k)
            left -= sizes[k]
    assert 5000 not in want and len(want) > 1000 and want <= {k for k, r in got.items() if r["taken"]}
    assert abs(sum(r["taken"] for r in got.values()) - target) < 16  # the smallest size
    assert sum(r["taken"] > r["size"] for r in got.values()) <= 4


def test_mixing_takes_odd_rows(spark):
    docs = cases.documents(spark)
    got = mixing.taken(docs).collect()
    assert len(got) == len(cases.ROWS) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.taken(cases.empty(spark)).count() == 0
    left = mixing.mixed(docs)
    assert left.columns == docs.columns and left.filter("doc_id is not null and size is null").count() == 0
    assert left.groupBy("doc_id").count().filter("count > 6").count() == 0


def test_targets_stop_and_reshare():
    sizes = {"a": 10, "b": 1000, None: 990}
    got = mixing.capped_targets(sizes, mixing.weights_in_turn(list(sizes)), 2000)
    assert mixing.weights_in_turn(["b", None, "a"]) == {"a": 1, "b": 2, None: 3}
    assert got["a"] == 30 and got["b"] == pytest.approx(1970 * 2 / 5) and got[None] == pytest.approx(1970 * 3 / 5)


def test_fill_comes_close():
    assert sum(k * [5, 30, 113, 162][i] for i, k in mixing.fill(108, [5, 30, 113, 162], [3, 3, 3, 2]).items()) == 105
    assert mixing.fill(0, [5], [3]) == {} and mixing.fill(9, [10], [3]) == {} and mixing.fill(7, [], []) == {}
    many = list(range(3, 400))
    assert sum(k * many[i] for i, k in mixing.fill(123_456, many, [3] * len(many)).items()) == 123_456


def test_flow_is_of_least_cost():
    """Against all integer flows of small overlapping sources."""
    capacity, members, quota = {"p": 2, "q": 2, "r": 1}, {"p": ["s"], "q": ["s", "t"], "r": ["t"]}, {"s": 4, "t": 3}
    price = lambda p, n: sum(mixing.COSTS[min(k // capacity[p], 2)] for k in range(n))
    best = None
    for a, b, c, d in itertools.product(range(7), range(7), range(7), range(4)):
        if a + b > quota["s"] or c + d > quota["t"] or a > 6 or b + c > 6 or d > 3:
            continue
        worth = (-(a + b + c + d), price("p", a) + price("q", b + c) + price("r", d))
        best = worth if best is None else min(best, worth)
    flow = mixing.min_cost_flow(capacity, members, quota)
    total = {p: sum(f.values()) for p, f in flow.items()}
    assert (-sum(total.values()), sum(price(p, n) for p, n in total.items())) == best


def _token_by_token(capacity, members, quota):
    """(tokens, cost) of a flow of least cost, found by shortest paths that carry one token each."""
    arcs = {}
    for p, c in capacity.items():
        for k, cost in enumerate(mixing.COSTS):
            arcs["S", (p, k)], arcs[(p, k), p] = [c, cost], [c, 0]
        for s in members[p]:
            arcs[p, "to " + s] = [99, 0]
    for s, q in quota.items():
        arcs["to " + s, "T"] = [q, 0]
    for (a, b), (_, cost) in list(arcs.items()):
        arcs[b, a] = [0, -cost]
    tokens = price = 0
    while True:
        dist, came, changed = {"S": 0}, {}, True
        while changed:
            changed = False
            for (a, b), (cap, cost) in arcs.items():
                if cap and a in dist and dist[a] + cost < dist.get(b, 999):
                    dist[b], came[b], changed = dist[a] + cost, a, True
        if "T" not in dist:
            return tokens, price
        tokens, price, at = tokens + 1, price + dist["T"], "T"
        while at != "S":
            arcs[came[at], at][0] -= 1
            arcs[at, came[at]][0] += 1
            at = came[at]


def test_flow_of_many_overlaps_is_of_least_cost():
    dice = random.Random(3)
    for _ in range(300):
        capacity = {f"p{i}": dice.randint(0, 5) for i in range(dice.randint(1, 6))}
        members = {p: dice.sample("abcd", dice.randint(0, 3)) for p in capacity}
        quota = {s: dice.randint(0, 12) for s in "abcd"}
        flow = mixing.min_cost_flow(capacity, members, quota)
        total = {p: sum(f.values()) for p, f in flow.items()}
        assert all(set(f) <= set(members[p]) and min(f.values(), default=1) > 0 for p, f in flow.items())
        assert all(sum(f.get(s, 0) for f in flow.values()) <= quota[s] for s in quota)
        price = sum(mixing.COSTS[k // capacity[p]] for p, n in total.items() for k in range(n))  # a fourth repeat would raise
        assert (sum(total.values()), price) == _token_by_token(capacity, members, quota)


def test_flow_of_very_many_patterns():
    """Time grows with the patterns: as many as a mix may have, alone and overlapping."""
    n = mixing.MAX_PATTERNS
    alone = mixing.min_cost_flow({f"p{i}": 10 for i in range(n)}, {f"p{i}": [i] for i in range(n)}, {i: 5 + i % 30 for i in range(n)})
    assert all(alone[f"p{i}"][i] == min(30, 5 + i % 30) for i in range(n))
    both = mixing.min_cost_flow({f"p{i}": 10 for i in range(n)}, {f"p{i}": [i % 50, (i * 7 + 1) % 50] for i in range(n)}, {i: 30_000 for i in range(50)})
    assert sum(sum(f.values()) for f in both.values()) == 1_500_000


def test_every_pattern_goes_through_the_flow(spark, monkeypatch):
    flow, routed = mixing.min_cost_flow, []
    monkeypatch.setattr(mixing, "min_cost_flow", lambda capacity, members, quota: routed.append(dict(capacity)) or flow(capacity, members, quota))
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = {(r["source"], r["source_size"]) for r in mixing.taken(docs).collect()}
    assert len(routed) == 1 and sorted(routed[0].values()) == sorted(n for _, n in got) and len(got) > 3


def test_pipeline_stages_against_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    f = dict(corpus_pipeline.STAGES)
    one = f["toxicity"](spark, docs, sf).cache()
    scores = {r["doc_id"]: r["_score"] for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    assert {r["doc_id"] for r in one.collect()} == {i for i, s in scores.items() if s < 0.5}
    two = f["exact_dedup"](spark, one, sf).cache()
    last = {r["text"]: r["doc_id"] for r in one.orderBy("doc_id").collect()}
    assert {r["doc_id"] for r in two.collect()} == set(last.values())
    three = f["ngram_jaccard"](spark, two, sf).cache()
    assert {r["doc_id"] for r in three.collect()} == {c for _, c, _ in brute_near([(r["doc_id"], r["text"]) for r in two.collect()])}
    four = f["mix_sources"](spark, three, sf).cache()
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.taken(three).collect() if r["size"]}
    assert {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()} == {i: n for i, n in times.items() if n}
    assert all(d.columns == names for d in (one, two, three, four))
    five = f["byte_bpe"](spark, four, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = five.collect()
    assert len(rows) == four.count() and all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
