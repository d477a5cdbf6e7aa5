"""The adaptive loop and the systems by name."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from turnlens.operators import graph, loop, pagerank, systems
from turnlens.plans import views
from turnlens.streaming.live import next_type

SF = f"{DATA}/sf0.001"


def test_adaptive_loop(spark):
    seeds = views.bench(spark, SF).select(F.col("item_id").alias("qid"), "question", "gold", F.col("text").alias("passage"))
    chunks = views.chunks(spark, SF)
    rows = loop.run(seeds, chunks, 3).collect()
    talks = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["turn_id"]):
        talks[r["qid"]].append(r)
    assert len(talks) == seeds.count() and all(len(t) == 3 for t in talks.values())
    for talk in talks.values():
        kind, n = "Seed", 0
        for t, r in enumerate(talk):
            assert r["query_type"] == kind
            n += r["outcome"] == "correct"
            kind = next_type(r["outcome"], kind, n, t)
    forced = loop.run(seeds.limit(3), chunks, 2, forced=("Topic Shift",)).filter("turn_id = 1").collect()
    assert {r["query_type"] for r in forced} == {"Topic Shift"}


def test_personalised_pagerank_against_a_plain_walk(spark):
    texts = [(0, 0, 0, "Alder River meets Brook Town near Cedar Hill."), (1, 0, 1, "Cedar Hill looks over Delta Port."), (2, 1, 0, "nothing named here"), (3, 1, 1, "Brook Town trades with Delta Port.")]
    chunks = spark.createDataFrame(texts, "chunk_id long, doc_id long, pos long, text string")
    asked = spark.createDataFrame([(1, "Where is Alder River?", "Where is Alder River?"), (2, "nothing", "nothing")], "qid long, question string, query string")
    got = {r["qid"]: [(d["chunk_id"], d["score"]) for d in r["docs"]] for r in systems.connect("hippo")(asked, chunks, k=3, rounds=4).collect()}
    e = graph.extract(chunks)
    edges = [(r["source"], r["target"]) for r in graph.edges_of(e).collect()]
    mentions = [(r["node_id"], r["chunk_id"]) for r in graph.mentions_of(e, graph.edges_of(e)).collect()]
    rank = walked(edges, ["alder_river"], 4)
    want = defaultdict(float)
    for node, chunk in mentions:
        want[chunk] += rank.get(node, 0.0)
    want = sorted(((c, round(s, 6)) for c, s in want.items() if any(n in rank for n, k in mentions if k == c)), key=lambda x: (-x[1], x[0]))[:3]
    assert [(c, pytest.approx(s)) for c, s in want] == got[1]
    assert [c for c, _ in got[2]] == [2]  # names nothing: the best chunks by shared tokens


def walked(edges: list[tuple[str, str]], seeds: list[str], rounds: int) -> dict[str, float]:
    """Rank of each entity; what arrives where no relation leads on goes back to the seeds."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    base = {s: 1 / len(seeds) for s in seeds}
    rank = dict(base)
    for _ in range(rounds):
        new = defaultdict(float)
        lost = sum(r for a, r in rank.items() if not out[a])
        for a, r in rank.items():
            for b in out[a]:
                new[b] += 0.85 * r / len(out[a])
        for a, p in base.items():
            new[a] += p * (0.15 + 0.85 * lost)
        rank = new
    return rank


def test_walks_of_many_questions_with_pruning_and_tolerance(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(50)}") for _ in range(150)]
    seeds = {q: [f"n{x}" for x in rng.sample(range(50), 3)] for q in range(6)}
    e = spark.createDataFrame(edges, "source string, target string")
    s = spark.createDataFrame([(q, n) for q, ns in seeds.items() for n in ns], "qid long, node string")
    table = lambda df: {(r["qid"], r["node"]): r["r"] for r in df.collect()}
    exact = table(pagerank.ranks(s, e, 12))
    for q, ns in seeds.items():
        want = walked(edges, ns, 12)
        assert {n: r for (k, n), r in exact.items() if k == q} == {n: pytest.approx(r) for n, r in want.items()}
        assert sum(want.values()) == pytest.approx(1)
    for error in (0.01, 0.2):
        pruned = table(pagerank.ranks(s, e, 12, error=error))
        off = [sum(abs(r - pruned.get(k, 0.0)) for k, r in exact.items() if k[0] == q) for q in seeds]
        assert max(off) <= error and (error < 0.1 or len(pruned) < len(exact))
    settled = table(pagerank.ranks(s, e, 60, tolerance=1e-6))
    final = table(pagerank.ranks(s, e, 60))
    assert all(abs(final[k] - r) < 1e-5 for k, r in settled.items())


def test_loose_links_to_names(spark):
    names = spark.createDataFrame([("alder_river", "alder river"), ("river", "river"), ("ab", "ab"), ("oak", "oak")], "node string, name string")
    asked = spark.createDataFrame([(1, "The RIVER is near"), (2, "alder and oaks, abx"), (3, "to be")], "qid long, query string")
    got = sorted(map(tuple, pagerank.linked(asked, names).collect()))
    assert got == [(1, "river"), (2, "alder_river"), (2, "oak")]  # a name means that entity alone; names of two letters are not held loosely


def test_registry():
    assert {"vector", "longrag", "hippo"} <= set(systems.available())
    with pytest.raises(ValueError):
        systems.connect("none")
    systems.register("mine", systems.vector)
    assert systems.connect(" Mine ") is systems.vector
