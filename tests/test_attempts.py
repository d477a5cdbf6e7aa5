"""Guards, retries and grounded seeds against plain Python; tests/test_oracle.py holds them against SQL."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from turnlens.functions import vocab
from turnlens.operators import attempts

PASSAGE = "The Alder River powers nine mills in Brook Town. It was dammed by Cedar Works in 1911. Trade was described in [7]. See TABREF3 for the flow of water there. Fish of the river feed the market of Delta Port."
SCHEMA = "qid long, query_type string, entities array<string>, history array<string>, answers array<string>, evidence array<string>"


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", (text or "").lower())


def meaning(text: str, filler) -> list[str]:
    return [w for w in tokens(text) if w not in filler and len(w) > 2]


def plain_objection(row: dict, last: bool) -> str | None:
    """The guards one by one."""
    kind, q, g = row["query_type"], row["question"], row["gold"]
    label = lambda t: re.search(r"(?i)\b(TABREF|SECREF|FIGREF|BIBREF|EQREF)\d*\b", t or "")
    if not last:
        if kind in ("Follow-Up", "Ambiguous Reference"):
            t = (row["target"] or "").strip().lower()
            if not set(re.findall("[a-z0-9_]+", q.lower())) & set(vocab.PRONOUNS) or (t and t in q.lower()):
                return "structure"
        if kind == "Clarification":
            own, said = set(re.findall("[a-z]{4,}", q.lower())) - set(vocab.CLARIFY_WORDS), set(re.findall("[a-z]{4,}", " ".join(row["history"]).lower()))
            if own and said and not own & said:
                return "structure"
        if label(q):
            return "label"
    if kind == "Unanswerable":
        return None
    if g == vocab.NO_ANSWER:
        return "ungrounded"
    have = lambda p: g.strip() and (g.strip().lower() in p.lower() or len(set(tokens(g)) & set(tokens(p))) >= 0.6 * max(len(set(tokens(g))), 1))
    if not any(have(p) for p in row["evidence"]):
        return "unsupported"
    if label(g):
        return "gold_label"
    if re.search(r"\[\s*\d+\s*\]", g) and len(set(meaning(re.sub(r"\[\s*\d+\s*\]", "", g), vocab.GRAMMAR_WORDS))) < 3:
        return "citation_only"
    words = meaning(g, vocab.COMMON_WORDS)
    if len(words) >= 5 and len([w for w in set(words) - set(meaning(q, vocab.COMMON_WORDS)) if not w.isdigit()]) < 2:
        return "restates"
    for said in row["answers"]:
        a, b = set(tokens(g)), set(tokens(said))
        if a and b and (g.strip().lower() in said.strip().lower() or len(a & b) / len(a | b) >= 0.8):
            return "repeats"
    return None


def best(question: str, passages: list[str]) -> str:
    top, n = vocab.NO_ANSWER, 0
    for p in passages:
        for s in re.split(r"(?<=[.!?])[ \t\n\f\r]+", p):
            k = len(set(tokens(question)) & set(tokens(s)))
            if k > n and s.strip():
                top, n = s.strip(), k
    return top


QUESTIONS = [
    "What powers it in Brook Town?", "Who dammed the Alder River?", "What is in TABREF3?", "Where was trade described?", "zzz qqq?", "How does the flow of water there go?",
    "The Alder River powers nine mills in Brook Town?", "Tell me what fish feed it", "Please clarify more", "Do they powers mills?", "Which unrelated giraffe lives here?",
]


def test_loop_against_plain_python(spark):
    rng = random.Random(3)
    plan = {(q, a): (rng.choice(QUESTIONS), rng.choice(["Alder River", "Brook Town", None, " "])) for q in range(160) for a in range(3)}
    kinds = [t[0] for t in vocab.QUERY_TYPES]
    answers = [["The Alder River powers nine mills in Brook Town."], ["nothing like it"], []]
    rows = [(q, kinds[q % 8], ["Alder River"], ["We spoke of mills and trade", "Yes"] if q % 3 else [], answers[q % 3], [PASSAGE, "More of nothing."]) for q in range(160)]
    table = spark.createDataFrame([(q, a, x, t) for (q, a), (x, t) in plan.items()], "qid long, attempt int, question string, target string")
    seen = []

    def propose(open_rows):
        seen.append(open_rows.count())
        return open_rows.join(table, ["qid", "attempt"])

    got = {r["qid"]: r for r in attempts.generated(spark.createDataFrame(rows, SCHEMA), propose).collect()}
    assert len(got) == 160 and seen[0] == 160 and seen[1] < 160 and seen[2] < seen[1]
    reasons_seen = set()
    for q, kind, _, history, said, evidence in rows:
        now, reasons = kind, []
        for a in range(3):
            question, target = plan[q, a]
            row = {"query_type": now, "question": question, "target": target, "history": history, "answers": said, "evidence": evidence, "gold": vocab.NO_ANSWER if now == "Unanswerable" else best(question, evidence)}
            bad = plain_objection(row, a == 2)
            if bad is None:
                break
            reasons.append(bad)
            if bad == "repeats" and now in attempts.CIRCLING and a < 2:
                now = "Multi-Hop"
        r = got[q]
        assert (r["asked_type"], r["query_type"], r["question"], r["gold"], r["attempts"], list(r["reasons"]), r["gave_up"]) == (kind, now, question, row["gold"], a + 1, reasons, bad is not None)
        reasons_seen |= set(reasons)
    assert reasons_seen >= {"structure", "label", "ungrounded", "gold_label", "citation_only", "restates", "repeats"}


def test_unsupported_golds_and_forced_types(spark):
    row = [(1, "Correction", ["Alder River"], [], ["The Alder River powers nine mills in Brook Town."], [PASSAGE])]
    same = lambda rows: rows.withColumn("question", F.lit("What powers nine mills in Brook Town?")).withColumn("target", F.lit(None).cast("string"))
    kept = attempts.generated(spark.createDataFrame(row, SCHEMA), same, forced=True).first()
    assert kept["query_type"] == "Correction" and list(kept["reasons"]) == ["repeats"] * 3 and kept["gave_up"]
    judged = spark.createDataFrame([("Topic Shift", "What?", None, "made up elsewhere entirely", [], [], [PASSAGE])], "query_type string, question string, target string, gold string, history array<string>, answers array<string>, evidence array<string>")
    assert judged.select(attempts.objection(False)).first()[0] == "unsupported" and judged.select(attempts.objection(False, strict=False)).first()[0] is None


def test_types_are_checked_and_difficulty_clamped(spark):
    rows = spark.createDataFrame([("Comparative", 0), ("Comparative", None), ("Follow-Up", 9), ("Follow-Up", -3)], "query_type string, proposed int")
    assert [r["difficulty"] for r in attempts.typed(rows).collect()] == [4, 4, 5, 1]
    with pytest.raises(Exception, match="unknown type Nonsense"):
        attempts.typed(spark.createDataFrame([("Nonsense", 1)], "query_type string, proposed int")).collect()


def test_seed_grounding(spark):
    seeds = spark.createDataFrame([(1, "Who dammed the river"), (2, "mills powers nine zebra"), (3, "xylophone quartz"), (4, "no passage at all")], "qid long, question string")
    filler = lambda q, n: [(q, i, 100 * q + i, "Nothing here. Or there.") for i in range(1, n)]
    hits = [*filler(1, 8), (1, 8, 108, "It dammed the river."), *filler(2, 20), (2, 20, 220, "Nine mills powers."), (3, 1, 301, "at old Cedar Works only."), (3, 25, 325, "xylophone quartz")]
    got = {r["qid"]: r for r in attempts.grounded_seeds(seeds, spark.createDataFrame(hits, "qid long, rank int, chunk_id long, text string")).collect()}
    assert (got[1]["attempt"], got[1]["chunk_id"], got[1]["rewritten"]) == (0, 108, False)
    assert (got[2]["attempt"], got[2]["chunk_id"]) == (2, 220)
    assert got[3]["attempt"] is None and got[3]["rewritten"] and got[3]["question"] == "Now tell me about Cedar Works."
    assert got[4]["question"] == "no passage at all" and not got[4]["rewritten"] and got[4]["chunk_id"] is None
