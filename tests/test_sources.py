"""Readers of question-answer files, dialogues and logs, on tiny files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from turnlens.sources import dialogue, logs, qa, registry


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_questions_json(spark, tmp_path):
    path = write(tmp_path / "q.json", json.dumps([{"id": "1", "question": " Q ", "answer": "A", "meta_info": "fact\n \nother", "area": "x"}, {"id": "2", "question": None, "answer": None, "meta_info": None, "area": None}]))
    rows = {r["id"]: r for r in qa.questions_json(spark, path).collect()}
    assert rows["1"]["question"] == "Q" and rows["1"]["context"] == ["fact", "other"] and rows["1"]["meta"] == {"area": "x"}
    assert rows["2"]["context"] == [] and rows["2"]["question"] == ""


def test_papers_put_evidence_first(spark, tmp_path):
    row = {
        "id": "p", "abstract": "abs", "full_text": {"paragraphs": [["one", "two"], ["three", ""]]},
        "qas": {"question": ["no", "yes"], "answers": [{"answer": [{"unanswerable": True, "free_form_answer": "x"}]}, {"answer": [{"unanswerable": False, "free_form_answer": "", "extractive_spans": ["s1", "s2"], "evidence": ["three", "absent"]}]}]},
    }
    none = {"id": "n", "abstract": "a", "full_text": {"paragraphs": []}, "qas": {"question": ["q"], "answers": [{"answer": [{"unanswerable": True}]}]}}
    got = qa.papers(spark, write(tmp_path / "p.jsonl", "\n".join(map(json.dumps, (row, none))))).collect()
    assert len(got) == 1 and got[0]["question"] == "yes" and got[0]["answer"] == "s1, s2" and got[0]["context"] == ["three", "abs", "one", "two"]


KEYWORDS = (
    "neural network,deep learning,machine learning,transformer model,language model,gradient descent,convolutional,attention mechanism,reinforcement learning,natural language processing,nlp,bert,gpt,llm,"
    "generative model,classification accuracy,word embedding,recurrent,support vector,random forest,feature extraction"
).split(",")


def test_articles_are_told_by_the_keywords(spark, tmp_path):
    body = "a paragraph of the article that is long enough to stay when all the short ones are dropped, number "
    rows = [{"article": f"{body}{i}", "abstract": f"On {k.title()} for x."} for i, k in enumerate(KEYWORDS)]
    rows += [{"article": f"{body}{90 + i}", "abstract": a} for i, a in enumerate(("We give data on a star system.", "A program of observations, with a model and software.", "An algorithm to compute a network of roads.", None))]
    got = qa.articles(spark, write(tmp_path / "a.jsonl", "\n".join(map(json.dumps, rows)))).collect()
    assert len(KEYWORDS) == 21 and sorted(r["context"][0] for r in got) == sorted(f"{body}{i}" for i in range(21))


def test_passages_skip_blank(spark, tmp_path):
    path = write(tmp_path / "c.jsonl", '{"_id": "a", "text": "t"}\n\n{"id": "b", "text": " "}\n{"id": "c", "text": "u"}\n')
    assert sorted(r["id"] for r in qa.passages(spark, path).collect()) == ["a", "c"]


def test_groups_of_four_drop_the_tail(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k long, text string")
    assert sorted(len(r["context"]) for r in qa.group_rows(rows, "k", "text").collect()) == [4, 4]


def test_registry(spark):
    assert registry.load(spark, " Synthetic ", limit=3).count() == 3
    with pytest.raises(ValueError):
        registry.load(spark, "nothing")
    with pytest.raises(RuntimeError):
        registry.load(spark, "questions", "/nowhere/q.json")


def test_dialogue_pairs(spark, tmp_path):
    talk = [{
        "domain": "clapnq", "messages": [
            {"speaker": "agent", "text": "hello"}, {"speaker": "user", "text": "q1", "enrichments": "{'Question Type': ['Factoid'], 'Answerability': ['ANSWERABLE']}"},
            {"speaker": "agent", "text": "canned", "original_text": "real", "contexts": [{"document_id": "d", "score": "18.759138", "text": " "}, {"document_id": "e", "score": "n/a", "text": "ctx"}]},
            {"speaker": "agent", "text": "again"}, {"speaker": "user", "text": "q2", "enrichments": "broken"}, {"speaker": "agent", "text": "a2", "contexts": []},
        ],
    }]
    rows = dialogue.read_dialogues(spark, write(tmp_path / "d.json", json.dumps(talk))).withColumn("k", F.lit(0))
    got = dialogue.pairs(rows, "k", ("canned",)).orderBy("turn_id").collect()
    assert [(r["question"], r["answer"], r["question_type"]) for r in got] == [("q1", "real", "Factoid"), ("q2", "a2", None)]
    assert [(c["doc_id"], c["rank"], c["score"]) for c in got[0]["contexts"]] == [("e", 2, None)] and got[1]["contexts"] == []


def test_logs_round_trip(spark, tmp_path):
    turn = lambda i, o: {"turn_id": i, "query_type": "Seed", "question": f"q{i}", "gold": "g", "rag_answer": f"a{i}", "outcome": o, "is_unanswerable": False}
    folder = tmp_path / "m" / "r" / "d" / "conversation_000"
    folder.mkdir(parents=True)
    write(folder / "conversation.json", json.dumps({"method": "m", "rag": "r", "dataset": "d", "conversations": [{"conversation_id": "c", "turns": [turn(0, "correct"), turn(2, "wrong"), turn(1, "abstained")]}]}))
    write(folder / "broken.json", "{nope")
    flat = logs.turns(logs.path_dimensions(logs.read_logs(spark, str(tmp_path / "m"))))
    assert flat.count() == 3
    bad = logs.failed_turns(flat).collect()
    assert len(bad) == 1 and [h["question"] for h in bad[0]["history"]] == ["q0", "q1"]
    assert logs.failed_turns(flat, abstained=True).count() == 2
    out = str(tmp_path / "out")
    logs.write_turns(flat, out)
    logs.write_turns(flat, out)
    assert spark.read.parquet(out).count() == 3
