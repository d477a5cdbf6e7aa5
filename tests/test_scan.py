"""The scan that stops early: ranges, order, rows read, shapes of contexts, odd lines."""

from __future__ import annotations

import gzip
import json

import pytest

from turnlens.sources import registry, scan

TITLED = {"title": ["A", "B"], "sentences": [["One.", "Two."], ["Three."]]}


def lines(path, rows):
    path.write_text("".join(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return path


@pytest.mark.parametrize("split", [1, 7, 64, 10_000])
def test_every_line_belongs_to_one_range(spark, tmp_path, split):
    rows = [{"id": f"{i}", "question": "ü" * (i % 9), "context": [f"c{i}"]} for i in range(40)]
    lines(tmp_path / "a.jsonl", [*rows[:25], "\n", "  \n"])
    lines(tmp_path / "b.jsonl", [*rows[25:39], json.dumps(rows[39])])  # no line end
    reader = scan.Lines({"path": str(tmp_path), "splitBytes": str(split)})
    got = [r[2] for part in reader.partitions() for r in reader.records(part)]
    assert got == [r["id"] for r in rows]
    if split == 64:
        assert sorted(r["id"] for r in scan.scan(spark, str(tmp_path), splitBytes=split).collect()) == sorted(got)


def test_limit_reads_no_further(spark, tmp_path):
    path = str(lines(tmp_path / "a.jsonl", [{"id": str(i)} for i in range(9)] + ["not json\n"]))
    assert [r["id"] for r in scan.scan(spark, path, 9).collect()] == [str(i) for i in range(9)]  # the bad line is never parsed
    with pytest.raises(Exception, match="at byte"):
        scan.scan(spark, path).collect()
    assert scan.scan(spark, path, mode="dropmalformed").count() == 9
    reader = scan.Lines({"path": path, "limit": "2", "splitBytes": "40"})
    parts = reader.partitions()
    assert len(parts) > 2 and all(len(list(reader.records(p))) <= 2 for p in parts[:-1])


def test_first_records_in_order_of_files(spark, tmp_path):
    lines(tmp_path / "b.jsonl", [{"id": "b"}])
    with gzip.open(tmp_path / "c.jsonl.gz", "wt") as f:
        f.write('{"id": "c"}\n{"id": "d"}\n')
    lines(tmp_path / "a.jsonl", [{"question": "no id"}, {"id": "a"}])
    assert [r["id"] for r in scan.scan(spark, str(tmp_path), 4).collect()] == ["0-0", "a", "b", "c"]
    assert scan.scan(spark, str(tmp_path), 0).count() == 0 and scan.scan(spark, str(tmp_path)).count() == 5


def test_samples_of_titled_contexts(spark, tmp_path):
    rows = [{"_id": "1", "question": " Q ", "answer": "A", "context": TITLED, "level": "hard", "n": 3}, {"_id": "2", "question": None, "context": "text"}, {"_id": "3", "context": ["x", " ", {"text": "y"}]}, {"_id": "4", "context": None}]
    path = str(lines(tmp_path / "t.jsonl", rows))
    got = {r["id"]: r for r in scan.samples(spark, path, fields={"id": "_id"}).collect()}
    assert got["1"]["context"] == ["One. Two.", "Three."] and got["1"]["question"] == "Q" and got["1"]["meta"] == {"level": "hard", "n": "3"}
    assert got["2"]["context"] == ["text"] and got["2"]["question"] == "" and got["3"]["context"] == ["x", "y"] and got["4"]["context"] == []


def test_by_name(spark, tmp_path):
    path = str(lines(tmp_path / "n.jsonl", [{"id": str(i), "context": "t"} for i in range(60)]))
    assert registry.load(spark, "lines", path, limit=7).count() == 7 and registry.load(spark, "lines", path).count() == 60
    with pytest.raises(RuntimeError):
        registry.load(spark, "lines", str(tmp_path / "absent"))
    with pytest.raises(RuntimeError):
        registry.load(spark, "lines", str(lines(tmp_path / "empty.jsonl", [])))
