"""Exact, suffix, line and near-duplicate removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import cases
from turnlens.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from turnlens.llm.common import cut
from turnlens.llm.shingles import shingle_hashes


def small(spark, n=250):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(n)


# --- exact ------------------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("most", [exact_dedup.MAX_BROADCAST_REGISTERS, 1])
@pytest.mark.parametrize("make", [cases.documents, cases.empty, small])
def test_exact(spark, make, most, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BROADCAST_REGISTERS", most)
    docs = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = exact_dedup.flag_copies(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_exact(rows)
    # one row of each text stays, the one of the largest id
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({t or "" for _, t in rows}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == len(kept)
    assert sorted((r["text"] or "" for r in left.collect())) == sorted({t or "" for _, t in rows})


def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    rows = spark.range(20000).select("id", F.xxhash64("id").alias("h"))
    got = {r[0] for r in exact_dedup.maybe_in(rows, "h", keys, "k").select("id").collect()}
    assert set(range(5000)) <= got and len(got) < 8000


# --- suffix array -----------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in [*range(30), 500]:
        t = np.array([rng.randint(1, letters) for _ in range(n)], int)
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def brute_suffix(rows, length=suffix_dedup.LENGTH):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def planted(spark):
    """Passages at and around the length, overlapping, within a document and across, and periodic text."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(80)[:k] for k in (199, 200, 201, 260, 400)]
    rows = [(k, prose(40) + "".join(rng.sample(passages, 2)) + prose(30), "en", "a") for k in range(30)]
    rows += [(100, "ab" * 300, "en", "a"), (101, passages[4] + passages[4], "en", "a"), (102, None, "en", "a"), (103, "ü" * 150, "de", "a"), (104, prose(300), "en", "b"), (104, rows[0][1], "en", "b")]
    return cases.documents(spark, rows)


@pytest.mark.parametrize("make", [planted, cases.empty])
@pytest.mark.parametrize("most", [suffix_dedup.MAX_TILES, 2])
def test_suffix(spark, make, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_TILES", most)
    docs = make(spark)
    got = suffix_dedup.remove_repeats(docs).collect()
    want = brute_suffix([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str) == want


def test_suffix_takes_odd_rows(spark):
    docs = cases.documents(spark)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[1]["n_bytes"] == 0 and bytes(got[4]["kept"]) == b"one" and len(got) == len({r[0] for r in cases.ROWS})


# --- lines ------------------------------------------------------------------------------


def words_of(line):
    return [w for w in re.split(line_dedup.SEPARATORS, line.lower()) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row[-1]


def brute_lines(rows):
    """Lines that go, as (row, position)."""
    first, names = {}, {}
    for r, (_, t) in enumerate(rows):
        for p, line in enumerate((t or "").split("\n")):
            if w := words_of(line):
                names.setdefault(tuple(w), []).append((r, p))
    keys = list(names)
    group = list(range(len(keys)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(keys)):
        for j in range(i):
            if distance(keys[i], keys[j]) <= (1 - line_dedup.SIMILARITY) * max(len(keys[i]), len(keys[j])) + 1e-9:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    for i, k in enumerate(keys):
        for at in names[k]:
            first.setdefault(find(i), at)
            first[find(i)] = min(first[find(i)], at)
    return {at for i, k in enumerate(keys) for at in names[k] if at != first[find(i)]}


def fuzzy(spark):
    rng = random.Random(11)
    base = [" ".join(rng.choice("alder brook cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north orchard pier quarry ridge shore thicket".split()) + str(rng.randint(0, 40)) for _ in range(n)) for n in (60, 90, 120, 200)]

    def change(line):
        w = line.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randint(0, 9))
        return " ".join(w)

    rows = [(k, "\n".join([*(change(rng.choice(base)) for _ in range(3)), "", "unique line " + str(k) * 3, "--- ***"]), "en", "a") for k in range(40)]
    return cases.documents(spark, rows)


@pytest.mark.parametrize("make", [fuzzy, cases.empty])
def test_lines(spark, make):
    docs = make(spark)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    gone = brute_lines(rows)
    want = [(i, "\n".join(x for p, x in enumerate((t or "").split("\n")) if (r, p) not in gone), sum(g[0] == r for g in gone)) for r, (i, t) in enumerate(rows)]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect())
    assert got == want
    assert make is cases.empty or len(gone) > 60


def test_lines_link_a_row_given_twice(spark):
    """Rows that repeat id and text are one document: its line is linked to a similar one as if it were given once."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        w = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
        v = [*w[:20], "changed", *w[21:]]
        rows += [(2 * k, " ".join(w), "en", "a")] * (1 + k % 4) + [(2 * k + 1, " ".join(v), "en", "a")] * (1 + k % 3)
    got = line_dedup.dedup_lines(cases.documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_removed"] == r["doc_id"] % 2 for r in got)


def test_lines_take_odd_rows(spark):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(cases.documents(spark)).collect()}
    assert got[1]["text"] == "" and got[1]["n_lines"] == 1 and got[3]["text"] == " \n\t " and got[9]["text"] == "\nother words here"


def changed_lines(spark):
    """Pairs of lines of 4 to 40 words around the similarity, by substitutions, insertions and deletions; some with repeated words."""
    rng = random.Random(23)
    word = lambda: rng.choice(["of", "the", "a"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = []
    for k in range(220):
        w = [word() for _ in range(rng.randint(4, 40))] if k % 11 else ["ha"] * rng.randint(4, 40)
        v = list(w)
        for _ in range(max(1, len(w) // 5 + rng.randint(-2, 1))):
            at, what = rng.randrange(len(v)), rng.randrange(4)
            v[at : at + 1] = [word()] if what < 2 else [v[at], word()] if what == 2 else []
        rows += [(2 * k, " ".join(w), "en", "a"), (2 * k + 1, " ".join(v), "en", "a")]
    return cases.documents(spark, rows)


def test_lines_lose_no_similar_pair(spark, monkeypatch):
    """The same with no and with most word pairs taken as frequent."""
    docs = changed_lines(spark)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    gone = {rows[r][0] for r, _ in brute_lines(rows)}
    assert len(gone) > 100
    for least in (16, 1):
        monkeypatch.setattr(line_dedup, "OFTEN_LEAST", least, raising=False)
        assert {r["doc_id"] for r in line_dedup.dedup_lines(docs).collect() if r["n_removed"]} == gone


def test_lines_are_confirmed_by_words(spark, monkeypatch):
    """With two codes for all words, codes alone would link lines that share no word but a pair."""
    monkeypatch.setattr(line_dedup, "CODES", 2)
    monkeypatch.setattr(line_dedup, "_may", lambda a, b: F.col(f"{a}.id") != F.col(f"{b}.id"))
    words = [[f"{c}{k}" for k in range(8)] + ["common", "pair"] for c in "abcdef"]
    rows = [(i, " ".join(w), "en", "a") for i, w in enumerate(words)] + [(10, " ".join([*words[0][:7], "x", *words[0][8:]]), "en", "a")]
    monkeypatch.setattr(line_dedup, "prefix_length", lambda n: n - 1)
    got = line_dedup.dedup_lines(cases.documents(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == {10}


def test_lines_of_a_common_pair(spark, monkeypatch):
    """Lines that meet in one bucket, few of them similar, compared in small blocks; and a very long line."""
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows = []
    for k in range(60):
        w = [*(word() for _ in range(6)), "common", "pair", *(word() for _ in range(rng.randint(0, 3)))]
        rows += [(2 * k, " ".join(w), "en", "a"), (2 * k + 1, " ".join([*w[:2], "else", *w[3:]]), "en", "a")]
    long = [word() for _ in range(6000)]
    rows += [(200, " ".join(long), "en", "a"), (201, " ".join([*long[:50], *long[900:]]), "en", "a"), (202, " ".join(reversed(long)), "en", "a")]
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    monkeypatch.setattr(line_dedup, "prefix_length", lambda n: n - 1)
    got = line_dedup.dedup_lines(cases.documents(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == {i for i, *_ in rows if i % 2}


@pytest.mark.parametrize("direct", [0, 64])
def test_lines_are_linked_where_the_first_pairs_are_not(spark, monkeypatch, direct):
    """If no pair that is tried first is a link, the other pairs of the buckets still are tried, with leaders and without."""
    first = line_dedup._met
    monkeypatch.setattr(line_dedup, "_met", lambda *args: (lambda pairs, *rest: (pairs.limit(0), *rest))(*first(*args)))
    monkeypatch.setattr(line_dedup, "DIRECT", direct, raising=False)
    rows = [(k, " ".join(["seven", "words", "that", "all", "lines", "do", "share", *(f"{c}{k}" for c in "abcdefgh")]), "en", "a") for k in range(1, 9)]
    rows.append((9, rows[3][1] + " more", "en", "a"))
    got = line_dedup.dedup_lines(cases.documents(spark, rows)).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == {9}


def test_lines_leave_little_behind(spark):
    """What rounds have read goes with them; the lines to remove alone stay in the checkpoint folder."""
    cut(spark.range(1))  # so that the folder is there
    at = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in at.rglob("*") if f.is_file())
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    before = size()
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert size() - before < sum(f.stat().st_size for f in Path(f"{DATA}/sf0.01").glob("documents.parquet*")) / 2


# --- near duplicates --------------------------------------------------------------------


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_near(rows):
    ids = [i for i, _ in rows]
    sets = [shingle_set(t) for _, t in rows]
    group, links = list(range(len(rows))), Counter()
    find = lambda x: x if group[x] == x else find(group[x])
    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=lambda r: ids[r])
                group[y] = x
    return sorted(((ids[r], ids[find(r)], links[r]) for r in range(len(rows))), key=str)


def near_copies(spark):
    rng = random.Random(5)
    base = [f"t{rng.randint(0, 5000)}" for _ in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
        rows.append((k, " ".join(w), "en", "a"))
    return cases.documents(spark, rows)


@pytest.mark.parametrize("make", [near_copies, cases.documents, cases.empty, small])
def test_near_duplicates(spark, make):
    docs = make(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == brute_near(rows)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """The same over several blocks of a chain."""
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", 16)
    docs = near_copies(spark)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == sorted(brute_near([(r["doc_id"], r["text"]) for r in docs.collect()]))
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns and left.count() == len({c for _, c, _ in got})


def test_near_duplicates_of_shared_and_text_ids(spark):
    """Rows that share an id are judged by their texts; ids may be strings."""
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w), "en", "a"), (1, "another text altogether of seven words", "en", "a"), (2, " ".join([*w[:59], "x"]), "en", "a"), (2, "one more text on its own here", "en", "a")]
    docs = cases.documents(spark, rows)
    assert sorted(r["text"] for r in ngram_join.keep_one(docs).collect()) == sorted([rows[0][1], rows[1][1], rows[3][1]])
    named = docs.withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(named).collect()} == {("id1", "id1", 1), ("id1", "id1", 0), ("id2", "id1", 1), ("id2", "id2", 0)}


def test_forest_ends_at_the_measured_recall(spark):
    found = lambda agree, n: spark.range(n).select(F.col("id").alias("a"), F.lit(agree).cast("long").alias("agree"))
    n, lost = ngram_join.missing(found(119, 5000), ngram_join.DEPTH)
    assert n == 5000 and lost < 1e-4 * 5000  # near-identical texts: whole labels find them all
    n, lost = ngram_join.missing(found(98, 5000), ngram_join.DEPTH)
    assert lost > 1e-4 * 5000  # at the threshold some must have been missed
    assert ngram_join.missing(found(119, 5), ngram_join.DEPTH)[1] > 1e-4 * 5  # too few to tell
    assert ngram_join.meet(ngram_join.THRESHOLD, ngram_join.prefix_length()) >= ngram_join.RECALL


def test_shingles_match_words():
    texts = [None, "", " ", "a b", "a b c d e f", "\x0ba\rb  c\td e", "é 漢 🎉 x y z", "a b c d e f"]
    hashes, n = shingle_hashes(texts)
    parts = np.split(hashes, np.cumsum(n)[:-1])
    assert n.tolist() == [0, 0, 0, 1, 2, 1, 2, 2] and parts[4].tolist() == parts[7].tolist() and parts[5][0] == parts[4][0]
