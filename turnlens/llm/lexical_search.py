"""The best documents for each of a set of queries, by WAND over document shards.

A pass over the texts keeps the number of terms of every document and its
counts of the terms that queries have. Statistics of the whole corpus
(documents, terms, documents of a term) are aggregates over that table. Then
every task takes the documents of its partition in shards of a bounded number
of postings, weighs the postings of a shard once, and runs each query over
them: cursors on the query's posting lists stand in order of their next
document; the pivot is the first cursor up to which the lists' greatest impacts
add up to the least score in the query's heap, and what lies before the pivot's
document is skipped, as it cannot enter the heap. A heap lives on from shard
to shard of a task; the heaps of all tasks are merged by Spark, first within
groups of tasks, then all, with k rows a query from each.

Queries are taken in blocks of a bounded number of rows, each broadcast to all
documents, so their number is not limited.

Score: a term of weight w that a document of length measure m holds tf times
adds w * (10^9 tf div (1000 tf + 8 m)), in 64-bit integers; see :func:`weight`
and :func:`measure`.

Defined results: a null text, or one without a term, counts neither as a
document nor is found; a query without terms, or whose terms no document has,
has no rows. Each row is a document by itself, also one that repeats or has no
id; equal scores come by ascending id, those without an id last. Empty tables
give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlens.llm.common import cut, small_batches

#: A term: a run of letters and digits, and of anything beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TOP = 10
#: Queries that are searched at once, and characters of them.
BLOCK_QUERIES, BLOCK_CHARS = 1024, 1 << 22
#: Postings of a shard; a shard ends with the document that reaches them.
SHARD_POSTINGS = 1 << 20
#: Different spellings of terms whose number a worker remembers.
MEMO_ENTRIES = 1 << 19
#: Groups of tasks whose heaps are merged first.
MERGE_GROUPS = 64


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def measure(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms each: 10 + 90 n / mean, rounded down."""
    return 10 + (90 * n * n_docs) // n_terms


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWERED)


_LOWERED = str.maketrans(UPPER, LOWER)


class Numbers(dict):
    """Spelling to the number of its term, -1 for terms that no query has; of bounded size."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms

    def __missing__(self, term: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        out = self[term] = self.terms.get(lowered(term), -1)
        return out


def counted(docs: DataFrame, terms: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms), terms (numbers of those that queries have) and tf of each row that has a term."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, number = re.compile(TERM).findall, Numbers(shared.value).__getitem__
        for batch in batches:
            lengths, which, tfs = [], [], []
            for text in batch.column(1):
                all_terms = find(text.as_py() or "")
                got = np.fromiter(map(number, all_terms), "i4", len(all_terms))
                t, tf = np.unique(got[got >= 0], return_counts=True)
                lengths.append(len(all_terms))
                which.append(t)
                tfs.append(tf)
            offsets = pa.array(np.cumsum([0, *map(len, which)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x or [np.array([])]).astype(t), k)) for x, t, k in ((which, "i4", pa.int32()), (tfs, "i8", pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tf array<long>")
    return rows.filter("n > 0")


_next = itemgetter(0)


def wand(lists: list[tuple[list[int], list[int], int]], heap: list[tuple[int, int]], k: int, order: Sequence[int]) -> None:
    """Keep in ``heap`` the k best (score, -order) of the documents of the lists and of what it holds.

    A list is the documents of a term in ascending order, what it adds to the
    score of each, and the greatest of that. ``order`` ranks documents whose
    scores are equal.
    """
    end = 1 << 62
    cursors = [[docs[0], 0, most, docs, adds] for docs, adds, most in lists]
    for _, _, _, docs, _ in cursors:
        if docs[-1] != end:
            docs.append(end)
    rest = sum(c[2] for c in cursors)
    least = heap[0][0] if len(heap) >= k else 1
    while rest >= least:
        cursors.sort(key=_next)
        total = 0
        for c in cursors:
            total += c[2]
            if total >= least:
                break
        pivot = c[0]
        if pivot == end:
            return
        if cursors[0][0] == pivot:
            score = 0
            for c in cursors:
                if c[0] != pivot:
                    break
                score += c[4][c[1]]
                c[1] += 1
                c[0] = c[3][c[1]]
            if score > 0:
                found = (score, -order[pivot])
                if len(heap) < k:
                    heapq.heappush(heap, found)
                elif found > heap[0]:
                    heapq.heapreplace(heap, found)
                if len(heap) >= k:
                    least = heap[0][0]
        else:
            for c in cursors:
                if c[0] >= pivot:
                    break
                c[1] = bisect_left(c[3], pivot, c[1])
                c[0] = c[3][c[1]]
        # lists at their end add nothing more
        while cursors and cursors[-1][0] == end:
            rest -= cursors.pop()[2]


class Shard:
    """Posting lists of some documents, weighed once for all queries."""

    def __init__(self, n: np.ndarray, terms: np.ndarray, tf: np.ndarray, per_doc: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        doc = np.repeat(np.arange(len(n)), per_doc)
        adds = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * measure(n, n_docs, n_terms)[doc]))
        by = np.argsort(terms, kind="stable")
        self.doc, self.adds, terms = doc[by], adds[by], terms[by]
        first = np.flatnonzero(np.diff(terms, prepend=-1))
        self.at = dict(zip(terms[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(terms)], strict=True), strict=True))
        self.lists: dict[int, tuple[list[int], list[int], int]] = {}

    def get(self, term: int) -> tuple[list[int], list[int], int] | None:
        if term not in self.lists and term in self.at:
            a, b = self.at[term]
            self.lists[term] = self.doc[a:b].tolist(), self.adds[a:b].tolist(), int(self.adds[a:b].max())
        return self.lists.get(term)


def _searched(counts: DataFrame, queries: list[list[int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query (its number), part, doc_id and score: the k best of each task."""
    shared = counts.sparkSession.sparkContext.broadcast((queries, weights))
    kind = counts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weigh = shared.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in asked]
        best: dict[int, object] = {}  # rank of a document among the ids seen: its id; a heap holds ranks
        kept: list[pa.RecordBatch] = []
        ids_type = None

        def search() -> None:
            """All queries over the rows that are kept; afterwards heaps hold ids again, as (score, order)."""
            rows = pa.Table.from_batches(kept).combine_chunks()
            rows = rows.sort_by([("doc_id", "ascending")])  # nulls last
            terms, tf = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows["terms"], rows["tf"]))
            per_doc = np.diff(np.asarray(terms.offsets))
            shard = Shard(rows["n"].to_numpy(), terms.flatten().to_numpy(), tf.flatten().to_numpy(), per_doc, weigh, n_docs, n_terms)
            ids = rows["doc_id"]
            if best:  # ranks over what heaps hold and what is new
                held = sorted({-o for h in heaps for _, o in h})
                both = pa.chunked_array([pa.array([best[o] for o in held], ids_type), *ids.chunks])
                ranked = np.empty(len(both), "i8")
                ranked[pc.sort_indices(both, null_placement="at_end").to_numpy()] = np.arange(len(both))
                new = dict(zip(held, ranked[: len(held)].tolist(), strict=True))
                for h in heaps:
                    h[:] = [(s, -new[-o]) for s, o in h]
                    heapq.heapify(h)
                order = ranked[len(held) :].tolist()
                names = {new[o]: best[o] for o in held}
            else:
                order, names = list(range(len(ids))), {}
            at = {o: i for i, o in enumerate(order)}
            for query, heap in zip(asked, heaps, strict=True):
                lists = [x for t in query if (x := shard.get(t))]
                if lists:
                    wand(lists, heap, k, order)
            best.clear()
            for o in {-o for h in heaps for _, o in h}:
                best[o] = names[o] if o in names else ids[at[o]].as_py()
            kept.clear()

        postings = 0
        for batch in batches:
            ids_type = batch.column(0).type
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                kept.append(part)
                postings += int(pc.sum(pc.list_value_length(part.column(2))).as_py() or 0)
                if postings >= SHARD_POSTINGS:
                    search()
                    postings = 0
        if kept:
            search()
        if ids_type is not None:
            rows = [(q, best[-o], s) for q, h in enumerate(heaps) for s, o in h]
            part = TaskContext.get().partitionId()
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([r[1] for r in rows], ids_type), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "part", "doc_id", "score"])

    return counts.mapInArrow(run, f"query int, part int, doc_id {kind}, score long")


def _best(rows: DataFrame, by: list[str | Column], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item, from rank 1."""
    spark = docs.sparkSession
    find = re.compile(TERM).findall
    out: DataFrame | None = None
    for block in _blocks(items.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text"))):
        numbers: dict[str, int] = {}
        queries = [[numbers.setdefault(t, len(numbers)) for t in dict.fromkeys(find(lowered(text or "")))] for _, text in block]
        counts = cut(counted(docs, numbers, id_col, text_col))
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        held = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()  # of the block's terms alone
        weights = np.zeros(len(numbers) + 1, "i8")
        for t, df in held:
            weights[t] = weight(n_docs, df)
        found = _searched(counts, queries, weights, n_docs, n_terms, k)
        merged = _best(_best(found.withColumn("part", F.col("part") % MERGE_GROUPS), ["query", "part"], k).drop("rank"), ["query"], k)
        schema = f"query int, item_id {items.schema[item_col].dataType.simpleString()}"
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], schema)
        rows = merged.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        kinds = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], "item_id {}, rank int, doc_id {}, score long".format(*kinds))
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The queries in blocks of bounded rows and characters; the driver holds one block at a time."""
    block, chars = [], 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        chars += len(text or "")
        if len(block) >= BLOCK_QUERIES or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


SQL = rf"""
    WITH terms AS (
        SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents
    ), docs AS (SELECT doc_id, d, len(t) AS n, t FROM terms WHERE len(t) > 0
    ), sizes AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM docs
    ), asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark
    ), tf AS (
        SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY d, term
    ), weighed AS (
        SELECT term, floor(1000 * ln((2 * max(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term
    ), adds AS (
        SELECT tf.d, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt))) AS s
        FROM tf JOIN docs ON docs.d = tf.d JOIN weighed USING (term), sizes
    ), scored AS (
        SELECT item_id, d, sum(s)::BIGINT AS score FROM adds JOIN asked USING (term) GROUP BY item_id, d HAVING sum(s) > 0
    ), ranked AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored JOIN docs USING (d)
    )
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
