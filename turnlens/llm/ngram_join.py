"""Near-duplicate texts: all pairs of a shingle Jaccard similarity, through a MinHash LSH forest.

1. Each text becomes the set of its five-word shingles and a MinHash
   signature. Texts of one set form a set class; only classes go on.
2. The signature is cut into TREES labels of DEPTH values. Each tree is a trie of
   its labels: classes with the same prefix of a label are partners. The
   search begins with whole labels and shortens the prefix by one value at a time,
   only for prefixes whose classes are not connected yet.
3. Partners whose signatures agree are joined to chains. From the similarity of
   those found follows how likely they were found at this depth, and so the recall
   (what was found, of what that many must come from). Shortening ends when it
   reaches the target, or at the depth at which even pairs at the threshold meet with
   the target recall.
4. Exact Jaccard of all pairs of a chain, in blocks of classes by blocks, so
   that a chain of any length spreads over tasks; no pair is emitted. Each
   block gives, for each class, its number of links and the least class it is
   connected to.
5. Connected components of these give the classes of near duplicates.

Defined results: a text of one to four words has a single shingle of them
all. Null and empty texts have none: each is a class of its own with no link.
Very long texts are read whole. A row whose id is null has no class and no links.
Repeated rows count as copies of each other; rows that share an id and not the text
are judged each by its text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import broadcast_if_small, components, cut, kept_narrow, own_names, small_batches
from turnlens.llm.exact_dedup import without
from turnlens.llm.shingles import mix, shingle_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Trees, values of a whole label, and the recall to reach.
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: Signatures that agree less than this are apart (5 standard errors below the threshold).
LIKELY = 0.6
#: Classes of a block: when comparing signatures, and when comparing sets; and shingles of a block of sets.
SIGNATURE_BLOCK, SET_BLOCK, SET_SHINGLES = 1024, 512, 1 << 20
#: Shingles (columns) that a set comparison spreads out at once.
COLUMNS = 2048
#: Characters of the texts that are sketched at once; a longer text goes alone.
SKETCH_CHARS = 1 << 21


def meet(similarity: float, depth: int, trees: int = TREES) -> float:
    """How likely two texts share a prefix of so many values in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which pairs at the threshold meet with the target recall: none need be shorter."""
    while depth > 1 and meet(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240607))
    n = TREES * DEPTH
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def sketches(texts: list, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: shingles in its set, two keys of the set, and the signature: 16-bit values, label by label."""
    hashes, counts = shingle_hashes(texts, size)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    n = np.bincount(owner, minlength=len(counts))
    some = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[some]
    keys = np.zeros((len(counts), 2), np.uint64)
    low = np.zeros((TREES * DEPTH, len(counts)), np.uint64)
    if len(some):
        keys[some, 0] = np.add.reduceat(mix(hashes), starts)
        keys[some, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
        a, b = _permutations()
        for k in range(TREES * DEPTH):
            low[k, some] = np.minimum.reduceat(hashes * a[k] + b[k], starts)
    # the low bits of an odd multiple are weak: the high ones carry a value
    signature = (mix(low >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.uint16).T
    return n, keys.astype(np.int64), np.ascontiguousarray(signature)


def _portions(texts: list) -> Iterator[tuple[int, int]]:
    """Runs of texts of SKETCH_CHARS characters at most, or of one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > SKETCH_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _sketched(texts: DataFrame) -> DataFrame:
    """doc_id, _h, n, k1, k2 and signature of texts (doc_id, _h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(2).to_pylist()
            for i, j in _portions(whole):
                n, keys, sig = sketches(whole[i:j])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in (0, 1)), pa.array(n.astype(np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["doc_id", "_h", "n", "k1", "k2", "signature"],
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, _h long, n long, k1 long, k2 long, signature binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal first ``keys`` columns, of sorted batches."""
    now, rows = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        heads = list(zip(*cols[:keys], strict=True))
        at = 0
        while at < len(heads):
            end = at + 1
            while end < len(heads) and heads[end] == heads[at]:
                end += 1
            if heads[at] != now:
                if rows is not None:
                    yield now, dict(zip(b.schema.names[keys:], rows, strict=True))
                now, rows = heads[at], [[] for _ in cols[keys:]]
            for have, col in zip(rows, cols[keys:], strict=True):
                have.extend(col[at:end])
            at = end
    if rows is not None:
        yield now, dict(zip(b.schema.names[keys:], rows, strict=True))


def _least_connected(linked: Callable[[int], np.ndarray], ids: np.ndarray) -> np.ndarray:
    """The least id of each node's component; ``linked(i)`` tells the neighbours of node i."""
    out = ids.copy()
    open_ = np.ones(len(ids), bool)
    for start in np.argsort(ids, kind="stable"):
        if open_[start]:
            open_[start] = False
            todo = [start]
            while todo:
                more = np.flatnonzero(linked(todo.pop()) & open_)
                open_[more] = False
                out[more] = ids[start]
                todo.extend(more)
    return out


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that join the classes of a bucket whose signatures agree, and the most values in which a agrees with another."""
    a, b, agree = [], [], []
    rows_of = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, agree)], ["a", "b", "agree"])
    for (_, _, one, two), rows in _groups(batches, 4):
        ids = np.array(rows["id"])
        sig = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(len(ids), -1)
        block = np.array(rows["block"])
        need = LIKELY * sig.shape[1]
        best = np.zeros(len(ids), int)

        def near(i: int, sig: np.ndarray = sig, block: np.ndarray = block, best: np.ndarray = best, need: float = need, cross: bool = one != two) -> np.ndarray:
            same = (sig == sig[i]).sum(1)
            same[i] = 0
            if cross:
                same[block == block[i]] = 0
            hit = same >= need
            best[hit] = np.maximum(best[hit], same[hit])
            return hit

        if len(ids) > 1:
            least = _least_connected(near, ids)
            far = least != ids
            a.extend(ids[far])
            b.extend(least[far])
            agree.extend(best[far])
        if len(a) > 20_000:
            yield rows_of()
            a, b, agree = [], [], []
    yield rows_of()


def link_matrix(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which sets of ``rows`` and of ``cols`` (indices) have at least this Jaccard similarity, exactly."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, col, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    number = np.cumsum(times > 1) - 1
    owner, col = owner[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    common = np.zeros((len(rows), len(cols)), np.float32)
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [low, low + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[i:j], col[i:j] - low] = 1
        common += x[rows] @ x[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    return common >= threshold * union - 1e-6


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class of a pair of blocks: the least class connected, and how many rows it links to."""
    a, b, links = [], [], []
    for (_, one, two), got in _groups(batches, 3):
        ids, keep = np.unique(np.array(got["id"]), return_index=True)  # a repeated row comes twice
        sets = [np.frombuffer(got["shingles"][k], np.uint64) for k in keep]
        copies, block = np.array(got["copies"])[keep], np.array(got["block"])[keep]
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        if not len(left) or not len(right) or len(ids) < 2:
            continue
        near = link_matrix(sets, left, right)
        full = np.zeros((len(ids), len(ids)), bool)
        full[np.ix_(left, right)] = near
        full |= full.T
        np.fill_diagonal(full, False)
        a.extend(ids)
        b.extend(_least_connected(full.__getitem__, ids))
        links.extend(full @ copies)
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], ["a", "b", "links"])
            a, b, links = [], [], []
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], ["a", "b", "links"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sorted shingle set; drops rows whose set is not that of the class (an id used twice)."""
    for b in batches:
        names = b.schema.names
        texts = b.column(names.index("text")).to_pylist()
        hashes, n = shingle_hashes(texts, SHINGLE)
        sets = [np.unique(s) for s in np.split(hashes, np.cumsum(n)[:-1])]
        k1 = [int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
        right = pa.array([x == y for x, y in zip(k1, b.column(names.index("k1")).to_pylist(), strict=True)])
        cols = [b.column(i) for i, c in enumerate(names) if c not in ("text", "k1")]
        out = pa.RecordBatch.from_arrays([*cols, pa.array([s.tobytes() for s in sets], pa.binary())], [*(c for c in names if c not in ("text", "k1")), "shingles"])
        yield out.filter(right)


def _in_block_pairs(rows: DataFrame, keys: list[str], blocks: str) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: (keys, one, two, block, ...)."""
    other = F.explode(F.expr(f"sequence(0L, {blocks} - 1)"))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(3), F.col("id")), F.col(blocks))).withColumn("_other", other).select(
        *keys, F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"), "block", *(c for c in rows.columns if c not in {*keys, blocks})
    )


def missing(found: DataFrame, depth: int) -> tuple[int, float]:
    """How many links of the threshold were found, (a, agree), and how many others these and none at all let expect at this depth."""
    alike = F.col("agree") / (TREES * DEPTH)
    likely = 1 - F.pow(1 - F.pow(alike, F.lit(depth)), F.lit(TREES))
    n, more = found.filter(alike >= THRESHOLD).agg(F.count(F.lit(1)), F.sum(1 / likely - 1)).first()
    # none found of some kind: up to three of them may exist (95 %), at worst right at the threshold
    return n, (more or 0.0) + 3 * (1 - meet(THRESHOLD, depth))


def _chains(classes: DataFrame) -> DataFrame:
    """(node, label): classes (id, signature) that the forest finds to be likely partners, connected."""
    found = label = None
    floor = prefix_length()
    for depth in range(DEPTH, floor - 1, -1):
        placed = classes.withColumn("label", F.col("id")) if label is None else classes.join(label, F.col("id") == F.col("node"), "left").select("id", "signature", F.coalesce("label", "id").alias("label"))
        prefix = lambda t: F.xxhash64(F.substring(F.col("signature"), t * (2 * DEPTH) + 1, F.lit(2 * depth)))  # noqa: E731, B023
        entries = placed.select("id", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), prefix)).alias("tree", "prefix"))
        stats = [F.count(F.lit(1)).alias("members"), F.min("id").alias("low"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark"), F.min("label").alias("x"), F.max("label").alias("y")]
        buckets = entries.groupBy("tree", "prefix").agg(*stats).filter("x <> y")
        # buckets of the same members are one
        buckets = cut(buckets.groupBy("members", "low", "mark").agg(F.min(F.struct("tree", "prefix")).alias("b")).select("b.*", "members"))
        members = entries.select("id", "tree", "prefix").join(broadcast_if_small(buckets), ["tree", "prefix"]).withColumn("blocks", F.ceil(F.col("members") / SIGNATURE_BLOCK)).drop("members")
        keys = ["tree", "prefix"]
        signed = members.join(classes.select("id", "signature"), "id")
        paired = _in_block_pairs(signed, keys, "blocks").repartition(*keys, "one", "two").sortWithinPartitions(*keys, "one", "two").select(*keys, "one", "two", "block", "id", "signature")
        more = cut(paired.mapInArrow(_likely, "a long, b long, agree long"))
        edges = more.select("a", "b")
        if label is not None:
            edges = edges.unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b")))
            more = more.unionByName(found.withColumn("b", F.col("a")))
        found, _ = kept_narrow(more.groupBy("a").agg(F.max("agree").alias("agree")))
        label = components(edges)
        n, lost = missing(found, depth)
        if lost <= (1 - RECALL) * (n + lost):
            break
    return label


def _classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _h (hash of the text), class_id, n_links and kept (the row of the class that stays) of each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_h"), F.col(text_col).alias("text"))
    sketched = cut(_sketched(texts).withColumn("row", F.monotonically_increasing_id()))
    known = sketched.filter("doc_id is not null and n > 0")
    first = F.min(F.struct("doc_id", "row"))
    sets = cut(known.groupBy("k1", "k2", "n").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")))
    sets = sets.select("k1", "k2", "n", F.col("first.row").alias("id"), F.col("first.doc_id").alias("least"), "copies")
    classes = cut(sets.join(sketched.select(F.col("row").alias("id"), "signature"), "id").select("id", F.col("least").alias("doc_id"), "copies", "k1", "n", "signature"))
    chains = _chains(classes.select("id", "signature"))
    members = chains.withColumnRenamed("node", "id").join(classes.select("id", "doc_id", "copies", "k1", "n"), "id")
    sizes = members.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SET_BLOCK), F.ceil(F.sum("n") / SET_SHINGLES)).alias("blocks"))
    placed = cut(members.join(broadcast_if_small(sizes), "label").select("label", "blocks", "id", F.col("doc_id").alias("own"), "copies", "k1"))
    with_text = texts.join(broadcast_if_small(placed), texts["doc_id"] == placed["own"]).select("label", "blocks", "id", "copies", "k1", "text")
    shingled = with_text.mapInArrow(_shingled, "label long, blocks long, id long, copies long, shingles binary")
    keys = ["label"]
    blocked = _in_block_pairs(shingled, keys, "blocks").repartition(*keys, "one", "two").sortWithinPartitions(*keys, "one", "two").select(*keys, "one", "two", "block", "id", "copies", "shingles")
    found = cut(blocked.mapInArrow(_verified, "a long, b long, links long"))
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    labels = components(found.select("a", "b")).withColumnRenamed("node", "id")
    joined = sets.select("id", "least").join(labels, "id").groupBy("label").agg(F.min(F.struct("least", "id")).alias("top"))
    joined = labels.join(joined, "label").select("id", "top")
    settled = sets.join(links, "id", "left").join(joined, "id", "left").select(
        "k1", "k2", "n", "copies", F.coalesce("top.least", "least").alias("class_id"), F.coalesce("top.id", "id").alias("stays"), F.coalesce("links", F.lit(0)).alias("links")
    )
    met = sketched.select("doc_id", "_h", "k1", "k2", "n", "row").join(settled, ["k1", "k2", "n"], "left")
    own = F.col("class_id").isNotNull() & F.col("doc_id").isNotNull()
    return met.select(
        "doc_id", "_h",
        F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(own, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"),
        (~own | (F.col("row") == F.col("stays"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the least id of its class), n_links.

    n_links counts the other rows of at least the threshold similarity, copies included.
    """
    return _classified(docs, id_col, text_col).select("doc_id", "class_id", "n_links")


@own_names
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates, that of the least id, all columns kept."""
    return without(docs, cut(_classified(docs, id_col, text_col)), F.xxhash64(F.coalesce(text_col, F.lit(""))), id_col)
