"""Mix overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that list
them). A flow network routes each pattern's tokens, at a convex cost for each
repetition, to the source quotas. Which documents of a pattern are repeated
once more is settled by a seeded hash, whose threshold is found from
histograms, so no source is ever sorted or gathered in one place. A document
that does not fit is skipped, and the search goes on behind it among those
that fit, until none does; a subset sum only fills the last words.

Defined results: a null text has size 0, an empty one too, and both are taken
0 times. A null source is a source of its own, last in order. A document
listed by no source takes no part. Rows that share an id, or have none, are told
apart by their texts; rows equal in both are taken alike. An empty table gives no
rows. Very long texts are counted whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import cut, own_names, word_count

#: Membership patterns a mix may have: they are metadata, solved on the driver and broadcast. More raise an error; none is dropped.
MAX_PATTERNS = 100_000
#: How often a document may be taken, and the marginal cost of each repetition.
REPEATS = 3
COSTS = (0, 1, 3)
#: Histogram levels, and bits of the seeded hash for each of them.
LEVELS, LEVEL_BITS = 3, 12
#: Documents of each size class that may fill what whole documents leave open.
FILLERS = 4


@dataclass
class Mix:
    """What the flow decided: source -> (size, target); pattern -> (full repeats, tokens beyond them), and
    the ranges (from, below, largest size) of buckets whose documents are taken once more."""

    sources: dict[str | None, tuple[int, float]]
    usage: dict[str, tuple[int, int]] = field(default_factory=dict)
    cuts: dict[str, list[tuple[int, int, int]]] = field(default_factory=dict)
    extra: list[tuple[str, int, int, int]] = field(default_factory=list)


def weights_in_turn(sources: list[str | None]) -> dict[str | None, int]:
    """1, 2, 3, repeating over sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: i % 3 + 1 for i, s in enumerate(ordered)}


def capped_targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: int, most: int = REPEATS) -> dict[str | None, float]:
    """Share ``total`` by weight; a target stops at ``most`` times its size, the rest is reshared."""
    targets: dict[str | None, float] = {}
    open_, left = [s for s in sizes if weights.get(s, 0) > 0], float(total)
    targets |= {s: 0.0 for s in sizes if weights.get(s, 0) <= 0}
    while open_:
        whole = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / whole > most * sizes[s]]
        if not over:
            return targets | {s: left * weights[s] / whole for s in open_}
        for s in over:
            targets[s] = float(most * sizes[s])
            left -= targets[s]
            open_.remove(s)
    return targets


def min_cost_flow(capacity: dict[str, int], members: dict[str, list], quota: dict, costs: tuple[int, ...] = COSTS) -> dict[str, dict]:
    """Tokens from patterns to sources: as many as quotas allow, at the least repetition cost.

    Only arcs into patterns cost anything, and a shortest path enters one pattern from
    the start, so all augmenting paths of one repetition cost the same: successive shortest
    paths are a maximum flow for each repetition in turn, on what the ones before left. Each
    is found in blocking flows, which take patterns without a competitor in one sweep.
    Returns for each pattern the tokens sent to each source.
    """
    open_ = {s: q for s, q in quota.items() if q > 0}
    ways = {p: [s for s in members[p] if s in open_] for p in sorted(capacity) if capacity[p] > 0}
    sent: dict[str, dict] = {p: dict.fromkeys(ss, 0) for p, ss in ways.items()}
    givers: dict[object, list[str]] = {s: [] for s in open_}
    for p, ss in ways.items():
        for s in ss:
            givers[s].append(p)
    for _ in sorted(costs):
        spare = {p: capacity[p] for p in ways}
        while _blocking_flow(ways, givers, sent, spare, open_):
            pass
    return {p: {s: n for s, n in sent.get(p, {}).items() if n} for p in capacity}


def _blocking_flow(ways: dict[str, list], givers: dict[object, list[str]], sent: dict[str, dict], spare: dict[str, int], open_: dict) -> int:
    """Adds to ``sent`` a flow that blocks all shortest paths from patterns with ``spare`` to sources still ``open_``; the tokens moved."""
    depth: dict[tuple, int] = {("p", p): 0 for p, n in spare.items() if n > 0}
    layer, reached = list(depth), False
    while layer and not reached:
        after = []
        for kind, v in layer:
            nexts = [("s", s) for s in ways[v]] if kind == "p" else [("p", p) for p in givers[v] if sent[p][v] > 0]
            for node in nexts:
                if node not in depth:
                    depth[node] = depth[kind, v] + 1
                    after.append(node)
                    reached = reached or (node[0] == "s" and open_[node[1]] > 0)
        layer = after
    if not reached:
        return 0
    tried: dict[tuple, int] = {}
    moved = 0
    for start in [p for p, n in spare.items() if n > 0]:
        path = [("p", start)]
        while path and spare[start] > 0:
            kind, v = path[-1]
            if kind == "s" and open_[v] > 0:
                back = [(path[i][1], path[i + 1][1]) for i in range(1, len(path) - 1, 2)]  # a source gives up what this pattern sent it
                push = min(spare[start], open_[v], *(sent[p][s] for s, p in back))
                for i in range(0, len(path) - 1, 2):
                    sent[path[i][1]][path[i + 1][1]] += push
                for s, p in back:
                    sent[p][s] -= push
                spare[start] -= push
                open_[v] -= push
                moved += push
                path = [("p", start)]
                continue
            nexts = ways[v] if kind == "p" else givers[v]
            i = tried.get(path[-1], 0)
            while i < len(nexts):
                node = ("s" if kind == "p" else "p", nexts[i])
                if depth.get(node) == depth[path[-1]] + 1 and (kind == "p" or sent[nexts[i]][v] > 0):
                    break
                i += 1
            tried[path[-1]] = i
            if i < len(nexts):
                path.append(node)
            else:  # no way on: the node before goes on with its next
                path.pop()
                if path:
                    tried[path[-1]] = tried.get(path[-1], 0) + 1
    return moved


def _order(seed: int) -> Column:
    """A seeded hash of the row: rows that share an id (or have none) and not the text are told apart."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _level(h: str, k: int) -> Column:
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * (k + 1)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).cast("int")


def keyed(docs: DataFrame, seed: int = 7, members: Column | None = None, size: Column | None = None) -> DataFrame:
    """``docs`` with _pattern (JSON of its sorted sources), _size and the seeded hash _h."""
    listed = F.array(F.col("source")) if members is None else F.coalesce(members, F.expr("array()"))
    pattern = F.array_sort(F.array_distinct(F.transform(listed, lambda s: F.struct(s.isNull().alias("n"), F.coalesce(s, F.lit("")).alias("s")))))
    return docs.withColumns({
        "_pattern": F.to_json(pattern),
        "_size": word_count(F.col("text")) if size is None else size,
        "_h": _order(seed),
    })


def _bucket() -> Column:
    return F.shiftrightunsigned("_h", 64 - LEVELS * LEVEL_BITS)


def _boundary(rows: DataFrame, rest: DataFrame, level: int) -> dict[str, tuple[int | None, int]]:
    """For each pattern the first bucket its remaining tokens do not fill, and the tokens of those before; none, and all, if they do.

    The histogram has 2**LEVEL_BITS rows a pattern at most, whatever the input.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("_pattern").orderBy("_b")
    hist = rows.groupBy("_pattern", _level("_h", level).alias("_b")).agg(F.sum("_size").alias("_s"))
    run = hist.withColumn("_cum", F.sum("_s").over(w)).join(F.broadcast(rest), "_pattern")
    over = F.when(F.col("_cum") > F.col("_rest"), F.struct("_b", (F.col("_cum") - F.col("_s")).alias("before")))
    out = run.groupBy("_pattern").agg(F.min(over).alias("m"), F.max("_cum").alias("all"))
    return {r[0]: (r[1], r[2]) for r in out.select("_pattern", "m._b", F.coalesce("m.before", "all")).collect()}


def _search(rows: DataFrame, rest: dict[str, int]) -> dict[str, tuple[int | None, int]]:
    """The same for buckets of all levels."""
    spark = rows.sparkSession
    frame = lambda d, name: F.broadcast(spark.createDataFrame([(p, int(x)) for p, x in d.items()], f"_pattern string, {name} long"))
    out = _boundary(rows, frame(rest, "_rest"), 0)
    for level in range(1, LEVELS):
        open_ = {p: b for p, (b, _) in out.items() if b is not None}
        if not open_:
            break
        inside = rows.join(frame(open_, "_at"), "_pattern").filter(F.shiftrightunsigned("_h", 64 - LEVEL_BITS * level) == F.col("_at"))
        found = _boundary(inside, frame({p: rest[p] - out[p][1] for p in open_}, "_rest"), level)
        out |= {p: ((open_[p] << LEVEL_BITS) + b, out[p][1] + n) for p, (b, n) in found.items()}
    return out


def _filled(rows: DataFrame, mix: Mix, state: dict[str, tuple[list, int]]) -> dict[str, tuple[int, list]]:
    """For each pattern, of which some ranges are taken and some tokens left, what a fill misses and the documents it takes.

    Filled from each size class: FILLERS of its documents not chosen yet, then as many chosen ones, as often as repeats allow.
    Where these leave more than a hundredth of the words open, the chosen ones among them may also make room (taken once less).
    """
    klass = F.floor(F.log2(F.col("_size"))).cast("int")
    out: dict[str, tuple[int, list]] = {p: (n, []) for p, (_, n) in state.items()}
    some = [(p, r, n) for p, (r, n) in state.items() if n > 0]
    if not some:
        return out
    open_ = F.broadcast(rows.sparkSession.createDataFrame(some, f"_pattern string, {RANGES}, _left long"))
    sized = rows.join(open_, "_pattern").filter("_size > 0").withColumn("_in", _chosen().cast("int"))
    # rows that are equal throughout are taken alike: their sizes count together
    kinds = ["_pattern", "_in", "k", "f"]
    sized = sized.filter("_in = 1 or _size <= _left").withColumns({"k": klass, "f": F.pmod(F.col("_h"), F.lit(FILLERS))})
    least = sized.groupBy(*kinds).agg(F.min("_h").alias("_h"))
    picks = sized.join(F.broadcast(least), [*kinds, "_h"]).groupBy(*kinds, "_h", "_size").agg(F.count(F.lit(1)).alias("n")).collect()
    found: dict[str, list] = {}
    for r in sorted(picks, key=lambda r: (r["_pattern"], r["_in"], -r["k"], r["f"])):
        found.setdefault(r["_pattern"], []).append(r)
    for p, items in found.items():
        sizes = [r["_size"] * r["n"] for r in items]
        left, most = state[p][1], [REPEATS - mix.usage[p][0] - r["_in"] for r in items]
        times = fill(left, sizes, most)
        miss = left - sum(n * sizes[i] for i, n in times.items())
        if miss * 100 > mix.usage[p][1]:
            held = [r["_in"] for r in items]
            swap = fill(left + sum(h * s for h, s in zip(held, sizes, strict=True)), sizes, [m + h for m, h in zip(most, held, strict=True)])
            swap = {i: swap.get(i, 0) - h for i, h in enumerate(held) if swap.get(i, 0) != h}
            rest = left - sum(n * sizes[i] for i, n in swap.items())
            if rest < miss:
                times, miss = swap, rest
        out[p] = miss, [(p, items[i]["_h"], items[i]["_size"], n) for i, n in times.items()]
    return out


def solve(rows: DataFrame, weights: dict | None = None) -> Mix:
    """Decide a mix from ``rows`` (of :func:`keyed`; read several times, so give them kept)."""
    spark = rows.sparkSession
    caps = rows.groupBy("_pattern").agg(F.sum("_size").alias("s")).limit(MAX_PATTERNS + 1).collect()
    if len(caps) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {r[0]: int(r[1]) for r in caps}
    members = {p: [None if m["n"] else m["s"] for m in json.loads(p)] for p in capacity}
    sizes: dict[str | None, int] = {}
    for p, ss in members.items():
        for s in ss:
            sizes[s] = sizes.get(s, 0) + capacity[p]
    total = sum(capacity[p] for p, ss in members.items() if ss)
    targets = capped_targets(sizes, weights or weights_in_turn(list(sizes)), total)
    mix = Mix({s: (sizes[s], targets[s]) for s in sizes})
    quota = {s: round(t) for s, t in targets.items()}
    flow = min_cost_flow(capacity, members, quota)
    for p, sent in flow.items():
        tokens = sum(sent.values())
        mix.usage[p] = divmod(tokens, capacity[p]) if capacity[p] else (0, 0)
    rest = {p: r for p, (_, r) in mix.usage.items() if r > 0}
    if not rest:
        return mix
    # Down the seeded order; what does not fit is skipped, and the rest sought among later documents that do.
    # After each search the words still open are filled; of equal results that of the latest search holds,
    # an earlier one only where few documents leave later ones no close fit.
    end, left = 1 << LEVELS * LEVEL_BITS, dict(rest)
    todo = {p: (0, 1 << 62) for p in rest}  # from bucket, largest size
    ranges: dict[str, list[tuple[int, int, int]]] = {}
    best: dict[str, int] = {}
    extra: dict[str, list] = {}
    while todo:
        at = F.broadcast(spark.createDataFrame([(p, *x) for p, x in todo.items()], "_pattern string, _from long, _most long"))
        fit = rows.join(at, "_pattern").filter((_bucket() >= F.col("_from")) & (F.col("_size") <= F.col("_most")) & (F.col("_size") > 0)).select("_pattern", "_size", "_h")
        found = _search(fit, {p: left[p] for p in todo})
        for p, (b, n) in found.items():
            ranges.setdefault(p, []).append((todo[p][0], end if b is None else b, todo[p][1]))
            left[p] -= n
        for p, (miss, more) in _filled(rows, mix, {p: (ranges[p], left[p]) for p in found}).items():
            if miss <= best.get(p, miss):
                best[p], extra[p], mix.cuts[p] = miss, more, list(ranges[p])
        # a bucket of several documents is sought in again, unless all of them would fit alone and still not together
        todo = {p: (b + (left[p] == todo[p][1]), left[p]) for p, (b, _) in found.items() if b is not None and left[p] > 0}
    mix.extra = [x for more in extra.values() for x in more]
    return mix


def fill(room: int, sizes: list[int], most: list[int], states: int = 2048) -> dict[int, int]:
    """How often to take each item (``most`` times at most) so that their sizes come closest below ``room``.

    Sums are built item by item, earlier items first; of more than ``states``
    sums the largest go on. Stops at an exact fit.
    """
    sums: dict[int, tuple | None] = {0: None}  # sum -> (item, times, sum before)
    for i, (size, n) in enumerate(zip(sizes, most, strict=True)):
        if room in sums:
            break
        fresh = {s + k * size: (i, k, s) for s in sums for k in range(n, 0, -1) if s + k * size <= room}
        sums = fresh | sums
        if len(sums) > states:
            keep, todo = set(sorted(sums)[-states:]) | {0}, []
            for s in list(keep):  # with what they were built from
                todo.append(s)
                while todo and (step := sums[todo.pop()]):
                    keep.add(step[2])
                    todo.append(step[2])
            sums = {s: sums[s] for s in keep}
    out, at = {}, max(sums)
    while sums[at]:
        i, k, at = sums[at]
        out[i] = k
    return out


#: The ranges of a pattern, as a column.
RANGES = "_ranges array<struct<lo:long,hi:long,most:long>>"


def _chosen() -> Column:
    """Whether a range of its pattern has the document."""
    return F.exists("_ranges", lambda r: (_bucket() >= r["lo"]) & (_bucket() < r["hi"]) & (F.col("_size") <= r["most"]))


def apply(rows: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with _times, how often each is taken. Joins only broadcast decisions (one row a pattern)."""
    spark = rows.sparkSession
    cuts = [(p, full, mix.cuts.get(p, [])) for p, (full, _) in mix.usage.items()]
    cuts = F.broadcast(spark.createDataFrame(cuts, f"_pattern string, _full long, {RANGES}"))
    extra = F.broadcast(spark.createDataFrame(mix.extra, "_pattern string, _h long, _size long, _more long"))
    out = rows.join(extra, ["_pattern", "_h", "_size"], "left").join(cuts, "_pattern", "left")
    more = F.when(_chosen(), 1).otherwise(0) + F.coalesce("_more", F.lit(0))
    times = F.when(F.col("_size") > 0, F.coalesce(F.col("_full") + more, F.lit(0))).otherwise(0).cast("long")
    return out.withColumn("_times", times).drop("_full", "_ranges", "_more")


def taken(docs: DataFrame, seed: int = 7, weights: dict | None = None) -> DataFrame:
    """doc_id, source, size, taken, source_size and target for documents of one source each."""
    rows = cut(keyed(docs, seed).select("doc_id", "source", "_pattern", "_size", "_h"))
    mix = solve(rows, weights)
    sources = docs.sparkSession.createDataFrame([(s, *v) for s, v in mix.sources.items()], "_s string, source_size long, target double")
    return apply(rows, mix).join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("_times") * F.col("_size")).alias("taken")
    )


@own_names
def mixed(docs: DataFrame, seed: int = 7, weights: dict | None = None) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each once for every time it is taken."""
    keep = [F.col(c) for c in docs.columns]
    mix = solve(cut(keyed(docs, seed).select("doc_id", "_pattern", "_size", "_h")), weights)
    rows = apply(keyed(docs, seed), mix).filter("_times > 0")
    return rows.withColumn("_k", F.explode(F.expr("sequence(1L, _times)"))).select(*keep)
