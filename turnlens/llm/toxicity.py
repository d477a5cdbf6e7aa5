"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

Training reads a bounded sample of labelled rows (TRAIN_ROWS, by a hash of
their ids). It yields a lexicon: words and word stems whose log-odds of
standing in toxic texts are surely high. The trees learn from dense features
(lexicon densities, second persons nearby, capitals, punctuation, obfuscated
spellings), where each half of the sample is read with the lexicon of the
other half, so that no text is scored by words learned from itself; scoring
uses the mean of both lexicons;
out-of-fold scores set the isotonic calibration. Scoring is one pass without
a shuffle; the model it broadcasts has a fixed bound.

Defined results: null and empty texts get the score of a text without any
words; very long ones are read whole, in linear time. Rows without a label, or
whose label is null, are scored all the same. Without labels of both kinds the
score is the share of toxic labels (0 if there are none). Repeated labels of an
id count once, toxic if any is; of rows that share a labelled id the least text is
learned from, and each is scored. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlens.llm.common import cut, own_names, small_batches

#: Labelled rows that training reads at most.
TRAIN_ROWS = 16_000
#: Lexicon entries at most, and the least log-odds (lower confidence bound) of one.
LEXICON, LEAST_ODDS = 4000, 1.0
#: Standard errors below the estimate at which log-odds count.
SURE = 2.0
#: Lengths of word stems.
STEMS = (4, 5, 6)
#: A general list of insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown fool imbecile jerk garbage vermin coward "
    "dummkopf idioten blöd dumm arschloch abschaum versager connard connasse imbécile crétin salaud abruti ordure idiota estúpido estúpida imbécil basura inútil".split()
)
#: Second persons, in the four languages.
SECOND = frozenset("you your yours yourself u ur thou thee du dich dir dein deine ihr euch euer tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
#: Look-alikes used to disguise letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

_WORDS = re.compile(r"\w+").findall
_LETTER = re.compile(r"[^\W\d_]").match
#: Marks inside a word, from the letter before them to the one after; and what else belongs to such a word.
_MARKED = re.compile(r"[^\W\d_][\d@$!|*.\-_]+[^\W\d_]").search
_REST = re.compile(r"[\w@$!|*.\-]*").match
_CAPITALS = re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{2,}\b").findall

FEATURES = ("log_words", "insults", "insult_density", "hits", "hit_density", "strong_hits", "top", "second", "near_second", "disguised", "capitals", "exclaims", "symbols")


class Weights(dict):
    """Word to its weight: the largest of the word's own and its stems'; of bounded size."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        get = self.lexicon.get
        out = max(get(word, 0.0), *(get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n), 0.0)
        if len(self) > 1 << 18:
            self.clear()
        if len(word) < 64:
            self[word] = out
        return out


def marked_words(text: str) -> Iterator[str]:
    """Words with marks or digits among their letters, in order; linear in the text."""
    at = 0
    while m := _MARKED(text, at):
        start = m.start()
        while start > at and _LETTER(text, start - 1):
            start -= 1
        at = _REST(text, m.end()).end()
        yield text[start:at]


def featurize(text: str, weights: Weights) -> list[float]:
    """The FEATURES of one whole text."""
    words = _WORDS(text.lower())
    n = len(words)
    got = list(map(weights.__getitem__, words))
    top = max(got, default=0.0)
    insults = near = hits = strong = 0
    second = sum(map(SECOND.__contains__, words))
    if top > 0 or not INSULTS.isdisjoint(words):
        marks = [i for i, w in enumerate(words) if got[i] > 0 or w in INSULTS]
        insults = sum(words[i] in INSULTS for i in marks)
        hits = sum(got[i] > 0 for i in marks)
        strong = sum(got[i] > 2 * LEAST_ODDS for i in marks)
        if second:
            near = sum(any(w in SECOND for w in words[max(0, i - 3) : i + 4]) for i in marks)
    disguised = 0
    for raw in marked_words(text):
        plain = raw.lower().translate(LOOKALIKES)
        plain = re.sub(r"[\W_]+", "", plain)
        disguised += raw.lower() != plain and (plain in INSULTS or weights[plain] > 2 * LEAST_ODDS)
    per = 100 / max(n, 1)
    chars = max(len(text), 1)
    return [
        float(np.log1p(n)), float(insults), insults * per, float(hits), hits * per, float(strong), top, second * per, float(near),
        float(disguised), len(_CAPITALS(text)) * per, text.count("!") / chars, sum(map(text.count, "#$%&*@")) / chars,
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="inverted_cdf")) for c in x.T]
        edges = [np.unique(np.r_[e, np.quantile(c[c > c.min()], np.linspace(0, 1, 9)[:-1], method="inverted_cdf") if (c > c.min()).any() else e, c.min()]) for e, c in zip(edges, x.T, strict=True)]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        z = np.full(len(x), self.base)
        for _ in range(self.rounds):
            p_ = 1 / (1 + np.exp(-z))
            tree = self._tree(binned, edges, y - p_, p_ * (1 - p_))
            self.trees.append(tree)
            z += self._leaf(tree, x)
        return self

    def _tree(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, float]]:
        """A complete tree as a heap: (feature or -1, threshold, value) at node i, children 2i+1 and 2i+2."""
        nodes = [(-1, 0.0, 0.0)] * (2 ** (self.depth + 1) - 1)
        todo = [(0, np.arange(len(g)))]
        while todo:
            at, rows = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-9, -1, 0)
            if at < 2**self.depth - 1:
                for f, e in enumerate(edges):
                    b = binned[rows, f]
                    gl = np.bincount(b, g[rows], len(e) + 1).cumsum()[:-1]
                    hl = np.bincount(b, h[rows], len(e) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                    gain[(hl < self.least) | (hs - hl < self.least)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                nodes[at] = (-1, 0.0, float(self.rate * gs / (hs + self.ridge)))
            else:
                nodes[at] = (best[1], float(edges[best[1]][best[2]]), 0.0)
                low = binned[rows, best[1]] <= best[2]
                todo += [(2 * at + 1, rows[low]), (2 * at + 2, rows[~low])]
        return nodes

    @staticmethod
    def _leaf(tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cuts, value = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), int)
        for _ in range(int(np.log2(len(tree) + 1)) - 1):
            f = feature[at]
            down = 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cuts[at])
            at = np.where(f >= 0, down, at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean scores of the blocks and their shares, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([s, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][k] + a[k] for k in range(3)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], rate: float):
        self.lexicon, self.rate = lexicon, rate
        self.trees: Trees | None = None
        self.at, self.share = np.zeros(1), np.full(1, rate)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Model:
        if not len(y) or y.min() == y.max():
            return self
        half = np.arange(len(y)) % 2 == 0
        out = np.zeros(len(y))
        for a, b in ((half, ~half), (~half, half)):
            out[b] = Trees().fit(x[a], y[a]).margin(x[b]) if a.any() and b.any() else 0.0
        self.at, self.share = isotonic(out, y)
        self.trees = Trees().fit(x, y)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        return np.clip(np.interp(self.trees.margin(x), self.at, self.share), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether the labels of this id are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _featured(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([featurize(t or "", weights) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], ["order", "y", "x"])

    return docs.select("order", "y", "text").mapInArrow(run, "order long, y double, x array<double>")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words and stems with surely high log-odds of toxic texts, from (text, y)."""
    totals = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    toxic, clean = float(totals[0] or 0), float(totals[1] or 0)
    if not toxic or not clean:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)))
    stems = [F.transform(F.filter("w", lambda w, n=n: F.length(w) > n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in STEMS]
    terms = rows.select("y", words.alias("w")).select("y", F.explode(F.array_distinct(F.concat("w", *stems))).alias("term"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (toxic + 1)) - F.log(b / (clean + 1)) - SURE * F.sqrt(1 / a + 1 / b)
    top = terms.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).filter("a >= 2").select("term", odds.alias("odds"))
    return {r[0]: r[1] for r in top.filter(F.col("odds") > LEAST_ODDS).orderBy(F.desc("odds"), "term").limit(LEXICON).collect()}


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from at most ``rows`` labelled rows; ids that :func:`held_out` marks are never read."""
    small_batches(docs.sparkSession)
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("double").alias("y"))
        .select("_id", "y", F.xxhash64(F.lit(1), F.col("_id")).alias("order")).orderBy("order", "_id").limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("_t"))
    sample = cut(texts.join(F.broadcast(known), "_id").groupBy("order", "y").agg(F.min("_t").alias("text")))
    even = F.col("order") % 2 == 0
    halves = [learn_lexicon(sample.filter(even)), learn_lexicon(sample.filter(~even))]
    parts = [_featured(sample.filter(~even), halves[0]), _featured(sample.filter(even), halves[1])]
    got = parts[0].unionByName(parts[1]).orderBy(F.xxhash64("order"), "order").collect()
    # texts are scored with the mean of both: odds learned from all rows would be surer, and so higher, than those the trees saw
    mean = {w: (halves[0].get(w, 0.0) + halves[1].get(w, 0.0)) / 2 for w in {*halves[0], *halves[1]}}
    lexicon = {w: x for w, x in mean.items() if x >= LEAST_ODDS}
    y = np.array([r["y"] for r in got])
    return Model(lexicon, float(y.mean()) if len(y) else 0.0).fit(np.array([r["x"] for r in got]), y)


def score(docs: DataFrame, model: Model, columns: list[str] | None = None, name: str = "_score") -> DataFrame:
    """``columns`` (default: all) of ``docs`` and the score of each row's whole text."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = docs.columns if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        weights = Weights(m.lexicon)
        for b in batches:
            x = np.array([featurize(t or "", weights) for t in b.column(b.num_columns - 1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(m.score(x))], [*b.schema.names[:-1], name])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


@own_names
def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows scored toxic."""
    return score(docs, train(docs, labels)).filter(F.col("_score") < threshold).drop("_score")
