"""URL filter: longest host-and-path rule, else logistic regression on hashed n-grams.

The model is trained on the driver from a small labelled table of URLs (the
built-in one, or the caller's), on character n-grams of host and path hashed
to a fixed number of weights. The weights are broadcast: their size is fixed.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is allowed (there is nothing to score). Very long urls are
read whole. Repeated rows are judged alike; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import small_batches

#: (host and path, verdict). A rule fits its host, all subdomains, and paths that start with its path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))

#: Words of the built-in labelled table: of hosts to block, of hosts to allow, and of either.
BAD = (
    "pills casino casinos bets betting slots roulette adult porn porno sex xxx nude cams hookup dating ads adserver adclick tracker tracking popunder spam phishing malware viagra cialis "
    "pharmacy escort escorts poker jackpot bingo payday loans replica warez crack cracked keygen torrent clickbait lottery sweepstakes".split()
)
GOOD = (
    "news library museum weather science history journal garden kitchen council theatre hospital archive school railway recipes travel music bicycle docs wiki university college "
    "bank forum radio paper press times post daily health law court church city town county state gov transport airport hotel film book books maps photo sport football software "
    "code data cloud mail studio design engineering printing training cooking shopping writing research institute society nature energy water forest farm market house street bridge river mountain coffee bakery "
    "zeitung verlag stadt schule bibliothek wetter verein handwerk garten reise mairie ville ecole bibliotheque journal cuisine musee ayuntamiento escuela biblioteca noticias cocina museo".split()
)
EITHER = "cheap free best online win world club shop hub my big the live top x now go get pro info web site net plus one".split()
PATHS = "/ /about /articles/2019/spring-report /blog/baking-bread /wiki/Main /index.php?id=4 /2021/06/14/notes.html /p/318 /category/page/2/ /search?q=a /en /docs/v2/guide#top".split()
TLDS = "com org net co.uk de fr es example.com example.org example.net info io gov edu eu".split()
SUBS = ("", "www.", "m.", "blog.", "en.", "static.")
#: Invented names of hosts to allow, so that letters the table never had with a blocked word speak for a host.
INVENTED = 1200


def invented(n: int, seed: int = 1) -> list[str]:
    """``n`` names of two to four syllables, drawn from letters by a seed."""
    draw = random.Random(seed)
    part = lambda: "".join((draw.choice("bcdfghjklmnprstvwyz"), draw.choice(("", "", "", "h", "l", "r")), draw.choice("aeiou"), draw.choice(("", "", "n", "r", "s", "t", "l", "th", "nd"))))
    return ["".join(part() for _ in range(2 + i % 3)) for i in range(n)]


def labelled_urls(bad: Sequence[str] = tuple(BAD), good: Sequence[str] = tuple(GOOD), names: int = INVENTED) -> list[tuple[str, int]]:
    """The built-in labelled table, (url, 1 = block): each word alone and with others, as host or in a path; invented names."""
    out: list[tuple[str, int]] = []
    draw = random.Random(2).choice  # what is around a word says nothing about the label
    put = lambda name, label: out.append((f"{draw(('http', 'https'))}://{draw(SUBS)}{name}.{draw(TLDS)}{draw(PATHS)}", label))
    for label, words in ((1, bad), (0, good)):
        for i, word in enumerate(words):
            for j in range(10):
                other = draw(EITHER)
                put((word, f"{other}-{word}", f"{word}-{other}", f"{other}{word}", f"{word}{i}")[j % 5], label)
            out.append((f"https://{draw(EITHER)}-{draw(good)}.{draw(TLDS)}/{draw(EITHER)}-{word}/{i}", label))
    for name in invented(names):
        put(name, 0)
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, as columns."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    chain: Column | None = None
    for rule in sorted({r for r, _ in rules}, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        chain = F.when(fits, F.lit(rule)) if chain is None else chain.when(fits, F.lit(rule))
    return F.lit(None).cast("string") if chain is None else chain


class UrlModel:
    """Logistic regression on hashed character n-grams."""

    def __init__(self, bits: int = 14, sizes: Sequence[int] = (3, 4, 5)):
        self.bits, self.sizes = bits, tuple(sizes)
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def features(self, host: str, path: str) -> np.ndarray:
        """Distinct slots of the n-grams; numbers count as one digit class."""
        out = set()
        for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
            text = "".join("0" if c.isdigit() else c for c in text.lower())
            raw = text.encode()
            for n in self.sizes:
                out.update(zlib.crc32(raw[i : i + n], ord(kind)) & ((1 << self.bits) - 1) for i in range(max(1, len(raw) - n + 1)))
        return np.fromiter(sorted(out), np.int64, len(out))

    def fit(self, rows: Sequence[tuple[str, str, int]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> UrlModel:
        """Full-batch gradient descent, so that a refit gives the same weights; both labels weigh alike."""
        if not rows:
            return self
        found = [self.features(h, p) for h, p, _ in rows]
        y = np.array([r[2] for r in rows], float)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        worth = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        scale = np.array([1 / np.sqrt(max(len(f), 1)) for f in found])
        flat, starts = np.concatenate(found), np.cumsum([0, *map(len, found)])[:-1]
        owner = np.repeat(np.arange(len(found)), list(map(len, found)))
        for _ in range(rounds):
            z = np.add.reduceat(self.weights[flat], starts) * scale + self.bias
            err = (1 / (1 + np.exp(-z)) - y) * worth
            grad = np.bincount(flat, (err * scale)[owner], minlength=len(self.weights))
            self.weights -= rate * (grad / len(rows) * 8 + decay * self.weights)
            self.bias -= rate * err.mean()
        return self

    def score(self, host: str, path: str) -> float:
        f = self.features(host, path)
        z = float(self.weights[f].sum()) / np.sqrt(max(len(f), 1)) + self.bias
        return float(1 / (1 + np.exp(-z)))


def host_and_path(url: str | None) -> tuple[str, str]:
    """:func:`split_url` for the driver's labelled rows."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    path = rest[cut:]
    end = min([i for i in map(path.find, "?#") if i >= 0], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def train(labelled: Sequence[tuple[str, int]] | None = None) -> UrlModel:
    return UrlModel().fit([(*host_and_path(u), y) for u, y in (labelled_urls() if labelled is None else labelled)])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides) of each row."""
    spark = pages.sparkSession
    small_batches(spark, 4096)
    shared = spark.sparkContext.broadcast(model or train())
    kind = pages.schema[id_col].dataType.simpleString()
    host, path = split_url(F.col("_url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for b in batches:
            got = [None if r is not None or not (h or p) else score(h, p) for h, p, r in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.float64())], [*b.schema.names, "score"])

    scored = ruled.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, score double")
    verdict = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, what).otherwise(verdict)
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
