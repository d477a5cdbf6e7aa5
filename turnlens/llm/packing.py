"""Packing token sequences into windows of one length by the sum-of-squares rule, online.

A document's ids and an end id are cut into full windows; what is left of it is
one item. Windows in which room is left are counted by how full they are, in
an array with one cell a fill level. An item goes to the level (or to a new
window) after which the sum of the squared counts is least; of equals the
fullest level is taken, of the windows of a level the oldest. A full window is
done and leaves the array. No two levels thereby pile up windows that no item
fits any more, and no list of the documents has to be sorted first.

Every task packs the documents of its own partition in their order and
numbers its windows under the partition's number, so nothing is shuffled and no
text moves. A task that runs again on the same input makes the same windows.

Documents may be cut, so windows need not stay open: where more than
``OPEN_WINDOWS`` are (items of which no two fit together leave ever more), and
at the end of a partition, they are closed: the emptiest are dealt into the gaps
of the fullest. So memory is bounded whatever the lengths are, and one window a
partition is padded at most.

Ids come from the tokenizers library. Text is handed to it by segments that
end where every split of the vocabulary begins anew, such as before a space
behind a letter: so the ids are those of the whole text, frequent segments are
looked up, and a text of any length takes no more than its ids. Strings of
special tokens within a text are ordinary text.

Defined results: a null or empty text is the end id alone. Rows that repeat, or
have no id, are packed each by itself. An empty table gives no piece. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlens.llm.common import small_batches

WINDOW = 2048
#: Id that ends each document.
END = 1
#: Windows that a task keeps open at most: 32 MB of ids at 2048 a window.
OPEN_WINDOWS = 4096
#: Characters of segments, with 64 for each, that a worker remembers.
MEMO_CHARS = 1 << 27
#: Pieces in a batch of results.
BATCH_PIECES = 512
#: Characters of a long text that are cut into segments at once.
BLOCK_CHARS = 1 << 20
#: White space by no definition: ASCII marks, letters and digits, and Latin letters.
_SOLID = "!-~À-ɏ"
_LETTER = "A-Za-z0-9À-ÖØ-öø-ɏ"
#: All ASCII marks but the apostrophe, which some splits begin with.
_MARK = r"!-&(-/:-@\[-`{-~"
_BEFORE_SPACE = rf"(?<=[{_SOLID}])(?= )"
#: Segments: letters, marks, and whatever else up to white space behind what is none, or to a mark behind letters.
#: No split of the vocabulary goes on over the end of any of them.
_SEGMENT = rf"(?s) ?[{_LETTER}]+(?=[ \n\r\t{_MARK}]|\Z)| ?[{_MARK}]+(?=[ \n\r\t{_LETTER}]|\Z)|.+?(?:(?<=[{_SOLID}])(?=[ \n\r\t])|(?<=[{_LETTER}])(?=[{_MARK}])|\Z)"


class Encoder:
    """Packed ids of texts, by the ids of their segments, of which it remembers a bounded amount; new ones go to the tokenizer together."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a worker: Spark has the others
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.segments, self.before_space = re.compile(_SEGMENT).findall, re.compile(_BEFORE_SPACE)
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.chars > MEMO_CHARS:
            self.known.clear()
            self.chars = 0
        parts = [self.segments(t) for t in texts]
        new = list(set().union(*parts).difference(self.known))
        for x, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = found.ids
            self.known[x] = struct.pack(f"<{len(ids)}I", *ids)
            self.chars += len(x) + 64
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, p)) for p in parts]


def blocks(text: str, boundary: re.Pattern) -> Iterator[str]:
    """A text in blocks that end where a segment does."""
    at = 0
    while len(text) - at > BLOCK_CHARS and (m := boundary.search(text, at + BLOCK_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encoded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
    """Id and packed ids of each row; about BLOCK_CHARS of text are encoded at once."""
    rows: list[tuple[object, str]] = []
    chars = 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py() or ""
        if len(text) > BLOCK_CHARS:
            yield doc, b"".join(encoder.encode([x])[0] for x in blocks(text, encoder.before_space))
            continue
        rows.append((doc, text))
        chars += len(text)
        if chars > BLOCK_CHARS:
            yield from zip((d for d, _ in rows), encoder.encode([t for _, t in rows]), strict=True)
            rows, chars = [], 0
    yield from zip((d for d, _ in rows), encoder.encode([t for _, t in rows]), strict=True)


Piece = tuple[object, int, bytes, int]  # document's id, ids before it, packed ids, ids of the document


class Windows:
    """Fill levels of the windows that are open, and the pieces in each of them."""

    def __init__(self, first: int, size: int = WINDOW, most: int = OPEN_WINDOWS):
        self.next, self.size, self.most = first, size, most
        self.counts = np.zeros(size + 1, "i8")
        self.at: dict[int, deque[int]] = defaultdict(deque)  # level: windows, the oldest first
        self.pieces: dict[int, list[Piece]] = {}

    def level(self, n: int) -> int:
        """The level to put n ids on: least sum of squares afterwards; 0 is a new window."""
        c, size = self.counts, self.size
        after = c[n:].copy()
        after[size - n] = -1  # a full window counts no more
        # one window leaves level h and one joins level h + n: the sum grows by 2 (c[h + n] - c[h] + 1)
        grown = 2 * (after - c[: size - n + 1] + 1)
        grown[size - n] = 1 - 2 * c[size - n]
        grown[0] = 2 * c[n] + 1 if n < size else 0
        grown[1:][c[1 : size - n + 1] == 0] = np.iinfo("i8").max
        return size - n - int(np.argmin(grown[::-1]))

    def put(self, piece: Piece) -> list[tuple[int, int, Piece]]:
        """Place one piece; (window, offset, piece) of a window that is full by it."""
        n = len(piece[2]) // 4
        h = self.level(n)
        if h:
            w = self.at[h].popleft()
            self.counts[h] -= 1
        else:
            w, self.next = self.next, self.next + 1
        self.pieces.setdefault(w, []).append(piece)
        if h + n == self.size:
            return self._out(w)
        self.at[h + n].append(w)
        self.counts[h + n] += 1
        return self.close(last=False) if len(self.pieces) > self.most else []

    def _out(self, w: int) -> list[tuple[int, int, Piece]]:
        at, out = 0, []
        for piece in self.pieces.pop(w):
            out.append((w, at, piece))
            at += len(piece[2]) // 4
        return out

    def close(self, last: bool = True) -> list[tuple[int, int, Piece]]:
        """Fill the gaps of the fullest windows with what is in the emptiest, cut where it must be; the one left over stays open unless this is the last call."""
        order = [(w, h) for h in sorted(self.at) for w in self.at[h]]
        out, i, j = [], 0, len(order) - 1
        room = {w: self.size - h for w, h in order}
        while i < j:
            w, target = order[i][0], order[j][0]
            while self.pieces[w] and i < j:
                doc, start, ids, total = self.pieces[w].pop()
                n = min(len(ids) // 4, room[target])
                self.pieces[target].append((doc, start, ids[: 4 * n], total))
                room[target] -= n
                if rest := ids[4 * n :]:
                    self.pieces[w].append((doc, start + n, rest, total))
                if not room[target]:
                    out += self._out(target)
                    j -= 1
                    target = order[j][0]
            if not self.pieces[w]:
                del self.pieces[w]
                i += 1
        self.counts[:] = 0
        self.at.clear()
        for w in list(self.pieces):  # one at most
            if last:
                out += self._out(w)
            else:
                h = sum(len(p[2]) for p in self.pieces[w]) // 4
                self.at[h].append(w)
                self.counts[h] += 1
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END) -> DataFrame:
    """doc_id, start, length, ids (packed as little-endian unsigned 32-bit), doc_tokens, sequence_id and offset of each piece.

    ``tokenizer`` is the path of a tokenizer file, which every worker reads.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        windows = Windows(TaskContext.get().partitionId() << 36, window)
        full = 4 * window
        done: list[tuple[int, int, Piece]] = []

        def taken(least: int) -> Iterator[pa.RecordBatch]:
            while len(done) > least:
                part, done[:] = done[:BATCH_PIECES], done[BATCH_PIECES:]
                columns = zip(*((doc, start, len(ids) // 4, ids, total, w, at) for w, at, (doc, start, ids, total) in part), strict=True)
                kinds = (ids_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        ids_type = None
        for batch in batches:
            ids_type = batch.column(0).type
            for doc, ids in encoded(encoder, batch):
                ids += tail
                total = len(ids) // 4
                cut = len(ids) - len(ids) % full
                for at in range(0, cut, full):
                    done.append((windows.next, 0, (doc, at // 4, ids[at : at + full], total)))
                    windows.next += 1
                    if len(done) >= 2 * BATCH_PIECES:
                        yield from taken(BATCH_PIECES)
                if cut < len(ids):
                    done += windows.put((doc, cut // 4, ids[cut:], total))
                yield from taken(BATCH_PIECES)
        if ids_type is not None:
            done += windows.close()
            yield from taken(0)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
