"""Scan of JSON lines that stops early: a data source with a declared schema, read in byte ranges.

Built-in readers of JSON read whole partitions before a limit on ordered rows
can stop them. Here each range stops after ``limit`` records, so the first n
records of many large files cost n records a range, and none beyond is parsed.

Defined results: a line belongs to the range that it starts in; blank lines are
skipped; files come in order of their names. Compressed files are one range
each. A line that is no JSON object is an error, or left out with
``mode=dropmalformed``. Records without an id get ``<file>-<offset>``. No file,
or empty ones, give no rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from turnlens.sources import qa

SCHEMA = "file long, offset long, id string, question string, answer string, context string, rest map<string,string>"
#: Bytes of a range.
SPLIT_BYTES = 64 << 20
#: Records of an Arrow batch.
BATCH = 512
#: Samples of a scan that names no limit.
DEFAULT_LIMIT = 50
PACKED = (".gz", ".bz2", ".zst", ".lz4")
_ARROW = pa.schema([("file", pa.int64()), ("offset", pa.int64()), *((c, pa.string()) for c in ("id", "question", "answer", "context")), ("rest", pa.map_(pa.string(), pa.string()))])


@dataclass
class Range(InputPartition):
    """Bytes of one file; ``stop`` is -1 for all of a compressed one."""

    file: int
    path: str
    start: int
    stop: int


def _text(value: object) -> str | None:
    """A field as text: strings as they are, all else as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class Lines(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root = options["path"]
        self.limit = int(options.get("limit", -1))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.drop = options.get("mode", "failfast").lower() == "dropmalformed"
        self.fields = json.loads(options.get("fields", "{}"))

    def partitions(self) -> list[Range]:
        system, path = fs.FileSystem.from_uri(self.root)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else []
        if not info.is_file and info.type != fs.FileType.Directory:
            raise FileNotFoundError(self.root)
        out: list[Range] = []
        for i, f in enumerate(sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)):
            starts = [0] if f.path.endswith(PACKED) else range(0, f.size, self.split)
            out += [Range(i, f.path, s, -1 if f.path.endswith(PACKED) else min(s + self.split, f.size)) for s in starts]
        return out or [Range(0, "", 0, 0)]

    def _lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_stream(part.path) if part.stop < 0 else system.open_input_file(part.path) as raw:
            at = 0
            if part.start:
                raw.seek(part.start - 1)
                at = part.start - 1
            lines = io.BufferedReader(raw)
            if part.start:
                at += len(lines.readline())  # the end of a line of the range before
            while part.stop < 0 or at < part.stop:
                line = lines.readline()
                if not line:
                    break
                yield at, line
                at += len(line)

    def _record(self, part: Range, at: int, line: bytes) -> tuple | None:
        try:
            row = json.loads(line)
            if not isinstance(row, dict):
                raise ValueError("no object")
        except ValueError as e:
            if self.drop:
                return None
            raise ValueError(f"{part.path} at byte {at}: {e}") from e
        name = lambda c: self.fields.get(c, c)
        used = {name(c) for c in ("id", "question", "answer", "context")}
        rest = [(k, _text(v)) for k, v in row.items() if k not in used and v is not None]
        id_ = _text(row.get(name("id")))
        return part.file, at, f"{part.file}-{at}" if id_ is None else id_, *(_text(row.get(name(c))) for c in ("question", "answer")), None if row.get(name("context")) is None else json.dumps(row[name("context")], ensure_ascii=False), rest

    def records(self, part: Range) -> Iterator[tuple]:
        """Records of a range, at most ``limit``; the line after the last is not parsed."""
        n = 0
        if not part.path or self.limit == 0:
            return
        for at, line in self._lines(part):
            if line.strip() and (got := self._record(part, at, line)) is not None:
                yield got
                n += 1
                if n == self.limit:
                    return

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for r in self.records(part):
            rows.append(r)
            if len(rows) == BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class JsonLines(DataSource):
    """``spark.read.format("early_lines").option("limit", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "early_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Lines:
        return Lines(self.options)


def scan(spark: SparkSession, path: str, limit: int | None = None, fields: Mapping[str, str] | None = None, **options: object) -> DataFrame:
    """The first ``limit`` records, in order of files and lines (all without one); ``fields`` renames fields to id, question, answer, context."""
    spark.dataSource.register(JsonLines)
    reader = spark.read.format("early_lines").option("fields", json.dumps(dict(fields or {}))).options(**{k: str(v) for k, v in options.items()})
    if limit is None:
        return reader.load(path)
    return reader.option("limit", limit).load(path).orderBy("file", "offset").limit(limit)


def samples(spark: SparkSession, path: str, limit: int | None = DEFAULT_LIMIT, fields: Mapping[str, str] | None = None, **options: object) -> DataFrame:
    """Samples of the first records. A context may be a text, a list of texts, or {title, sentences} whose groups of sentences are a text each."""
    rows = scan(spark, path, limit, fields, **options)
    return rows.select(*qa._sample(F.col("id"), F.col("question"), F.col("answer"), qa.coerce_context(F.col("context")), F.coalesce("rest", F.expr("cast(map() as map<string,string>)"))))
