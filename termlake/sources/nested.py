"""A nested question-answer file read by many tasks: a data source whose partitions are byte ranges cut at records.

A record is an object of the ``data`` array: one that begins with the key "title" or "paragraphs". Inside a JSON string every
quote has a backslash before it, so an opening brace, a bare quote, one of these words and a bare quote with a colon can only
be the beginning of a record, wherever reading starts. A range reads the records that begin in it, the last one to its end.
Files are opened by pyarrow: local paths and the URIs it knows (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import span_id

FORMAT = "nested_qa"
SPLIT_BYTES, BLOCK_BYTES = 64 << 20, 1 << 20
BEGINS = re.compile(rb'\{\s*"(?:title|paragraphs)"\s*:')
LONGEST_MARK = 4096  # bytes that a beginning with its white space may take


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of the files of a folder; names that begin with _ or a point are none."""
    from pyarrow import fs

    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [(prefix + f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]


def records(path: str, begin: int, end: int) -> Iterator[dict]:
    """The records that begin from ``begin`` on and before ``end``."""
    system, inner = _opened(path)
    decode = json.JSONDecoder().raw_decode
    with system.open_input_file(inner) as file:
        size, at, held, start = file.size(), begin, b"", None

        def more() -> bool:
            nonlocal at, held
            if at >= size:
                return False
            file.seek(at)
            block = file.read(min(BLOCK_BYTES, size - at))
            at += len(block)
            held += block
            return True

        base = begin  # place of the first held byte
        look = 0
        while True:
            mark = BEGINS.search(held, look)
            if mark is None:
                look = max(look, len(held) - LONGEST_MARK)
                if start is None and base + look >= end or not more():
                    break
                if start is None and look:
                    held, base, look = held[look:], base + look, 0
                continue
            if start is not None:
                yield decode(held[start : mark.start()].decode("utf-8"))[0]
                start = None
            held, base = held[mark.start() :], base + mark.start()
            if base >= end:
                return
            start, look = 0, len(mark[0])
        if start is not None:
            yield decode(held[start:].decode("utf-8"))[0]


def spans_of(record: dict) -> Iterator[tuple]:
    """(title, kind, text, char_start, char_end) of every answer."""
    for paragraph in record.get("paragraphs") or []:
        for qa in paragraph.get("qas") or []:
            for answer in qa.get("answers") or []:
                text, at = answer.get("text"), answer.get("answer_start")
                known = text is not None and at is not None
                yield record.get("title"), (qa.get("id") or "").split("__")[-1] if qa.get("id") is not None else None, text, at, at + len(text) if known else None


class NestedQaReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(path, a, min(a + self.split, size)) for path, size in _files(self.path) for a in range(0, size, self.split)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        for record in records(partition.path, partition.begin, partition.end):
            yield from spans_of(record)


class NestedQaSource(DataSource):
    """``spark.read.format("nested_qa").option("splitBytes", n).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "title string, clause_type string, text string, char_start int, char_end int"

    def reader(self, schema) -> NestedQaReader:
        return NestedQaReader(self.options)


def nested_qa_split(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of ``readers.nested_qa``, of files of any size, by as many tasks as they have ranges of ``split_bytes``."""
    spark.dataSource.register(NestedQaSource)
    rows = spark.read.format(FORMAT).option("splitBytes", str(split_bytes)).load(path)
    key = span_id(F.col("title"), F.col("clause_type"), F.col("char_start"), F.col("char_end"))
    return rows.select(key.alias("id"), "title", "clause_type", "text", "char_start", "char_end")
