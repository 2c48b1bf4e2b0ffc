"""Documents as a format to write: ranges of files go where they belong, and files appear when all are there."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote, urlparse
from uuid import uuid4

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quire.functions.shipping import ship


@dataclass
class Written(WriterCommitMessage):
    """For each document of a task its ranges: (at, length), those that follow each other as one."""

    ranges: dict[str, list[tuple[int, int]]] = field(default_factory=dict)


class RangeWriter(DataSourceWriter):
    """Tasks write their ranges in place in a folder beside the target; a task that runs twice writes the same bytes again."""

    def __init__(self, options: dict, overwrite: bool):
        where = urlparse(options["path"])
        if where.scheme not in ("", "file"):
            raise ValueError("quire_documents writes to a folder that driver and executors have mounted")
        self.path, self.overwrite, self.suffix = unquote(where.path), overwrite, options.get("suffix", ".pdf")
        # made here and never by a task, so that one that goes on after an abort finds no place to write
        self.staged = os.path.join(self.path, f".staged-{uuid4().hex}")
        os.makedirs(self.staged)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        out, name, file = Written(), None, None
        try:
            for row in iterator:
                if row.doc != name:
                    if file is not None:
                        os.close(file)
                    name, file = row.doc, os.open(os.path.join(self.staged, quote(str(row.doc), safe="")), os.O_CREAT | os.O_WRONLY)
                held, done = out.ranges.setdefault(name, []), 0
                while done < len(row.bytes):
                    done += os.pwrite(file, row.bytes[done:], row.at + done)
                if held and sum(held[-1]) == row.at:
                    held[-1] = (held[-1][0], held[-1][1] + done)
                else:
                    held.append((row.at, done))
        finally:
            if file is not None:
                os.close(file)
        return out

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        ranges: dict[str, list[tuple[int, int]]] = {}
        for m in messages:
            for doc, some in (m.ranges if m else {}).items():
                ranges.setdefault(doc, []).extend(some)
        for doc, some in ranges.items():
            end = 0
            for at, n in sorted(some):
                if at != end:
                    self.abort(messages)
                    raise ValueError(f"the ranges of {doc!r} do not follow each other without gaps")
                end += n
        if self.overwrite:
            for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
                if name.endswith(self.suffix):
                    os.remove(os.path.join(self.path, name))
        for doc in ranges:
            name = quote(str(doc), safe="")
            os.replace(os.path.join(self.staged, name), os.path.join(self.path, name + self.suffix))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if os.path.isdir(self.staged):
            dead = f"{self.staged}-dead"
            os.rename(self.staged, dead)
            shutil.rmtree(dead)


class Documents(DataSource):
    """quire_documents: (doc, at, bytes) as a file for each document, named after it; options path and suffix.

    The folder is on a file system that driver and executors mount. Files appear in commit, all complete, by renaming;
    if a task fails or ranges leave gaps or overlap, none does.
    """

    @classmethod
    def name(cls) -> str:
        return "quire_documents"

    def schema(self) -> str:
        return "doc string, at long, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RangeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats of this package known to a session."""
    from quire.streaming.feed import ReleaseAnswers

    ship(spark)
    for source in (Documents, ReleaseAnswers):
        spark.dataSource.register(source)
