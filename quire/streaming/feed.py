"""The release feed as a streaming source.

Each answer, good or bad, is recorded as a numbered file before it is read, so offsets are numbers, a restarted query
reads the very answers again that its checkpoint asks for, and none twice. One request is under way at a time.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Fields of a recorded answer. status 0: none came; visible: whether the project's page is there, asked only after a 404.
ANSWER = "number long, asked_at timestamp, status int, visible boolean, feed string"


def _ask(url: str, timeout: float) -> tuple[int, str | None]:
    request = urllib.request.Request(url, headers={"Cache-Control": "no-cache", "Pragma": "no-cache", "Accept": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return 0, None


def recorded(folder: str) -> list[int]:
    """Numbers of the answers in a folder, in order."""
    if not os.path.isdir(folder):
        return []
    return sorted(int(n[:-5]) for n in os.listdir(folder) if n.endswith(".json") and n[:-5].isdigit())


def record(folder: str, status: int, feed: str | None, visible: bool | None = None, asked_at: float | None = None) -> int:
    """Add an answer to a folder, whole or not at all; its number."""
    os.makedirs(folder, exist_ok=True)
    number = (recorded(folder) or [-1])[-1] + 1
    held = os.path.join(folder, f".{number:012d}.partial")
    with open(held, "w", encoding="utf-8") as f:
        json.dump({"asked_at": time.time() if asked_at is None else asked_at, "status": status, "visible": visible, "feed": feed}, f)
    os.replace(held, os.path.join(folder, f"{number:012d}.json"))
    return number


def poll(url: str, folder: str, project: str | None = None, timeout: float = 20.0, stale: float = 300.0) -> int | None:
    """Ask once and record the answer; None where another request is under way. A request older than stale seconds is dead."""
    os.makedirs(folder, exist_ok=True)
    flag = os.path.join(folder, ".asking")
    try:
        os.close(os.open(flag, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        try:
            if time.time() - os.path.getmtime(flag) < stale:
                return None
            os.utime(flag)
        except FileNotFoundError:
            return None
    try:
        status, feed = _ask(url, timeout)
        visible = _ask(project, timeout)[0] == 200 if status == 404 and project else None
        return record(folder, status, feed, visible)
    finally:
        os.remove(flag)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.url, self.project = options["path"].removeprefix("file://"), options.get("url"), options.get("project")
        self.every, self.asked = float(options.get("every", 86_400)), None

    def initialOffset(self) -> dict:
        return {"next": 0}

    def due(self) -> bool:
        """Whether to ask: some time after the last attempt, whoever made it and however it ended."""
        numbers = recorded(self.folder)
        if not numbers:
            return True
        with open(os.path.join(self.folder, f"{numbers[-1]:012d}.json"), encoding="utf-8") as f:
            return time.time() - json.load(f)["asked_at"] >= self.every

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.url and self.due():
            poll(self.url, self.folder, self.project)
        numbers = recorded(self.folder)
        end = {"next": max(start["next"], numbers[-1] + 1 if numbers else 0)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = []
        for n in recorded(self.folder):
            if start["next"] <= n < end["next"]:
                with open(os.path.join(self.folder, f"{n:012d}.json"), encoding="utf-8") as f:
                    a = json.load(f)
                rows.append((n, datetime.fromtimestamp(a["asked_at"], timezone.utc), a["status"], a["visible"], a["feed"]))
        return iter(rows)

    def commit(self, end: dict) -> None:
        # answers stay: they are the record of attempts
        pass


class ReleaseAnswers(DataSource):
    """release_answers: the answers in a folder (path), as a stream; with url it asks there when every seconds have passed since the last attempt.

    project: a page whose status tells a missing release (404) from a missing project. Reading is the driver's: an
    answer is small, and there are few.
    """

    @classmethod
    def name(cls) -> str:
        return "release_answers"

    def schema(self) -> str:
        return ANSWER

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def releases(answers: DataFrame, status_class: Column | None = None) -> DataFrame:
    """Answers with the class of their status and, of good ones, what the feed says; the same for streams and tables."""
    from quire.operators import release

    told = answers.withColumn("class", status_class if status_class is not None else release.fetch_status(F.col("status"), F.coalesce("visible", F.lit(False))))
    return release.parse_feed(told.withColumn("feed", F.when(F.col("class") == "ok", F.col("feed"))))
