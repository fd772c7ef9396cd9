"""Edges of the engine: model, lookup and OCR calls as pluggable functions, offline and deterministic unless one is given."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers of a service that are worth another try.
RETRY_STATUS = {408, 409, 425, 429, 500, 502, 503, 504}
RETRY_WORDS = ("timeout", "timed out", "temporarily", "connection", "rate limit", "overloaded")


def retryable(status: int | None, message: str = "") -> bool:
    return status in RETRY_STATUS or any(w in message.lower() for w in RETRY_WORDS)


def backoff(attempt: int) -> float:
    """Seconds before the next try: 5, 10, 20, 40, then 60."""
    return min(60.0, 5.0 * 2**attempt)


def with_retries(call: Callable[[], str], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(tries):
        try:
            return call()
        except Exception as e:
            if attempt + 1 == tries or not retryable(getattr(e, "status", None), str(e)):
                raise
            sleep(backoff(attempt))
    raise AssertionError("unreachable")


class Limiter:
    """At most `calls` in any sliding window; acquire() tells how long to wait first."""

    def __init__(self, calls: int, window: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.calls, self.window, self.clock, self.at = calls, window, clock, deque()

    def acquire(self) -> float:
        now = self.clock()
        while self.at and now - self.at[0] >= self.window:
            self.at.popleft()
        wait = 0.0 if len(self.at) < self.calls else self.window - (now - self.at[len(self.at) - self.calls])
        self.at.append(now + wait)
        return wait


def mock_reply(prompt: str | None) -> str:
    """A reply that depends on the prompt alone: its digest and length."""
    body = prompt or ""
    return json.dumps({"digest": hashlib.md5(body.encode()).hexdigest()[:8], "chars": len(body)}, separators=(",", ":"))


def replies(prompt: Column, call: Callable[[str], str] = mock_reply) -> Column:
    """One reply a row; equal prompts of a batch are asked once, null prompts not at all."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            told = {p: with_retries(lambda p=p: call(p)) for p in prompts.dropna().unique()}
            yield prompts.map(lambda p: told.get(p))

    return F.pandas_udf(of, "string")(prompt)


def cached_replies(asked: DataFrame, cache: DataFrame, keys: list[str], prompt: str, call: Callable[[str], str] = mock_reply) -> DataFrame:
    """asked with a reply: from the cache (keys, reply) where it has one, else from the call, each key asked once."""
    known = asked.join(cache.select(*keys, "reply"), keys, "left")
    new = known.filter("reply IS NULL").groupBy(*keys).agg(F.min(prompt).alias("_p")).select(*keys, replies(F.col("_p"), call).alias("_new"))
    return known.join(new, keys, "left").select(*asked.columns, F.coalesce("reply", "_new").alias("reply"))


class Store:
    """Annotations and feedback in SQLite: one annotation a (paper, record, field), feedback appended."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(path)
        self.db.executescript("""
            CREATE TABLE IF NOT EXISTS annotations (paper TEXT, record INTEGER, field TEXT, label TEXT, status TEXT, created TEXT, updated TEXT, PRIMARY KEY (paper, record, field));
            CREATE TABLE IF NOT EXISTS feedback (id INTEGER PRIMARY KEY AUTOINCREMENT, paper TEXT, record INTEGER, body TEXT, created TEXT);
        """)

    def annotate(self, paper: str, record: int, field: str, label: str, status: str, now: str) -> None:
        if status == "reviewed" and not label:
            raise ValueError("a reviewed annotation needs a final label")
        self.db.execute(
            "INSERT INTO annotations VALUES (?, ?, ?, ?, ?, ?, ?) ON CONFLICT DO UPDATE SET label = excluded.label, status = excluded.status, updated = excluded.updated",
            (paper, record, field, label, status, now, now),
        )
        self.db.commit()

    def give_feedback(self, paper: str, record: int, body: str, now: str) -> None:
        if not body.strip():
            raise ValueError("feedback needs a text")
        self.db.execute("INSERT INTO feedback (paper, record, body, created) VALUES (?, ?, ?, ?)", (paper, record, body, now))
        self.db.commit()

    def rows(self, table: str) -> list[tuple]:
        if table not in ("annotations", "feedback"):
            raise ValueError(table)
        return self.db.execute(f"SELECT * FROM {table} ORDER BY 1, 2, 3").fetchall()

    def summary(self) -> tuple[int, int, int]:
        return self.db.execute("SELECT count(*), count(DISTINCT paper), count(DISTINCT paper || '::' || record) FROM feedback").fetchone()
