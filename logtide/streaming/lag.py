"""Lag of a stream over text files: the lines that lie there and have not been read.

``Progress`` listens to the streams of a session and keeps how far each has read; ``unread`` counts the lines
beyond, by a Spark job over the unread byte ranges alone.
"""

from __future__ import annotations

import ast
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.text import NAME, TextSource


class Progress(StreamingQueryListener):
    """The last offsets of each stream, by its name (or id): ``spark.streams.addListener(Progress())``."""

    def __init__(self) -> None:
        self.offsets: dict[str, list[str]] = {}
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        self.offsets[name] = [s.endOffset for s in p.sources]
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def _offset(given: str | dict | None) -> dict:
    """An offset as listeners (JSON), ``lastProgress`` (a dictionary's text) or nobody (None) give it."""
    if not isinstance(given, str):
        return given or {}
    try:
        return json.loads(given) or {}
    except ValueError:
        return ast.literal_eval(given) or {}


def unread_lines(spark: SparkSession, path: str, offset: str | dict | None = None) -> DataFrame:
    """``file, offset, line`` beyond a stream's offset (None: all); an unfinished last line counts."""
    spark.dataSource.register(TextSource)
    return spark.read.format(NAME).option("after", json.dumps(_offset(offset))).load(path)


def unread(spark: SparkSession, path: str, offset: str | dict | None = None) -> int:
    """How many lines (not empty) a stream has still to read: ``readmodels.health(..., lag=unread(...))``."""
    return unread_lines(spark, path, offset).count()
