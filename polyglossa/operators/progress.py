"""Counts of rows as they pass: an observation in a batch job, and the same counts of every trigger of a stream. No row is read for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def watched(df: DataFrame, name: str | Observation, **conditions: Column) -> DataFrame:
    """df with counts: rows, and how many meet each condition. An Observation gives them after an action (`.get`), a name to a listener."""
    return df.observe(name, F.count("*").alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def lookup_progress(found: DataFrame, name: str | Observation) -> DataFrame:
    """What tm_lookup gives, with counts of rows found, missed and unchanged."""
    method = F.col("method")
    return watched(found, name, found=method.endswith("_phrase"), missed=method == "unknown_for_review", identity=method == "identity")


def merge_progress(merged: DataFrame, name: str | Observation) -> DataFrame:
    """What phrasebook_merge gives, with counts of entries by outcome."""
    return watched(merged, name, **{k: F.col("outcome") == k for k in ("kept", "created", "updated", "failed")})


class Progress(StreamingQueryListener):
    """Adds up the counts of an observed stream: totals by name, over all triggers of all queries of the session."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            held = self.totals.setdefault(name, {})
            for k, n in row.asDict().items():
                held[k] = held.get(k, 0) + n

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
