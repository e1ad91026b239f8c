"""Entries that are delivered late or again, as a stream: each once, without the deleted, with what readers have overridden."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delivered(entries: DataFrame, tombstones: DataFrame, overrides: DataFrame, keys: Sequence[str], late: str = "1 day", event_time: str = "ts") -> DataFrame:
    """``entries`` (a stream, or a table of one delivery) once for each key within ``late``, without those in ``tombstones``.

    A column of ``overrides`` that isn't null takes the place of an entry's own of that name. A later delivery of a
    key within the time is the same entry; state is as large as what came within ``late``.
    """
    once = entries.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys)) if entries.isStreaming else entries.dropDuplicates(list(keys))
    alive = once.join(tombstones.select(*keys).distinct(), list(keys), "left_anti")
    own = [c for c in overrides.columns if c not in keys]
    renamed = overrides.select(*keys, *[F.col(c).alias(f"own_{c}") for c in own])
    joined = alive.join(renamed, list(keys), "left")
    return joined.select(*[F.coalesce(f"own_{c}", c).alias(c) if c in own else F.col(c) for c in entries.columns])
