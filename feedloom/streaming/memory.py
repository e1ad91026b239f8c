"""What a feed's recent extractions said: the same text for another entry within hours is refused, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Texts remembered for each feed, and for how long, in milliseconds.
MOST, TTL = 300, 6 * 3600 * 1000
ROW = "feed long, entry long, at long, sibling long"


class Recent:
    """Fingerprints of one feed, the least recently noted first: at most ``MOST``."""

    def __init__(self, known: dict[str, tuple[int, int]] | None = None):
        self.known = known or {}

    def sibling(self, entry: int, fingerprint: str, at: int) -> int | None:
        """The other entry that was given this text within the time, or nothing, and then the text is noted for this one."""
        other, since = self.known.get(fingerprint, (entry, at))
        if at - since <= TTL and other != entry:
            return other
        self.known.pop(fingerprint, None)
        self.known[fingerprint] = (entry, at)
        if len(self.known) > MOST:
            del self.known[next(iter(self.known))]
        return None


def replayed(rows: DataFrame) -> DataFrame:
    """(feed, entry, at, sibling) of every distinct extraction (feed, entry, fingerprint, at in milliseconds), by time and then entry.

    Each feed's rows pass in order through one task, which holds a batch of them and the memory, never a whole feed.
    Rows without a feed, entry, fingerprint or time take no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        feed, recent = None, Recent()
        for batch in batches:
            out = []
            for f, entry, fingerprint, at in batch.itertuples(index=False):
                if f != feed:
                    feed, recent = f, Recent()
                out.append((f, entry, at, recent.sibling(entry, fingerprint, at)))
            yield pd.DataFrame(out, columns=["feed", "entry", "at", "sibling"]).astype({"sibling": "Int64"})

    whole = rows.select("feed", "entry", "fingerprint", "at").dropna().distinct()
    return whole.repartition("feed").sortWithinPartitions("feed", "at", "entry", "fingerprint").mapInPandas(run, ROW)


class Memory(StatefulProcessor):
    """Rows wait in state until the watermark has passed them, so that late ones come in their turn and repeated ones count once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "fingerprint string", "entry long, at long, turn long")
        self.waiting = handle.getMapState("waiting", "at long, entry long, fingerprint string", "once boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for at, entry, fingerprint in batch[["at", "entry", "fingerprint"]].drop_duplicates().itertuples(index=False):
                self.waiting.updateValue((int(at), int(entry), fingerprint), (True,))
            for at in batch["at"].unique().tolist():
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k for k in self.waiting.keys() if k[0] <= until)
        if not due:
            return
        before = {k[0]: tuple(v) for k, v in self.known.iterator()}
        recent = Recent({f: v[:2] for f, v in sorted(before.items(), key=lambda x: x[1][2])})
        turn, out = max((v[2] for v in before.values()), default=0), []
        for at, entry, fingerprint in due:
            other = recent.sibling(entry, fingerprint, at)
            if other is None:
                turn += 1
                before[fingerprint] = (entry, at, turn)
                self.known.updateValue((fingerprint,), (entry, at, turn))
            out.append((key[0], entry, at, other))
            self.waiting.removeKey((at, entry, fingerprint))
        for fingerprint in before.keys() - recent.known.keys():
            self.known.removeKey((fingerprint,))
        for fingerprint in [f for f, v in recent.known.items() if until - v[1] > TTL]:
            self.known.removeKey((fingerprint,))
        yield pd.DataFrame(out, columns=["feed", "entry", "at", "sibling"]).astype({"sibling": "Int64"})

    def close(self) -> None:
        pass


def streaming(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same over a stream (feed, entry, fingerprint, ts), its rows at most ``late`` behind. Needs the RocksDB state store."""
    timed = rows.dropna(subset=["feed", "entry", "fingerprint", "ts"]).withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy("feed").transformWithStateInPandas(Memory(), ROW, "Append", "EventTime")
