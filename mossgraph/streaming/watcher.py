"""A file watcher's events as a stream: debounced by path, without a store's own writes, and cleared by an overflow.

Rows are root, path, kind, at and seq. The kinds of files pass through; ``SUPPRESS`` announces a write of the store itself, so
that the next event of its path is dropped once, if it comes within ``suppress_s``; ``OVERFLOW`` means that events of the root were lost:
what waits is dropped and the overflow itself is passed on, for a reconcile; ``TICK`` only moves the clock. Paths outside of
their root go. The first event of a path that has none waiting starts its delay, and when that is over the last
event of the path is passed on.

State is kept for each root and bucket of paths, as a map from path to what waits; an overflow or tick reaches all buckets.
Rows of a batch are taken in order of time and move the clock of their bucket; a timer does where none come, once the watermark has passed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BUCKETS, DEBOUNCE_S, SUPPRESS_S = 64, 0.2, 10.0
EVENTS = "root string, path string, kind string, at timestamp, seq long, due timestamp"
EVERYWHERE = ("OVERFLOW", "TICK")


PIECE = 10_000  #: rows that are Python objects at once, and of a frame


def ordered(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """path, kind, at (microseconds) and seq in order of time. They are held as numbers, since a bucket may get very many rows in a batch."""
    names: dict[str | None, int] = {}
    coded = lambda c: np.fromiter((names.setdefault(x, len(names)) for x in c), np.int32, len(c))
    pieces = [(coded(r["path"]), coded(r["kind"]), r["at"].astype("datetime64[us]").astype("int64").to_numpy(), r["seq"].to_numpy()) for r in rows]
    path, kind, at, seq = (np.concatenate(c) for c in zip(*pieces, strict=True))
    order, name = np.lexsort((seq, at)), list(names)
    for k in range(0, len(order), PIECE):
        part = order[k : k + PIECE]
        yield from zip((name[i] for i in path[part]), (name[i] for i in kind[part]), at[part].tolist(), seq[part].tolist(), strict=True)


class Debounce(StatefulProcessor):
    def __init__(self, debounce_s: float, suppress_s: float):
        self.debounce, self.suppress = round(debounce_s * 1e6), round(suppress_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "path string", "first long, kind string, at long, seq long")
        self.own = handle.getMapState("own", "path string", "until long")

    def _held(self) -> dict[str, tuple]:
        """What waits, by path."""
        return {k[0]: tuple(v) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}

    def _kept(self, before: dict[str, tuple], after: dict[str, tuple]) -> None:
        """Writes what has changed, and the time of the next one that is due."""
        for path in before.keys() - after.keys():
            self.waiting.removeKey((path,))
        for path, v in after.items():
            if before.get(path) != v:
                self.waiting.updateValue((path,), v)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if after:
            self.handle.registerTimer((min(v[0] for v in after.values()) + self.debounce) // 1000 + 1)

    def _due(self, root: str, held: dict[str, tuple], firsts: list[tuple[int, str]], now: int) -> list[tuple]:
        """Takes what is due by ``now`` out of ``held``; ``firsts`` is a heap of when paths began to wait, with entries of others that no longer do."""
        out = []
        while firsts and firsts[0][0] + self.debounce <= now:
            first, path = heapq.heappop(firsts)
            if path in held and held[path][0] == first:
                _, kind, at, seq = held.pop(path)
                out.append((root, path, kind, at, seq, first + self.debounce))
        return out

    def _step(self, key: tuple, rows: Iterator[tuple], held: dict[str, tuple]) -> Iterator[tuple]:
        firsts = [(v[0], path) for path, v in held.items()]
        heapq.heapify(firsts)
        owned = self.own.exists()
        for path, kind, at, seq in rows:
            yield from self._due(key[0], held, firsts, at)
            if kind == "OVERFLOW":
                held.clear()
                firsts.clear()
                if key[1] == 0:  # one for the root
                    yield (key[0], None, kind, at, seq, at)
            elif kind == "SUPPRESS":
                self.own.updateValue((path,), (at + self.suppress,))
                owned = True
            elif kind != "TICK":
                if owned and self.own.containsKey((path,)):
                    until = self.own.getValue((path,))[0]
                    self.own.removeKey((path,))
                    if at <= until:
                        continue
                if path not in held:
                    heapq.heappush(firsts, (at, path))
                held[path] = (held[path][0] if path in held else at, kind, at, int(seq))

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["root", "path", "kind", "at", "seq", "due"])
        for c in ("at", "due"):
            made[c] = pd.to_datetime(made[c].astype("int64"), unit="us")
        return made

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self._held()
        after = dict(before)
        out = self._step(key, ordered(rows), after)
        while piece := list(islice(out, PIECE)):
            yield self._frame(piece)
        self._kept(before, after)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = self._held()
        after = dict(before)
        firsts = [(v[0], path) for path, v in after.items()]
        heapq.heapify(firsts)
        out = self._due(key[0], after, firsts, expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._kept(before, after)
        yield self._frame(out)

    def close(self) -> None:
        pass


def watched(events: DataFrame, debounce_s: float = DEBOUNCE_S, suppress_s: float = SUPPRESS_S, late: str = "1 second", buckets: int = BUCKETS) -> DataFrame:
    """``events`` (a stream) as the store sees them: root, path, kind, at, seq and due, when they are passed on. An overflow has no path.

    The session needs the RocksDB state store."""
    inside = F.col("kind").isin(*EVERYWHERE) | F.startswith("path", F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")))
    own = F.array(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    dealt = events.where(inside).withColumn("bucket", F.explode(F.when(F.col("kind").isin(*EVERYWHERE), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(own)))
    return dealt.select("root", "bucket", "path", "kind", "at", "seq").withWatermark("at", late).groupBy("root", "bucket").transformWithStateInPandas(Debounce(debounce_s, suppress_s), EVENTS, "Append", "EventTime")
