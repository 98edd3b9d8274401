"""Writes that a store has and its indexes lack, as the state of a stream: what readers have to see, and how far all has arrived.

Rows are id, kind, seq, content_hash, content, n and at; n is their order. ``PUT`` and ``REMOVE`` are writes, numbered by seq from 1.
``PROJECTED`` says that an index has the content of that hash, ``DELETED`` that it has dropped the id, and ``PERSISTED`` that it has all up to
seq. A write that a newer one of its id replaces is settled, as is one that is projected, a removal by ``DELETED`` only. Rows without
an id, but for ``PERSISTED``, are an error, as their numbers would hold the mark for ever.

A bucket of ids holds at most ``entries`` pending writes. The oldest beyond that are no longer shown but still hide what an
index has of their ids, for a time to live at most (``view`` tells), as their projection may never come. Contents are passed on, not held.
Hidden ids are kept in ``PARTS`` parts of a bucket, each a row of the state: a batch reads and writes the parts of its ids once, and asks the state nothing for a row.

Every batch appends the ids whose state it changes. The mark is the last number up to which all are settled, whatever came after
a gap; numbers beyond it are kept until the gap is closed. A batch that runs again writes the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.changes import OVERLAY_ENTRIES, OVERLAY_TTL_S
from ..shared import exists

BUCKETS, PARTS, ROWS = 64, 256, 1 << 16  #: of ids; of a bucket's hidden ids; rows of a frame that is passed on
WRITES = "id string, kind string, seq long, content_hash string, content string, n long, at timestamp"
UPDATES = "id string, what string, seq long, deleted boolean, content_hash string, content string, at timestamp"
_HELD = "seq long, content_hash string, deleted boolean, at long"


def _part(id: str) -> int:
    return crc32(id.encode()) % PARTS


class Overlay(StatefulProcessor):
    def __init__(self, entries: int):
        self.most = entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "id string", _HELD)
        self.hidden = handle.getMapState("hidden_parts", "part int", "rows string")

    @staticmethod
    def _all(state: Any) -> list[tuple[str, tuple]]:
        return [(k[0], tuple(v)) for k, v in state.iterator()] if state.exists() else []

    def _held(self, part: int) -> dict[str, list]:
        """The hidden ids of a part: seq, content_hash, deleted and at."""
        return json.loads(self.hidden.getValue((part,))[0]) if self.hidden.exists() and self.hidden.containsKey((part,)) else {}

    def _hidden_of(self, ids: Iterable[str]) -> dict[str, tuple | None]:
        """Those of ``ids`` that are hidden; a part at a time is in memory."""
        out: dict[str, tuple | None] = {}
        if self.hidden.exists():
            for part, some in groupby(sorted(ids, key=_part), _part):
                held = self._held(part)
                out |= {id: tuple(held[id]) for id in some if id in held}
        return out

    def _hide(self, changed: dict[str, tuple | None]) -> None:
        """Writes what has become of ids: None for those that are no longer hidden."""
        for part, some in groupby(sorted(changed, key=_part), _part):
            held = self._held(part)
            before = bool(held)
            for id in some:
                if changed[id] is None:
                    held.pop(id, None)
                else:
                    held[id] = list(changed[id])
            if held:
                self.hidden.updateValue((part,), (json.dumps(held),))
            elif before:
                self.hidden.removeKey((part,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pending = dict(sorted(self._all(self.entries), key=lambda e: e[1][0]))  # ``entries`` at most, the oldest first
        given = pd.concat(list(rows)).sort_values("n")
        hidden = self._hidden_of(given["id"].dropna().unique())
        before, found, whole, settled, contents, was = dict(pending), dict(hidden), False, [], {}, {}
        out: list[tuple] = []

        def status(id: str) -> tuple | None:
            if id in pending:
                return ("PENDING", *pending[id])
            held = hidden.get(id)
            return ("HIDDEN", *held) if held else None

        def unhide(id: str) -> None:
            if held := hidden.get(id):
                hidden[id] = None
                settled.append(held[0])

        text = lambda c: given[c].astype(object).where(given[c].notna(), None)
        times = given["at"].astype("datetime64[ns]").astype("int64") // 1000
        for id, kind, seq, content_hash, content, at in zip(given["id"], given["kind"], given["seq"], text("content_hash"), text("content"), times.tolist(), strict=True):
            if kind == "PERSISTED":
                if not whole:
                    stored = {i: tuple(v) for _, rows_ in self._all(self.hidden) for i, v in json.loads(rows_[0]).items()}
                    found, hidden, whole = stored | found, stored | hidden, True
                for i in [i for i, v in [*pending.items(), *hidden.items()] if v and v[0] <= seq]:
                    was.setdefault(i, status(i))
                    if pending.pop(i, None) is None:
                        hidden[i] = None
                if key[0] == 0:  # one for all buckets
                    out.append((None, "PERSISTED", int(seq), None, None, None, at))
                continue
            was.setdefault(id, status(id))
            if kind in ("PUT", "REMOVE"):
                if id in pending:
                    settled.append(pending.pop(id)[0])
                unhide(id)
                deleted = kind == "REMOVE"
                pending[id] = (int(seq), content_hash, deleted, at)
                contents[id] = None if deleted else content
                while len(pending) > self.most:
                    oldest = next(iter(pending))
                    was.setdefault(oldest, status(oldest))
                    hidden[oldest] = (*pending.pop(oldest)[:3], at)
            elif held := status(id):
                if held[3] if kind == "DELETED" else kind == "PROJECTED" and not held[3] and held[2] == content_hash:
                    if pending.pop(id, None):
                        settled.append(held[1])
                    else:
                        unhide(id)
        for id in before.keys() - pending.keys():
            self.entries.removeKey((id,))
        for id, v in pending.items():
            if before.get(id) != v:
                self.entries.updateValue((id,), v)
        self._hide({id: v for id, v in hidden.items() if v != found.get(id)})
        for id, old in was.items():
            if (now := status(id)) != old:
                what, seq, content_hash, deleted, at = now or ("GONE", old[1], None, None, old[4])
                out.append((id, what, seq, deleted, content_hash, contents.get(id) if what == "PENDING" else None, at))
        out += [(None, "SETTLED", seq, None, None, None, 0) for seq in settled]
        for first in range(0, max(1, len(out)), ROWS):
            yield self._frame(out[first : first + ROWS])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["id", "what", "seq", "deleted", "content_hash", "content", "at"], dtype=object)
        made["seq"] = made["seq"].astype("int64")
        made["at"] = pd.to_datetime(made["at"].astype("int64"), unit="us")
        return made

    def close(self) -> None:
        pass


def pending(writes: DataFrame, entries: int = OVERLAY_ENTRIES, buckets: int = BUCKETS) -> DataFrame:
    """The changes of state that a stream of ``writes`` makes. The session needs the RocksDB state store."""
    named = F.when(F.col("id").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")).otherwise(F.raise_error(F.lit("a write without an id")).cast("int"))
    dealt = writes.withColumn("bucket", F.explode(F.when(F.col("kind") == "PERSISTED", F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(named))))
    return dealt.select("bucket", *writes.columns).groupBy("bucket").transformWithStateInPandas(Overlay(entries), UPDATES, "Append", "None")


def low_water(settled: DataFrame, start: int) -> int:
    """The last number up to which all from ``start`` on are among ``settled`` (seq)."""
    known = settled.where(F.col("seq") > start).select("seq").distinct()
    follows = known.select((F.col("seq") + 1).alias("seq")).unionByName(known.sparkSession.range(1).select(F.lit(start + 1).cast("long").alias("seq")))
    return follows.join(known, "seq", "left_anti").agg(F.min("seq")).first()[0] - 1


def kept(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of state and the mark of each batch below ``out``."""

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{out}/updates/batch={batch}")
        made = spark.read.schema(UPDATES).parquet(f"{out}/updates/batch={batch}")
        start, settled = 0, made.where("what = 'SETTLED'").select("seq")
        if batch and exists(spark, f"{out}/marks/{batch - 1}/_SUCCESS"):
            start = spark.read.parquet(f"{out}/marks/{batch - 1}").first()[0]
            settled = settled.unionByName(spark.read.schema("seq long").parquet(f"{out}/beyond/{batch - 1}"))
        mark = low_water(settled, max(start, made.where("what = 'PERSISTED'").agg(F.max("seq")).first()[0] or 0))
        settled.where(F.col("seq") > mark).write.mode("overwrite").parquet(f"{out}/beyond/{batch}")
        spark.range(1).select(F.lit(mark).cast("long").alias("mark")).write.mode("overwrite").parquet(f"{out}/marks/{batch}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark(spark: SparkSession, out: str) -> DataFrame:
    """One row: the newest mark, which never falls."""
    return spark.read.schema("mark long").option("recursiveFileLookup", True).parquet(f"{out}/marks").agg(F.max("mark").alias("mark"))


def view(spark: SparkSession, out: str, now: Column, ttl_s: float = OVERLAY_TTL_S) -> DataFrame:
    """id, what (PENDING or HIDDEN), seq, deleted, content_hash, content, at and expired: an expired id no longer hides anything, but its projection is still awaited."""
    rows = spark.read.schema(UPDATES + ", batch int").parquet(f"{out}/updates").where(F.col("what").isin("PENDING", "HIDDEN", "GONE"))
    last = rows.groupBy("id").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("id", "batch"))), "batch").alias("v")).select("id", "v.*")
    old = (F.col("what") == "HIDDEN") & (F.col("at") < now - F.make_interval(secs=F.lit(ttl_s)))
    return last.where("what <> 'GONE'").withColumn("expired", old)


def listed(base: DataFrame, seen: DataFrame) -> DataFrame:
    """``base`` (id, ...) of the store without ids that are pending or whose deletion is hidden; the pending ones come beside it."""
    return base.join(seen.where("what = 'PENDING' OR (deleted AND NOT expired)").select("id"), "id", "left_anti")


def found(hits: DataFrame, seen: DataFrame) -> DataFrame:
    """``hits`` (id, ...) of an index without ids of which it has older contents."""
    return hits.join(seen.where("NOT expired").select("id"), "id", "left_anti")
