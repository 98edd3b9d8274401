import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from mossgraph.shared import shared_folder
from mossgraph.streaming import overlay
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


class Run:
    """Batches of (id, kind, seq, hash), a second apart."""

    def __init__(self, spark, **more):
        self.spark, self.more, self.folder, self.n = spark, more, shared_folder(spark), 0

    def batch(self, *rows):
        made = [(i, k, s, h, h and f"text {h}", self.n + j, START + timedelta(seconds=self.n + j)) for j, (i, k, s, h) in enumerate(rows)]
        self.n += len(rows)
        self.spark.createDataFrame(made, overlay.WRITES).write.parquet(f"{self.folder}/in/{self.n}")
        stream = self.spark.readStream.schema(overlay.WRITES).parquet(f"{self.folder}/in/*")
        overlay.kept(overlay.pending(stream, **self.more), f"{self.folder}/out", f"{self.folder}/state").awaitTermination()
        return self

    def view(self, at=0, ttl_s=300):
        return overlay.view(self.spark, f"{self.folder}/out", F.lit(START + timedelta(seconds=at)), ttl_s)

    def seen(self, **more):
        return sorted((r.id, r.what, r.seq, r.deleted, r.content) for r in self.view(**more).collect())

    @property
    def mark(self):
        return overlay.mark(self.spark, f"{self.folder}/out").first()[0]


def ids(df):
    return sorted(r.id for r in df.collect())


def test_the_mark_waits_for_gaps(rocks):
    run = Run(rocks, buckets=3).batch(("a", "PUT", 1, "x"), ("b", "PUT", 2, "y"), ("c", "REMOVE", 3, None))
    assert run.mark == 0 and run.seen() == [("a", "PENDING", 1, False, "text x"), ("b", "PENDING", 2, False, "text y"), ("c", "PENDING", 3, True, None)]
    run.batch(("b", "PROJECTED", None, "y"), ("c", "DELETED", None, None))
    assert run.mark == 0 and [s[0] for s in run.seen()] == ["a"]
    run.batch(("a", "PROJECTED", None, "old"), ("a", "DELETED", None, None))  # neither is what waits
    assert run.mark == 0
    run.batch(("a", "PROJECTED", None, "x"))
    assert run.mark == 3 and run.seen() == []


def test_a_replaced_write_waits_once(rocks):
    run = Run(rocks, buckets=2).batch(("a", "PUT", 1, "x")).batch(("a", "PUT", 2, "y")).batch(("a", "PROJECTED", None, "x"))
    assert run.mark == 1 and run.seen() == [("a", "PENDING", 2, False, "text y")]
    assert run.batch(("a", "PROJECTED", None, "y")).mark == 2


def test_overflow_hides_until_projected_or_too_old(rocks):
    run = Run(rocks, buckets=1, entries=1).batch(("a", "PUT", 1, "x"), ("b", "REMOVE", 2, None), ("c", "PUT", 3, "z"))  # a gives way at second 1, b at 2
    assert run.mark == 0 and run.seen() == [("a", "HIDDEN", 1, False, None), ("b", "HIDDEN", 2, True, None), ("c", "PENDING", 3, False, "text z")]
    hits = rocks.createDataFrame([(i,) for i in "abcd"], "id string")
    assert ids(overlay.found(hits, run.view())) == ["d"] and ids(overlay.listed(hits, run.view())) == ["a", "d"]
    assert ids(run.view(at=302).where("expired")) == ["a"] and ids(overlay.found(hits, run.view(at=302))) == ["a", "d"]
    assert ids(overlay.found(hits, run.view(at=1000))) == ["a", "b", "d"] and ids(overlay.listed(hits, run.view(at=1000))) == ["a", "b", "d"]
    run.batch(("a", "PROJECTED", None, "x"))
    assert run.mark == 1 and [s[0] for s in run.seen()] == ["b", "c"]
    run.batch(("b", "DELETED", None, None), ("c", "PROJECTED", None, "z"))
    assert run.mark == 3 and run.seen() == []


def test_persisted_settles_all_before(rocks):
    run = Run(rocks, buckets=3, entries=1).batch(*((i, "PUT", n + 1, i) for n, i in enumerate("abcdef"))).batch((None, "PERSISTED", 4, None))
    assert run.mark == 4 and [s[0] for s in run.seen()] == ["e", "f"]
    assert run.batch((None, "PERSISTED", 2, None), ("e", "PROJECTED", None, "e")).mark == 5


def test_random_writes_against_a_plain_model(rocks):
    rng = random.Random(1)
    run, rows, waits, seq = Run(rocks, buckets=4, entries=2), [], {}, 0
    for _ in range(400):
        i, kind, h = rng.choice("abcdefghijklmnop"), rng.choice(["PUT", "PUT", "REMOVE", "PROJECTED", "DELETED"]), rng.choice("xy")
        mine = waits.get(i)
        if kind in ("PUT", "REMOVE"):
            seq += 1
            waits[i] = (seq, kind == "REMOVE", h if kind == "PUT" else None)
        elif mine and (mine[1] if kind == "DELETED" else not mine[1] and mine[2] == h):
            del waits[i]
        rows.append((i, kind, seq if kind in ("PUT", "REMOVE") else None, h if kind in ("PUT", "PROJECTED") else None))
        if len(rows) == 100:
            run.batch(*rows)
            rows = []
            assert [(s[0], s[2], s[3]) for s in run.seen()] == sorted((k, v[0], v[1]) for k, v in waits.items())
            assert run.mark == min([v[0] for v in waits.values()], default=seq + 1) - 1


def test_low_water(spark):
    for settled, start, want in [([], 0, 0), ([2, 3], 0, 0), ([1, 2, 2, 4], 0, 2), ([1, 2, 6, 7], 5, 7), ([], 9, 9)]:
        assert overlay.low_water(spark.createDataFrame([(s,) for s in settled], "seq long"), start) == want


def test_a_write_without_an_id_is_an_error(rocks):
    with pytest.raises(Exception, match="without an id"):
        Run(rocks).batch((None, "PUT", 1, "x"))


def test_the_state_is_asked_by_part_and_not_by_row():
    class Held(dict):
        calls = 0

        def exists(self):
            Held.calls += 1
            return bool(self)

        def containsKey(self, key):
            Held.calls += 1
            return key in self

        def getValue(self, key):
            Held.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            Held.calls += 1
            self[key] = value

        def removeKey(self, key):
            Held.calls += 1
            self.pop(key, None)

        def iterator(self):
            return iter(list(self.items()))

    states = {}
    made = overlay.Overlay(10)
    made.init(SimpleNamespace(getMapState=lambda name, *_: states.setdefault(name, Held())))
    frame = lambda kind, first, n0: pd.DataFrame({"id": [f"i{k}" for k in range(5000)], "kind": kind, "seq": range(first, first + 5000), "content_hash": "h", "content": "c", "n": range(n0, n0 + 5000), "at": pd.Timestamp("2024-01-01")})
    told = pd.concat(made.handleInputRows((0,), iter([frame("PUT", 1, 1)]), None))
    assert (told["what"] == "HIDDEN").sum() == 4990 and (told["what"] == "PENDING").sum() == 10 and Held.calls < 5000
    told = pd.concat(made.handleInputRows((0,), iter([frame("PROJECTED", 0, 9000)]), None))
    assert (told["what"] == "GONE").sum() == 5000 and (told["what"] == "SETTLED").sum() == 5000 and Held.calls < 10_000
    assert not any(states.values())
