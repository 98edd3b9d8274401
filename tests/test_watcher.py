from datetime import datetime, timedelta

import pandas as pd
import pytest
from mossgraph.shared import shared_folder
from mossgraph.streaming import drain
from mossgraph.streaming.watcher import ordered, watched

SCHEMA = "root string, path string, kind string, at timestamp, seq long"
START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def run(spark, tmp_path, *batches):
    """What comes out of the batches, one after the other; times in seconds."""
    out = []
    for n, rows in enumerate(batches):
        made = [("/v", p, k, START + timedelta(seconds=t), 100 * n + i) for i, (p, k, t) in enumerate(rows)]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        drain.drained(watched(stream, 2, 10, buckets=4), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    for r in spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "out")).collect():
        out.append((r.path, r.kind, (r.at - START).total_seconds(), (r.due - START).total_seconds()))
    return sorted(out, key=str)


def test_the_last_event_of_a_path_passes_once(rocks, tmp_path):
    got = run(rocks, tmp_path, [("/v/a", "CREATED", 0), ("/v/a", "MODIFIED", 1), ("/v/b", "CREATED", 1), ("/w/c", "CREATED", 1), ("/vx", "CREATED", 1)], [("/v/a", "DELETED", 1.5), ("/v/a", "CREATED", 5)], [(None, "TICK", 20)])
    assert got == [("/v/a", "CREATED", 5, 7), ("/v/a", "DELETED", 1.5, 2), ("/v/b", "CREATED", 1, 3)]


def test_own_writes_are_dropped_once(rocks, tmp_path):
    got = run(rocks, tmp_path, [("/v/a", "SUPPRESS", 0), ("/v/a", "MODIFIED", 1), ("/v/b", "SUPPRESS", 0)], [("/v/a", "MODIFIED", 6), ("/v/b", "MODIFIED", 11)], [(None, "TICK", 30)])
    assert got == [("/v/a", "MODIFIED", 6, 8), ("/v/b", "MODIFIED", 11, 13)]  # the second came, the announcement was too old


def test_an_overflow_clears_what_waits(rocks, tmp_path):
    got = run(rocks, tmp_path, [("/v/a", "CREATED", 0), ("/v/b", "CREATED", 1)], [(None, "OVERFLOW", 1.5), ("/v/c", "CREATED", 1.7)], [(None, "TICK", 30)])
    assert got == [("/v/c", "CREATED", 1.7, 3.7), (None, "OVERFLOW", 1.5, 1.5)]


def test_a_timer_passes_what_waits_where_nothing_comes(rocks, tmp_path):
    got = run(rocks, tmp_path, [("/v/a", "CREATED", 0)], [("/v/b", "CREATED", 60)], [("/v/b", "MODIFIED", 61)])
    assert ("/v/a", "CREATED", 0, 2) in got and not any(p == "/v/b" for p, *_ in got)


def test_rows_of_a_bucket_are_ordered_in_pieces():
    frames = [pd.DataFrame({"path": [f"/v/{i % 7}", None], "kind": ["a", "TICK"], "at": pd.to_datetime([1000 - i, i]), "seq": [i, i]}) for i in range(300)]
    for f in frames:
        f["at"] = START + (f["at"] - pd.Timestamp(0)) * 1000
    expected = sorted(((p, k, a.value // 1000, s) for f in frames for p, k, a, s in f.itertuples(index=False)), key=lambda r: (r[2], r[3]))
    assert list(ordered(iter(frames))) == expected
