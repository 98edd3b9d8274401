import base64
import gzip
import hashlib
import random
import re
import zlib
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import SF
from mossgraph.llm import decontamination as dec
from mossgraph.llm import licenses, queries, sharding, toxicity, warc
from mossgraph.llm.common import shared_dir
from oracle import both
from pyarrow import fs
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    mine, theirs = both(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)
    assert mine == theirs


# WARC


def pages():
    r = random.Random(1)
    noise = "".join(chr(r.randrange(32, 1000)) for _ in range(70_000))
    inner = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nnested", mtime=0).decode("latin-1")
    return [(3, "http://a b", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "u", "same"), (None, "u", "alone"), (7, "u", noise), (8, "u", inner * 50), (9, "u", "é\r\n\r\nWARC/1.1"), (9, "u", "é\r\n\r\nWARC/1.1")]


def test_warc(spark):
    rows = spark.createDataFrame([(*p, "x") for p in pages()], "page_id long, url string, html string, payload string")
    first = {}
    for i, _, h in pages():
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h in pages():
        data = (h or "").encode()
        to = first.get(h or "") if i is None or i != first[h or ""] else None
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    assert sorted(map(tuple, warc.round_trip(spark, rows).collect()), key=str) == sorted(expected, key=str)
    assert warc.round_trip(spark, rows.limit(0)).count() == 0


@pytest.mark.parametrize("step", [777, 20_000, 1 << 20])
def test_warc_ranges_own_each_record_once(spark, step):
    rows = spark.createDataFrame([p for p in pages() if p[0] is not None], "page_id long, url string, html string").coalesce(1)
    archives = warc.write(rows, shared_dir(spark), date="2024-01-01T00:00:00Z")
    got = warc.read(archives, step).select("path", "offset", "record_id").collect()
    assert len(got) == len({(r.path, r.offset) for r in got}) == 8
    for a in archives.collect():
        store, path = fs.FileSystem.from_uri(a.path)
        data = store.open_input_file(path).read()
        assert len(data) == a.bytes and gzip.decompress(data).count(b"WARC-Record-ID") == a.records
    responses = warc.read(archives, step).where("record_type = 'response' AND target_uri = 'u'").collect()
    assert {bytes(r.payload).decode() for r in responses} >= {h or "" for i, u, h in pages() if u == "u" and i is not None}


def test_warc_chance_magic_is_no_member():
    data = warc.compressed(warc.record("urn:page:1", None, b"x" + warc.MAGIC * 5, None, "2024-01-01T00:00:00Z"))
    noise = warc.MAGIC + b"\0" * 30 + data + data

    class Source:
        def seek(self, at):
            self.at_ = at

        def read(self, n):
            return noise[self.at_ : self.at_ + n]

    assert [o for o, _ in warc.Archive(Source(), len(noise)).records(0, len(noise))] == [33, 33 + len(data)]


# licences


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][1]
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "RELEASED, under the mit licence!"), (3, None), (4, ""), (5, mit.replace(", ", ",\n", 3)), (6, "license " * 5000), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), (7, "Licensed under the Apache License, Version 2.0.")]
    docs = spark.createDataFrame([(*x, "own") for x in rows], "doc_id long, text string, unit string")
    got = sorted((r.doc_id, r.license, r.dice, r.n_matches) for r in licenses.per_document(docs).fillna("-", ["license"]).collect())

    def brute(text):
        units = (text or "").split("\n") + [p for p in re.split(r"\n[ \t\r]*\n", text or "") if "\n" in p]
        found = []
        for unit in units:
            held = set(licenses.bigrams_of(unit))
            for name, b in licenses.flat(licenses.TEMPLATES):
                if 200 * (shared := len(held & set(b))) >= 80 * (len(held) + len(b)):
                    found.append((-round(2 * shared / (len(held) + len(b)), 6), name))
        best = min(found, default=(0.0, "-"))
        return best[1], abs(best[0]), len(found)

    assert got == sorted((d, *brute(t)) for d, t in rows)
    assert [r[1] for r in got] == ["MIT", "-", "-", "-", "MIT", "-", "Apache-2.0", "CC-BY-NC-4.0"]
    found = licenses.scanned(docs.where("doc_id = 1")).first().license_matches
    assert ("Released under the MIT License.", "MIT") in [(m.unit, m.license) for m in found]


def test_every_template_is_probed():
    known = licenses.flat(licenses.TEMPLATES)
    probes = licenses.probe_words(known, 80)
    for _, b in known:
        may_miss = len(b) - -(-len(b) * 80 // 120)
        assert sum(any(p in x for p in probes) for x in b) > may_miss


# toxicity


def test_toxicity(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(5))
    rows, labels = [], []
    for d in range(900):
        toxic = d % 6 == 0
        w = [word() for _ in range(r.randint(5, 60))]
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["grumpf", "Blargh", "snarg"]))
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "grumpf"), (5, rows[5][1])]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.per_document(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert {x.doc_id for x in got if x.held_out} == {d for d, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert sum(x.predicted == int(x.doc_id % 6 == 0) for x in held) >= 0.97 * len(held)
    assert {x.predicted for x in got if x.doc_id in (900, 901)} == {0}
    none = toxicity.per_document(docs, known.limit(0)).collect()
    assert len({x.score for x in none}) == 1


def paired(n):
    """Toxic are only the insults beside their own group: a linear score cannot have both of these and neither of the crossed ones."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(5))
    kinds = [["grumpf", "zemlan"], ["blargh", "quivor"], ["grumpf", "quivor"], ["blargh", "zemlan"], ["grumpf"], ["blargh"], ["zemlan"], ["quivor"], [], []]
    rows = []
    for d in range(n):
        k = r.choice([0, 0, 1, 1, *range(2, 10)])
        w = [word() for _ in range(r.randint(5, 30))] + kinds[k]
        r.shuffle(w)
        rows.append((d, " ".join(w), int(k < 2)))
    return rows


def test_fitted_pairs_beat_a_refitted_linear_model(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows = paired(3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    machine = toxicity.fit(docs.drop("toxic"), docs.drop("text"))
    index = machine.index
    found = {d: sorted(index[b] for b in toxicity.bins_of(t) if b in index) for d, t, _ in rows}
    held = {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    vector = lambda f: Vectors.sparse(len(index), f, [1.0] * len(f))
    line = LogisticRegression(maxIter=200).fit(spark.createDataFrame([(float(y), vector(found[d])) for d, _, y in rows if d not in held], ["label", "features"]))
    pairs = sum((machine.score(found[d]) >= 0.5) == bool(y) for d, _, y in rows if d in held) / len(held)
    alone = sum(line.predict(vector(found[d])) == y for d, _, y in rows if d in held) / len(held)
    assert pairs >= 0.97 and pairs > alone + 0.05, (pairs, alone)


def test_score_equals_a_double_loop_and_spark():
    import math

    import numpy as np

    g = np.random.default_rng(1)
    own = toxicity.Machine({}, g.normal(size=9), -0.3, g.normal(size=9), g.normal(size=(9, 4)))
    for f in ([], [4], [0, 8], [1, 2, 5, 7], list(range(9))):
        z = own.intercept + sum(own.linear[i] * own.scale[i] for i in f)
        z += sum(float(own.factors[i] @ own.factors[j]) * own.scale[i] * own.scale[j] for i in f for j in f if i < j)
        assert own.score(f) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


# benchmark


ITEM = "On Monday Tom bought 3 kg of apples for 12 dollars and then Tom sold 2 kg of them to Mary for 10 dollars"


def test_templates(spark):
    other = ITEM.replace("Tom", "Anna").replace("Mary", "Bob").replace("3", "7").replace("12", "30").replace("apples", "apples")
    mixed = ITEM.replace("Tom bought", "Anna bought").replace("3 kg", "7 kg").replace("2 kg", "7 kg")
    rows = [(1, f"before. {ITEM} after"), (2, f"Other words. {other}. End"), (3, f"Other. {mixed}"), (4, "On Monday Tom bought 3 kg of pears"), (5, None), (6, ""), (7, "short item"), (7, "a short item here"), (9, "a Short item here"), (8, "word " * 3000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "short item"), (3, None), (4, ""), (None, "word word")], "item_id long, text string")
    got = sorted((r.doc_id, r.contaminated, r.item_ids) for r in dec.per_document(docs, bench).collect())
    assert got == [(1, True, [1]), (2, True, [1]), (3, False, []), (4, False, []), (5, False, []), (6, False, []), (7, True, [2]), (7, True, [2]), (8, False, []), (9, False, [])]
    assert sorted(r.doc_id for r in dec.clean(docs, bench).collect()) == [3, 4, 5, 6, 8, 9]
    assert dec.per_document(docs, bench.limit(0)).where("contaminated").count() == 0


def test_templates_equal_brute_force(spark):
    """The same windows by plain comparison of every window with every item's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    split = lambda t: dec.tokens([dec.classified(w) for w in t.split()])
    items = {r.item_id: split(r.text) for r in bench.collect()}
    shape = lambda w: tuple((k, "" if k else v) for k, v in w)
    index = {}
    for i, t in items.items():
        for k in range(max(1, len(t) - dec.WINDOW + 1)):
            index.setdefault(shape(t[k : k + dec.WINDOW]), []).append((i, k))
    expected = {}
    for r in docs.collect():
        t, found = split(r.text), {}
        for k in range(len(t) - dec.WINDOW + 1):
            for i, at in index.get(shape(t[k : k + dec.WINDOW]), ()):
                found.setdefault((i, k - at), []).append(at)
        good = {}
        for (i, shift), ats in found.items():
            good.setdefault(i, set()).update(dec.consistent(items[i], t, shift, ats, dec.WINDOW))
        expected[r.doc_id] = sorted(i for i, g in good.items() if 2 * len(g) >= max(1, len(items[i]) - dec.WINDOW + 1))
    assert {r.doc_id: r.item_ids for r in dec.per_document(docs, bench).collect()} == expected and any(expected.values())


# shards


def test_shards(spark):
    docs = spark.range(1000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("text"), F.lit(None).cast("string").alias("none"))
    store = sharding.ShardStore(spark, shared_dir(spark), docs.schema, fanout=3, file_bytes=40_000, smallest=1000)
    assert store.read().count() == 0 and store.version() == 0
    for k in range(9):
        store.append(docs.where(F.pmod("id", F.lit(9)) == k).coalesce(1))
        store.compact()
    assert len(store.runs()) < 9 and sum(r.merged for r in store.runs()) == 9
    assert all(r.bytes / r.files <= 2 * 40_000 for r in store.runs() if r.merged > 1)
    assert store.read().exceptAll(docs).count() == 0 and store.read().count() == 1000
    old = store.version()
    store.append(docs.limit(0))
    assert store.read(old).count() == store.read().count() == 1000
    with pytest.raises(sharding.Conflict):
        store.commit(old, [])
    store.vacuum()
    assert store.read().count() == 1000


def test_parts_of_one_table_are_runs_of_one_job(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (2, None, None), (3, "", 1), (None, "d", 2)], "doc_id long, text string, PART int")
    store = sharding.ShardStore(spark, shared_dir(spark), docs.schema)
    assert list(store.append_parts(docs, F.col("PART"))) == [1, 2, 3, 4]
    assert sorted(store.read().collect(), key=str) == sorted(docs.collect(), key=str) and store.read().columns == docs.columns
    assert store.read(1).count() < store.read(3).count() and {r.merged for r in store.runs()} == {1}
    assert list(store.append_parts(docs.limit(0), F.col("PART"))) == [] and store.read().count() == 5


def test_two_writers_at_once_lose_nothing(spark):
    docs = spark.range(60).select("id", F.col("id").cast("string").alias("text"))
    folder = shared_dir(spark)

    def write(who):
        store = sharding.ShardStore(spark, folder, docs.schema, fanout=3, smallest=1000)
        for k in range(3):
            store.append(docs.where(F.pmod("id", F.lit(6)) == 3 * who + k))
            store.compact()

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, range(2)))
    store = sharding.ShardStore(spark, folder, docs.schema)
    assert sorted(r.id for r in store.read().collect()) == list(range(60)) and sum(r.merged for r in store.runs()) == 6


# defined results at the edges


def test_empty_tables(spark):
    none = lambda n: spark.read.parquet(f"{SF}/{n}.parquet").limit(0)
    docs = none("documents")
    assert licenses.per_document(docs).count() == 0
    assert toxicity.per_document(docs, none("labels")).count() == 0
    assert dec.per_document(docs, none("benchmark")).count() == 0
    assert sharding.compacted(spark, docs, shared_dir(spark)).count() == 0


def test_long_texts_of_licences_and_items(spark):
    """Megabytes around one licence line and one item."""
    noise = "\n".join(f"{k} plain words of line {k % 97}" for k in range(60_000))
    docs = spark.createDataFrame([(1, f"{noise}\nReleased under the MIT License.\n{noise} {ITEM} {noise}"), (2, noise)], "doc_id long, text string")
    assert {r.doc_id: r.license for r in licenses.per_document(docs).collect()} == {1: "MIT", 2: None}
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert {r.doc_id: r.item_ids for r in dec.per_document(docs, bench).collect()} == {1: [1], 2: []}
