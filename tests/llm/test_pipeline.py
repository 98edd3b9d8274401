import tiktoken
import public_tokenizers
from conftest import SF
from test_jaccard import brute as near
from test_substrings import brute_bytes
from mossgraph.llm import bpe, decontamination, quality
from mossgraph.llm.common import written
from mossgraph.llm.queries import PIECES, RANKS
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark):
    """Each stage against brute force on what the one before has kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    (_, rules), (_, join), (_, strings), (_, leaks), (_, code) = corpus_pipeline.STAGES
    one = written(rules(spark, docs, SF))
    vocabularies = [quality.vocabulary(PIECES), quality.vocabulary(RANKS, public_tokenizers.PATTERN)]
    kept = []
    for r in docs.collect():
        words = r.text.encode().split()
        for v in vocabularies:
            v.learn(set(words))
        if quality.judge(r.text, r.lang, words, vocabularies)[-1]:
            kept.append(r)
    assert sorted(one.collect()) == sorted(kept) and one.columns == docs.columns

    two = written(join(spark, one, SF))
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert sorted(r.doc_id for r in two.collect()) == sorted({c for _, n, c in near(rows, 80, 5)}) and two.columns == docs.columns

    three = written(strings(spark, two, SF))
    before = {r.doc_id: r for r in two.collect()}
    after = {r.doc_id: r for r in three.collect()}
    ids = sorted(before)
    assert sorted(after) == ids and three.columns == docs.columns
    for d, (n, gone, _, _) in zip(ids, brute_bytes([before[d].text for d in ids], 200)):
        assert n - gone - 6 <= len(after[d].text.encode()) <= n - gone and after[d].n_chars == len(after[d].text)

    four = written(leaks(spark, three, SF))
    index = decontamination.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], decontamination.WINDOW)
    hit = {d for d, r in after.items() for i, n, _ in index.matches(r.text) if 2 * n >= index.items[i].windows}
    assert {r.doc_id for r in four.collect()} == set(ids) - hit

    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in code(spark, four, SF).collect()} == {d: len(theirs.encode_ordinary(after[d].text)) for d in set(ids) - hit}


def test_edges(spark):
    """Null, empty, wordless and repeated rows, an added column, a null id; then no row at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    first = docs.first()
    names = docs.columns
    change = lambda **k: tuple({**first.asDict(), **k}[c] for c in names)
    odd = [tuple(first), tuple(first), change(doc_id=9001, text=None), change(doc_id=9002, text=""), change(doc_id=9003, text="  \n"), change(doc_id=None), change(doc_id=9004, lang=None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("shard", F.lit("own"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = written(stage(spark, rows, SF))
        assert k == 4 or rows.columns == [*names, "shard"]
    alone = docs
    for _, stage in corpus_pipeline.STAGES:
        alone = written(stage(spark, alone, SF))
    ids = [r.doc_id for r in rows.collect()]
    assert len(ids) == len(set(ids)) and not {9001, 9002, 9003} & set(ids)
    assert sorted(map(str, rows.select(alone.columns).collect())) == sorted(map(str, alone.collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.count() == 0
