import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from strikeline.llm import jaccard_join, pii
from strikeline.session import shared_dir
from tests.conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, left = docs.columns, [docs.count()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark)
        stage(spark, docs, DATA).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = (before, docs)
        left.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert left[0] > left[1] > left[2] >= left[3] == left[4]

    before, after = kept["exact_dedup"]
    texts = {(r.text or "").lower() for r in before.collect()}
    assert len(texts) <= after.count() <= before.count()
    before, after = kept["near_dedup"]
    want = {r.component_id for r in jaccard_join.report(before).collect()}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept["pii"]
    assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    found = pii.report(after).selectExpr("sum(n_email + n_ip + n_card + n_phone) as n").first()
    assert found.n == 0
    before, after = kept["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {(r.doc_id, r.start): r for r in after.collect()}
    for d in before.collect():
        ids, at = [*library.encode(d.text, add_special_tokens=False).ids, 1], 0
        while at < len(ids):
            r = rows.pop((d.doc_id, at))
            piece = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(piece)
            at += r.length
    assert not rows


def test_registered(spark):
    names = contract.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


def test_odd_documents_pass_through(spark, documents, odd_pairs):
    docs = documents(odd_pairs)
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.count() >= 5
