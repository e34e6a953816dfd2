import hashlib
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from strikeline.llm import packing, sentencepiece_agenda
from strikeline.llm.queries import op2_sentencepiece, op8_power_of_two_packing
from tests.conftest import DATA

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", " a", "a ", " a  b ", "x<|endoftext|>y it's 'sam ''s", "ΣΑΣ İx é e\u0301",
    "a▁b  ▁", "😀 x\n\n y\t", "日本語 1234 12a", "\n", "don't!!! we'll're", "ﬁ Ａ", "À la CARTE",
]


def test_ids_are_the_tokenizers_own():
    library = Tokenizer.from_file(WORDS)
    own = packing.Encoder(WORDS, entries=5)  # forgets all the time
    for _ in range(2):
        for text in ODD:
            ids = np.frombuffer(own.ids([text])[0], "<u4").tolist()
            assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_lengths():
    for n in range(1, 5000):
        parts = packing.lengths_of(n, 1024)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts)
        assert sorted(parts, reverse=True) == parts


def test_packing_query(spark):
    library = Tokenizer.from_file(WORDS)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op8_power_of_two_packing(spark, DATA).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            piece = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids))
            assert r.ids_crc32 == zlib.crc32(piece)
            assert r.length & (r.length - 1) == 0 and r.length <= 2048
            at += r.length
        assert at == len(ids)


def test_odd_documents(spark, documents, odd_pairs, tmp_path):
    docs = documents(odd_pairs)
    pieces = packing.pack(docs, WORDS, with_ids=True)
    rows = pieces.collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1
    assert sum(r.start == 0 for r in rows) == len(odd_pairs)
    packing.store_buckets(pieces, str(tmp_path / "buckets"))
    assert spark.read.parquet(str(tmp_path / "buckets")).count() == len(rows)
    assert packing.pack(documents([]), WORDS).count() == 0
    encoded = sentencepiece_agenda.encode(docs, PIECES).collect()
    assert len(encoded) == len(odd_pairs)
    assert {r.n_tokens for r in encoded if r.doc_id in (1, 2)} == {2}
    assert all(r.agrees for r in encoded)
    assert sentencepiece_agenda.encode(documents([]), PIECES).count() == 0


def test_agenda_is_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = sentencepiece_agenda.Agenda(PIECES, entries=5)
    for text in ODD:
        (ids, agreed), = own.encode([text])
        ids = np.frombuffer(ids, "<u4").tolist()
        assert agreed and ids == library.encode(text), text
        assert own.decode(ids) == library.decode(ids)


def test_sentencepiece_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = op2_sentencepiece(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.agrees


def test_long_parts_are_not_kept():
    """Unbroken text of any length is encoded rightly and leaves the caches small."""
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choices("0123456789abcdef日本語", k=20_000)) for _ in range(40)]
    texts += ["x" * 3000, "short words stay " * 3]
    own, library = packing.Encoder(WORDS), Tokenizer.from_file(WORDS)
    agenda = sentencepiece_agenda.Agenda(PIECES)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for at in range(0, len(texts), 7):
        some = texts[at : at + 7]
        for text, ids in zip(some, own.ids(some), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
        for text, (ids, agreed) in zip(some, agenda.encode(some), strict=True):
            assert agreed and np.frombuffer(ids, "<u4").tolist() == lib.encode(text)
    for cache in (own.known, agenda.known, agenda.merged):
        assert all(len(k) <= packing.LONGEST_KEPT for k in cache)
    assert "short" in own.known and sum(map(len, agenda.merged)) < 200_000


def test_caches_are_bounded_by_bytes():
    own = packing.Encoder(WORDS, entries=10)
    for i in range(50):
        own.ids([f"{chr(97 + i % 26)}{'b' * (i % 40)} some words"])
        assert own.held <= 10 * 200 + 5000
    agenda = sentencepiece_agenda.Agenda(PIECES, entries=10)
    for i in range(50):
        agenda.encode([f"{chr(97 + i % 26)}{'b' * (i % 40)} some words"])
        assert agenda.held <= 2 * 10 * 200 + 5000


def test_operators_ship_themselves(tmp_path):
    """Called on a DataFrame of one's own, from a folder that workers cannot import from."""
    import os
    import subprocess
    import sys

    import strikeline

    root = os.path.dirname(os.path.dirname(strikeline.__file__))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from strikeline.session import build_session
spark = build_session("local[2]", "ship", **{{"spark.checkpoint.dir": {str(tmp_path)!r}}})
from strikeline.llm import line_dedup, packing, periodic_runs, syncmers
docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
assert syncmers.fingerprints(docs).count() == 2
assert periodic_runs.find_runs(docs).count() == 2
assert packing.pack(docs, {WORDS!r}).count() >= 2
assert line_dedup.without_repeated_lines(docs, at_least=2).first().n_dropped == 1
print("all shipped")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
        timeout=300, check=False,
    )
    assert "all shipped" in done.stdout, done.stderr[-3000:]
