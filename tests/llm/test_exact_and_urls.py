import hashlib
import string
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as contract
from strikeline.llm import exact_dedup, url_trust, warc
from strikeline.llm.queries import ORACLES
from tests.conftest import DATA
from tests.test_queries import _sorted

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got = contract.queries()[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = _sorted(result.fetchall(), columns)
    assert _sorted([tuple(r) for r in got.collect()], got.columns) == want


def test_dedup_of_odd_rows(documents, odd_pairs):
    docs = documents(odd_pairs)
    groups = defaultdict(list)
    for i, t in odd_pairs:
        groups[(t or "").translate(_LOWER)].append(i)
    got = exact_dedup.report(docs).collect()
    assert len(got) == len(odd_pairs)
    kept = defaultdict(int)
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        known = [i for i in groups[key] if i is not None]
        assert r.group_size == len(groups[key])
        assert r.keep_id == (max(known) if known else None)
        kept[key] += r.kept
    assert all(kept[k] == 1 for k in groups)
    rows = exact_dedup.deduplicate(docs)
    assert rows.columns == docs.columns
    assert sorted((r.doc_id or -99, (r.text or "").translate(_LOWER)) for r in rows.collect()) == sorted(
        (max((i for i in g if i is not None), default=-99), k) for k, g in groups.items()
    )


def test_dedup_of_a_hot_group(documents):
    docs = documents([(i, "Same" if i % 3 else f"other {i}") for i in range(900)], 7)
    got = {r.doc_id: r for r in exact_dedup.report(docs).collect()}
    assert got[1].keep_id == 899 and got[1].group_size == 600 and not got[1].kept
    assert got[3].group_size == 1 and got[3].kept
    assert exact_dedup.deduplicate(docs).count() == 301


def test_no_repeated_text_is_missed(spark):
    digests = spark.range(3000).selectExpr("unhex(sha2(cast(id % 2000 as string), 256)) as digest", "id")
    blocks = exact_dedup.blocks_for(3000)
    bits = exact_dedup.repeated_bits(digests, blocks)
    flagged = exact_dedup.with_possibly_repeated(digests, bits, blocks)
    assert flagged.where("id % 2000 < 1000 and not possibly_repeated").count() == 0
    assert flagged.where("id between 1000 and 1999 and possibly_repeated").count() < 100


def test_empty_tables(spark, documents):
    docs = documents([])
    assert exact_dedup.report(docs).count() == 0
    assert exact_dedup.deduplicate(docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_trust.verdicts(pages).count() == 0


def test_rules():
    con = duckdb.connect()
    con.execute("""CREATE TABLE pages AS SELECT * FROM (VALUES
        (1, 'http://A.com', NULL), (2, 'http://a.com/x', ''), (3, 'x://www.example.com/en/1?q', ''),
        (4, 'http://m.example.com/en/', ''), (5, 'nothing', ''), (6, NULL, NULL),
        (7, 'http://b.net/es/1', ''), (8, 'http://xnet/es/1', '')) t(page_id, url, html)""")
    rows = {r[0]: r[1:] for r in con.execute(ORACLES["op10_url_trust"]).fetchall()}
    assert rows[1] == ("a.com", "", None, "allow")
    assert rows[2][2:] == ("com/", "allow")
    assert rows[3][2:] == ("www.example.com/en/", "allow")
    assert rows[4][2:] == ("example.com/en/", "block")
    assert rows[5] == rows[6] == ("", "", None, "allow")
    assert rows[7][2:] == ("net/es/", "block")
    assert rows[8][2:] == (None, "allow")


def _link(*hosts):
    return "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)


def test_trust_and_distrust_spread(spark):
    """good.com is trusted; bad.net blocked; hosts that link to bad.net are distrusted, those
    that good.com links to are trusted."""
    pages = [
        (1, "http://good.com/", _link("friend.org", "mixed.org")),
        (2, "http://bad.net/fr/", _link("victim.org")),
        (3, "http://farm.org/", _link("bad.net", "bad.net", "feeder.org")),
        (4, "http://feeder.org/", _link("farm.org")),
        (5, "http://friend.org/", _link("good.com")),
        (6, "http://mixed.org/", _link("good.com", "friend.org", "friend.org", "bad.net")),
        (7, "http://victim.org/", None), (8, None, _link("farm.org")), (8, None, None),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_trust.verdicts(table).collect()}
    assert [got[i].verdict for i in (3, 4)] == ["block", "block"]
    assert [got[i].verdict for i in (1, 5, 6, 7, 8)] == ["allow"] * 5
    assert got[5].trust > got[6].trust > 0 and got[3].distrust > got[4].distrust > 0
    # the same by the SQL, which goes on for all steps
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    want = sorted(con.execute(ORACLES["op10_url_trust"]).fetchall(), key=str)
    columns = ("page_id", "host", "path", "rule", "verdict")
    got = [tuple(r) for r in url_trust.verdicts(table).select(*columns).collect()]
    assert sorted(got, key=str) == want


def test_warc_is_the_same_for_any_split(spark, tmp_path):
    html = ["<p>" + "".join(chr(97 + (i * j * j) % 26) for j in range(n)) for i, n in
            enumerate([0, 5, 999, 5000, 90_000, 200_000, 1100])]
    pages = [(i, f"http://h/{i} ü\n", html[i % 7]) for i in range(40)]
    pages += [(None, None, None), (7, "http://again/", html[0]), (41, "http://x", "é" * 600)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write(table, str(tmp_path / "archives"))
    seen = None
    for split in (700, 5000, 1 << 24):
        rows = warc.read(manifest, split, with_payload=True).collect()
        assert all(r.intact for r in rows)
        found = sorted((tuple(r) for r in rows), key=str)
        assert seen in (None, found)
        seen = found
    assert len(seen) == len(pages)
    by_id = {r.page_id: r for r in rows}
    for i, _, text in pages:
        raw = (text or "").encode()
        r = by_id[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        same = [p[0] for p in pages if p[2] == text and p[0] is not None]
        if len(raw) >= 1000 and max(same) != i:
            assert (r.record_type, r.refers_to) == ("revisit", max(same))
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
            assert bytes(r.payload) == raw


def test_warc_of_nothing(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(table, str(tmp_path / "none"))).count() == 0


def test_magic_inside_a_member_is_no_record(tmp_path):
    import io
    import zlib

    def member(raw):
        # stored, so that what is inside stands in the file as it is
        deflate = zlib.compressobj(0, zlib.DEFLATED, 31)
        return deflate.compress(raw) + deflate.flush()

    inner = warc.MAGIC + b"\x00" * 20 + b"WARC/1.1 is not here"
    data = b"".join(member(warc.record(i, None, inner * 50, None)) for i in range(5))
    found = []
    for start in range(0, len(data), 97):
        found += [h["warc-record-id"] for h, _ in
                  warc.records_in(io.BytesIO(data), start, min(start + 97, len(data)))]
    assert found == [f"<urn:page:{i}>" for i in range(5)]


def test_warc_of_long_urls(spark, tmp_path):
    pages = [(1, "http://a/" + "x" * 70_000, "one"), (2, "http://b/" + "中" * 9000, "two"),
             (3, "http://c/" + "".join(map(str, range(600_000))), None), (4, "http://d/", "four")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    manifest = warc.write(table, str(tmp_path / "long"))
    for split in (5000, 1 << 24):
        rows = {r.page_id: r for r in warc.read(manifest, split).collect()}
        assert rows.keys() == {1, 2, 3, 4}
        assert [len(rows[i].url) for i in (1, 2, 3, 4)] == [70_009, 9 + 9 * 9000, len(pages[2][1]), 9]


def test_warc_records_that_are_not_read_are_an_error(spark, tmp_path):
    table = spark.createDataFrame([(i, "http://x/", f"{i}") for i in range(20)],
                                  "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(table, str(tmp_path / "broken"))
    path = manifest.first().path
    with open(path, "r+b") as file:  # cut off within the last member
        file.truncate(manifest.first().bytes - 5)
    with pytest.raises(RuntimeError, match="20 records"):
        warc.read(manifest)
