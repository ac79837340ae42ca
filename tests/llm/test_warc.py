import base64
import gzip
import hashlib

from carelake.llm.queries import op6_warc_transactions
from carelake.llm.shared import Scratch, table
from carelake.llm.warc import assemble, page_captures, read_records, write_archives

SCHEMA = "page_id long, url string, html string, id string, digest string, owner long, home long"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7, 8) for r in rows], SCHEMA)


def _expected(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        owner = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            again = i is not None and i != owner and len(payload) >= least
            out.append((i, len(payload), digest, "revisit" if again else "response", owner if again else None))
    return sorted(out, key=repr)


def _found(df):
    rows = df.select("metadata.page_id", "response.payload_bytes", "response.digest", "response.type", "original").collect()
    return sorted(map(tuple, rows), key=repr)


AWKWARD = [
    (1, "http://a/", "<html>same</html>"),
    (2, "http://b/", "<html>same</html>"),
    (3, None, "<html>same</html>"),
    (4, "http://c/\r\nX-Evil: 1", None),
    (5, "http://d/", ""),
    (6, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\nWARC/1.1\r\n"),
    (7, "http://f/\U0001f600", "é\U0001f600\n\r\n\r\n"),
    (8, "http://g/", "long " * 300_000),
    (None, "http://h/", "<html>same</html>"),
    (None, None, None),
]


def test_awkward_rows_come_back_whole(spark):
    assert _found(page_captures(_pages(spark, AWKWARD))) == _expected(AWKWARD)
    assert _found(page_captures(_pages(spark, AWKWARD), 10)) == _expected(AWKWARD, 10)


def test_same_as_brute_force_on_a_whole_table(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in table(spark, sf_dir, "pages").collect()]
    found = sorted(map(tuple, op6_warc_transactions(spark, sf_dir).collect()), key=repr)
    assert found == _expected(rows)


def test_repeated_rows_give_a_capture_each(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "u", "b"), (1, "v", "b")]
    found = _found(page_captures(_pages(spark, rows)))
    assert [r[0] for r in found] == [1, 1, 1, 2]
    assert sorted((r[0], r[1], r[3], r[4]) for r in found if r[3] == "revisit") == [(1, 1, "revisit", 2)]


def test_payloads_and_record_structure(spark):
    path = f"{Scratch(spark, 'warc-test').root}/archives"
    write_archives(_pages(spark, AWKWARD), path)
    records = read_records(spark, path, payloads=True)
    kinds = {r["type"]: r["count"] for r in records.groupBy("type").count().collect()}
    assert kinds == {"request": 10, "metadata": 10, "response": 7, "revisit": 3}
    captures = assemble(records).collect()
    payloads = {r["metadata"]["page_id"]: r["response"]["payload"] for r in captures if r["response"]["type"] == "response"}
    for i, _, html in AWKWARD:
        if i in (5, 6, 7, 8):
            assert bytes(payloads[i]) == (html or "").encode()
    files = spark.read.format("binaryFile").load(path).collect()
    assert gzip.decompress(files[0]["content"]).startswith(b"WARC/1.1\r\nWARC-Type: request\r\n")


def test_empty_table(spark):
    assert page_captures(_pages(spark, [])).count() == 0


def test_a_revisit_refers_to_the_record_that_holds_its_payload(spark):
    rows = [(2, "u", "a"), (2, "u", "b"), (3, "u", "a"), (1, "u", "b")]
    assert _found(page_captures(_pages(spark, rows))) == _expected(rows)


def test_large_page_ids(spark):
    rows = [((1 << 60) + 1, "u", "same"), ((1 << 60) + 5, "u", "same")]
    assert _found(page_captures(_pages(spark, rows))) == _expected(rows)


def test_records_without_partners_still_assemble(spark):
    """A lone response has null request and metadata; a request or metadata of no known response gives no row."""
    schema = "type string, id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, page_id long, payload binary"
    rows = [
        ("response", "r1", None, None, "u", "D", 1, None, None),
        ("request", "q9", "r9", None, "u", None, None, None, None),
        ("metadata", "m9", "r9", None, None, None, None, 9, None),
        ("warcinfo", "w", None, None, None, None, None, None, None),
    ]
    found = assemble(spark.createDataFrame(rows, schema)).collect()
    assert [(r["id"], r["request"], r["metadata"]) for r in found] == [("r1", None, None)]
