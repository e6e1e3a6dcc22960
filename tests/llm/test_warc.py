import base64
import hashlib

from weftline.llm import warc
from weftline.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, digest string, record_type int"


def expected(rows, least=0):
    first = {}
    for i, _, h, *_ in rows:
        h = (h or "").encode()
        if i is not None:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h, *_ in rows:
        h = (h or "").encode()
        same = len(h) < least or i == first.get(h)
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if same else "revisit", None if same else first[h]))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(i, f"http://e.org/{i}", f"<html>page {i % 40} " + "some words of markup " * (i % 40), "d", 1) for i in range(200)]
    rows += [(500, None, None, None, None), (501, "http://e.org/\r\nx", "", None, None), (502, "u", "\r\n\r\né😀" + "x" * 300_000, "d", 2), rows[3], rows[60]]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    folder = f"{shared_dir(spark)}/warc-test"
    files = warc.archive(pages, folder).collect()
    assert sum(f.records for f in files) == len(rows)
    got = warc.read(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    content = spark.read.format("binaryFile").load(files[0].archive).head().content
    assert int.from_bytes(content[:4], "little") == warc.DICT_MAGIC
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")


def test_short_payloads_are_responses(spark):
    rows = [(1, "a", "xx", "", 0), (2, "b", "xx", "", 0), (3, "c", "long enough", "", 0), (4, "d", "long enough", "", 0)]
    folder = f"{shared_dir(spark)}/warc-short"
    warc.archive(spark.createDataFrame(rows, SCHEMA), folder, least=5)
    got = warc.read(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows, 5)


def test_empty_table(spark):
    folder = f"{shared_dir(spark)}/warc-none"
    assert warc.archive(spark.createDataFrame([], SCHEMA), folder).count() == 0
    assert warc.read(spark, folder).count() == 0
