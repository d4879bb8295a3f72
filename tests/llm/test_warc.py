import hashlib
import io
import random

import pytest
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from shelfmark.llm import warc
from shelfmark.session import new_table_path
from tests.llm.helpers import plain

SCHEMA = "page_id long, url string, html string, digest string, first string, path string"


def pages():
    rng = random.Random(6)
    big = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(300_000))
    copy = "<p>" + "same " * 40 + "</p>"
    rows = [(i, f"http://x/{i}", "".join(rng.choice("abc \n<é>") for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(400 + i, "http://copy/", copy) for i in range(40)] + [(399, "http://copy/", copy), (399, "http://other/", copy)]
    rows += [(500, None, None), (501, "bad\r\nurl \x00", ""), (502, "u", big), (None, "u", copy), (None, "u", "x" * 200), (None, None, None)]
    rows += [(600, "u", "s" * 99), (601, "u", "s" * 99), (602, "u", "é" * 50), (603, "u", "é" * 50), (604, "u", "WARC/1.1\r\n\r\n\x1f\x8b")]
    return [(*r, "d", "f", "p") for r in rows]


def brute(rows):
    first = {}
    for i, _, html, *_ in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html, *_ in rows:
        payload = (html or "").encode()
        to = first.get(html) if len(payload) >= 100 else None
        repeat = to is not None and i != to
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if repeat else "response", to if repeat else None))
    return plain(out)


@pytest.mark.parametrize("split", [997, 50_000, 10**9])
def test_round_trip(spark, monkeypatch, split):
    monkeypatch.setattr(warc, "ROLL_BYTES", 60_000)
    monkeypatch.setattr(warc, "READ_BYTES", 4096)
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    archives = warc.write_archives(warc.with_record_types(df), new_table_path(spark, "warc"))
    got = warc.read_archives(archives, split, payload=True).collect()
    assert plain((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute(pages())
    texts = {(r[0], (r[2] or "").encode()) for r in pages()}
    assert all((r["page_id"], r["payload"]) in texts for r in got if r["record_type"] == "response")


def test_foreign_archives_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    archives = warc.write_archives(warc.with_record_types(none), new_table_path(spark, "warc"))
    assert warc.read_archives(archives).count() == 0
    folder = new_table_path(spark, "warc")
    warc.write_archives(warc.with_record_types(spark.createDataFrame(pages()[:50], SCHEMA)), folder)
    assert warc.read_archives(warc.list_archives(spark, folder), 3000).count() == 50


def test_false_magic_is_not_a_record():
    """Stored bytes that look like the start of a member, and junk between members."""
    member = warc.encode_record(1, "u", b"x" * 300, hashlib.sha256(b"x" * 300).hexdigest(), None)
    junk = warc.MAGIC + b"junk" + warc.MAGIC[:2]
    data = junk + member + junk + member + warc.MAGIC
    for split in (1, 7, 100, 10**6):
        found = sum(len(list(warc.records_in_range(io.BytesIO(data), s, s + split))) for s in range(0, len(data), split))
        assert found == 2


def test_damage_is_reported(spark):
    folder = new_table_path(spark, "warc")
    store, root = arrow_fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    member = warc.encode_record(1, "u", b"x" * 300, "0" * 64, None)
    with store.open_output_stream(f"{root}/a.warc.gz", compression=None) as out:
        out.write(member)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(warc.list_archives(spark, folder)).collect()


def test_types_need_no_gathering(spark):
    plan = warc.with_record_types(spark.createDataFrame(pages(), SCHEMA).withColumn("n", F.lit(1)))
    assert plan.columns == ["page_id", "url", "payload", "digest", "refers_to"]
