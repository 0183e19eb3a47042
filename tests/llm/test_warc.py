import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from weftline.llm import warc as m

SCHEMA = "page_id long, url string, html string"
LONG = "é" * 600


def expected(rows):
    best = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = best.get(h) if i is not None and len(b) >= 1000 else None
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/", LONG), (2, "http://b/\r\nX: y", LONG), (3, None, None), (4, "http://c/", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", LONG), (7, "ü", "\r\n\r\nWARC/1.1\r\n" + "x" * 2_000_000), (9, "u", LONG), (9, "u", LONG)]


def test_round_trip(spark):
    got = m.archive_round_trip(spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in ("sha1", "_key", "kept", "refers_to", "bundle")})).drop("url")
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=repr) == expected(ROWS)
    assert m.archive_round_trip(spark.createDataFrame(ROWS, SCHEMA).limit(0)).count() == 0


def test_index_finds_records(spark, tmp_path):
    index = m.write_warc(spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}").collect()
    assert len(index) == len(ROWS)
    for row in index:
        headers, block = m.fetch(row["bundle"], row["frame"], row["at"])
        assert headers["warc-record-id"] == row["record_id"] and headers["x-page-id"] == ("" if row["page_id"] is None else str(row["page_id"]))
    seven = next(r for r in index if r["page_id"] == 7)
    assert m.fetch(seven["bundle"], seven["frame"], seven["at"])[1].endswith(b"x" * 100)


def test_bundles_are_plain_zstandard(spark, tmp_path):
    """Any reader that skips skippable frames unpacks a bundle."""
    m.write_warc(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), f"file://{tmp_path}")
    (bundle,) = tmp_path.glob("*.zst")
    with zstandard.ZstdDecompressor().stream_reader(bundle.read_bytes(), read_across_frames=True) as r:
        assert r.read().count(b"WARC-Record-ID: ") == len(ROWS)


def test_damage_is_noticed(spark, tmp_path):
    index = m.write_warc(spark.createDataFrame(ROWS[:1], SCHEMA).coalesce(1), f"file://{tmp_path}")
    (bundle,) = tmp_path.glob("*.zst")
    record = m.make_record(1, "u", b"y" * 2000, "0" * 40, None, "2026-01-01T00:00:00Z")
    w = m.BundleWriter(f"file://{tmp_path}/bad")
    w.add(1, record)
    bad = spark.createDataFrame([(w.close()[0][2],)], "bundle string")
    with pytest.raises(Exception, match="differs from its digest"):
        m.read_warc(bad).collect()
    assert m.read_warc(index).count() == 1


def test_a_repeated_task_has_bundles_of_its_own(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    first, second = (m.write_warc(rows, f"file://{tmp_path}") for _ in range(2))
    assert {r["bundle"] for r in first.collect()}.isdisjoint({r["bundle"] for r in second.collect()})
    assert m.read_warc(first).count() == m.read_warc(second).count() == len(ROWS)
