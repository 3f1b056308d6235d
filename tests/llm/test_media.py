"""Media columns: digests against plain hashing over whole tables, pages with several media, and tags left open."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.llm import media

from .common import D, ODD, SCHEMA


@pytest.mark.parametrize("table", ["sf0.001", "odd"])
def test_query_is_brute_force(spark, tmp_path, table):
    folder = D
    if table == "odd":
        folder = str(tmp_path)
        spark.createDataFrame([(*r, 1, 2) for r in ODD], SCHEMA + ", digest long, position long").write.parquet(f"{folder}/documents.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = media.op1_interleaved_media(spark, folder).collect()
    assert len(got) == len(rows) and sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (r.doc_id for r in rows)))
    texts = {r.doc_id: r.text or "" for r in rows}
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.decode(stored) == payload
        x = np.frombuffer(payload, np.uint8).astype(float)
        assert r.feature.startswith(f"png;64x{len(payload) // 64};mean={x.mean():.4f};sd={x.std():.4f};bands=")


def test_positions_and_captions_stay_with_their_media(spark):
    one, two = (hashlib.sha256(b).hexdigest() for b in (b"first", b"second"))
    page = f'<p>a<figure><img src="sha256:{two}"><figcaption>the second</figcaption></figure>b<img src="sha256:{one}" alt="the first">c<img src="sha256:{one}"><img src="gone"></p>'
    pages = spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string")
    stored = media.features(media.store(spark.createDataFrame([(b"first",), (b"second",), (b"first",)], "payload binary")))
    got = media.resolve(media.interleave(pages), stored).where("page_id < 3").orderBy("page_id", "position").collect()
    assert [(r.page_id, r.position, r.caption, r.n_bytes) for r in got] == [(p, k, c, n) for p in (1, 2) for k, c, n in ((1, "the second", 6), (3, "the first", 5), (5, None, 5), (6, None, None))]


def test_tags_left_open_take_little_time():
    for piece in ("<a ", '<a "', "<a '\"", '<a b="x\' ', "<!--", "<a <b>"):
        began = time.time()
        media.sequence(piece * 40_000)
        assert time.time() - began < 5


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, html string")
    assert media.interleave(empty).collect() == []
    assert media.features(media.store(empty.select(F.col("html").alias("payload")))).collect() == []
