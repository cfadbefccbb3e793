"""Where operators once had limits or lost digits: results beyond them equal those without."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vertexloom.llm import fingerprints, packing, queries, textscan, url_filters, warc

BIG = (1 << 53) + 1


def test_globs_whatever_the_case(spark):
    df = spark.createDataFrame([(1, "http://a.com/X/ADS-TRACK.js"), (2, "http://a.com/x/ads-track.js"), (3, "http://ADS-TRACK.com"), (4, None), (4, None)], "page_id long, url string")
    for inline in (500, 0):
        out = url_filters.judge_urls(df, [("*ads-track.*", "block")], max_inline=inline).select("page_id", "verdict").collect()
        assert sorted(map(tuple, out)) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (4, "allow")]


def test_urls_ties_and_long(spark):
    """Of rules of one length the smaller string wins; a url may be long."""
    df = spark.createDataFrame([(1, "http://b.a.com/x"), (2, "http://a.com/" + "y" * 200_000), (3, "http://a.com/" + "y/" * 50_000 + "z")], "page_id long, url string")
    out = {r["page_id"]: (r["rule"], len(r["path"])) for r in url_filters.judge_urls(df, [("*b.a*", "allow"), ("*b?a*", "block"), ("*.a.c*", "block"), ("a.com/y", "block")]).collect()}
    assert out == {1: ("*.a.c*", 2), 2: ("a.com/y", 200_001), 3: ("a.com/y", 100_002)}


def test_warc_keeps_large_ids(spark, tmp_path):
    same, longer = "same page " * 20, "x" * 3_000_000
    rows = [(BIG, "u", same), (BIG + 1, "u", same), (None, "u", same), (BIG + 2, None, None), (-(1 << 62), "v", longer), (1 << 62, "v", longer)]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a", roll_bytes=1000)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, f"file://{tmp_path}/a", payloads=False).collect()}
    assert got == {BIG: ("response", None), BIG + 1: ("revisit", BIG), None: ("revisit", BIG), BIG + 2: ("response", None), -(1 << 62): ("response", None), 1 << 62: ("revisit", -(1 << 62))}
    text = {r["page_id"]: r["payload"] for r in warc.read_warc(spark, f"file://{tmp_path}/a").where("record_type = 'response'").collect()}
    assert text[-(1 << 62)] == longer and text[BIG] == same


def test_warc_reads_an_empty_archive(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").collect() == []


def test_ranges_with_outliers(spark):
    rows = [(i,) for i in [*range(20_000), -(1 << 63), (1 << 63) - 1, 1 << 40, None]]
    ranged, n = fingerprints.in_ranges(spark.createDataFrame(rows, "k long"), "k", 10)
    found = ranged.groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("range_id").collect()
    assert n == len(found) == 10 and max(r["n"] for r in found) < 2_200
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))
    assert fingerprints.in_ranges(spark.createDataFrame([(None,), (5,), (5,)], "k long"), "k", 4)[0].count() == 3


def test_packing_keeps_large_ids(spark):
    rows = [(BIG, "a"), (None, "b"), (BIG + 2, None), (BIG, "a"), (BIG, "a")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")), queries.tokenizer()).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (BIG, 2), (BIG, 2), (BIG, 2), (BIG + 2, 1)]


@pytest.mark.parametrize("text", [("word" + 7 * "\n") * 400, ("x  \t" + "y" * 30 + " ") * 300, "é  \u0085  b" * 500, "z" * 9000, " " * 9000, "a,b. (c) " * 900 + "  ", "日本 語　です " * 400])
def test_long_texts_are_encoded_as_a_whole(monkeypatch, text):
    encoder = packing.Encoder(queries.tokenizer())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(textscan, "GROUP", 500)
    for _ in range(2):  # anew, then from memory
        assert next(iter(encoder.ids(pa.array([text])))).tolist() == want


def test_encoder_beyond_its_memory(monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 50)
    rng, encoder = np.random.default_rng(0), packing.Encoder(queries.tokenizer())
    for _ in range(5):
        texts = [" ".join(f"{chr(97 + int(i) % 26)}{i}" for i in rng.integers(0, 60, 30)) + "," for _ in range(20)]
        assert [x.tolist() for x in encoder.ids(pa.array(texts))] == [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_packing_deals_repeated_rows_evenly(spark):
    got = packing.pack(spark.createDataFrame([(7, "same text")] * 4000, "doc_id long, text string"), queries.tokenizer(), shard_docs=500).collect()
    shards = np.unique([r["sequence_id"] >> 32 for r in got], return_counts=True)[1]
    assert len(got) == 4000 and len(shards) == 8 and shards.max() <= 520


def test_warc_digests(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([(1, "u", "é" * 60)], "page_id long, url string, html string"), f"file://{tmp_path}/d")
    row = warc.read_warc(spark, f"file://{tmp_path}/d").first()
    assert row["payload_digest"] == hashlib.sha256(("é" * 60).encode()).hexdigest() and row["payload_bytes"] == 120
