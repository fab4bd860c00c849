"""WARC round trip, the two-level index, and the pipeline's stages."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tardy.llm import language_id, queries, warc
from tardy.llm.common import Scratch, ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)



def expected_rows(pages):
    groups = {}
    for i, html in pages:
        if i is not None:
            groups[html or ""] = max(i, groups.get(html or "", i))
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        top = groups.get(html or "")
        revisit = top is not None and i != top
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_round_trip_of_the_table(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert rows_of(queries.op4_warc(spark, SF)) == expected_rows(pages)


def test_round_trip_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "PART_LINES", 10)
    pages = [(i, f"http://a.example.com/{i % 7}", f"<p>{i % 9}") for i in range(60)]
    pages += [(100 + i, "http://hot.example.com/", "same") for i in range(40)]
    pages += [(200, None, None), (201, "::bad url::", ""), (202, "http://x.example/ a b", "éé"), (203, "http://[", "q"),
              (None, "http://n.example/", "same"), (None, None, "only null"), (300, "http://r.example/", "rep"),
              (300, "http://r.example/", "rep"), (301, "HTTP://WWW.A.Example.com:80/X?B#f", "x" * 100_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    assert rows_of(warc.round_trip(df.repartition(5))) == expected_rows([(a, c) for a, _, c in pages])
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payload_bound(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                               "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df, min_payload=4).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_url_keys():
    assert warc.url_key("http://www.A.example.com:80/Path?Q=1#frag") == "com,example,a)/path?q=1"
    assert warc.url_key("https://a.example.com:8443") == "com,example,a:8443)/"
    assert warc.url_key(None) == ")"


def test_files_are_plain_warc_and_lookups_use_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 8)
    monkeypatch.setattr(warc, "PART_LINES", 30)
    root = f"file://{tmp_path}/archive"
    scratch = Scratch(spark, "test")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/{i % 10}", f"page {i}") for i in range(100)],
                                  "page_id long, url string, html string")
    captures = scratch.table(warc.write_archives(pages, root))
    directory = scratch.table(warc.write_index(captures, root, 100))
    records = 0
    for name in os.listdir(f"{tmp_path}/archive"):
        if name.endswith(".warc.gz"):
            records += gzip.open(f"{tmp_path}/archive/{name}").read().count(b"WARC/1.1\r\n")
    assert records == 100
    blocks = [tuple(r) for r in directory.select("first_key", "first_id", "last_key", "last_id", "file", "offset", "length").collect()]
    assert len(blocks) >= 12
    index = warc.CaptureIndex(root, warc.Directory(blocks))
    expected = [i for i in range(100) if i % 3 == 1 and i % 10 == 4]
    files, got = {}, []
    for file, offset, length in index.url("https://www.h1.example.com/4"):
        headers, block = warc.read_record(index.fs, files, f"{index.folder}/{file}", offset, length)
        got.append((warc._named(headers["warc-record-id"]), block.decode()))
    assert sorted(got) == [(i, f"page {i}") for i in expected]
    assert index.url("http://none.example.com/") == [] and len(index.captures("com,example,h1)/4", expected[0])) == 1


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, scratch = docs.columns, Scratch(spark, "test")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.table(stage(spark, before, SF))
        if name != "packing":
            assert after.columns == names
            ids = {r.doc_id for r in after.select("doc_id").collect()}
            old = {r.doc_id for r in before.select("doc_id").collect()}
            assert ids <= old
            kept[name] = (len(old), len(ids))
            before = after
    assert kept["language_id"][0] == kept["language_id"][1]
    assert kept["secrets"][0] == kept["secrets"][1] and kept["minhash_dedup"][1] < kept["minhash_dedup"][0]
    assert after.select("doc_id").distinct().count() == kept["secrets"][1]
    assert after.select(F.sum("length")).first()[0] == after.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_pipeline_query(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_language_stage_rejects_only_what_is_no_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "123 456 !!!", "en", "s", 11)], docs.schema)
    got = corpus_pipeline.identify_language(spark, docs.union(bad), SF)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert language_id.UNKNOWN == "und"


def test_near_duplicate_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(2, text, "en", "s", 1), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (3, "other words here", "en", "s", 1),
            (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == [1, 3, None]


def test_pipeline_stages_take_any_further_columns(spark):
    """Names that the operators use themselves pass through unharmed."""
    clash = ["score", "predicted", "lang_pred", "bits_per_byte", "_raw", "probability", "log_words", "toxic", "node"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in clash})
    scratch = Scratch(spark, "test")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.table(stage(spark, docs, SF))
        assert after.columns == docs.columns and after.count() > 0
        assert after.filter(" or ".join(f"{c} <> concat('{c}', doc_id)" for c in clash)).count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.table(stage(spark, docs, SF))
        assert after.count() == 0
        if name != "packing":
            assert after.columns == docs.columns
            docs = after
