"""The SentencePiece codec against the library, WARC round trips, URL filters and top-k search against brute force."""

from __future__ import annotations

import base64
import hashlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import sentencepiece_codec, topk_search, url_filters, warc
from factloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, piece_model


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabcdethinrs."), st.characters(blacklist_categories=("Cs",))), max_size=60))
def test_encoding_is_the_librarys(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    own = sentencepiece_codec.codec(piece_model())
    ids = own.encode(text)
    assert ids == library.encode(text)
    assert own.decode(ids) == library.decode(ids)
    want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert own.digest(text) == want


def test_decoding_of_any_ids_is_the_librarys(library):
    own, r = sentencepiece_codec.codec(piece_model()), random.Random(4)
    for _ in range(500):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randrange(9))]
        assert own.decode(ids) == library.decode(ids)


def test_long_words_and_runs(library):
    own = sentencepiece_codec.codec(piece_model())
    for text in ("ab" * 30_000, " " * 5000 + "x", "é" * 3000, "the" * 7000):
        assert own.encode(text) == library.encode(text)


def test_documents_with_nulls_and_repeats(spark, library):
    rows = [(1, "héllo  wörld\n"), (1, None), (None, ""), (2, "x" * 5000)]
    got = sentencepiece_codec.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), piece_model())
    found = {(r["doc_id"], tuple(r["ids"])) for r in got.collect()}
    assert found == {(k, tuple(library.encode(t or ""))) for k, t in rows}
    back = sentencepiece_codec.decode_documents(got, piece_model())
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(k, t or "") for k, t in rows}


PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c/\r\nX: y", ""), (5, "http://d/", "é" * 30_000), (6, "u", "WARC/1.1\r\n\r\n"), (None, "n", "same"), (2, "http://b/", "same")]


def expected_records():
    by_payload = {}
    for key, _, html in PAGES:
        if key is not None:
            by_payload[html or ""] = min(by_payload.get(html or "", key), key)
    out = []
    for key, _, html in PAGES:
        data = (html or "").encode()
        first = by_payload.get(html or "")
        refers = first if first != key else None
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(map(repr, out))


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.archive_pages(pages, path=f"file://{tmp_path}/a").collect()
    assert sorted(repr(tuple(r)) for r in got) == expected_records()
    assert warc.archive_pages(pages.limit(0), path=f"file://{tmp_path}/empty").count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages, "page_id", "url", "html"), f"file://{tmp_path}/a", roll_bytes=100)
    read = warc.read_archives(spark, f"file://{tmp_path}/a")
    assert read.rdd.getNumPartitions() > 1
    wanted = "warc_type = 'response' and record_id in ('<urn:page:5>', '<urn:page:2>')"
    found = warc.read_archives(spark, f"file://{tmp_path}/a", where=wanted).select("record_id", "payload").collect()
    assert read.where(wanted).count() == 1 and read.count() == len(PAGES)
    assert [(r["record_id"], len(r["payload"])) for r in found] == [("<urn:page:5>", 60_000)]


def test_headers_decide_before_payloads_are_inflated():
    noise = random.Random(1).randbytes(200_000)
    rows = [{"record_id": f"<urn:page:{i}>", "warc_type": "response", "target_uri": "u", "payload_digest": "D", "refers_to": None, "payload_bytes": len(noise), "payload": noise} for i in range(5)]
    for data in (b"".join(warc.gzip_member(warc.record_bytes(r)) for r in rows), b"".join(map(warc.record_bytes, rows))):
        reader, records = warc.WarcReader("x", True), warc.Records(io.BytesIO(data))
        reader.wanted = {"record_id": {"<urn:page:3>"}}
        found = list(reader.rows(records))
        assert [(r[0], r[6]) for r in found] == [("<urn:page:3>", noise)]
        assert data[:2] != b"\x1f\x8b" or records.skipped_inflating == 4


def url_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(r.key), len(r.host), r) for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda x: x[:2])[2] if fits else None
    return host, path, best and best.key, best.action if best else "allow"


def test_urls(spark):
    urls = [None, "", "x", "://", "http://", "http://COM/en/", "https://a.com/en/1#f", "https://example.com/en/7", "http://www.Example.com/en/77?x=/de/", "http://notexample.com/en/7", "http://xnet/de/", "http://net/de/", "ftp://b.net/de/81", "http://example.net/de/8", "http://z.org/es", "http://z.org/es/?q", "a://b.com?c/en/", "http://É.com/en/é", "x://com/en/://org/es/", "http://a..com/en/"]
    rows = [(i, u, "own") for i, u in enumerate(urls)] * 2
    got = url_filters.filter_urls(spark.createDataFrame(rows, "page_id long, url string, verdict string"), URL_RULES).collect()
    assert sorted((r["page_id"], r["host"], r["path"], str(r["rule"]), r["verdict"]) for r in got) == sorted((i, *(str(x) if n == 2 else x for n, x in enumerate(url_verdict(u)))) for i, u, _ in rows)


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("cast(id as string) as key")
    listed = universe.where("cast(key as int) % 97 = 3")
    cascade = url_filters.build_cascade(listed, universe)

    wrong = universe.where(cascade.contains(F.col("key")) != (F.col("key").cast("int") % 97 == 3))
    assert wrong.count() == 0 and len(cascade.levels) > 1
    assert universe.where(url_filters.build_cascade(listed.limit(0), universe).contains(F.col("key"))).count() == 0


def brute_top_k(rows, queries, k, scale=256):
    import math

    def quantise(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    known = [(i, q) for i, v in rows if i is not None and (q := quantise(v)) is not None]
    out = []
    for i, v in queries:
        if i is None or (q := quantise(v)) is None:
            continue
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, w, strict=True)))), j) for j, w in known if j != i and len(w) == len(q))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(7, 3), (1000, 1000)])
def test_top_k_matches_brute_force(spark, blocks):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [1.0] * 5 + [float("nan")]), (204, [1.0] * 5 + [None]), (205, [1.0, 2.0]), (206, []), (207, []), (None, [0.5] * 6), (208, [float("inf")] * 6), (209, [1e14] * 6), (210, [-1e14] * 6), (50, rows[3][1])]
    queries = [x for x in rows if x[0] is not None and x[0] % 10 in (0, 5)]
    schema = "vec_id long, embedding array<double>"
    got = topk_search.top_k_search(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), row_block=blocks[0], query_block=blocks[1]).collect()
    assert sorted(tuple(x) for x in got) == brute_top_k(rows, queries, 5)
    empty = spark.createDataFrame([], schema)
    assert topk_search.top_k_search(empty, empty).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_match_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, db.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))


def test_writes_append(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    records = lambda rows: warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), "page_id", "url", "html")
    warc.write_archives(records([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")]), path)
    warc.write_archives(records([(4, "d", "x"), (5, "e", None)]), path)
    assert warc.read_archives(spark, path).count() == 5
    failing = records([(6, "f", "w")]).withColumn("payload_bytes", F.expr("raise_error('no')").cast("long"))
    before = sorted(x.name for x in (tmp_path / "a").iterdir())
    with pytest.raises(Exception, match="no"):
        warc.write_archives(failing, path)
    assert sorted(x.name for x in (tmp_path / "a").iterdir()) == before
    assert sorted(r["record_id"] for r in warc.read_archives(spark, path, payload=False).collect()) == [f"<urn:page:{i}>" for i in range(1, 6)]
    warc.write_archives(records([(7, "g", "v")]), path, mode="overwrite")
    assert [r["record_id"] for r in warc.read_archives(spark, path).collect()] == ["<urn:page:7>"]
    assert sum(x.name.startswith(warc.MANIFEST) for x in (tmp_path / "a").iterdir()) == 1


def test_leftovers_of_failed_tasks_go(tmp_path):
    import pyarrow as pa

    row = {"record_id": "<r>", "warc_type": "response", "target_uri": "u", "payload_digest": "D", "refers_to": None, "payload_bytes": 1, "payload": b"x"}
    batch = pa.RecordBatch.from_pylist([row])
    first, second = (warc.WarcWriter(str(tmp_path), 100) for _ in range(2))
    lost, kept = first.write(iter([batch])), first.write(iter([batch, batch]))
    first.commit([kept, None])
    second.write(iter([batch]))
    second.abort([])
    names = {x.name for x in tmp_path.iterdir()}
    assert names == {f"{warc.MANIFEST}{first.job}.json", *kept.names} and not names & set(lost.names)


def test_large_payloads_take_linear_time(spark, tmp_path):
    body = "".join(random.Random(2).choices("abcdef", k=1 << 20)) * 24
    pages = spark.createDataFrame([(1, "u", body), (2, "v", body)], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archive_pages(pages, path=f"file://{tmp_path}/a").collect()))
    digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
    assert got == [(1, len(body), digest, "response", None), (2, len(body), digest, "revisit", 1)]
    # beyond the bit array all rows meet the repeated digests
    records = warc.plan_records(spark.createDataFrame(PAGES, "page_id long, url string, html string"), "page_id", "url", "html", max_bits=0)
    assert sorted((r["key"] or 0, r["warc_type"]) for r in records.collect()) == sorted((k or 0, t) for k, _, _, t, _ in map(eval, expected_records()))


def test_vectors_with_clashing_columns_and_shuffled_queries(spark):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5)], 1, "x") for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block int, matrix string")
    queries = vectors.where("vec_id % 9 = 0")
    for limit in (0, 64 << 20):
        got = topk_search.top_k_search(vectors, queries, row_block=11, query_block=4, max_broadcast=limit).collect()
        assert sorted(map(tuple, got)) == brute_top_k([x[:2] for x in rows], [x[:2] for x in rows if x[0] % 9 == 0], 5)


def test_odd_tables_of_texts_and_urls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece_codec.encode_documents(empty, piece_model()).count() == 0
    clash = spark.createDataFrame([(1, "one two", "k", 3, None)], "doc_id long, text string, key string, n_tokens int, ids string")
    got = sentencepiece_codec.encode_documents(clash, piece_model()).collect()
    assert len(got) == 1 and got[0]["n_tokens"] == len(got[0]["ids"]) > 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filters.filter_urls(pages, URL_RULES).count() == 0
    long = "http://a." + "b" * 200_000 + ".com/en/" + "x" * 500_000
    got = url_filters.filter_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), URL_RULES).collect()
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == url_verdict(long)


def test_memos_are_bounded_and_emptied(spark):
    own = sentencepiece_codec.SentencePieceCodec(piece_model(), memo_bytes=20_000, max_pairs=50)
    r = random.Random(3)
    text = " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(2000))
    assert own.digest(text) == sentencepiece_codec.codec(piece_model()).digest(text)
    assert len(own.memo) < 100 and len(own.older) < 100 and len(own.pairs) <= 50
    own.forget()
    assert not own.memo and not own.older and not own.pairs
