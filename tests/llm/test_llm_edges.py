"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortlens.llm import ann, linededup, minhash, neardup_vectors, packing, quality, segment, sharding, toxicity, warc

WORDS = [f"word{i}" for i in range(400)]
LONG = " ".join(WORDS[(i * i + 3 * i) % 400] for i in range(20_000))
BAD = " ".join(["plain words and then an insult like moron beside a"] * 2)
DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "s", 1),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, " \n\t\n ", "en", "s", 5),
    (6, LONG, "en", "s", len(LONG)),
    (7, "Ünïcödé ☃ 中文 <|endoftext|> a\x00b \x1c c", None, "s", 3),
    (None, "a row without an id, told apart by nothing", "en", "s", 9),
    (9, BAD, "en", "s", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names the operators use inside.
CLASHES = ["id", "key", "row", "score", "__score", "shard", "slot", "size", "th", "ranges", "component", "piece", "__group", "vec", "dim", "cell", "digest"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(DOCS, SCHEMA)
    return plain.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (9, 0, 1), (9, None, 1), (None, 1, 1), (6, 1, 0), (2, 1, 0), (7, 1, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)


ALL = sorted((d[0] is None, d[0] or 0) for d in DOCS)


def test_sharding(docs, nothing):
    shards = {s: 1.0 for s in range(3)}
    rows = sharding.shard_documents(docs, shards, {3: 1.0}).collect()
    assert ids(rows) == ALL
    for s in range(3):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4)} == {16}
    assert sharding.shard_documents(nothing, shards).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(docs, "doc_id", {0: 0.0})


def test_segmentations(docs, nothing):
    rows = segment.segmentations(docs, k=3).collect()
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["sample"]), []).append(r)
    assert {k[0] for k in by} == {d[0] for d in DOCS}
    assert [len(r["ids"]) for r in by[(3, 1)]] == [0] and (3, 2) not in by and by[(4, 1)][0]["inclusion"] == 1.0
    assert len(by[(2, 1)]) == 2 and by[(2, 1)][0]["ids"] == by[(2, 1)][1]["ids"]
    assert segment.segmentations(nothing).count() == 0


def test_packing(docs, nothing):
    rows = packing.pack_documents(docs, capacity=512).collect()
    assert {r["doc_id"] for r in rows} == {d[0] for d in DOCS}
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4)] == [1, 1]
    for s in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 512
    assert packing.pack_documents(nothing).count() == 0


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_classifiers(spark, docs, labels, nothing, kind):
    rows = kind.score_documents(docs, labels).collect()
    assert ids(rows) == ALL
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] in (0, 1) for r in rows)
    assert kind.score_documents(nothing, labels).count() == 0
    none = labels.where("doc_id < 0")
    assert {round(r["score"], 9) for r in kind.score_documents(docs, none).collect()} == {0.5}


def test_line_dedup(docs, nothing):
    rows = linededup.dedup_lines(docs).collect()
    assert ids(rows) == ALL
    assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in (3, 4, 6)} == {3: None, 4: "", 6: LONG}
    assert set(CLASHES) <= set(linededup.dedup_lines(docs).columns)
    assert linededup.dedup_lines(nothing).count() == 0
    again = linededup.dedup_lines(docs.withColumn("Lines_Deleted", F.lit("x")))
    assert [c.lower() for c in again.columns].count("lines_deleted") == 1 and again.count() == len(DOCS)


def test_near_duplicates(docs, nothing):
    rows = minhash.near_duplicates(docs, n=4).collect()
    assert ids(rows) == ALL
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[1]["kept"]
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == by[5]["n_shingles"] == 0 and by[5]["component_id"] == 5
    assert minhash.near_duplicates(nothing).count() == 0


VECTORS = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, []), (6, [1.0, None, 0.0]),
           (7, [math.nan, 0.0, 1.0]), (8, [math.inf, 0.0, 0.0]), (20, [2.0, 0.1, 0.0]), (40, [1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in CLASHES})


def test_near_vectors(vectors):
    rows = neardup_vectors.near_duplicates(vectors).collect()
    assert len(rows) == len(VECTORS)
    by = {r["vec_id"]: r for r in rows}
    assert (by[1]["n_links"], by[2]["n_links"], by[20]["n_links"]) == (2, 2, 2)
    assert by[20]["component_id"] == 1 and not by[2]["kept"]
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (3, 4, 5, 6, 7, 8, 9, 40, None))
    assert neardup_vectors.near_duplicates(vectors.where("vec_id = 3")).collect()[0]["kept"]
    assert neardup_vectors.near_duplicates(vectors.limit(0)).count() == 0


def test_nearest(vectors):
    rows = sorted(tuple(r) for r in ann.nearest(vectors).collect())
    assert rows == [(20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 9, -2.0)]
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_archives(spark):
    big = "<p>" + "x" * 1200
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", None), (5, "", ""),
             (6, "http://a\r\nWARC-Type: evil", "short"), (None, "http://a/n", big), (7, "http://a/7", "é" * 300_000)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({c: F.lit("x") for c in CLASHES})
    folder = warc.archive_folder(spark)
    rows = warc.read(warc.write(df, folder), folder).collect()
    assert len(rows) == len(pages)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in rows)
    assert got == [(0, "revisit", 3, 1203), (1, "revisit", 3, 1203), (2, "revisit", 3, 1203), (2, "revisit", 3, 1203), (3, "response", 0, 1203),
                   (4, "response", 0, 0), (5, "response", 0, 0), (6, "response", 0, 5), (7, "response", 0, 600_000)]
    folder = warc.archive_folder(spark)
    assert warc.read(warc.write(df.limit(0), folder), folder).count() == 0


def test_stages(spark, docs, labels, nothing, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for first in (docs, nothing):
        now = first
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert out.columns == first.columns, name
            now = spark.createDataFrame(out.collect(), out.schema)
        assert now.count() > 0 or first is nothing
