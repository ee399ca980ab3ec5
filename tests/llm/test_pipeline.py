"""Stages on a small fixture, each against what must stay of its own input, and the whole of it."""

import hashlib

import corpus_pipeline
import pytest
from factloom.llm import queries

BODY = "the small house and the old mouse lived with the other mother near a wide river"
ITEM = "seven quick wizards jump over the lazy brown fence beside nine calm rivers today"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    unique = lambda k: " ".join(f"{w}{k}{j}" for j, w in enumerate((BODY + " " + BODY).split()))
    rows = [(k, unique(k) + "\n" + unique(k + 1000), "en", "s", 1) for k in range(40)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, unique(1) + "\n" + unique(1001) + " x", "en", "s", 1), (102, "intro " + ITEM + " outro", "en", "s", 1), (103, None, None, None, None), (104, "123", "en", "s", 3), (None, "no id", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = set(docs.columns)
    gone = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert set(kept.columns) == columns
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, kept))
        gone.append((name, before - after))
        docs = kept
    assert gone == [("language_id", {103, 104}), ("line_dedup", {100}), ("near_dedup", {101}), ("decontaminate", {102})]


def test_run(spark, folder):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(out, key=repr) == sorted([*range(40), None], key=repr)
    texts[None] = "no id"
    assert all(r.decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i, r in out.items())


def test_lone_copies_of_long_lines_go(spark):
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"one\n{long}\ntwo", "en", "s", 1), (2, f"three\n{long}\nfour", "en", "s", 1), (3, long, "en", "s", 1)]
    out = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "three\nfour"}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, k string, component_id long"


def test_odd_rows(spark, tmp_path):
    """Clean documents stay though their ids are null or repeat; of repeated rows one stays; columns with clashing names and very long texts do no harm."""
    say = lambda k, n=40: " ".join(f"the{k} house{k} and{k} {w}" for w in (BODY.split() * n)[:n])
    rows = [(None, say(1)), (None, say(2)), (7, say(3)), (7, say(4)), (7, f"intro {ITEM} outro {say(5)}"), (8, say(6)), (8, say(6)), (None, say(7)), (None, say(7)), (9, say(8, 60_000)), (10, None), (None, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "en", None, None, 1, "k", 5) for i, t in rows], SCHEMA)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    want = [(None, say(1)), (None, say(2)), (7, say(3)), (7, say(4)), (8, say(6)), (None, say(7)), (9, say(8, 60_000))]
    assert sorted(((r.doc_id, r.decoded_sha256) for r in docs.collect()), key=repr) == sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in want), key=repr)


def test_empty_tables_and_no_labels(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == [], name
    bare = spark.createDataFrame([(1, "a text", None, "s", 6, 1, "k", 1), (2, "12 !", None, "s", 4, 1, "k", 1)], SCHEMA)
    assert [(r.doc_id, r.lang) for r in corpus_pipeline.identify_language(spark, bare, "").collect()] == [(1, "und")]


def test_every_query_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 13)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
