"""A corpus through five stages, each of which takes all that the one before has kept.

Counts as part of the ``llm`` subpackage: it is not there without it. All stages take documents with null
ids, ids that repeat, null, empty and very long texts; a null text has no letter and leaves with the first stage. Only the
columns of ``documents`` are taken and returned, whatever else a table has. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, language_id, line_dedup, near_dup
from factloom.llm.bpe import encode_decode
from factloom.llm.scratch import cut, numbered

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()))


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``ids(row)`` does not name; ids go to every executor if they are few, and rows are shuffled otherwise."""
    ids = cut(ids)
    few = ids.count() <= near_dup.BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "row", "left_anti").select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are near enough to a known language; the language found becomes ``lang``.

    Texts that are null or have no letter go. If no document has a language, there is nothing to judge by, and
    documents with a letter stay, as ``und``.
    """
    docs = _documents(docs)
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, COLUMNS)
    kept = found.where("not rejected") if model.langs else found.where(F.col("text").rlike(r"\p{L}"))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of runs of two lines or more and of single lines of more than 50 words; documents of which no word is left by that go.

    Rows that share an id or have none are documents of their own. Doubling ends at runs of two lines, since deeper intervals only tell how long runs are.
    """
    docs = _documents(docs)
    out = line_dedup.line_dedup(docs, min_lines=2, carry=["lang", "source"], lone_words=50, depth=2)
    return out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document, by id, of each group of near duplicates (5-word shingles, similarity of 0.8 or more); texts without words stay.

    Rows that share an id or have none are documents of their own, so of repeated rows one stays.
    """
    docs = numbered(_documents(docs), "doc_id", "text")
    groups = near_dup.near_duplicates(docs, id_col="row", shingle=5, num=80, den=100)
    return _without(docs, groups.where("not kept").select(F.col("doc_id").alias("row")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold 10 consecutive words of a benchmark item; rows that share an id or have none are documents of their own."""
    docs = numbered(_documents(docs), "doc_id", "text")
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, id_col="row")
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("row")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left, and check the round trip; a row for every row, with its id, null or repeated as it is."""
    return encode_decode(_documents(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, full=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenize),
]

#: The language model and the transducer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again before the next."""
    import uuid

    from factloom.llm.scratch import shared_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{base}/{k}_{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
