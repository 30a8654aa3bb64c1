"""A corpus pipeline of five stages, each of which calls one operator of ``voxspark.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.llm import decontam, langid, minhash, mixing, tokens
from voxspark.llm.queries import vocabulary
from voxspark.llm.scratch import Scratch

#: Documents whose best language is less likely than this, and those without a letter, go.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of an identified language; a null ``lang`` takes what was found.

    The model learns from this stage's documents, leaving out held-out ids as op8 does.
    """
    scratch = Scratch(spark, "pipeline-language")
    model = langid.train(docs, scratch, vocabulary("piece_bpe_32k.model"))
    scratch.free()  # the model is with the driver
    return langid.filtered(docs, model, LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles, similarity of 0.8 or more.

    Texts without a word have no class and stay; rows that repeat an id and a text stay once.
    """
    scratch = Scratch(spark, "pipeline-dedup")
    near = minhash.near_duplicates(docs, scratch, k=5, percent=80)
    ids = scratch.keep(near.groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count_if(F.col("kept")).alias("n")), "ids")
    gone = scratch.keep(ids.filter("not stays").select("doc_id"), "gone")
    again = scratch.keep(ids.filter("n > 1").select("doc_id"), "again")
    scratch.free(gone, again)
    out = _among(docs, gone, "left_anti")
    if not again.limit(1).count():
        return out
    # only rows whose id is repeated are compared
    return _among(out, again, "left_anti").unionByName(_semi(out, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def _among(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``_semi`` for ids that few rows have: a filter of bits lets the other rows by, so that their texts are not shuffled,
    at small sizes as at large ones."""
    rows = minhash.flagged(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id"), ids.withColumnRenamed("doc_id", "wanted"))
    rest = rows.filter("not flag").select("row.*")
    some = rows.filter("flag").select("row.*")
    return rest.unionByName(_semi(some, ids.hint("merge"), how))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its own or other values, go."""
    scratch = Scratch(spark, "pipeline-decontaminate")
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch)
    gone = scratch.keep(found.select("doc_id").distinct(), "gone")
    scratch.free(gone)
    return _semi(docs, gone, "left_anti")


def _semi(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id is, or is not, among ``ids`` (doc_id), which has one column of its own."""
    a, b = docs.alias("docs"), ids.alias("ids")
    return a.join(b, F.col("docs.doc_id").eqNullSafe(F.col("ids.doc_id")), how)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target weight asks for."""
    return mixing.mixed(docs, Scratch(spark, "pipeline-mix"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row for each document in them, read back."""
    scratch = Scratch(spark, "pipeline-tokens")
    folder = scratch.folder("tokens")
    manifest = tokens.write_tokens(docs, scratch, vocabulary("word_bpe_49k.json"), folder)
    return tokens.read_tokens(manifest, folder, tokens.crc32_of_ids, "long").withColumnRenamed("value", "ids_crc32")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("write_tokens", write_tokens),
]

#: Training, sketches and tokenizers are beyond SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
