"""A training corpus in five stages over ``documents``; each works on all rows its predecessor kept.

quality: documents that the site quality classifier rejects or finds toxic go.  near_duplicates: of each component of
similar texts (five-word shingles, Jaccard similarity 0.8 or more) the smallest id stays.  decontamination: documents that
hold a benchmark item go.  mixing: documents come as often as the curriculum takes them, in training order.  tokens: the
token file of the rest, read back.

Rows without an id can't be named in any result and leave in the first stage.  An empty table passes every stage as an empty
table; columns beyond those of documents are left behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import curriculum_mix, ngram_jaccard_join, site_quality, template_decontam, token_file
from quarry.llm.common import cut, shared_dir, small_side

SHINGLE, PERCENT = 5, 80
#: Of a reading that the end of a source's demand cuts, the share of the document that makes it count.
LEAST_SHARE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The documents whose id is not among ids (doc_id)."""
    kept = docs.where("doc_id is not null").join(small_side(cut(ids.distinct(), name)), "doc_id", "left_anti")
    return kept.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps and does not find toxic.  Null, empty and blank texts are judged like others, by
    the features of an empty text; an id of several rows goes with all of them where one is rejected."""
    scored = site_quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("not keep or toxic").select(F.col("id").alias("doc_id")), "quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of similar texts.  Null and blank texts are like no other and stay; of equal rows
    with different ids the smallest id stays, and rows of one id stay together."""
    found = ngram_jaccard_join.link_components(docs, k=SHINGLE, percent=PERCENT)
    return _without(docs, found.where("id <> component_id").select(F.col("id").alias("doc_id")), "near")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.  Null and blank texts hold none and stay; an id of several rows goes
    with all of them where one holds an item."""
    found = template_decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select(F.col("id").alias("doc_id")), "leaks")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document, in training order.  The last reading of a source ends within a document; it
    counts where at least LEAST_SHARE of the document is taken.  Texts without a word are never read; of several
    rows of one id each has readings of its own."""
    taken = curriculum_mix.readings(docs).where(f"words > 0 and words >= {LEAST_SHARE} * size")
    taken = taken.select(F.col("id").alias("doc_id"), F.col("source").alias("from"), "copy", "pass", "position")
    rows = curriculum_mix.documents_with_copies(docs.select(*COLUMNS)).alias("d").join(taken.alias("t"), F.expr("d.doc_id = t.doc_id and d.copy = t.copy and d.source <=> t.from"))
    rows = rows.select(*[f"d.{c}" for c in COLUMNS], "t.pass", "t.position")
    return curriculum_mix.in_training_order(rows, "doc_id", "pass").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Start, number and checksum of each reading's token ids, read back from the token file.  Null and empty texts have
    the end id only; readings of one id follow each other."""
    folder = token_file.write_tokens(docs, token_file.new_folder(spark))
    return token_file.read_tokens(spark, folder, digests=True).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The classifier's fit and the token file are beyond SQL; tests hold near_duplicates against brute force, the others against their operators.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet and read as the next one's input."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/quarry/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
