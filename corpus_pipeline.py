"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept and its decisions take effect. Stages
that drop rows shuffle only narrow rows to decide; the rows to drop then leave by
an anti-join on id and text hash, which Spark turns into a broadcast where it finds
the dropped side small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm import bpe, decontaminate, exact_dedup, language, simhash
from platterlake.llm._common import shared_folder, shelve, table

#: A document whose best language holds less than this share of its letters is rejected.
LEAST_SHARE = 0.25
#: So is one with less than this share of its letters in scripts that a language was learned with.
LEAST_KNOWN = 0.5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose (doc_id, text) are in ``gone`` (id, text_hash); other columns are not looked at."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), F.xxhash64("text").alias("hash"))
    return packed.join(gone, packed.key.eqNullSafe(gone.id) & (packed.hash == gone.text_hash), "left_anti").select("row.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no learned language for the most part, go.

    Those are the ones mostly in scripts that no language was learned with, and
    the ones whose words fit no language as well as labelled documents fit theirs.
    A null or empty text goes. Rows are judged by their text alone: repeated rows
    and nulls in other columns do not matter. Where no row has a label nothing can
    be learned and every document goes; an empty table gives an empty one. The
    model comes from all labelled rows that are not held out, and what counts as a
    fit from all that are.
    """
    model = language.train(docs)
    found = language.identify(docs, model).withColumn("found", F.col("found").dropFields("spans"))
    found = shelve(found)  # the least fit and the verdicts are both read from it
    known = (F.col("found.lang") != language.UNKNOWN) & (F.col("found.score") >= LEAST_SHARE) & (F.col("found.known") >= LEAST_KNOWN)
    return found.where(known & language.fits(language.least_fit(found, model))).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays.

    Rows that repeat an id and its text become one row; of equal texts that have
    only null ids one row stays.
    """
    rows = exact_dedup.exact_dedup(docs.select("doc_id", "text"))
    text_hash = F.xxhash64("text")
    copies = rows.where(~F.col("kept")).select("id", "digest")
    repeated = rows.where("kept").groupBy("id", "digest").count().where("count > 1").select("id", "digest")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("key"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("hash"), text_hash.alias("text_hash"))

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, left.key.eqNullSafe(right.id) & (left.hash == right.digest), how)

    kept = met(packed, copies, "left_anti")
    if not repeated.isEmpty():
        single = met(kept, repeated, "left_semi").dropDuplicates(["key", "hash"])
        kept = met(kept, repeated, "left_anti").unionByName(single)
    return kept.select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash links chain together the smallest id stays.

    A null text is one without words. Rows that repeat an id and its text stay or
    go together, and so do rows without an id; a group that has no id keeps all its
    rows. An empty table gives an empty one.
    """
    rows = simhash.near_dedup(docs.select("doc_id", "text"))
    return _without(docs, rows.where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "text_hash"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words inside benchmark windows go.

    A text that is null, empty or without words stays, and so does everything if the
    benchmark is empty. Each row is judged by itself; repeated rows fare alike. An
    empty table gives an empty one.
    """
    found = decontaminate.verdict(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))
    return found.where(~F.col("contaminated")).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the check that they decode to the text.

    A null text is an empty one: no tokens. Each row is encoded by itself; repeated
    rows and nulls in other columns stay as they are. An empty table gives an empty one.
    """
    found = bpe.tokenize(docs, bpe.public_files())
    return found.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "exact")


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("tokenize", tokenize),
]

#: SimHash needs XXH64 and the others learned models or a tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
