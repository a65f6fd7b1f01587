"""The corpus pipeline: language ID, near-duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the last, returns the
columns of documents.  run() writes each stage as Parquet in the shared checkpoint folder and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrack.llm import langid, mixture, packing, secrets, simhash
from tallyrack.llm.common import checkpoint, row_digest, shared_folder, table, unused, without

#: SQL has neither the models nor the hashes; tests hold the stages against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too), those that op1 calls undetermined.  Rows that
    repeat stay, as do all other columns, whatever their names."""
    lang, score = unused(docs, "lang_pred", "score")
    found = langid.identify(docs, langid.train(docs), lang, score)
    return without(found.filter(F.col(lang) != langid.UNDETERMINED), lang, score)


def _first_of_each(docs: DataFrame, digest: str, repeated: DataFrame) -> DataFrame:
    """docs with its digests, rows of `repeated` digests (a, n) once; they are wholly equal, and combined by tasks."""
    once = docs.join(repeated, F.col(digest) == F.col(repeated.columns[0]), "left_anti")
    if repeated.isEmpty():
        return once
    many = docs.join(repeated, F.col(digest) == F.col(repeated.columns[0]), "left_semi")
    row = F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != digest))).alias("row")
    return once.unionByName(many.groupBy(digest).agg(row).select(digest, "row.*"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, the one with the least doc_id (null last) and, among rows that
    share it, the least digest.  Rows are told apart by a digest of all their columns, so that different texts with
    equal or null ids never drop each other; only rows that repeat wholly are aggregated.  Null and empty texts are
    near-duplicates of each other."""
    digest, stays, n = unused(docs, "row_digest", "stays", "n")
    keyed = docs.withColumn(digest, row_digest(docs))
    groups = checkpoint(simhash.near_duplicates(keyed, more=(digest,)).select("doc_id", "root", F.col(digest).alias("row")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "row"))
    stay = groups.groupBy("root").agg(first["row"].alias(stays))
    rows = groups.groupBy("row").agg(F.count(F.lit(1)).alias(n))
    stay = checkpoint(stay.join(rows, F.col(stays) == F.col("row")).select(stays, n))
    kept = keyed.join(stay, F.col(digest) == F.col(stays), "left_semi")
    return without(_first_of_each(kept, digest, stay.filter(F.col(n) > 1)), digest)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; documents all stay, those without a text and repeated ones too.  An empty table
    gives an empty one."""
    return secrets.redact(docs, secrets.train(secrets.findings(docs)))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or one to three rows.  Rows are told apart by a digest
    of all their columns; of rows that repeat, together as many stay as the mix takes.  Texts without a word go.  An empty
    table gives an empty one."""
    digest, taken, copies, n, copy = unused(docs, "row_digest", "taken", "copies", "n", "copy")
    keyed = docs.withColumn(digest, row_digest(docs))
    found = mixture.mix(keyed, row=digest).groupBy(F.col("row").alias(taken)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(n))
    found = checkpoint(found.filter(F.col(copies) > 0))
    each = _first_of_each(keyed, digest, found.filter(F.col(n) > 1)).join(found.drop(n), F.col(digest) == F.col(taken))
    return without(each.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies))), digest, taken, copies, copy)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row a piece, for repeated documents as well; a text without a token is its
    end id alone."""
    return packing.pack_documents(docs)


STAGES = [("langid", language), ("simhash", one_of_each), ("secrets", without_secrets), ("mixture", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    name, stage = STAGES[-1]
    stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")
