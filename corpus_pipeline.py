"""The corpus pipeline: five stages over ``documents``.

language   language ID; documents without a language (no letter) or with a
           pooled probability under ``LANGUAGE_MIN`` go
duplicates n-gram Jaccard join; of each component the document with the
           smallest doc_id stays; unlike texts that share a doc_id, and
           documents without one, count as documents of their own
repeats    exact substring dedup; repeated words go, and documents of which
           nothing is left
mixing     documents are taken as often as the sources' targets ask
packing    best-fit packing into sequences of 1024 tokens

Every stage works on all that the one before kept; all but the last return
the columns of documents (n_chars follows the text). Stage outputs are
written to the shared scratch folder and reread, so a lost executor costs
one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.llm import jaccard, langid, mixing, packing, substring
from wattlane.session import materialize, ship_package

LANGUAGE_MIN = 0.3
BATCH_ROWS = 1000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ready(spark: SparkSession) -> None:
    """The package for the workers, and Arrow batches of fewer rows than
    Spark's default of 10,000: the rows are whole texts, and all stages share
    the executors' memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    net = langid.fit(docs.filter(~langid.held_out()))
    told = langid.predict(docs, net, COLUMNS[1:])
    return told.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LANGUAGE_MIN)).select(COLUMNS)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are compared under a name of their own (a hash of doc_id and
    text), so rows that share a doc_id or have none are documents like any
    other. Rows equal in both are one; of a component the smallest doc_id
    stays (none last), of equal ones the smallest name. Should unlike rows
    ever share a name, they all stay."""
    _ready(spark)
    named = docs.withColumn("_name", F.xxhash64("doc_id", "text"))
    seen = named.groupBy("_name").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_id"), F.min(F.crc32("text")).alias("_low"),
                                      F.max(F.crc32("text")).alias("_high"), F.min(F.octet_length("text")).alias("_short"),
                                      F.max(F.octet_length("text")).alias("_long"), F.max("doc_id").alias("_last"))
    clash = ~(F.col("_low").eqNullSafe(F.col("_high")) & F.col("_short").eqNullSafe(F.col("_long")) & F.col("_id").eqNullSafe(F.col("_last")))
    seen = materialize(seen.select("_name", "_n", "_id", clash.alias("_clash")), "pipeline-names")
    comp = jaccard.jaccard_components(named.select(F.col("_name").alias("doc_id"), "text")).select(F.col("doc_id").alias("_name"), "component_id").distinct()
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_name")).alias("_first")
    stays = seen.join(comp, "_name").groupBy("component_id").agg(first).select(F.col("_first._name").alias("_name"))
    stays = materialize(stays.unionByName(seen.where("_clash").select("_name")).distinct().join(seen.select("_name", (F.col("_n") > 1).alias("_many")), "_name"), "pipeline-stays")
    kept = named.join(stays, "_name")
    many = kept.where("_many").groupBy("_name", "doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_o"))
    return (kept.where("NOT _many").select(COLUMNS)
            .unionByName(many.select("doc_id", "text", "_o.lang", "_o.source", "_o.n_chars")))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    out = substring.dedup_substrings(docs, keep=["lang", "source"])
    return (out.filter("n_words > n_removed")
            .select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return mixing.mix(docs).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("duplicates", duplicates),
    ("repeats", repeats),
    ("mixing", mixed),
    ("packing", packed),
]

# Training, a global join and pseudo-random rounding: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
