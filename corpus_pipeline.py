"""The corpus pipeline: documents -> quality -> near duplicates -> secrets -> mixing -> tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which run() writes as Parquet and reads again for the next
stage. All stages but the last return the columns of documents. Each stage is
exact over all rows that the one before kept:

- quality: documents that the nearest-neighbour classifier rejects go.
- near_duplicates: of each component of the 5-word-shingle Jaccard join (0.8),
  the document with the smallest doc_id stays. Where ids repeat or are null,
  each different text is a document of its own.
- secrets: every secret in a text is replaced by [SECRET]; n_chars follows.
- mixing: rows are dropped or repeated at the fitted rates, so that toxic text
  falls to its target share while clean documents keep a rate of about
  KEEP_CLEAN (so nearly all of them stay, and a few come twice).
- tokens: token ids, with the digests of ids and decoded bytes.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilscan.llm import bpe, mixing, ngram_join, quality_classifier, secrets
from veilscan.llm.queries import VOCABULARY, domains
from veilscan.llm.runtime import cut, ensure_checkpoint_dir, release, table

#: Target token shares of the mixing stage, and the rate that clean text keeps on average.
SHARES = {"clean": 0.97, "toxic": 0.03}
KEEP_CLEAN = 1.05
#: Ids that repeat are broadcast up to so many (8 MB), joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    release(spark)  # the driver's one large array is gone
    return quality_classifier.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row's key: its doc_id; where that is null or repeats, a hash of id and text, so that each text is judged by itself
    twice = cut(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("__id"), F.lit(True).alias("__again")))
    few = twice.count()
    rows = docs.withColumn("__again", F.lit(False))
    if few:
        rows = docs.join(F.broadcast(twice) if few <= BROADCAST_IDS else twice, docs["doc_id"].eqNullSafe(F.col("__id")), "left").drop("__id")
    rows = rows.withColumn("__key", F.when(F.coalesce("__again", F.lit(False)), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")))
    keyed = rows.select(F.col("__key").alias("doc_id"), "text")
    gone = ngram_join.jaccard_components(keyed).where("component_id <> doc_id").select(F.col("doc_id").alias("__key")).distinct()
    rest = rows.join(gone, "__key", "left_anti")
    # rows that repeat both id and text: one stays
    first = Window.partitionBy("__key").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")] or ["__key"])
    once = rest.where("__again").withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth") if few else rest.where("false")
    return rest.where("coalesce(__again, false) = false").unionByName(once).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.scan(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, mask=True)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = domains(table(spark, sf_dir, "labels"))
    release(spark)
    return mixing.mixture(docs, labelled, SHARES, anchor="clean", margin=KEEP_CLEAN)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.tokenize(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, digest=True)
    return coded.drop("text", "n_chars")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL cannot express the classifier, the solver or the tokenizer; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows go through Parquet in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
