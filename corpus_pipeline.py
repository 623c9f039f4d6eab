"""The corpus pipeline: quality, near duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next stage's documents.  All but the last return the columns of
``documents``; further columns of the input are left behind.

- ``quality`` drops documents that the positive-unlabelled classifier rejects.
- ``near_duplicates`` keeps one document of each class of similar ones, with the least id.
- ``decontamination`` drops documents that share a window of words with the benchmark.
- ``secrets`` replaces secrets in the texts and counts their characters again.
- ``encoding`` returns the token ids of each text.

A null or empty text passes where its score allows; texts without words are one class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontam, neardup, pieces, quality, secrets
from parley.llm import queries as q
from parley.llm.common import stored, table, text_keys

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MASK = "[SECRET]"
#: Keys of contaminated documents are broadcast up to so many; beyond, the join shuffles.
BROADCAST_KEYS = 1_000_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    model = q.quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, F.col("text"), *(F.col(c) for c in COLUMNS), model=model)
    return scored.filter(F.col("score") >= 0.7).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = neardup.join(docs, keys=True)
    found = stored(found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("class_key", "doc_id", "k1", "k2"))
    # where texts of the least id are several of one class, or a row is repeated, one stays
    least = found.groupBy("class_key").agg(F.min(F.struct("k1", "k2")).alias("k")).select(F.col("k.k1").alias("_k1"), F.col("k.k2").alias("_k2"))
    k1, k2 = text_keys("doc_id", "text")
    kept = docs.withColumns({"k1": k1, "k2": k2}).join(least, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left_semi")
    return kept.dropDuplicates(["k1", "k2"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keys=True)
    bad = stored(found.filter("n_hit > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct())
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_KEYS else bad
    k1, k2 = text_keys("doc_id", "text")
    return docs.join(bad, (k1 == F.col("_k1")) & (k2 == F.col("_k2")), "left_anti").select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in COLUMNS if c not in ("text", "n_chars")]
    found = secrets.scan(docs, F.col("text"), *(F.col(c) for c in others), vocabulary_path=q.VOCABULARY, mask=MASK)
    return found.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.length("masked").cast("bigint").alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, F.col("text"), F.col("doc_id"), model_path=q.PIECES, keep=("ids",))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", without_secrets),
    ("encoding", encoded),
]
#: SQL expresses neither the classifier nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
