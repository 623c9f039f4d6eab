"""The queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import bytebpe, decontam, hardneg, langid, neardup, pieces, pii, quality, secrets, spans, telephony, toxicity, whitening
from parley.llm.common import crc_bucket, labelled_sample, sample, stored, table

TOKENIZERS = "/opt/tokenizers"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: At most so many labelled rows of each label value are used to fit a classifier.
FIT_ROWS = 2500
#: At most so many training documents stand for the unlabelled ones.
UNLABELLED_ROWS = 5000
#: About so many training texts of each language are used to fit the language model.
FIT_TEXTS = 300


def rank_file(path: str) -> bytes:
    """The content of a file of ranks, which the driver reads and tasks get."""
    with open(path, "rb") as f:
        return f.read()


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    payload = F.coalesce("text", F.lit("")).cast("binary")
    # the media are written, and what is decoded is read from there
    media = stored(telephony.store(docs, payload, F.col("doc_id")))
    read = telephony.decode(media, F.col("media"), F.col("doc_id"), F.col("n_bytes"))
    digests = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return read.select(*digests, telephony.features(read).alias("feature"), "pcm")


def op2_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", crc_bucket(F.col("doc_id"), 5) != 0, FIT_ROWS)
    model = toxicity.fit([t for t, _ in rows], [y for _, y in rows])
    scored = toxicity.score(docs, F.col("text"), F.col("doc_id"), model=model)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses", "spans")


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = langid.sample(docs, crc_bucket(F.col("doc_id"), 5) != 0, FIT_TEXTS)
    model = langid.fit([t for t, _ in rows], [lang for _, lang in rows])
    found = langid.identify(docs, F.col("text"), F.col("doc_id"), model=model)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents"))


def _is(k: int) -> Callable:
    return lambda x: x == k


def op5_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(pii.BASE)]
    digest = F.sha2(pii.rendered(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.rendered(F.concat("base", "added")).alias("spans"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id"), model_path=PIECES, keep=())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, F.col("text"), F.col("doc_id"), vocabulary_path=VOCABULARY)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on trusted positives and on a sample of all training documents, whether labelled or not."""
    train = crc_bucket(F.col("doc_id"), 4) != 2
    positive = [t for t, y in labelled_sample(docs, labels.filter(F.col("quality") == 1), "quality", train, FIT_ROWS) if y == 1]
    return quality.fit(positive, sample(docs, train, UNLABELLED_ROWS))


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, F.col("text"), F.col("doc_id"), model=model)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vector = F.when(whitening.usable(F.col("embedding")), whitening.fixed(F.col("embedding"), 256, 0))
    # labels of every seventh row are wrong on purpose
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows, vector, F.col("vec_id") % 50 == 0, label)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"ranks": rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN}
    found = bytebpe.encode(table(spark, sf_dir, "documents"), F.col("text"), F.col("doc_id"), **known)
    found = bytebpe.decode(found, F.col("tokens"), F.col("doc_id"), F.col("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), **known)
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_telephony_audio, op2_toxicity_grammar, op3_language_spans, op4_sentence_spans, op5_pii_weak_supervision, op6_ngram_jaccard, op7_winnowing, op8_sentencepiece, op9_secret_scan, op10_quality_pu, op11_hard_negatives, op12_byte_bpe, op13_whitening)
}
ORACLES: dict[str, str] = {"op7_winnowing": decontam.ORACLE, "op11_hard_negatives": hardneg.ORACLE}
