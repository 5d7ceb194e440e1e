"""One query for each operator over its whole table, with production parameters, and the SQL that checks it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockhealth.llm import chat, crosspolytope, decontaminate, langid, licenses, mixing, prefixes, pstable, secrets, sentencepiece_bpe, simhash, suffixes, whitening
from stockhealth.llm.common import read_table

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    """A file of the public tokenizers; other models are given by their path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def chat_events(conversations: DataFrame) -> DataFrame:
    """The table as a log: answers stream in two deltas after a discarded draft, other turns are edited once.

    Rows that share conversation and turn are messages of their own, in the order role, text.
    """
    twice = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("copy", F.row_number().over(twice))
    half = F.floor(F.length("text") / 2).cast("int")
    head, tail = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda seq, kind, text: F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("said"))
    streamed = F.array(event(0, "delta", F.concat(head, F.lit("…"))), event(1, "regenerate", F.lit(None).cast("string")), event(2, "delta", head), event(3, "delta", tail))
    edited = F.array(event(0, "delta", head), event(1, "edit", F.col("text")))
    log = rows.withColumn("e", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)))
    return log.select("conv_id", "turn", "copy", "role", "e.seq", "e.kind", F.col("e.said").alias("text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    probe = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe.alias("text"))
    whole = table.unionByName(extra.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns]))
    turns = chat.format_log(chat_events(whole), ("conv_id", "turn", "copy"))
    return chat.read_back(turns, ("turn", "copy"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), model_path())


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), digest=True)
    return found.withColumnRenamed("redacted", "redacted_sha256")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.withColumn("held_out", held_out), model, keep=("doc_id", "held_out"))


def op7_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return crosspolytope.search(vectors, F.col("vec_id") % 20 == 0)


def op8_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"]))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents", ["doc_id", "text"]), read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return decontaminate.report(docs, items)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash, op2_suffixes, op3_chat, op4_sentencepiece, op5_secrets, op6_langid, op7_crosspolytope, op8_pstable, op9_mixing, op10_licenses, op11_whitening, op12_trie, op13_decontaminate)
}
