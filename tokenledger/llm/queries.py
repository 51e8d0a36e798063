"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm import darts, dialogue, labelled, lm, maxscore, mixing, multi_index, nbsvm, packing, rans, relative_lz, rules, toxicity, urls
from tokenledger.llm.tables import load, stage
from tokenledger.session import new_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    sized = stage(docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size")), "mix-sizes")
    return mixing.rates(sized, sizes=sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are the documents labelled as of good quality, the background all documents."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    scored = lm.losses(docs, labels.filter("quality = 1"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = nbsvm.train(docs, labels, where=labelled.id_crc32(F.col("sample_id")) % 3 != 1)
    held = F.coalesce(labelled.id_crc32(F.col("doc_id")) % 3 == 1, F.lit(False))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return nbsvm.score(docs, model).select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    net = toxicity.train(docs, labels, where=labelled.id_crc32(F.col("sample_id")) % 5 != 0)
    held = F.coalesce(labelled.id_crc32(F.col("doc_id")) % 5 == 0, F.lit(False))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return toxicity.score(docs, net).select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


def op5_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "rans")
    rans.store(load(spark, sf_dir, "documents"), path, TOKENIZER)
    return rans.digest(spark, path)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = relative_lz.cleaned(docs, "doc_id", "text")
    spaced = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    kept = F.coalesce("kept_text", spaced)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(load(spark, sf_dir, "documents"), TOKENIZER))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = rules.train(docs, load(spark, sf_dir, "labels"))
    judged = rules.judge(docs, model, rules.KEEP, "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op9_darts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return darts.classes(load(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations")
    return dialogue.report(conversations, dialogue.damaged(conversations))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of every seventh id is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


#: The rules of the URL query, as host, start of the path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules are the list; a URL that it does not hold is allowed."""
    return urls.judge(load(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, urls.LIST), keep=["page_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_lm": op2_lm,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_rans": op5_rans,
    "op6_substrings": op6_substrings,
    "op7_pack": op7_pack,
    "op8_rules": op8_rules,
    "op9_darts": op9_darts,
    "op10_maxscore": op10_maxscore,
    "op11_dialogue": op11_dialogue,
    "op12_negatives": op12_negatives,
    "op13_urls": op13_urls,
}
