"""The registered queries of these operators, over the tables of a folder."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm import bpe, collocations, cotrain, decontam, infill, minhash, oracle, packed, rules, secrets, tokencount, tokengroups, toxicity, urls
from spanwright.session import read_table, shared_folder

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
OTHER_BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def op1_cotrain(spark: SparkSession, folder: str) -> DataFrame:
    return cotrain.quality(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op3_rules(spark: SparkSession, folder: str) -> DataFrame:
    measured = rules.ledger(read_table(spark, folder, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return measured.select(
        "doc_id", *[F.col("ledger")[n].alias(n) for n in names], (~rules.passes("base-1")).alias("base_failed"),
        rules.passes("full-2").alias("kept"), F.col("ledger.failed").alias("failed_bits"))


def rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    return rules.ablations(rules.ledger(read_table(spark, folder, "documents")))


def op4_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, folder, "documents"), width=2)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    machine = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    packed.write(read_table(spark, folder, "documents"), path, public_tokenizers.path(WORD_BPE), END_ID)
    return packed.read(spark, path)


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    weights = urls.train(spark.createDataFrame(urls.LABELLED, "url string, label int"))
    return urls.judge(read_table(spark, folder, "pages").select("page_id", "url"), weights).select("page_id", "host", "path", "rule", "verdict")


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokencount.count_tokens(read_table(spark, folder, "documents"), public_tokenizers.path(OTHER_BYTE_BPE), public_tokenizers.PATTERN)
    return counted.select("doc_id", "section", "n_sections", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.secrets(docs).select("doc_id", "secrets.*")

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    form, output = F.col("infill.form"), F.col("infill.output")
    prefix, middle = infill.part_lengths(form, output)
    return infill.infilled(read_table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("infill.n").alias("n"), form.alias("form"), prefix.alias("prefix_chars"), middle.alias("middle_chars"),
        F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored(form, output).cast("binary"), 256).alias("restored_sha256"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


def op13_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return tokengroups.jaccard_components(read_table(spark, folder, "documents"))


REGISTERED = {
    "op1_cotrain": (op1_cotrain, None),
    "op2_bpe": (op2_bpe, None),
    "op3_rules": (op3_rules, oracle.OP3),
    "rule_ablations": (rule_ablations, oracle.OP3_ABLATIONS),
    "op4_minhash": (op4_minhash, oracle.OP4),
    "op5_toxicity": (op5_toxicity, None),
    "op6_packed_ids": (op6_packed_ids, None),
    "op7_urls": (op7_urls, oracle.OP7),
    "op9_token_counts": (op9_token_counts, None),
    "op8_decontaminate": (op8_decontaminate, None),
    "op10_secrets": (op10_secrets, None),
    "op11_infill": (op11_infill, oracle.OP11),
    "op12_collocations": (op12_collocations, oracle.OP12),
    "op13_jaccard": (op13_jaccard, oracle.OP13),
}
