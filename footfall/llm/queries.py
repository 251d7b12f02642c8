"""The numbered queries: thin wrappers that put an operator's output into its agreed columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import bpe, decontam, html_extract, lm, merkle, oracle, pii, prefix_trie, quality_mil, quality_rules, secrets, simhash, token_output, toxicity
from footfall.llm.common import fold, shared_folder, stored


#: Only for the registered queries; a run on real data passes its own secret.
PSEUDONYM_KEY = b"footfall demonstration key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model, cuts = toxicity.learn(docs, labels, fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model, ["doc_id", "lang"])
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        toxicity.flag(scored, cuts).alias("flagged"),
    )


def op2_lm(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    made = lm.score(docs, ~held_out, vocabulary or vocabulary_path("word_bpe_49k.json"))
    return made.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"] < len(secrets.BASE))
    counts = [F.size(secrets.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(spans).alias("spans"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.keeps("base-1")).alias("base_failed"),
        (quality_rules.keeps("base-1") & quality_rules.keeps("web-1")).alias("kept"),
        "failed",
    )


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_mil.learn(docs, labels, fold(F.col("doc_id"), 4) != 2)
    scored = quality_mil.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary or vocabulary_path("word_bpe_49k.json"), ["doc_id"])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str, key: bytes = PSEUDONYM_KEY) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(prefix_trie.turns_of(table(spark, sf_dir, "conversations")))
    nodes = prefix_trie.prefix_nodes(*prefix_trie.spliced(turns))
    names = {"seq": "conv_id", "parent": "parent_conv_id", "n_seqs": "n_convs", "saved_bytes": "saved_tokens"}
    return nodes.withColumnsRenamed(names)


def op12_token_output(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    place = f"{shared_folder(spark)}/footfall-tokens-{uuid.uuid4().hex}"
    token_output.write(table(spark, sf_dir, "documents"), place, vocabulary or vocabulary_path("byte_bpe_50k.json"))
    found = token_output.read(spark, place, ids=False)
    return found.withColumnRenamed("key", "doc_id")


LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = {c: F.col(c) for c in LEAF_COLUMNS}
    lowered = merkle.leaf(*(values | {"text": F.translate("text", UPPER, LOWER)}).values())
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = docs.select("doc_id", "lang", merkle.leaf(*values.values()).alias("leaf"), F.when(tampered, lowered).alias("changed"))
    made = merkle.manifest(stored(leaves), "doc_id", "lang")
    root = F.lit(made.root.hex() if made.root else None).cast("string")
    path = F.col("path")
    found = made.proofs().select(
        "doc_id",
        merkle.spelled(F.col("leaf")).alias("leaf"),
        merkle.spelled(F.col("subroot")).alias("subroot"),
        root.alias("root"),
        merkle.proof(path).alias("proof_sha256"),
        merkle.spelled(merkle.folded(F.coalesce("changed", "leaf"), path)).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lm": op2_lm,
    "op3_html": op3_html,
    "op4_secrets": op4_secrets,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_mil": op7_quality_mil,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_output": op12_token_output,
    "op13_merkle": op13_merkle,
}

ORACLES = oracle.ORACLES
