"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counting, hmm, html, media, minhash, mixing, packing, quality, repeats, rules, shards, tokens, trie
from .common import crc_mod, cut, n_words, shared_dir, table

ARRIVALS = 4


def op1_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as JPEG and read back."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op2_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with risk-controlled cutoffs for each language."""
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov log10 probabilities of all documents."""
    return hmm.hmm_scores(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 4-word shingles, similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents in order of ids, as read back from the files."""
    import public_tokenizers

    folder = shared_dir(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = tokens.write_tokens(table(spark, sf_dir, "documents"), folder, path, 0)
    return tokens.read_digests(spark, folder, manifest)


def op7_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 words: no two documents of one source, and no two copies of one text, share one."""
    docs = table(spark, sf_dir, "documents")
    copies = F.xxhash64(F.lower("text"))
    items = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), copies.alias("cluster"))
    return packing.best_fit(items, "doc_id", "size", "source", "cluster")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.main_texts(table(spark, sf_dir, "pages"))


def op9_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four lots as small shards, are compacted, and are read from the last version."""
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    shards.append(docs, root, crc_mod(F.col("doc_id"), ARRIVALS))
    version = shards.compact(spark, root)
    shards.expire(spark, root)
    return shards.live(spark, root, docs.schema, version).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5")
    )


def op10_pair_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods in all texts, one in ten of them with a planted loop."""
    docs = table(spark, sf_dir, "documents")
    return repeats.periodic_runs(docs, repeats.looped(F.col("doc_id"), F.col("text")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and whether they are more than 512."""
    import public_tokenizers

    counts = counting.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt with the first turns of its group's first one."""
    turns = cut(trie.keyed_turns(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(*trie.rebuilt(turns))


QUERIES = {
    "op1_jpeg_media": op1_jpeg_media,
    "op2_risk_rules": op2_risk_rules,
    "op3_hmm_scores": op3_hmm_scores,
    "op4_source_mix": op4_source_mix,
    "op5_minmax_dedup": op5_minmax_dedup,
    "op6_token_files": op6_token_files,
    "op7_conflict_packing": op7_conflict_packing,
    "op8_main_text": op8_main_text,
    "op9_tiered_shards": op9_tiered_shards,
    "op10_pair_ranker": op10_pair_ranker,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op4_source_mix": mixing.MIX_SQL,
    "op9_tiered_shards": "select doc_id, octet_length(encode(text))::bigint as n_bytes, md5(text) as text_md5 from documents",
    "op11_periodic_runs": repeats.RUNS_SQL,
    "op13_prefix_trie": trie.TRIE_SQL,
}
