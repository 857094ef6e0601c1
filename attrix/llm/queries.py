"""Queries of the text operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrix.llm import (exact_dedup, line_spread, mixing, ngram_join, packing, periodic_runs, quality_rules, sharding,
                        substring_dedup, suffix_tree, token_alignment, toxicity, url_reputation)
from attrix.llm.common import load, words

Query = Callable[[SparkSession, str], DataFrame]

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


# The rules of the query's contract.
URL_RULES = (
    url_reputation.UrlRule("allow", "com", "/"),
    url_reputation.UrlRule("block", "example.com", "/en/"),
    url_reputation.UrlRule("allow", "www.example.com", "/en/"),
    url_reputation.UrlRule("block", "net", "/es/"),
    url_reputation.UrlRule("block", "net", "/fr/"),
)


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return url_reputation.judge_urls(pages, url_reputation.page_outcomes(pages), URL_RULES)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(load(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = substring_dedup.drop_repeats(load(spark, sf_dir, "documents"))
    return trimmed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_spread.drop_spread_lines(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = mixing.mix_decisions(load(spark, sf_dir, "documents"))
    return decisions.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                            "source", "copies")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"), 24)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(load(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", F.array_join("failed", ",").alias("failed"))


def toxicity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table as the chain's two categories, in order."""
    return load(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge_toxicity(load(spark, sf_dir, "documents"), toxicity_labels(spark, sf_dir))


def id_hash() -> Column:
    """CRC-32 of the decimal doc_id, unsigned (null id: null)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def op11_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(load(spark, sf_dir, "documents"), id_hash() % 10 == 0)


def looped_documents(docs: DataFrame) -> DataFrame:
    """doc_id and text; where the contract asks for it, the words from ``a`` on repeat those of the first ``p``."""
    w, n, g = words(F.col("text")), F.size("w"), F.floor(F.col("h") / 10)
    a, p = (F.col("g") % n), F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    looped = docs.select("doc_id", "text", id_hash().alias("h")).filter("h % 10 = 0")
    looped = looped.select("doc_id", "text", w.alias("w"), g.alias("g"))
    looped = looped.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    place = lambda i: (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    word = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", place(i))))
    looped = looped.select("doc_id", F.when(n > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", "text").filter(F.coalesce(id_hash() % 10 != 0, F.lit(True))).unionByName(looped)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped_documents(load(spark, sf_dir, "documents")))
    runs = F.col("runs")
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"),
                                                               r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    return (found.withColumn("best", longest)
            .select("doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
                    F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(written, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256")))


def alignment_tokenizers() -> token_alignment.Tokenizers:
    import public_tokenizers

    return token_alignment.Tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"),
                                      tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(load(spark, sf_dir, "documents"), alignment_tokenizers())


QUERIES: dict[str, Query] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_spread": op4_line_spread,
    "op5_mixture": op5_mixture,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_suffix_tree": op11_suffix_tree,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op4_line_spread": f"""
        WITH l AS (SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        w AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS has_word FROM l),
        s AS (SELECT line, min(doc_id) AS first_id FROM w WHERE has_word
              GROUP BY line HAVING count(DISTINCT site) >= {line_spread.MIN_SITES}),
        k AS (SELECT w.*, s.line IS NOT NULL AND w.doc_id IS DISTINCT FROM s.first_id AS cut
              FROM w LEFT JOIN s ON w.has_word AND w.line = s.line)
        SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (cut) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '')) AS kept_sha256
        FROM k GROUP BY doc_id""",
}
