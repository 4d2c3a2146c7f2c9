"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sugarmill.llm import chat, embedding_join, html_text, lm_scoring, ngram_join, oracle, packing, paragraphs, phrases, pieces, quality, sharding, toxicity, whitening
from sugarmill.llm.common import table, written


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files of this machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


CONTROL_TURNS = "select -1L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted; digests of what is read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_TURNS))
    chats = chat.format_chats(rows, chat.text_part(F.col("text")))
    back = chats.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "attachment_tokens",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and perplexity verdict of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = quality.fit(docs)
    scored = written(quality.score(docs, model).drop("text"))
    m = F.col("quality")
    edges = quality.bands(scored, model, F.col("lang"), m)
    return scored.select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines", "quality.n_repeat_words",
        quality.base_failed(m).alias("base_failed"), quality.verdict(m, *edges).alias("kept"), quality.sign_failed(m).alias("sign_failed"),
        F.exp("quality.log_ppl").alias("perplexity"), F.exp("quality.log_low").alias("low_perplexity"),
        *(F.exp(x).alias(n) for n, x in zip(("lower_perplexity", "upper_perplexity", "upper_low_perplexity"), edges, strict=True)),
    )


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings with a cosine of 0.9 or more."""
    return embedding_join.join(table(spark, sf_dir, "embeddings"), least=0.9)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose 4-word shingles have a Jaccard of 0.85 or more."""
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of all documents, and whether they decode to the texts."""
    model = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.encode(table(spark, sf_dir, "documents"), model)
    back = pieces.decode(F.col("ids"), model)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), (back == F.coalesce("text", F.lit(""))).alias("lossless"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of all documents that has a near copy, with the one that stays in its place, and every passage that
    goes beside them, by its first word and length."""
    docs = table(spark, sf_dir, "documents")
    found = written(paragraphs.clusters(docs))
    rows = found.select("doc_id", F.col("line").alias("paragraph"), "n_shingles", F.col("cluster_doc").alias("kept_doc_id"), F.col("cluster_line").alias("kept_paragraph"), "removed", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_words"))
    spans = paragraphs.passages(docs, paragraphs.gone_lines(found))
    none = lambda name: F.lit(None).cast("long").alias(name)
    return rows.unionByName(spans.select("doc_id", none("paragraph"), none("n_shingles"), F.col("kept_doc").alias("kept_doc_id"), none("kept_paragraph"), F.lit(True).alias("removed"), "start", "n_words"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; labels of a quarter of the ids are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "toxicity.score", F.when(F.col("toxicity.score") >= 0.3, 1).otherwise(0).alias("predicted"),
        F.size("toxicity.hits").cast("long").alias("n_hits"), F.col("toxicity.quoted").alias("n_quoted"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents under a model of those not held out."""
    return lm_scoring.score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the 16 leading components of the distinct ones, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=16).withColumn("deviation", F.col("deviation").cast("long"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row counts along a Hilbert curve over language, source and length."""
    placed = sharding.place(table(spark, sf_dir, "documents"), ("lang", "source", "n_chars"), 24, "rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return phrases.mine(table(spark, sf_dir, "documents"), support=10, share=50, best=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_quality_rules": op2_quality_rules,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_toxicity": op4_toxicity,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_packing": op8_packing,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_sharding": op12_sharding,
        "op13_phrase_collocations": op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name, where SQL can express it."""
    return dict(oracle.ORACLE)
