"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers as tokenizer_files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.llm.byte_bpe import byte_bpe_decode, byte_bpe_encode
from urbanframe.llm.conversations import audit_conversations, damaged
from urbanframe.llm.langid import identify_language, train_language_model
from urbanframe.llm.lexical import ranked_search
from urbanframe.llm.lm_scoring import score_by_words
from urbanframe.llm.near_duplicates import near_duplicate_classes
from urbanframe.llm.neighbours import nearest_neighbours
from urbanframe.llm.packing import pack_sequences
from urbanframe.llm.quality import quality_verdicts
from urbanframe.llm.substrings import remove_repeated_passages
from urbanframe.llm.token_counts import count_tokens
from urbanframe.llm.toxicity import toxicity_scores
from urbanframe.llm.wavelet import token_shards
from urbanframe.session import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both."""
    small_batches(spark)  # two workers a task, and the rows pass through the JVM between them
    ranks = tokenizer_files.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe_encode(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, tokenizer_files.PATTERN)
    decoded = byte_bpe_decode(encoded, "doc_id", "ids", ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every word in a 35-word window that occurs more than once."""
    cut = remove_repeated_passages(table(spark, sf_dir, "documents"), "doc_id", "text", window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def held_out() -> Column:
    """Rows that language training may not see."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    net = train_language_model(docs, "doc_id", "text", "lang", ~held_out())
    found = identify_language(docs, "doc_id", "text", net)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict for every document."""
    return quality_verdicts(table(spark, sf_dir, "documents"), "doc_id", "text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram pieces of every document."""
    path = tokenizer_files.path("piece_bpe_32k.model")
    return count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as possible."""
    path = tokenizer_files.path("byte_bpe_50k.json")
    return pack_sequences(table(spark, sf_dir, "documents"), "doc_id", "text", path, end_id=0, capacity=2048)


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids through wavelet-matrix shard files."""
    path = tokenizer_files.path("word_bpe_49k.json")
    return token_shards(table(spark, sf_dir, "documents"), "doc_id", "text", path, end_id=2)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the documents labelled as good (target) and all others."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # one join strategy at every size: texts are dealt once, and a hot key is split
    labelled = docs.join(good.hint("merge"), "doc_id", "left")
    return score_by_words(labelled, "doc_id", "text", F.col("quality") == 1)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest by inner product for every 20th vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples; ``evidence``: their ids, nearest first."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = toxicity_scores(docs, "doc_id", "text", labels, "doc_id", "toxic", ~held)
    return found.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        F.col("evidence.example").alias("evidence"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_search(docs, "doc_id", "text", items, "item_id", "text", k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage by checksum."""
    names = ("conv_id", "turn", "role", "text")
    rows = damaged(table(spark, sf_dir, "conversations"), *names)
    return audit_conversations(rows, *names, present=F.col("present"))


def queries() -> dict:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_substrings": op2_substrings,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_langid": op4_langid,
        "op5_quality": op5_quality,
        "op6_token_counts": op6_token_counts,
        "op7_packing": op7_packing,
        "op8_wavelet": op8_wavelet,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_neighbours": op10_neighbours,
        "op11_toxicity": op11_toxicity,
        "op12_lexical_search": op12_lexical_search,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    from urbanframe.llm.oracles import ORACLES

    return dict(ORACLES)
