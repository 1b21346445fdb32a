"""The queries of this subpackage by name, and their DuckDB form where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    from .common import scratch

    path = scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import digests

    return digests(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import digests

    return digests(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import classes

    return classes(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digests

    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_files
    from .common import scratch

    path = scratch(spark, "ids")
    token_files.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stash
    from .simhash import against_next, near_counts

    # searched for are the documents whose id is divisible by 20, against all
    prints = stash(against_next(_table(spark, sf_dir, "documents")), "prints")
    return near_counts(prints, F.col("doc_id") % 20 == 0)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained

    return contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_chats
    from .common import stash

    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_chats(stash(format_chats(turns.unionByName(own)), "chats"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, lines, ngram_join, substrings, warc

    return {"op1_warc": warc.SQL, "op2_line_dedup": lines.SQL, "op3_substring_dedup": substrings.SQL, "op4_ngram_jaccard_join": ngram_join.SQL, "op8_benchmark_decontamination": decontaminate.SQL}
