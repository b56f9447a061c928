"""A training corpus from `documents`: language ID, line dedup, near-dedup, mixing, tokens.

Every stage takes what the one before kept, which run() writes as Parquet to the shared folder and
reads again.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, langid, linededup, mixing, simhash
from tessella.llm.common import cut
from tessella.llm.queries import table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text evidence, or whose language stays in doubt, go."""
    model = langid.train(docs)
    found = langid.identify(docs, model, host="source")
    return found.filter("lang_accepted").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came earlier, up to one edit, go from the texts; n_chars is counted anew."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash links one document stays, that with the smallest id; rows without an id come last."""
    return simhash.simhash_kept(docs)


def weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of each text, and whether decoding gives the text back."""
    both = bpe.bpe_checked(docs, tokenizer_path(), carry=["doc_id", "lang", "source"])
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_copies),
    ("mix_sources", weights),
    ("bpe_tokens", tokens),
]

#: SimHash components, hashed choices and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
