"""The corpus pipeline: stages applied one after another to ``documents``.

Each stage takes all rows its predecessor kept and, but for the last, returns
the columns of ``documents``: quality rules drop what they reject, near-duplicate
search leaves one document of each group, personal data is replaced in the texts,
sources are drawn to their target weights, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import bpe, mixing, near, pii, quality
from tributary.llm.common import discard, quoted, settled, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and their hosts' verdicts keep.

    Null and empty texts go; a null source is a host of its own. Repeated rows are
    judged alike, ids aren't used, an empty table gives an empty one.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates.

    Rows without text stay. Rows that share an id, or have none, are told apart by
    their texts: of those that repeat in id and text one stays, different texts of one
    id all do unless they are near duplicates. An empty table gives an empty one.
    """
    small_batches(spark)
    return near.keep(docs, one_an_id=False)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced by their kind; ``n_chars`` follows the text.

    Null texts stay null (and ``n_chars`` is null then), empty ones empty; all rows
    stay, repeated ones too; an empty table gives an empty one.
    """
    small_batches(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn to weights of the square root of their sources' sizes, shard by shard in shuffled order.

    Null ids and texts count as values, a null source as the source ''. Of repeated
    rows as many are drawn as their places in the order say; an empty table gives an
    empty one.
    """
    out = mixing.mix(docs)
    # The order is what is decided, so it is what is written: sorted before its columns go.
    out = out.sortWithinPartitions(*out.columns[-2:])
    return out.select(*(quoted(c) for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, with the round trip checked.

    A null text gives null tokens, an empty one none; null ids stay null, repeated rows
    are encoded again, an empty table gives an empty one.
    """
    small_batches(spark)
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("PII", private_data),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", encoded),
]
#: MinHash groups, the hypergeometric deal and BPE merges are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder as Parquet and read again.

    What a stage wrote on its way is deleted when its result is there, and that when
    the next stage's is. Nulls, empty and repeated rows and empty tables as the stages
    say.
    """
    small_batches(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.split()[0].lower())
        if last is not None:
            discard(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
