"""The training-data pipeline: documents to token ids in five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import bpe, langid, mixing, repeats, simhash
from meridian.llm.common import delete, scratch, table, written
from meridian.llm.queries import tokenizer_path

#: A document whose language has a lower score is rejected, as is one without a letter.
LEAST_SCORE = 0.2
#: Bytes of a repeated string: under what 50 words take, so that a passage of over 50 words is found.
REPEAT_BYTES = 200


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and, in one struct, all others: their names then clash with none that an operator makes."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in needed] or [F.lit(None).alias("none")]).alias("rest"))


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col(f"`{c}`") if c in packed.columns else F.col(f"rest.`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang itself stays as it came. Where no document has a language to learn from, all with a letter stay."""
    model = langid.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows = _packed(docs, "text").withColumn("body", F.col("text"))
    found = langid.identify(rows, model, text="body", pred="pred", score="score")
    return _unpacked(found.filter((F.col("pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.first_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat anywhere in them; n_chars follows the text."""
    kept = _unpacked(repeats.cut(_packed(docs, "text"), length=REPEAT_BYTES).withColumnRenamed("kept", "text"), docs.columns)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that it takes twice is there twice, one that it does not take is not."""
    mixed = mixing.mix(_packed(docs, "doc_id", "source", "text"), keep=("source", "text", "rest"))
    twice = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "source", "text", "rest")
    return _unpacked(twice, docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of what they decode to."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(rows, bpe.Codec.load(tokenizer_path()), outputs=("ids", "ids_sha256", "decoded_sha256")).drop("text")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mix_sources),
    ("bpe", bpe_encode),
]

#: SQL cannot say what the stages do; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents. What a stage wrote for itself goes when its result is written, and a result when the next one is; the last one's input stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs, path = written(stage(spark, docs, sf_dir), name)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
