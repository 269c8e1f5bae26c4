"""From raw documents to packed sequences: each stage is one operator, its result written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critmill.llm import mixing, neardup, packing, quality, suffix
from critmill.llm.common import BROADCAST_ROWS, save
from critmill.llm.queries import TOKENIZER, read

#: The score is a calibrated probability of good: this cut, op8's own, has the least expected cost where a bad document
#: that stays costs 7/3 of a good one that goes.
REJECT_BELOW = 0.7
#: Bytes of a string that counts as a repeated passage: fifty words of three bytes and their blanks are longer.
PASSAGE_BYTES = 150


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id, source and text; the other columns in one of another name, so that none clashes with those that an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "source", "text", F.struct(*rest).alias("__rest"))


def _whole(t: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return t.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier, fitted on labels outside the held-out fold, rejects.

    Null and empty texts have the score of the model's intercept, equal texts one score; repeated rows stay or go together; an empty table
    stays empty. Columns of any name pass through.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return _whole(quality.score(_bare(docs), model, REJECT_BELOW).filter("predicted = 1"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates (five-word shingles, 80 %).

    Texts without words stay, as do rows without a doc_id; repeated rows of one doc_id stay or go together; an empty table stays empty.
    """
    gone = save(neardup.near_duplicates(docs, size=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return docs.join(side, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document of a smaller doc_id holds; a character that loses a byte goes whole. Every document stays, its text perhaps empty.

    Null and empty texts stay as they are; a null doc_id counts as the largest; rows of one doc_id don't cut each other; n_chars follows the text.
    """
    t = suffix.remove_repeats(_bare(docs), PASSAGE_BYTES, characters=True)
    cut = F.col("n_removed") > 0
    t = t.withColumn("text", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.when(cut, F.length("text").cast("long")).otherwise(F.col("__rest")["n_chars"])
        t = t.withColumn("__rest", F.col("__rest").withField("n_chars", n))
    return _whole(t, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target asks: a row for each copy.

    A null source is one of its own; texts without words count as documents of size 0; repeated rows are documents of their own; an empty
    table stays empty.
    """
    return _whole(mixing.emit(mixing.mix(_bare(docs))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of at most 2048 tokens.

    Null and empty texts are one piece of the end id; repeated rows (the mixture's copies) have pieces of their own; an empty table gives none.
    """
    return packing.pack(packing.pieces(docs, TOKENIZER, end_id=0))


STAGES = [
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprint, compression and packing steps have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
