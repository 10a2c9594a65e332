"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Further columns of ``docs``, whatever their names, are left
out; an empty table gives an empty one; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shiftglass.llm import langid, linedup, mixing, packing, probminhash
from shiftglass.llm.common import Scratch, table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.5
#: Words whose ids a packing task remembers: its workers share their memory with what the stages before left in them.
WORDS_AT_ONCE = 400_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; undetermined and doubtful ones go.

    Null and empty texts, and texts without a letter, go. Null languages teach nothing; if
    there is none to learn from, no language can be told and every document goes. Null ids
    count as remainder 0 of the split. Texts of any length are scored whole.
    """
    model = langid.train(docs.where(langid.remainder("doc_id", 4) != 2))
    scored = langid.predict(docs, model, keep=COLUMNS)
    return scored.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; documents of which no word is left go.

    The first copy, by doc_id and line, stays (``linedup.dedup``; equal rows lose the same
    lines). Null and empty texts have nothing to remove and stay as they are, with their
    n_chars; texts that were cut get theirs anew.
    """
    cut = linedup.dedup(docs.select(*COLUMNS))
    touched = F.col("n_removed") > 0
    left = cut.where(~touched | (mixing.word_count("text") > 0))
    return left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class.

    The one with the smallest id stays, a null id only where a class has no other; of
    repeated rows one. Texts without a word (null, empty, blank) are near to nothing and
    all stay.
    """
    return probminhash.dedup(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null is a source of its own, last in order. Documents without a word (null, empty) have
    size 0: they weigh nothing and are never taken. Equal sizes are dealt by id and row.
    """
    mixed = mixing.mix(docs.select(*COLUMNS).withColumn("size", mixing.word_count("text")))
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies")))).where("copy > 0").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the training sequences.

    Null and empty texts are their end id alone; texts over 4096 ids are cut into pieces.
    Pieces of one length are interchangeable: ties are ordered by the row's hash.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), most_words=WORDS_AT_ONCE))


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classification, sampling and packing can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
