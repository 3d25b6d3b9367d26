"""A pipeline over the documents table: quality, repeated lines, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of documents: (doc_id, text, lang, source, n_chars); further columns of docs, whatever their names, are left out. Whole
texts are read at any length, and an empty table gives an empty one of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftarc.llm import jaccard, lines, mixing, packing, quality
from weftarc.llm.common import few, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posteriors of low quality and of toxic words are at most one half.

    Rows with null ids and repeated rows stay or go by their own texts; a null or empty text has the one feature of being
    empty; a null source or language is a site of its own; without labels, nothing goes.
    """
    return quality.kept(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier, equal ones of any length; those of which nothing is left go, if they had anything.

    Of equal lines, that of the smallest id and line number stays. Repeated rows of an id have lines of equal standing, so
    both keep theirs. Null ids neither remove lines nor lose any; null and empty texts stay as they are.
    """
    left = lines.remove_lines(docs.select(*COLUMNS), exact=1)
    return _with_size(left.filter((F.size("removed") == 0) | (F.trim("text") != "")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the document with the smallest id.

    Rows that repeat this id all stay, rows of other ids of the group all go. Null ids, and texts without words, are copies
    of nothing and stay.
    """
    found = jaccard.join(docs, 5, 80, 100)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(few(stored(gone, "copies")), "doc_id", "left_anti").select(*COLUMNS)


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to token weights by language, the natural shares to the power of 0.7; none is left out.

    Repeated rows of an id are repeated alike, as often as the most that one of them would be. Null ids and texts without
    tokens come once; rows without a language are counted by what their texts tell; without labels, all come once.
    """
    rates, _ = mixing.mix(docs, mixing.by_language(docs, _table(spark, sf_dir, "labels")), 0.7, floor=1.0, grow=True)
    more = stored(rates.filter("copies > 1").groupBy("doc_id").agg(F.max("copies").alias("copies")), "copies")
    joined = docs.join(few(more), "doc_id", "left")
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)).cast("int"))).alias("copy")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens.

    A null or empty text is its closing id alone; repeated rows are packed as often as they come; null ids are kept.
    """
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", judge_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_copies),
    ("mixing sources to target weights", mix_languages),
    ("packing", pack_windows),
]

#: Classifiers, an iteration and a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
