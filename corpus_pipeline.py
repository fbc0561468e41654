"""From raw documents to training sequences: five stages, each one operator of ``tracelark.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet
before the next begins, so a lost executor never costs more than its own tasks' work. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.llm.bloom import blocks_for, with_hits
from tracelark.llm.decontaminate import find_leaks
from tracelark.llm.line_dedup import dedup_lines
from tracelark.llm.ngram_join import link_documents
from tracelark.llm.packing import pack_documents
from tracelark.llm.quality import score_quality
from tracelark.llm.storage import counted, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _parted(docs: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` without, and with, the doc_id and text of a row of ``named`` (doc_id, print: xxhash64 of the text).

    Ids may be null or shared by different texts: only rows with both the same are meant. Only rows that a Bloom filter
    of bounded size lets through are shuffled into the exact join.
    """
    named, count = counted(named.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct(), "named")
    blocks = blocks_for(count)
    tested = docs.select(*COLUMNS).withColumn("_seen", F.xxhash64("text"))
    keys = named.select(F.xxhash64("_id", "_print").alias("key"))
    tested = with_hits(tested, keys, blocks, F.xxhash64(F.col("doc_id").cast("long"), "_seen"), "_hit")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_seen") == F.col("_print"))
    hits = tested.where("_hit")
    without = tested.where("not _hit").select(*COLUMNS).unionByName(hits.join(named, same, "left_anti").select(*COLUMNS))
    return without, hits.join(named, same, "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 2), learnt from ``labels``.

    Rows are judged by their texts: null and empty ones like any other, repeated ones alike, rows of one id each by its
    own text. An empty table stays empty; without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _parted(docs, score_quality(docs, labels).where("predicted = 0"))[0]


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines (operator 5); one of which nothing but blank lines is left was a copy and goes.

    Null and empty texts stay. Of equal runs the one of the smallest doc_id stays, nulls first; repeated rows of one id
    and text count as one place, lose the same lines and are left to the next stage. An empty table stays empty.
    """
    out = dedup_lines(docs.select(*COLUMNS))
    return out.where(~((F.col("n_removed") > 0) & F.col("text").rlike(r"^\s*$"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that the n-gram Jaccard join connects (operator 1): the one of the smallest id, nulls last.

    Of rows of one id and different texts, and of rows without an id, one stays too, by the text's hash; of repeated rows
    any one. Null and empty texts link with nothing and stay. An empty table stays empty.
    """
    linked = written(link_documents(docs), "linked")
    kept, _ = _parted(docs, linked.where("not is_first"))
    twice = linked.where("is_first and component_size > 1").groupBy("doc_id", "print").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return kept
    once, repeated = _parted(kept, twice)
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark`` (operator 3).

    Null and empty texts hold nothing and stay, repeated rows go alike, rows of one id each by its own text; with an
    empty table on either side nothing goes.
    """
    return _parted(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))[0]


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences (operator 7).

    A null or empty text is a piece of its closing id alone; repeated rows are packed once each; an empty table gives
    no pieces.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Trained rules, sketches and tokens: none of the stages has an equal in SQL. Tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
