"""Documents to packed sequences: quality, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept,
and returns a DataFrame that is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameloom.llm.common import table, written
from nameloom.llm.line_dedup import line_dedup
from nameloom.llm.minhash import near_duplicates
from nameloom.llm.packing import best_fit_pack
from nameloom.llm.quality import quality_scores
from nameloom.llm.queries import packing_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject, each by its own text; null ids,
    repeated ids and null texts are scored as any other.  Columns other than those
    of documents are left out, here and in the next stages, whatever their names.
    Labels that are null or no 0 or 1 teach nothing; without any, all rows stay."""
    scored = quality_scores(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines; documents of which nothing is left go, those
    that were blank before stay.  n_chars is counted again where a line went."""
    cleaned = line_dedup(docs.select(*COLUMNS))
    blank = F.coalesce(F.col("text").rlike(r"^\s*$"), F.lit(True))
    text = cleaned.where(~(blank & (F.col("n_removed") > 0)))
    n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return text.select("doc_id", "text", "lang", "source", n.cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest
    id; of a group's rows that repeat that id, the smallest.  Rows of one id whose
    texts are neither equal nor linked stay apart.  Null ids stay."""
    docs = docs.select(*COLUMNS)
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
        return docs.join(gone, docs["doc_id"] == F.col("_id"), "left_anti").select(*COLUMNS)
    # equal texts of one id are one row (blank ones, too, which nothing links); the rows get keys of their own
    one = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    rows = docs.join(twice.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id"), "left_anti").select(*COLUMNS).unionByName(one)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "rows")
    known = rows.where("doc_id is not null")
    groups = near_duplicates(known, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    groups = written(known.select("row", "doc_id").join(groups, "row"), "groups")
    first = groups.groupBy("component_id", "doc_id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    first = first.groupBy("component_id").agg(F.min(F.struct("doc_id", "n", "row")).alias("f")).select("component_id", "f.*")
    first = written(first, "first")
    single = rows.join(first.where("n = 1").select("row"), "row", "left_semi").select(*COLUMNS)
    tied = groups.join(first.where("n > 1").select("component_id", "doc_id"), ["component_id", "doc_id"]).select("row", "component_id")
    tied = rows.join(tied, "row").groupBy("component_id").agg(F.min(F.struct(*COLUMNS)).alias("d")).select("d.*")
    return rows.where("doc_id is null").select(*COLUMNS).unionByName(single).unionByName(tied)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every row, as best_fit_pack() gives them: null texts are
    one end token, null ids and rows that repeat are packed each."""
    return best_fit_pack(docs, *packing_tokenizer())


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_repeated_lines), ("minhash near-dedup", drop_near_duplicates), ("best-fit packing", pack)]

#: A trained classifier and a tokenizer have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again.  An empty table goes
    through to an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, "stage")
    return docs
