"""Names as a stream: parsing is stateless per name, so records append as names
arrive; no watermark and no state are needed for them.  Counts are kept by the time
that names carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import parse


def names_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files of a folder, a name per line, with the time they were read."""
    lines = spark.readStream.text(path).where("value <> ''")
    return lines.select(F.xxhash64("value").alias("name_id"), F.col("value").alias("name"), F.current_timestamp().alias("seen"))


def parse_stream(names: DataFrame, evidence: bool = True) -> DataFrame:
    """Records of a stream of names (name_id, name), by the rule tagger."""
    return parse(names, evidence=evidence)


def timed_names_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON files of a folder with the time each name was posted: name_id, name,
    posted.  Lines without a name or a time are left out."""
    lines = spark.readStream.schema("name string, posted timestamp").json(path).where("name <> '' and posted is not null")
    return lines.select(F.xxhash64("name", "posted").alias("name_id"), "name", "posted")


def counts_by_source(names: DataFrame, time: str = "posted", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Releases per window and source by the names' own time (a column of names:
    name_id, name, time); names more than `late` behind the latest are left out."""
    from ..functions import convert as C
    from ..functions.text import byte_slice
    from ..operators.tagger import rule_spans

    spans = F.filter(rule_spans(F.col("name")), lambda s: s["type"] == "source_type")
    sources = F.transform(spans, lambda s: C.source(byte_slice(F.col("name"), s["begin"], s["end"])))
    rows = names.withWatermark(time, late).select(time, F.get(F.filter(sources, lambda v: v.isNotNull()), F.lit(0)).alias("source"))
    return rows.groupBy(F.window(time, window).alias("window"), "source").agg(F.count("*").alias("n"))
