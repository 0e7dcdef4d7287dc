"""Segmentation: guards, and decoding of the scores of a plugged-in model.

A tagger is any function from names (name_id, name) to spans (name_id, ord, type,
begin, end, confidence), offsets in bytes of the trimmed name.  A model that
scores runs of characters is applied with mapInArrow and decoded here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import full_width_folded, is_kana, runs_of

#: Longest name, in bytes, that is segmented.
LONGEST = 16384


def guard(name: Column) -> Column:
    """ok, empty, too_long (only title and year are read) or nul (invalid)."""
    return F.when(F.coalesce(name, F.lit("")) == "", "empty").when(name.contains("\0"), "nul").when(F.octet_length(name) > LONGEST, "too_long").otherwise("ok")


def script_route(name: Column) -> Column:
    """japanese where kana decide; han where a model would have to; else the script."""
    return (
        F.when(is_kana(name), "japanese").when(name.rlike(r"\p{IsHan}"), "han").when(name.rlike(r"\p{IsHangul}"), "hangul")
        .when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsLatin}"), "latin").otherwise("other")
    )


def _range_class(*scripts: str) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for s in scripts for a, b in vocab.SCRIPTS[s])


def code_point_routes(name: Column, japanese: Column | None = None) -> Column:
    """The route of each code point, full-width forms folded: ascii, modified_latin,
    cyrillic, hangul, japanese_cj, chinese_han or sentinel (any other).

    A name's Chinese and Japanese characters share one decision.  Kana make it
    Japanese; Han alone is left to `japanese` (whether a model says so) and without
    it is undecided: null."""
    folded = full_width_folded(name)
    decided = F.when(folded.rlike(f"[{_range_class('hiragana', 'katakana')}]"), F.lit("japanese_cj"))
    if japanese is not None:
        decided = decided.when(japanese, "japanese_cj").when(~japanese, "chinese_han")
    cj = f"[{_range_class('han', 'hiragana', 'katakana')}]"
    return F.transform(F.regexp_extract_all(folded, F.lit("(?s)."), F.lit(0)), lambda c: (
        F.when(c.rlike(r"[\x00-\x7F]"), "ascii").when(c.rlike(cj), decided).when(c.rlike(f"[{_range_class('hangul')}]"), "hangul")
        .when(c.rlike(f"[{_range_class('cyrillic')}]"), "cyrillic").when(c.rlike(f"[{_range_class('modified_latin')}]"), "modified_latin").otherwise("sentinel")))


def n_tokens(name: Column) -> Column:
    return F.size(runs_of(name))


def decode_runs(scores: DataFrame) -> DataFrame:
    """name_id, ord, begin, end, split_prob, type, prob (a row per run and type)
    to name_id, ord, type, begin, end, confidence.

    A run whose split_prob exceeds 0.5 begins a segment, and so does a name's
    first run.  A segment's type is that with the highest mean probability (ties
    to the alphabetically smaller one); segments of type O are dropped."""
    by = Window.partitionBy("name_id", "type").orderBy("ord")
    starts = F.sum(((F.col("split_prob") > 0.5) | (F.row_number().over(by) == 1)).cast("int")).over(by)
    means = scores.withColumn("ord", F.col("ord")).withColumn("segment", starts).groupBy("name_id", "segment", "type").agg(
        F.avg("prob").alias("mean"), F.min("begin").alias("begin"), F.max("end").alias("end"))
    best = means.groupBy("name_id", "segment").agg(F.min(F.struct((-F.col("mean")).alias("less"), "type", "begin", "end")).alias("x"))
    return best.where("x.type <> 'O'").select("name_id", F.col("segment").cast("int").alias("ord"), "x.type", "x.begin", "x.end", (-F.col("x.less")).cast("float").alias("confidence"))


def argmax_verdicts(scores: DataFrame) -> DataFrame:
    """name_id, head, value, prob to name_id, head, value, confidence (ties to the smaller value).

    The best are sought after a shuffle into many small parts: before it, a task
    would sort all scores of its file."""
    spark = scores.sparkSession
    parts = max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = scores.repartition(parts, "name_id", "head").groupBy("name_id", "head").agg(F.min(F.struct((-F.col("prob")).alias("less"), "value")).alias("x"))
    return best.select("name_id", "head", "x.value", (-F.col("x.less")).cast("float").alias("confidence"))


def availability(logit: Column) -> Column:
    return (1 / (1 + F.exp(-logit))).cast("float")


def verdict_columns(verdicts: DataFrame, heads: list[str]) -> DataFrame:
    """Verdicts as a row per name with a struct<value, confidence> for each head."""
    pick = lambda h: F.max(F.when(F.col("head") == h, F.struct("value", F.col("confidence").cast("float").alias("confidence"))))
    return verdicts.groupBy("name_id").agg(*(pick(h).alias(h) for h in heads))
