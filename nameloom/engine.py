"""Names to records, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .functions import convert as C
from .functions.text import once, trimmed, valid_utf8
from .operators.fold import READS, converted, fold, items_of, values_for
from .operators.segments import LONGEST, guard
from .operators.tagger import rule_spans

Tagger = Callable[[DataFrame], DataFrame]


def parse(names: DataFrame, name_col: str = "name", id_col: str = "name_id", tagger: Tagger | None = None, verdicts: DataFrame | None = None, evidence: bool = True, strict: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A record per row of names.

    Without a tagger, rules of our own find the spans as a Column expression, and
    no row is shuffled.  A tagger gives spans (name_id, ord, type, begin, end,
    confidence) as rows, which are grouped by name_id (then ids must be unique).
    verdicts: name_id with struct<value, confidence> columns content, adult,
    numbering, pack_scope, special, anime, and availability.  columns: what to
    return besides name_id; only what these are read from is converted.  A name may
    be BINARY; bytes that are no UTF-8 are replaced as by valid_utf8().

    A null name gives an invalid record, or with strict fails the query.  Names
    over 16 KiB are degraded: only title and year are read; one with a NUL is
    invalid."""
    if columns is not None:
        unknown = sorted({*columns} - {*READS})
        if unknown:
            raise ValueError(f"no columns of a record: {', '.join(unknown)}")
        asked = columns = ["name_id", *(c for c in columns if c != "name_id")]
        columns = [*dict.fromkeys([*asked, "name", "title", "valid", "degraded"])]  # by which long names are read
    name = valid_utf8(F.col(name_col))
    if strict:
        name = F.when(name.isNull(), F.raise_error(F.lit("a name is null"))).otherwise(name)
    rows = names.select(F.col(id_col).alias("name_id"), normal(name).alias("name"))
    if tagger is None:
        spans = rows.select("name_id", "name", _spans().alias("spans"))
        ready = spans.select("name_id", "name", items_of("name", "spans", values_for(columns)).alias("items"))
    else:
        fit = rows.where(guard(F.col("name")) == "ok")
        spans = tagger(fit).drop("name").join(fit, "name_id")
        ready = rows.join(converted(spans, columns).drop("name"), "name_id", "left")
    if verdicts is not None:
        ready = ready.join(verdicts, "name_id", "left")
    records = degrade(fold(ready, evidence, columns))
    return records if columns is None else records.select(*asked)


def parse_repeated(names: DataFrame, name_col: str = "name", id_col: str = "name_id", evidence: bool = True, columns: list[str] | None = None) -> DataFrame:
    """What parse() gives by the rule tagger, for tables in which names recur: each
    distinct name is parsed once, and its record joined to all its rows.

    The names are read twice, so they must be the same both times, and no stream.
    Where all differ this costs a shuffle of them more than parse()."""
    rows = names.select(F.col(id_col).alias("name_id"), normal(valid_utf8(F.col(name_col))).alias("name"))
    records = parse(spread(rows.select("name").distinct()), id_col="name", evidence=evidence, columns=columns)
    kept = [c for c in records.columns if c not in ("name_id", "name")]
    found = rows.join(records.select(F.col("name_id").alias("name"), *kept), "name")
    return found.select(*records.columns)


def counted(names: DataFrame, name_col: str = "name") -> DataFrame:
    """name, n: the distinct names and how many rows have each, for counts of
    records: parse(counted(names), id_col="n") has n as its name_id."""
    return spread(names.select(normal(valid_utf8(F.col(name_col))).alias("name")).groupBy("name").agg(F.count("*").alias("n")))


def normal(name: Column) -> Column:
    """A valid name as it is parsed: trimmed, empty for null."""
    return F.coalesce(trimmed(name), F.lit(""))


def spread(names: DataFrame) -> DataFrame:
    """Few bytes of names are much work: they aren't left to a few tasks."""
    spark = names.sparkSession
    return names.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


@once
def _spans():
    return rule_spans(F.col("name"))


def degrade(records: DataFrame) -> DataFrame:
    """Names too long to segment get their title and year from the whole name."""
    long = (F.octet_length("name") > LONGEST) & ~F.col("name").contains("\0")
    title = C.title(F.col("name"))
    read = {
        "title": F.when(long, F.when(title != "", title)).otherwise(F.col("title")), "year": F.when(long, C.year(F.col("name"))).otherwise(F.col("year")),
        "degraded": long, "valid": F.when(long, title != "").otherwise(F.col("valid")),
    }
    return records.withColumns({c: v for c, v in read.items() if c in records.columns})


def observed(records: DataFrame, observation: Observation) -> DataFrame:
    """The records, with figures of the batch in `observation` once they have been
    read: names, valid, degraded, titled, bytes and longest (of a name)."""
    size = F.octet_length("name")
    count = lambda c: F.sum(c.cast("long"))
    return records.observe(observation, F.count("*").alias("names"), count(F.col("valid")).alias("valid"), count(F.col("degraded")).alias("degraded"), count(F.col("title").isNotNull()).alias("titled"), F.sum(size).alias("bytes"), F.max(size).alias("longest"))
