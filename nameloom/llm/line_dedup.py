"""Line dedup by distinct-site spread.

HyperLogLog sketches of each repeated line's sites merge by aggregation; lines
whose estimate is near the threshold get an exact distinct count.  A line that
stands on many sites is boilerplate and stays only where it comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

KEY = ["h1", "h2"]


def _lines(rows: DataFrame) -> DataFrame:
    """A row per line that isn't blank: its document, place, site and hashes."""
    split = rows.select("doc_id", "row", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.where(~F.col("line").rlike(r"^\s*$")).select("doc_id", "row", "pos", "site", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def line_dedup(docs: DataFrame, min_sites: int = 10, near: float = 0.1, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with text_col less its boilerplate, and n_lines and n_removed.

    A line (exact, between newlines) found on at least min_sites distinct sites is
    removed wherever it stands but for its first place: the smallest document id,
    then the smallest position.  Blank lines always stay.

    Null texts stay null; a document may come out empty.  Null sites count as no
    site, null ids come first.  Rows that repeat (id and text) are one document
    for the first place and lose the same lines.  All columns of docs are kept;
    one named n_lines or n_removed is replaced.

    Skew: counts and sketches are pre-aggregated, and a frequent line meets its
    one row in joins that Spark may split.  Sites are estimated only for lines
    with at least min_sites occurrences, which no removed line can lack.
    """
    text = F.col(text_col).cast("string")
    row = F.xxhash64(F.col(id_col), text)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), row.alias("row"), F.col(site_col).cast("string").alias("site"), text.alias("text"))
    lines = _lines(rows)
    often = lines.groupBy(*KEY).agg(F.count("site").alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = often.where((F.col("n") >= min_sites) & ((F.col("a") < F.col("b")) | F.lit(min_sites <= 1))).select(*KEY)
    # as a table of its own, its join with all lines can be split or broadcast
    often = written(lines.join(written(often, "often"), KEY), "lines")

    sketches = often.groupBy(*KEY).agg(F.hll_sketch_agg("site", F.lit(12)).alias("sketch"), F.min(F.struct("doc_id", "row", "pos")).alias("first"))
    spread = written(sketches.select(*KEY, F.hll_sketch_estimate("sketch").alias("sites"), "first"), "spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + near))
    close = spread.where(F.col("sites").between(min_sites * (1 - near), min_sites * (1 + near)))
    exact = often.join(close.select(*KEY), KEY, "left_semi").select(*KEY, "site").distinct().groupBy(*KEY).agg(F.count("site").alias("exact"))
    close = close.join(exact.where(F.col("exact") >= min_sites).select(*KEY), KEY)
    bad = sure.unionByName(close).select(*KEY, "first")

    gone = often.join(bad, KEY).where(F.struct("doc_id", "row", "pos") != F.col("first"))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))
    # the row travels as one struct, so that none of its names can clash
    named = {c: F.col(f"`{c}`") for c in docs.columns}
    marked = docs.select(F.struct(*named.values()).alias("doc"), F.coalesce(named[id_col].cast("long"), F.lit(-(2**63))).alias("doc_id"), row.alias("row"), text.alias("text"))
    joined = marked.join(gone, ["doc_id", "row"], "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    cleaned = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counts = {"n_lines": F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)), "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))}
    own = [(cleaned if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns if c not in counts]
    return joined.select(*own, *(n.cast("long").alias(c) for c, n in counts.items()))


def oracle(min_sites: int = 10) -> str:
    """DuckDB SQL for doc_id, text, n_lines, n_removed over documents."""
    return f"""
with parts as (
  select doc_id, source, string_split(text, chr(10)) as parts from documents
), lines as (
  select doc_id, source, unnest(parts) as line, unnest(range(1, len(parts) + 1)) as pos from parts
), bad as (
  select line, min(struct_pack(d := doc_id, p := pos)) as first from lines
  where not regexp_full_match(line, '\\s*') group by line having count(distinct source) >= {min_sites}
), marked as (
  select l.doc_id, l.pos, l.line, b.line is not null and (l.doc_id, l.pos) <> (b.first.d, b.first.p) as gone
  from lines l left join bad b on l.line = b.line
)
select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text,
       count(*) as n_lines, count(*) filter (where gone) as n_removed
from marked group by doc_id
"""
