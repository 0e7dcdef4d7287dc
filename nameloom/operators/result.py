"""Projections of a record: masks, confidences, evidence rows, dict, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab

# Names of the dict's keys.

#: The key whose value an evidence field backs, where it is called otherwise.
BACKED = {
    "alternate_title": "alternative_title", "air_date": "date", "quality": "screen_size", "release_source": "source", "platform": "streaming_service",
    "codec": "video_codec", "audio": "audio_codec", "audio_language": "language",
}
#: Keys backed by the evidence of another one.
SHARED = {"audio_channels": "audio_codec", "audio_profile": "audio_codec", "episode_count": "episode"}
#: Keys with a value per piece of evidence, and the column of their values.
LISTED = {"alternative_title": "alternative_titles", "language": "languages", "subtitle_language": "subtitle_languages", "release_group": "release_groups"}
#: Keys backed by a verdict on the whole name.
JUDGED = {"type": "content", "content": "content", "medium": "content", "adult": "adult", "anime": "anime", "numbering": "numbering", "pack_scope": "pack_scope", "special": "special"}
#: Evidence fields that the dict's origins call otherwise.
SHOWN = {"release_source": "source", "release_group": "group"}
#: Flags that the dict lists under "other", in its order (fixed values).
OTHER = [
    ("proper", "Proper"), ("repack", "Repack"), ("remux", "Remux"), ("complete_range", "Complete"), ("dual_audio", "Dual Audio"), ("multi_audio", "Multi Audio"),
    ("multi_subs", "Multi Subs"), ("hard_subs", "Hardcoded Subtitles"), ("english_dub", "English Dub"), ("hdr10", "HDR10"), ("dolby_vision", "Dolby Vision"),
    ("hdr10_plus", "HDR10+"), ("hlg", "HLG"), ("light_encode", "Light"), ("ai_upscale", "AI Upscale"),
]


def _mask(bits: list[Column]) -> Column:
    total = F.lit(0)
    for k, b in enumerate(bits):
        total = total + F.when(b, 1 << k).otherwise(0)
    return total.cast("int")


def stated_mask() -> Column:
    """A bit for each number that is stated; a stated 0 counts."""
    return _mask([F.col(c).isNotNull() for c in vocab.STATED])


def flags_mask() -> Column:
    return _mask([F.col(c) if c != "anime" else F.coalesce(F.col("anime") == "True", F.lit(False)) for c in vocab.FLAGS])


def hdr_mask() -> Column:
    return _mask([F.col(c) for c in ("hdr10", "dolby_vision", "hdr10_plus", "hlg")])


def other_labels() -> Column:
    return F.array_compact(F.array(*(F.when(F.col(c), label) for c, label in OTHER)))


def origin_of(origins: Column, field: str) -> Column:
    """The first evidence of a field, or null."""
    return F.get(F.filter(origins, lambda o: o["field"] == field), F.lit(0))


def screen_size_text(origins: Column) -> Column:
    """The text that the resolution was read from; null without."""
    return origin_of(origins, "quality")["text"]


def frame_size(origins: Column) -> Column:
    """array of width and height stated by the first resolution span; null without."""
    text = screen_size_text(origins)
    side = lambda k: F.regexp_extract(text, r"(\d{3,4})\s*[xX×]\s*(\d{3,4})", k).try_cast("int")
    return F.when(side(1).isNotNull(), F.array(side(1), side(2)))


def _names(names: dict[str, str], field: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, field), field)


def located(origins: Column) -> Column:
    """Evidence that has a place in the name, by the key that it backs: array of
    struct<key, confidence>, in order."""
    placed = F.filter(origins, lambda o: o["begin"] >= 0)
    return F.transform(placed, lambda o: F.struct(_names(BACKED, o["field"]).alias("key"), o["confidence"].cast("double").alias("confidence")))


def _sure(key: str) -> Column:
    """The confidence of a stated key: the least of what backs its value."""
    if key in JUDGED:
        return F.coalesce(F.col(f"{JUDGED[key]}_confidence").cast("double"), F.lit(0.0))
    backing = F.transform(F.filter("located", lambda x: x["key"] == SHARED.get(key, key)), lambda x: x["confidence"])
    if key in ("crc32", "website"):
        return F.get(backing, F.lit(0))
    if key in LISTED:
        # a value beyond the evidence has the least confidence of all of it
        backing = F.when(F.size(LISTED[key]) <= F.size(backing), F.slice(backing, F.lit(1), F.greatest(F.size(LISTED[key]), F.lit(1)))).otherwise(backing)
    return F.least(F.coalesce(F.array_min(backing), F.lit(1.0)), F.lit(1.0))


def origins_long(records: DataFrame) -> DataFrame:
    """A row for each piece of evidence, in order."""
    return records.select("name_id", F.posexplode("origins").alias("pos", "o")).select("name_id", "pos", "o.*")


def confidence_by_field(records: DataFrame) -> DataFrame:
    """name_id, field, confidence: the least of the located evidence of a field."""
    return origins_long(records).where("begin >= 0").groupBy("name_id", "field").agg(F.min("confidence").alias("confidence"))


def _text(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _list(items: Column) -> Column:
    """JSON texts as a JSON array."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _several(items: Column) -> Column:
    """One JSON text alone, several as an array; null without."""
    return F.when(F.size(items) == 1, F.get(items, F.lit(0))).when(F.size(items) > 1, _list(items))


def _object(entries: list[tuple[str, Column]]) -> Column:
    """A JSON object of the entries that aren't null."""
    parts = F.array_compact(F.array(*(F.concat(F.lit(f'"{k}": '), v) for k, v in entries)))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def _three(c: Column) -> Column:
    """A number of three decimals as JSON."""
    return F.round(c.cast("double"), 3).cast("string")


def to_dict(records: DataFrame, evidence: bool = False) -> DataFrame:
    """name_id, dict: stated facts as a JSON object, absent where not stated, with
    the confidence of each key under `confidence`.

    A list only where there are several values, a range as the list of its
    numbers.  content, adult and anime are always there (unknown, false and false
    with confidence 0 without a verdict).  evidence adds the located origins, whose
    `unconverted` is there only if true."""
    col = F.col
    read = lambda field: F.get(F.transform(F.filter("origins", lambda o: (o["field"] == field) & (o["begin"] >= 0)), lambda o: F.coalesce(F.when(o["value"] != "", o["value"]), o["text"])), F.lit(0))
    numbers = lambda a, b: F.when(col(b) > col(a), _list(F.transform(F.sequence(col(a), col(b)), lambda x: x.cast("string")))).otherwise(col(a).cast("string"))
    string = lambda c: F.when(c.isNotNull(), _text(c))
    quoted = lambda c: F.transform(c, _text)
    flag = lambda c, yes: F.coalesce(col(c) == yes, F.lit(False)).cast("string")
    content = F.coalesce(col("content"), F.lit("unknown"))
    # key, value, whether the key has a confidence
    entries = [
        ("title", string(col("title")), True), ("alternative_title", _several(quoted("alternative_titles")), True), ("episode_title", string(col("episode_title")), True),
        ("franchise_prefix", string(col("franchise_prefix")), True), ("year", col("year").cast("string"), True), ("date", string(col("date").cast("string")), True),
        ("season", numbers("season", "season_end"), True), ("episode", F.when(~F.coalesce((col("episode") == 0) & (col("absolute_episode") > 0), F.lit(False)), numbers("episode", "episode_end")), True),
        ("absolute_episode", numbers("absolute_episode", "absolute_episode_end"), True), ("episode_count", col("episode_count").cast("string"), True), ("screen_size", string(col("screen_size")), True),
        ("frame_size", _list(F.transform(frame_size(col("origins")), lambda x: x.cast("string"))), False), ("source", string(col("source")), True), ("video_codec", string(col("video_codec")), True),
        ("audio_codec", string(col("audio_codec")), True), ("audio_channels", string(col("audio_channels")), True), ("audio_profile", string(col("audio_profile")), True),
        ("color_depth", F.when(col("ten_bit"), F.lit('"10-bit"')), False), ("hdr", F.when(col("hdr") != "SDR", string(col("hdr"))), True), ("streaming_service", string(col("streaming_service")), True),
        ("edition", _several(quoted("editions")), True), ("other", _several(quoted(other_labels())), False), ("version", F.when(col("revision_version") > 1, col("revision_version").cast("string")), False),
        ("real", F.when(col("revision_real") > 0, col("revision_real").cast("string")), False), ("language", _several(quoted("languages")), True), ("subtitle_language", _several(quoted("subtitle_languages")), True),
        ("release_group", _several(quoted("release_groups")), True), ("container", string(col("container")), True), ("crc32", string(read("crc32")), True), ("website", string(read("site_banner")), True),
        ("type", F.when(content.endswith("movie"), F.lit('"movie"')).when(content.endswith("series"), F.lit('"episode"')), True), ("content", _text(content), True), ("medium", string(col("medium")), True),
        ("adult", flag("adult", "yes"), True), ("anime", flag("anime", "True"), True), ("numbering", F.when(col("numbering") != "none", string(col("numbering"))), True),
        ("pack_scope", F.when(col("pack_scope") != "single", string(col("pack_scope"))), True), ("special", F.when(col("special") != "none", string(col("special"))), True),
        ("degraded", F.when(col("degraded"), F.lit("true")), False), ("availability", _three(col("availability")), False),
    ]
    backing = F.transform(located(col("origins")), lambda x: x.withField("key", F.when(x["key"] == "site_banner", "website").otherwise(x["key"])))
    rows = records.withColumn("located", backing).select("name_id", "origins", "located", *(c for c in records.columns if c.endswith("_confidence") or c in LISTED.values()), *(v.alias(f"_{k}") for k, v, _ in entries))
    whole = [(k, col(f"_{k}")) for k, *_ in entries]
    whole.append(("confidence", _object([(k, F.when(col(f"_{k}").isNotNull(), _three(_sure(k)))) for k, _, sure in entries if sure])))
    if evidence:
        shown = lambda o: _object([
            ("field", _text(_names(SHOWN, o["field"]))), ("value", _text(o["value"])), ("text", _text(o["text"])), ("begin", o["begin"].cast("string")), ("end", o["end"].cast("string")),
            ("confidence", _three(o["confidence"])), ("unconverted", F.when(o["unconverted"], F.lit("true"))),
        ])
        whole.append(("origins", _list(F.transform(F.filter("origins", lambda o: o["begin"] >= 0), shown))))
    return rows.select("name_id", _object(whole).alias("dict"))


def rank_by_availability(records: DataFrame, *by: str) -> DataFrame:
    """rank within `by`, the most available first; unknown counts as 0, ties by id."""
    order = Window.partitionBy(*by).orderBy(F.coalesce("availability", F.lit(0.0)).desc(), "name_id")
    return records.withColumn("rank", F.row_number().over(order))


def rank_by_revision(records: DataFrame) -> DataFrame:
    """rank of a release among those of its title, season and episode, the latest first."""
    order = Window.partitionBy("title", "season", "episode").orderBy(F.desc("revision_version"), F.desc("revision_real"), "name_id")
    return records.withColumn("rank", F.row_number().over(order))
