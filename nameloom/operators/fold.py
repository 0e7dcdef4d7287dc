"""Spans to a record: conversion of each span, then an ordered fold per name.

A name's converted spans are one array, so every policy (first, last, highest,
any, union) is a higher-order function over it; three short folds carry what
depends on order: titles, resolutions, and seasons with episodes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import convert as C
from ..functions.text import byte_slice, fold_key, group, groups, has, integer, let, once, trimmed

NONE = lambda kind: F.lit(None).cast(kind)
NO_STRINGS = lambda: F.array().cast("array<string>")
ORIGIN = "struct<field:string,value:string,text:string,begin:int,end:int,confidence:float,unconverted:boolean>"
SPAN = "struct<ord:int,type:string,begin:int,end:int,confidence:float>"
#: The first and last year that a release may carry.
FIRST_YEAR, LAST_YEAR = 1890, 2035
TITLED = ["MAIN", "ALT", "episode_title", "franchise_prefix", "subtitle_part", "year"]


def origin(field, value, text, begin, end, confidence) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    value = F.coalesce(as_column(value), F.lit(""))
    return F.struct(
        as_column(field).alias("field"), value.alias("value"), as_column(text).alias("text"), as_column(begin).cast("int").alias("begin"),
        as_column(end).cast("int").alias("end"), as_column(confidence).cast("float").alias("confidence"), (value == "").alias("unconverted"),
    ).cast(ORIGIN)


def _text(name: Column, s: Column) -> Column:
    """A span's text; empty if its offsets lie outside the name."""
    begin, end = s["begin"], s["end"]
    inside = (begin >= 0) & (end > begin) & (end <= F.octet_length(name))
    return F.when(inside, trimmed(byte_slice(name, begin, end))).otherwise(F.lit(""))


def _codes(kind: Column, raw: Column) -> Column:
    """Languages of a span; an E-Sub names English."""
    found = F.when(kind.isin("audio_language", "subtitle_language", "hardsub_tag"), C.languages(raw))
    found = let(F.array(found), lambda a: F.when((kind == "subtitle_language") & (F.size(a[0]) == 0) & has(raw, r"\bE[ ._-]?Subs?\b"), F.array(F.lit("eng"))).otherwise(a[0]))
    return F.coalesce(found, NO_STRINGS())


#: Types of the values of a converted span.
VALUES = {
    "title": "string", "date": "date", "year": "int", "lines": "int", "value_end": "int", "source": "string", "bare_uhd": "boolean",
    "extras": "struct<lines:int,hdr10:boolean,dolby_vision:boolean>", "remux": "boolean", "light": "boolean", "hybrid": "boolean", "platform": "string",
    "codec": "string", "depth": "string", "depth_medium": "string", "hdr": "string", "audio": "string", "languages": "array<string>", "multi": "boolean",
    "bare_dub": "boolean", "named_dub": "boolean", "subtitle_format": "string", "several": "boolean", "subtitled": "boolean", "burned": "boolean", "group": "string",
    "season": "struct<first:int,last:int,count:int,stated:boolean>", "marker": "struct<season:int,first:int,last:int,count:int,stated:boolean>",
    "edition": "string", "editions": "array<string>", "proper": "boolean", "repack": "boolean", "ai_upscale": "boolean", "revision": "int", "real": "int",
    "three_d": "boolean", "checksum": "boolean", "container": "string",
}
#: Which of them a column of a record is read from, besides those of its walk.
TITLES, SIZES, NUMBERS = "title date year", "lines value_end extras", "season marker"
READS = {
    "valid": TITLES, "title": TITLES, "alternative_titles": TITLES, "episode_title": TITLES, "year": TITLES, "date": TITLES, "franchise_prefix": "title",
    **dict.fromkeys("season season_end episode episode_end absolute_episode absolute_episode_end episode_count pack complete_range numbering pack_scope".split(), NUMBERS),
    "screen_size": SIZES, "downscaled": SIZES, "source": "source bare_uhd", "streaming_service": "platform", "video_codec": "codec", "ten_bit": "depth",
    **dict.fromkeys("hdr hdr10 hdr10_plus hlg dolby_vision".split(), "hdr extras"), **dict.fromkeys("audio_codec audio_channels audio_profile".split(), "audio"),
    "edition": "editions", "editions": "editions", "proper": "proper", "repack": "repack", "revision_version": "proper repack revision", "revision_real": "real",
    "remux": "remux", "light_encode": "light", "hybrid": "hybrid", "ai_upscale": "ai_upscale", "three_d": TITLES + " three_d checksum",
    "languages": "languages", "subtitle_languages": "languages", "subtitle_format": "subtitle_format", "dual_audio": "multi", "multi_audio": "multi languages",
    "english_dub": TITLES + " multi bare_dub named_dub", "multi_subs": "several", "hard_subs": "burned", "release_group": "group", "release_groups": "group",
    "specials": "", "container": "container", "medium": "container depth_medium", "crc32": "checksum",
    **dict.fromkeys("name_id name degraded content adult anime special availability".split(), ""),
    **{f"{v}_confidence": "" for v in ("content", "adult", "numbering", "pack_scope", "special", "anime")}, "origins": " ".join(VALUES),
}


def values_for(columns: list[str] | None) -> frozenset[str]:
    """The values of spans that these columns of a record are read from."""
    return frozenset(VALUES if columns is None else " ".join(READS[c] for c in columns).split())


def convert_span(name: Column, s: Column, values: frozenset[str] = frozenset(VALUES)) -> Column:
    """A span (ord, type, begin, end, confidence) with its text and its values, null
    where they aren't asked for."""
    spoken = not values.isdisjoint({"languages", "multi", "bare_dub", "named_dub"})
    codes = lambda raw: _codes(s["type"], raw) if spoken else NO_STRINGS()
    return let(_text(name, s), lambda raw: let(codes(raw), lambda found: _pruned(_converted(name, s, raw, found), values)))


def _pruned(made: dict[str, Column], values: frozenset[str]) -> Column:
    return F.struct(*((c if k not in VALUES or k in values else NONE(VALUES[k])).alias(k) for k, c in made.items()))


def _converted(name: Column, s: Column, raw: Column, codes: Column) -> dict[str, Column]:
    kind, begin, end = s["type"], s["begin"], s["end"]
    on = lambda types, value: F.when(kind.isin(*types.split()), value)
    plus = F.when(byte_slice(name, end, end + 1) == "+", F.lit("+")).otherwise(F.lit(""))
    medium = F.when(C.bit_depth(raw).isNotNull(), NONE("string")).when(C.states_sample_depth(raw), "music").when(C.states_bitness(raw), "software")
    trailing = group(raw, r"([ ._\-]*(?:to|->|>))$", 1)
    usable = C.release_group(raw)
    made = (
        s["ord"].cast("int").alias("ord"), kind.alias("type"), begin.cast("int").alias("begin"), end.cast("int").alias("end"), s["confidence"].cast("float").alias("confidence"), raw.alias("raw"),
        F.coalesce(F.when(kind.isin(TITLED), C.title(raw)), F.lit("")).alias("title"),
        on("year", C.air_date(raw)).alias("date"), on("year", C.year(raw)).alias("year"),
        on("resolution frame_size", C.resolution_lines(raw)).alias("lines"),
        (end - F.octet_length(trailing)).cast("int").alias("value_end"),
        on("source_type", C.source(raw)).alias("source"), on("source_type", C.source_is_bare_uhd(raw)).alias("bare_uhd"), on("source_type", C.source_extras(raw)).alias("extras"),
        on("source_type edition", F.when(kind == "edition", C.is_remux(raw)).otherwise(C.source_is_remux(raw))).alias("remux"),
        on("source_type edition", F.when(kind == "edition", C.is_light_encode(raw)).otherwise(C.source_is_light(raw))).alias("light"),
        on("source_type edition", C.is_hybrid(raw)).alias("hybrid"),
        on("platform", C.platform(raw)).alias("platform"),
        on("codec bit_depth", C.video_codec(raw)).alias("codec"), on("codec bit_depth", C.bit_depth(raw)).alias("depth"),
        F.when(kind == "bit_depth", medium).alias("depth_medium"),
        on("hdr", C.hdr(raw)).alias("hdr"),
        F.when(kind == "audio_codec", C.audio_codec(F.concat(raw, plus))).when(kind == "audio_channels", C.audio_channels(raw)).when(kind == "audio_feature", C.audio_profile(raw)).alias("audio"),
        codes.alias("languages"),
        F.coalesce(on("audio_language dual_audio_tag", C.is_multi_audio(raw) & ((kind == "dual_audio_tag") | (F.size(codes) == 0))), F.lit(False)).alias("multi"),
        F.when(kind == "audio_language", ((F.size(codes) == 0) & C.is_bare_dub(raw))).alias("bare_dub"),
        F.when(kind == "audio_language", C.is_dub(raw) & F.array_contains(codes, "eng")).when(kind == "dual_audio_tag", fold_key(raw).contains("dub") & fold_key(raw).contains("eng")).alias("named_dub"),
        F.when(kind == "subtitle_language", C.subtitle_format(raw)).when(kind.isin("container", "file_extension"), F.when(C.medium_of_container(C.container(raw)) == "subtitle", C.subtitle_format(C.container(raw)))).alias("subtitle_format"),
        on("subtitle_language", C.states_several_subtitles(raw)).alias("several"), on("subtitle_language", C.states_subtitles(raw)).alias("subtitled"),
        on("hardsub_tag", ~has(raw, r"\bwithout\b|\bno\b") & ~has(raw, r"\bsoft[ ._-]?subs?\b")).alias("burned"),
        on("release_group", F.when(~C.never_a_group(usable), usable)).alias("group"),
        on("season_marker", C.marker_numbers(raw)).alias("season"),
        F.when(kind == "episode_marker", C.episode_marker(raw)).when(kind == "season_episode_marker", C.season_episode_marker(raw)).alias("marker"),
        on("edition", C.edition(raw)).alias("edition"), F.coalesce(on("edition", C.editions(raw)), NO_STRINGS()).alias("editions"),
        on("edition", C.is_proper(raw)).alias("proper"), on("edition", C.is_repack(raw)).alias("repack"), on("edition", C.is_ai_upscale(raw)).alias("ai_upscale"),
        on("edition", C.stated_revision(raw)).alias("revision"), on("edition", C.real_count(raw)).alias("real"),
        on("edition crc32", C.is_three_d(raw)).alias("three_d"), on("crc32", C.is_checksum(raw)).alias("checksum"),
        on("container file_extension", C.container(raw)).alias("container"),
    )
    return dict(zip(["ord", "type", "begin", "end", "confidence", "raw", *VALUES], made, strict=True))


@once
def items_of(name: str, spans: str, values: frozenset[str] = frozenset(VALUES)) -> Column:
    """The converted spans of a column of arrays of spans."""
    return F.filter(F.transform(F.col(spans), lambda s: convert_span(F.col(name), s.cast(SPAN), values)), lambda x: x["raw"] != "")


@once
def _row_columns(values: frozenset[str]) -> tuple[Column, Column, Column]:
    name, s = F.col("name"), F.col("s")
    return _text(name, s).alias("raw"), _codes(F.col("s.type"), F.col("raw")).alias("codes"), _pruned(_converted(name, s, F.col("raw"), F.col("codes")), values).alias("x")


def converted(spans: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name_id, name, ord, type, begin, end, confidence (a row per span, any other
    columns left out) to a row per name with its array of converted spans."""
    rows = spans.select("name_id", "name", F.struct("ord", "type", "begin", "end", "confidence").alias("s"))
    # a column for what the values share, so that it is read once
    raw, codes, x = _row_columns(values_for(columns))
    rows = rows.withColumn("raw", raw).where("raw <> ''").withColumn("codes", codes).select("name_id", "name", x)
    return rows.groupBy("name_id").agg(F.first("name").alias("name"), F.array_sort(F.collect_list("x")).alias("items"))


def _first(items: Column, when, value) -> Column:
    return F.get(F.transform(F.filter(items, when), value), F.lit(0))


def _last(items: Column, when, value) -> Column:
    return F.try_element_at(F.transform(F.filter(items, when), value), F.lit(-1))


def _any(items: Column, test) -> Column:
    return F.exists(items, lambda x: F.coalesce(test(x), F.lit(False)))


def _union(items: Column, types: list[str], value) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(items, lambda x: x["type"].isin(types)), value)))


def _adjacent(name: Column, left: Column, right: Column) -> Column:
    """Only up to three separators lie between two byte offsets."""
    return (left >= 0) & (right >= left) & (right - left <= 3) & byte_slice(name, left, right).rlike("^[ ._-]*$")


def fold_titles(name: Column, items: Column) -> Column:
    """title, title_end, episode_title, alternatives, year, date, origins (with ord)."""
    noted = f"array<struct<ord:int,o:{ORIGIN}>>"
    start = F.struct(
        F.lit("").alias("title"), F.lit(-1).alias("title_end"), F.lit("").alias("held"), F.lit(-1).alias("held_end"), F.lit("").alias("episode_title"), F.lit(-1).alias("episode_title_end"),
        NO_STRINGS().alias("alternatives"), NONE("int").alias("year"), NONE("date").alias("date"), F.array().cast(noted).alias("origins"),
    )

    def step(s, x):
        kind, text = x["type"], x["title"]
        titled = s["title"] != ""
        after_title = titled & _adjacent(name, s["title_end"], x["begin"])
        full = F.when((s["held"] != "") & _adjacent(name, s["held_end"], x["begin"]), F.concat(s["held"], F.lit(" "), text)).otherwise(text)
        main, part, year = kind == "MAIN", kind == "subtitle_part", kind == "year"
        dated = year & x["date"].isNotNull()
        plausible = year & ~dated & F.coalesce(x["year"].between(FIRST_YEAR, LAST_YEAR), F.lit(False))
        odd = year & ~dated & x["year"].isNotNull() & ~plausible  # a number of the title
        grows = (odd | part) & after_title
        holds = (odd & ~after_title) | (part & ~titled)
        after_episode = part & titled & ~after_title & (s["episode_title"] != "") & _adjacent(name, s["episode_title_end"], x["begin"])
        other = part & titled & ~after_title & ~after_episode
        begins = main & ~titled
        longer = F.concat(s["title"], F.lit(" "), text)
        episode = F.concat(s["episode_title"], F.lit(" "), text)
        first_episode = (kind == "episode_title") & (s["episode_title"] == "")
        alternative = F.when(main & titled, full).when((kind == "ALT") | other, text)
        field = C.choose((begins | grows, "title"), (alternative.isNotNull(), "alternate_title"), ((kind == "episode_title") | after_episode, "episode_title"), (dated, "air_date"), (year & ~odd, "year"))
        value = C.choose((begins, full), (grows, longer), (alternative.isNotNull(), alternative), (after_episode, episode), (kind == "episode_title", text), (dated, x["date"].cast("string")), (plausible, x["year"].cast("string")))
        note = F.struct(x["ord"].alias("ord"), origin(field, value, x["raw"], x["begin"], x["end"], x["confidence"]).alias("o"))
        return F.struct(
            F.when(begins, full).when(grows, longer).otherwise(s["title"]).alias("title"),
            F.when(begins | grows, x["end"]).otherwise(s["title_end"]).alias("title_end"),
            F.when(main, F.lit("")).when(holds, text).otherwise(s["held"]).alias("held"),
            F.when(holds, x["end"]).otherwise(s["held_end"]).alias("held_end"),
            F.when(first_episode, text).when(after_episode, episode).otherwise(s["episode_title"]).alias("episode_title"),
            F.when(first_episode | after_episode, x["end"]).otherwise(s["episode_title_end"]).alias("episode_title_end"),
            F.when(alternative.isNotNull(), F.concat(s["alternatives"], F.array(alternative))).otherwise(s["alternatives"]).alias("alternatives"),
            F.when(plausible, x["year"]).otherwise(s["year"]).alias("year"),
            F.when(dated, x["date"]).otherwise(s["date"]).alias("date"),
            F.when(field.isNotNull(), F.concat(s["origins"], F.array(note).cast(noted))).otherwise(s["origins"]).alias("origins"),
        )

    return F.aggregate(F.filter(items, lambda x: x["type"].isin("MAIN", "ALT", "episode_title", "subtitle_part", "year")), start, step)


def fold_resolution(name: Column, items: Column) -> Column:
    """lines (0 if unknown) and downscaled; a compound source fills what is unknown by then."""
    start = F.struct(F.lit(0).alias("lines"), F.lit(-1).alias("end"), F.lit(False).alias("downscaled"), F.array().cast("array<int>").alias("down_at"))

    def step(s, x):
        sized = x["type"].isin("resolution", "frame_size")
        lines = F.coalesce(x["lines"], F.lit(0))
        gap = x["begin"] - s["end"]
        joined = (s["end"] >= 0) & (gap > 0) & (gap <= 8) & has(byte_slice(name, s["end"], x["begin"]), r"^[ ._\-]*(?:to|->|>)[ ._\-]*$")
        down = sized & (lines > 0) & (lines < s["lines"]) & joined
        return F.struct(
            F.when(down | (sized & (lines > s["lines"])), lines).when(~sized & (s["lines"] == 0) & x["extras"].isNotNull(), x["extras"]["lines"]).otherwise(s["lines"]).alias("lines"),
            F.when(sized, x["value_end"]).otherwise(s["end"]).alias("end"),
            (s["downscaled"] | down).alias("downscaled"),
            F.when(down, F.concat(s["down_at"], F.array(x["ord"]))).otherwise(s["down_at"]).alias("down_at"),
        )

    return F.aggregate(F.filter(items, lambda x: x["type"].isin("resolution", "frame_size", "source_type")), start, step)


def _bracketed(name: Column, begin: Column, end: Column) -> Column:
    before = F.rtrim(byte_slice(name, F.lit(0), begin))
    after = F.ltrim(byte_slice(name, end))
    return (before.endswith("(") & after.startswith(")")) | (before.endswith("[") & after.startswith("]"))


def fold_numbers(name: Column, items: Column) -> Column:
    """season, season_end, episode, episode_end, count, pack, complete, combined, origins (with ord)."""
    noted = f"array<struct<ord:int,o:{ORIGIN}>>"
    start = F.struct(
        *(NONE("int").alias(c) for c in ("season", "season_end", "episode", "episode_end", "count")),
        *(F.lit(False).alias(c) for c in ("pack", "complete", "combined")), F.array().cast(noted).alias("origins"),
    )

    def step(s, x):
        kind, n, m = x["type"], x["season"], x["marker"]
        yes = lambda c: F.coalesce(c, F.lit(False))
        is_season, is_episode, both = kind == "season_marker", kind == "episode_marker", kind == "season_episode_marker"
        no_season, no_episode = s["season"].isNull(), s["episode"].isNull()
        season_here = is_season & yes(n["stated"]) & no_season
        stated = yes(m["stated"])
        begins = stated & no_episode
        ranged = begins & (m["last"] > m["first"])
        crossed = stated & (m["season"] > 0) & no_season & ((is_episode & no_episode) | both)
        end = F.coalesce(s["episode_end"], s["episode"])
        goes_on = is_episode & stated & ~no_episode & (m["count"] == 1) & (m["last"] == 0) & ((m["season"] == 0) | no_season | (m["season"] == s["season"])) & (m["first"] == end + 1)
        season_range = season_here & (n["last"] > n["first"])
        say = lambda field, value: F.struct(x["ord"].alias("ord"), origin(field, value, x["raw"], x["begin"], x["end"], x["confidence"]).alias("o"))
        notes = F.array_compact(F.array(
            F.when(is_season, say("season", F.when(n["stated"], n["first"].cast("string")))),
            F.when(both & crossed, say("season", m["season"].cast("string"))),
            F.when(is_episode, say("episode", F.when(stated, m["first"].cast("string")))).when(both & begins, say("episode", m["first"].cast("string"))),
        ))
        return F.struct(
            F.when(season_here, n["first"]).when(crossed, m["season"]).otherwise(s["season"]).alias("season"),
            F.when(season_range, n["last"]).otherwise(s["season_end"]).alias("season_end"),
            F.when(begins, m["first"]).otherwise(s["episode"]).alias("episode"),
            F.when(ranged, m["last"]).when(goes_on, m["first"]).otherwise(s["episode_end"]).alias("episode_end"),
            F.when(ranged, F.greatest(m["count"], m["last"] - m["first"] + 1)).when(goes_on, m["first"] - s["episode"] + 1).otherwise(s["count"]).alias("count"),
            (s["pack"] | season_range | ranged | goes_on).alias("pack"),
            (s["complete"] | (is_episode & ranged & (m["last"] >= 10) & _bracketed(name, x["begin"], x["end"]))).alias("complete"),
            (s["combined"] | (both & crossed)).alias("combined"),
            F.concat(s["origins"], notes.cast(noted)).alias("origins"),
        )

    return F.aggregate(F.filter(items, lambda x: x["type"].isin("season_marker", "episode_marker", "season_episode_marker")), start, step)


def _other_origins(items: Column, resolution: Column) -> Column:
    """Evidence of the spans that the folds don't note, with ord."""
    noted = f"array<struct<ord:int,o:{ORIGIN}>>"

    def of(x):
        kind, raw = x["type"], x["raw"]
        say = lambda field, value: origin(field, value, raw, x["begin"], x["end"], x["confidence"])
        joined = F.array_join(x["languages"], "/")
        routed = F.array_join(F.array_compact(F.array(*(F.when(x[c], F.lit(label)) for c, label in (
            ("proper", "proper"), ("repack", "repack"), ("ai_upscale", "ai upscale"), ("light", "light encode"), ("hybrid", "hybrid"), ("three_d", "3D"), ("remux", "remux"))))), "+")
        multi = F.exists(items, lambda y: y["multi"] & (y["ord"] <= x["ord"]))
        tier = F.concat(x["lines"].cast("string"), F.lit("p"))
        three_d = F.coalesce(x["three_d"], F.lit(False)) & ~F.coalesce(x["checksum"], F.lit(False))
        many = F.size(x["languages"]) > 0
        return C.choose(
            (kind.isin("resolution", "frame_size"), F.array_compact(F.array(F.when(F.array_contains(resolution["down_at"], x["ord"]), say("downscaled", "yes")), say("quality", tier)))),
            (kind == "source_type", F.array(say("release_source", F.coalesce(x["source"], F.when(x["remux"], "remux"), F.when(x["light"], "light encode"))))),
            (kind == "platform", F.array(say("platform", x["platform"]))),
            (kind == "codec", F.array(say("codec", x["codec"]))),
            (kind == "bit_depth", F.array(say("bit_depth", F.coalesce(x["depth"], F.when(x["depth_medium"] == "music", "audio sample depth"), F.when(x["depth_medium"] == "software", "software bitness"))))),
            (kind == "hdr", F.array(say("hdr", x["hdr"]))),
            (kind.isin("audio_codec", "audio_channels", "audio_feature"), F.array(say("audio", x["audio"]))),
            (kind == "audio_language", F.array(say("audio_language", F.when(many, joined).when(multi, "multi audio").when(x["bare_dub"], "english dub")))),
            (kind == "subtitle_language", F.array_compact(F.array(
                say("subtitle_language", F.when(many, joined).when(x["subtitle_format"].isNotNull(), x["subtitle_format"]).when(x["several"], "several").when(x["subtitled"], "subtitles")),
                F.when(x["subtitle_format"].isNotNull(), say("subtitle_format", x["subtitle_format"]))))),
            (kind == "dual_audio_tag", F.array(say(F.when(x["multi"], "multi_audio").otherwise("dual_audio"), "yes"))),
            (kind == "hardsub_tag", F.array(say("hard_subs", F.when(~x["burned"], "no").when(many, joined).otherwise("yes")))),
            (kind == "franchise_prefix", F.array(say("franchise_prefix", x["title"]))),
            (kind == "release_group", F.array(say("release_group", x["group"]))),
            (kind.isin("volume_marker", "pack_marker"), F.array(say("pack_marker", raw))),
            (kind.isin("special_marker", "site_banner", "tracker_tag"), F.array(say(kind, raw))),
            (kind == "edition", F.array(say("edition", F.coalesce(x["edition"], routed)))),
            (kind.isin("container", "file_extension"), F.array(say("container", x["container"]))),
            (kind == "crc32", F.when(three_d, F.array(say("three_d", "yes"))).otherwise(F.array(say("crc32", F.when(x["checksum"], raw))))),
            default=F.array().cast(f"array<{ORIGIN}>"),
        )

    return F.flatten(F.transform(items, lambda x: F.transform(of(x), lambda o: F.struct(x["ord"].alias("ord"), o.alias("o"))))).cast(noted)


# What the whole name may say outside of spans.
LAYOUT_3D = r"(?s)^(.*?(?:^|[ ._\-]))(3D|(?:Half|Full)[ ._-]?SBS|HSBS|(?:Half|Full)[ ._-]?OU|HOU)(?=$|[ ._\-])"
BRACKETED_DUB = r"(?s)^(.*?[\[(]\s*)(Dub(?:bed)?)\s*[\])]"
WRITTEN = r"(?s)^(.*?(?:^|[^A-Za-z0-9]))(s(\d{1,2}))([ ._-]?)(e(\d{1,4}))"
MARK = r"s(\d{1,2})[ ._-]?e(\d{1,4})|(\d{1,2})x(\d{2,3})"
MARKER_RANGE = rf"(?s)^(.*?(?:^|[^A-Za-z0-9]))((?:{MARK})[ ._]*(?:[-~]|to|thru|bis)[ ._]*(?:{MARK}))(?:[^A-Za-z0-9]|$)"


def fold(df: DataFrame, evidence: bool = True, columns: list[str] | None = None) -> DataFrame:
    """name_id, name, items (and the verdicts content, adult, numbering, pack_scope,
    special, anime as struct<value, confidence>, availability, where given) to records.

    Unknown values are null, 0 is a value, lists are empty rather than null.  A
    null `items` (a name that couldn't be encoded) gives an invalid record.
    evidence=False leaves the origins out, and all work that only they need;
    columns, if given, are all that a record has, and only what they need is done.
    """
    verdicts = ["content", "adult", "numbering", "pack_scope", "special", "anime"]
    nothing = "struct<value:string,confidence:float>"
    given = {v: (F.col(v).cast(nothing) if v in df.columns else NONE(nothing)) for v in verdicts}
    df = df.select("name_id", "name", F.coalesce("items", F.array().cast(df.schema["items"].dataType)).alias("items"), *(c.alias(f"v_{v}") for v, c in given.items()), (F.col("availability").cast("float") if "availability" in df.columns else NONE("float")).alias("availability"))
    df = df.withColumns(_walks()).withColumns(_facts())
    evidence = evidence and (columns is None or "origins" in columns)
    return _rules(df.withColumn("noted", _noted() if evidence else F.array().cast(f"array<{ORIGIN}>")), columns)


@once
def _walks() -> dict[str, Column]:
    name, items = F.col("name"), F.col("items")
    return {"t": fold_titles(name, items), "r": fold_resolution(name, items), "n": fold_numbers(name, items)}


@once
def _facts() -> dict[str, Column]:
    items = F.col("items")
    of = lambda *kinds: (lambda x: x["type"].isin(*kinds))
    known = lambda kinds, c: (lambda x: x["type"].isin(*kinds.split()) & x[c].isNotNull())
    value = lambda c: (lambda x: x[c])
    first = lambda kinds, c: _first(items, known(kinds, c), value(c))
    rank = F.greatest(*(F.coalesce(F.array_max(F.transform(items, f)), F.lit(0)) for f in (
        lambda x: C.hdr_rank(x["hdr"]),
        lambda x: F.when(x["extras"]["dolby_vision"], 4).when(x["extras"]["hdr10"], 1).otherwise(0))))
    formats = F.array_compact(F.transform(items, lambda x: x["hdr"]))
    found_groups = F.array_compact(F.transform(F.filter(items, of("release_group")), value("group")))
    keys = F.transform(found_groups, fold_key)
    kinds = ["container", "file_extension"]
    ids = {label: k for k, label in enumerate(vocab.EDITION_LABELS, 1)}
    all_ids = F.create_map(*(F.lit(x) for pair in ids.items() for x in pair))
    edition_ids = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(items, value("editions"))), lambda e: F.element_at(all_ids, e))))
    revision = F.coalesce(F.array_max(F.transform(items, value("revision"))), F.lit(0))
    bumped = _any(items, lambda x: x["proper"] | x["repack"])
    return {
        "franchise_prefix": _first(items, lambda x: (x["type"] == "franchise_prefix") & (x["title"] != ""), value("title")),
        "source": F.coalesce(_first(items, lambda x: x["source"].isNotNull() & ~x["bare_uhd"], value("source")), first("source_type", "source")),
        "remux": _any(items, value("remux")), "light_encode": _any(items, value("light")), "hybrid": _any(items, value("hybrid")),
        "streaming_service": first("platform", "platform"), "video_codec": first("codec bit_depth", "codec"),
        "ten_bit": _any(items, lambda x: x["depth"] == "10bit"),
        "hdr": F.element_at(F.array(*map(F.lit, vocab.HDR_ORDER)), rank + 1),
        "dolby_vision": F.array_contains(formats, "DV") | _any(items, lambda x: x["extras"]["dolby_vision"]),
        "hdr10_plus": F.array_contains(formats, "HDR10+"), "hlg": F.array_contains(formats, "HLG"),
        "hdr10": F.array_contains(formats, "HDR10") | _any(items, lambda x: x["extras"]["hdr10"]),
        # the value read once more, as a span of its own
        "audio_codec": C.audio_codec(first("audio_codec", "audio")), "audio_channels": C.audio_channels(first("audio_channels", "audio")), "audio_profile": first("audio_feature", "audio"),
        "languages": _union(items, ["audio_language"], value("languages")), "subtitle_languages": _union(items, ["subtitle_language", "hardsub_tag"], value("languages")),
        "dual_audio": _any(items, lambda x: (x["type"] == "dual_audio_tag") & ~x["multi"]),
        "english_dub": _any(items, lambda x: F.coalesce(x["bare_dub"], F.lit(False)) | (F.coalesce(x["named_dub"], F.lit(False)) & ~((x["type"] == "dual_audio_tag") & x["multi"]))),
        "multi_subs": _any(items, value("several")), "hard_subs": _any(items, value("burned")), "subtitle_format": first("subtitle_language container file_extension", "subtitle_format"),
        "release_groups": F.filter(found_groups, lambda g, i: F.array_position(keys, fold_key(g)) == i + 1),
        "marked_pack": _any(items, of("volume_marker", "pack_marker")),
        "marked_complete": _any(items, lambda x: (x["type"] == "pack_marker") & fold_key(x["raw"]).contains("complete")),
        "marked_special": _any(items, of("special_marker")),
        "editions": C.edition_labels(edition_ids),
        "proper": _any(items, value("proper")), "repack": _any(items, value("repack")), "ai_upscale": _any(items, value("ai_upscale")),
        "three_d": _any(items, lambda x: x["three_d"] & ~F.coalesce(x["checksum"], F.lit(False))),
        "revision_version": F.when(bumped, F.when(revision > 0, revision + 1).otherwise(2)).otherwise(F.greatest(revision, F.lit(1))).cast("int"),
        "revision_real": F.aggregate(items, F.lit(0), lambda s, x: s + F.coalesce(x["real"], F.lit(0))),
        "container": _last(items, lambda x: x["type"].isin(kinds) & x["container"].isNotNull(), value("container")),
        "depth_medium": first("bit_depth", "depth_medium"), "crc32": _first(items, lambda x: x["checksum"], value("raw")),
        "tagged_multi": _any(items, value("multi")),
    }


@once
def _noted() -> Column:
    """All evidence of the walk, in order of spans."""
    noted = F.concat(*(F.transform(x, _keyed(0)) for x in (F.col("t.origins"), F.col("n.origins"), _other_origins(F.col("items"), F.col("r")))))
    return F.transform(F.array_sort(noted, _by_place), lambda x: x["o"])


def _keyed(_):
    return lambda x, i: F.struct(x["ord"].alias("ord"), i.alias("sub"), x["o"].alias("o"))


def _by_place(a: Column, b: Column) -> Column:
    return F.when(a["ord"] != b["ord"], a["ord"] - b["ord"]).otherwise(a["sub"] - b["sub"])


def _rules(df: DataFrame, columns: list[str] | None) -> DataFrame:
    *stages, shown = _rule_stages()
    for stage in stages:
        df = df.withColumns(stage)
    shown = [c for name, c in shown.items() if columns is None or name in columns]
    # A generator of one row: conditions on the record are evaluated on its
    # columns, and never rewritten into copies of the expressions above.
    return df.select(F.inline(F.array(F.struct(*shown))))


@once
def _rule_stages() -> list:
    """What the whole name says after the fold: fills what is empty; only a range
    of whole markers replaces what spans said."""
    stages = []
    name, noted = F.col("name"), F.col("noted")
    none = F.array().cast(f"array<{ORIGIN}>")
    empty = F.col("t.title") == ""
    promoted = F.array_position(F.transform(noted, lambda o: o["field"]), "alternate_title")
    promote = empty & (F.size("t.alternatives") > 0)
    retitled = F.transform(noted, lambda o, i: F.when(promote & (i + 1 == promoted), o.withField("field", F.lit("title"))).otherwise(o))
    # an alternative's place also without evidence: it is the first span of its kind
    first_end = _first(F.col("items"), lambda x: x["type"] == "ALT", lambda x: x["end"])
    stages.append({
        "title": F.when(promote, F.get("t.alternatives", F.lit(0))).otherwise(F.col("t.title")),
        "alternative_titles": F.when(promote, F.slice("t.alternatives", F.lit(2), F.size("t.alternatives"))).otherwise(F.col("t.alternatives")),
        "title_end": F.when(promote, first_end).otherwise(F.col("t.title_end")),
        "noted": retitled.cast(f"array<{ORIGIN}>"),
    })
    end = F.col("title_end")
    tail = F.when((end >= 0) & (end < F.octet_length(name)), byte_slice(name, end)).otherwise(F.lit(""))
    place = lambda pattern: (end + F.octet_length(group(tail, pattern, 1)), group(tail, pattern, 2))
    (at_3d, text_3d), (at_dub, text_dub) = place(LAYOUT_3D), place(BRACKETED_DUB)
    in_3d, in_dub = ~F.col("three_d") & (text_3d != ""), ~F.col("english_dub") & (text_dub != "")
    lead, s_text, gap, e_text = (group(name, WRITTEN, k) for k in (1, 2, 4, 5))
    s_at = F.octet_length(lead)
    e_at = s_at + F.octet_length(s_text) + F.octet_length(gap)
    fill_s, fill_e = (s_text != "") & F.col("n.season").isNull(), (s_text != "") & F.col("n.episode").isNull()
    written_s, written_e = integer(group(name, WRITTEN, 3)), integer(group(name, WRITTEN, 6))
    span = lambda field, value, text, at: origin(field, value, text, at, at + F.octet_length(text), 1.0)
    stages.append({
        "three_d": F.col("three_d") | in_3d, "english_dub": F.col("english_dub") | in_dub,
        "season": F.when(fill_s, written_s).otherwise(F.col("n.season")), "season_end": F.col("n.season_end"),
        "episode": F.when(fill_e, written_e).otherwise(F.col("n.episode")), "episode_end": F.col("n.episode_end"), "episode_count": F.col("n.count"),
        "noted": F.concat(
            noted, F.when(in_3d, F.array(span("three_d", "yes", text_3d, at_3d))).otherwise(none), F.when(in_dub, F.array(span("audio_language", "english dub", text_dub, at_dub))).otherwise(none),
            F.when(fill_s, F.array(span("season", written_s.cast("string"), s_text, s_at))).otherwise(none),
            F.when(fill_e, F.array(span("episode", written_e.cast("string"), e_text, e_at))).otherwise(none)),
    })

    # a range of whole markers
    g = [F.lit("")] + [group(name, MARKER_RANGE, k) for k in range(1, 11)]
    stages.append({"m": F.struct(
        F.octet_length(g[1]).alias("at"), g[2].alias("text"), integer(F.concat(g[3], g[5])).alias("s1"), integer(F.concat(g[4], g[6])).alias("e1"),
        integer(F.concat(g[7], g[9])).alias("s2"), integer(F.concat(g[8], g[10])).alias("e2"),
        F.octet_length(group(g[2], rf"^(?:{MARK})", 0)).alias("first_size"))})
    m = F.col("m")
    there = m["text"] != ""
    rising, same = there & (m["s2"] > m["s1"]), there & (m["s2"] == m["s1"]) & (m["e2"] > m["e1"])
    count = m["e2"] - m["e1"] + 1
    totals = F.transform(groups(name, r"\((\d{2,4})\)", 1, False), integer)
    contradicted = F.exists(totals, lambda x: ~x.between(1900, 2100) & (x != count))
    runs_on = rising & (m["e2"] > m["e1"]) & (m["e2"] > (m["s2"] - m["s1"] + 1) * 30) & ~contradicted
    whole = lambda field, value, sure=1.0, size=None: origin(field, value, m["text"], m["at"], m["at"] + (F.octet_length(m["text"]) if size is None else size), sure)
    kept = F.filter(noted, lambda o: ~there | ~o["field"].isin("season", "episode"))
    e1, s1 = m["e1"].cast("string"), m["s1"].cast("string")
    stages.append({
        "season": F.when(there, m["s1"]).otherwise(F.col("season")), "season_end": F.when(there, F.when(rising, m["s2"])).otherwise(F.col("season_end")),
        "episode": F.when(there, F.when(~rising | runs_on, m["e1"])).otherwise(F.col("episode")),
        "episode_end": F.when(there, F.when(same | runs_on, m["e2"])).otherwise(F.col("episode_end")),
        "episode_count": F.when(there, F.when(same | runs_on, count)).otherwise(F.col("episode_count")),
        "pack": F.col("n.pack") | F.col("marked_pack") | rising | same, "pack_marked": F.col("marked_pack") | rising,
        "noted": F.concat(
            kept, F.when(there, F.array(whole("season", s1))).otherwise(none), F.when(rising, F.array(whole("pack_marker", m["text"]))).otherwise(none),
            F.when(runs_on, F.array(whole("episode", e1, 0.75))).when(there & ~rising, F.array(whole("episode", e1, 1.0, F.when(~same, m["first_size"]).otherwise(F.octet_length(m["text"]))))).otherwise(none)),
    })

    # verdicts
    verdict = lambda v: F.col(f"v_{v}")
    numbering, scope = verdict("numbering")["value"], verdict("pack_scope")["value"]
    overruled = F.coalesce((numbering == "absolute") & F.col("n.combined") & F.col("season").isNotNull() & (F.col("episode") > 0), F.lit(False))
    single = F.coalesce(scope.isin("complete", "season", "multi_season", "episode_batch") & (F.col("episode") > 0) & F.col("episode_end").isNull() & ~F.col("pack_marked"), F.lit(False))
    stages.append({"numbering": F.when(overruled, F.lit("season_episode")).otherwise(numbering), "pack_scope": F.when(single, F.lit("single")).otherwise(scope), "single": single})
    medium = F.coalesce(C.medium_of_container(F.col("container")), F.col("depth_medium"), C.medium_of_content(verdict("content")["value"]))
    moves = F.coalesce((F.col("numbering") == "absolute") & (F.col("episode") > 0), F.lit(False))
    scoped = F.coalesce(F.col("pack_scope").isin("complete", "season", "multi_season", "episode_batch", "volume"), F.lit(False))
    said = lambda field, value, v: F.when(F.coalesce(value, F.lit("")) != "", F.array(origin(field, value, "", -1, -1, F.coalesce(verdict(v)["confidence"], F.lit(0.0))))).otherwise(none)
    clean = lambda c: F.when(c != "", c)
    shown = (
        "name_id", "name", (F.col("title") != "").alias("valid"), F.lit(False).alias("degraded"),
        clean(F.col("title")).alias("title"), "alternative_titles", clean(F.col("t.episode_title")).alias("episode_title"), "franchise_prefix",
        F.coalesce("t.year", F.year("t.date")).alias("year"), F.col("t.date").alias("date"), "season", "season_end",
        F.when(~moves, F.col("episode")).alias("episode"), F.when(~moves, F.col("episode_end")).alias("episode_end"),
        F.when(moves, F.col("episode")).alias("absolute_episode"), F.when(moves, F.col("episode_end")).alias("absolute_episode_end"), "episode_count",
        F.when(F.col("r.lines") > 0, F.concat(F.col("r.lines").cast("string"), F.lit("p"))).alias("screen_size"), F.col("r.downscaled").alias("downscaled"),
        "source", "streaming_service", "video_codec", "ten_bit", "hdr", "hdr10", "hdr10_plus", "hlg", "dolby_vision", "audio_codec", "audio_channels", "audio_profile",
        F.get("editions", F.lit(0)).alias("edition"), "editions", "proper", "repack", "revision_version", "revision_real", "remux", "light_encode", "hybrid", "ai_upscale", "three_d",
        "languages", "subtitle_languages", "subtitle_format", "dual_audio", (F.col("tagged_multi") | (F.size("languages") > 2)).alias("multi_audio"), "english_dub", "multi_subs", "hard_subs",
        F.get("release_groups", F.lit(0)).alias("release_group"), "release_groups", (F.col("pack") | scoped).alias("pack"),
        (F.col("n.complete") | F.col("marked_complete") | F.coalesce(F.col("pack_scope") == "complete", F.lit(False))).alias("complete_range"),
        (F.col("marked_special") | F.coalesce(verdict("special")["value"].isin("ova", "special"), F.lit(False))).alias("specials"), "container", medium.alias("medium"), "crc32",
        verdict("content")["value"].alias("content"), verdict("adult")["value"].alias("adult"), verdict("anime")["value"].alias("anime"), "numbering", "pack_scope", verdict("special")["value"].alias("special"),
        *(verdict(v)["confidence"].alias(f"{v}_confidence") for v in ("content", "adult", "numbering", "pack_scope", "special", "anime")), "availability",
        F.concat(
            "noted", said("medium", medium, "content"), said("content_kind", verdict("content")["value"], "content"), said("adult_kind", verdict("adult")["value"], "adult"),
            said("numbering_kind", F.col("numbering"), "numbering"), said("pack_scope", F.col("pack_scope"), "pack_scope"), said("special_kind", verdict("special")["value"], "special"),
        ).alias("origins"),
    )
    return [*stages, {_alias(c): F.col(c) if isinstance(c, str) else c for c in shown}]


def _alias(c) -> str:
    return c if isinstance(c, str) else re.search(r" AS (\w+)'>$", str(c))[1]
