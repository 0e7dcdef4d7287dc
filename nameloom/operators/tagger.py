"""A transparent tagger of our own: spans by rules.

It is a stand-in for a trained segmenter: no accuracy is claimed.  A name is cut
into pieces between separators; a piece's type is the first rule it matches; the
title is what stands before the first typed piece, the group what follows the
last dash.  Everything is a Column expression, so it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rx
from .segments import guard

#: Type and pattern of a whole piece, in order of precedence.
RULES = [
    ("year", r"(?:19[3-9]\d|20[0-2]\d)"),
    ("resolution", r"\d{3,4}[pi]|4k|8k|uhd|fhd"),
    ("frame_size", r"\d{3,4}x\d{3,4}"),
    ("season_marker", r"s\d{1,2}(?:-s?\d{1,2})?"),
    ("season_episode_marker", r"cap\d{3,4}"),
    ("episode_marker", r"(?:e|ep)\d{1,4}(?:-e?\d{1,4})?|s\d{1,2}e\d{1,4}|\d{1,2}x\d{2,3}|\d{1,2}of\d{1,2}"),
    ("source_type", r"(?:uhd)?blu-?ray|b[dr]rip|bdremux|remux|web(?:-?dl|-?rip|hd)?|hdtv|pdtv|dvd(?:rip|5|9)?|hdrip|cam(?:rip)?|hdts|telesync|screener|dcp|bdmv"),
    ("platform", r"amzn|nf|netflix|dsnp|hmax|hulu|atvp|pcok|cr|itunes|ip"),
    ("codec", r"[xh]-?26[456]|hevc|avc|xvid|divx|av1|vp9|vc-?1|mpeg-?2"),
    ("bit_depth", r"(?:8|10|12)-?bits?|hi10p"),
    ("hdr", r"hdr(?:10(?:\+|plus)?)?|dv|dovi|hlg|sdr"),
    ("audio_codec", r"(?:dd[p+]?|e?ac3|aac|dts(?:-?hd)?(?:-?ma)?|truehd|flac|opus|mp3|pcm)"),
    ("audio_channels", r"[257]\.[01]|[268]ch"),
    ("audio_feature", r"atmos|dts-?x"),
    ("audio_language", r"german|french|truefrench|italian|spanish|english|japanese|russian|hindi|korean|ita|eng|ger|fre|jpn|rus"),
    ("subtitle_language", r"subs?|esubs?|vostfr|engsub|multisubs?"),
    ("dual_audio_tag", r"dual(?:-?audio)?|multi"),
    ("edition", r"proper|repack\d?|rerip|extended|unrated|uncut|remastered|imax|internal|limited|theatrical|v[2-9]|hybrid|3d|hsbs"),
    ("pack_marker", r"complete|batch|integrale"),
    ("special_marker", r"ova|oad|ncop\d?|nced\d?|special"),
    ("crc32", r"\[?[0-9A-F]{8}\]?"),
    ("file_extension", r"mkv|mp4|avi|m2ts|srt|ass|flac|mp3|epub|pdf|zip|rar"),
]
SEPARATORS = r" ._\[\](){}+"


def piece_type(piece: Column) -> Column:
    found = F
    for kind, pattern in RULES:
        found = found.when(piece.rlike(rx(rf"^(?:{pattern})$", kind != "crc32")), kind)
    return found.otherwise(F.lit(None).cast("string"))


def rule_spans(name: Column) -> Column:
    """array<struct<ord, type, begin, end, confidence>> of one name; empty where
    the guard doesn't let it through."""
    # layouts of channels hold a dot, a season may be glued to its episode, a group follows the last dash: cut out first
    pieces = F.regexp_extract_all(name, F.lit(rf"(?i)[257]\.[01](?![0-9])|s\d{{1,2}}(?=e\d)|(?:ddp?|aac|e?ac3|dts|flac|opus|truehd)(?=[257]\.[01](?![0-9]))|-(?=[^\-{SEPARATORS}]+(?:\.[a-z0-9]{{2,4}})?$)|[{SEPARATORS}]+|(?:(?!-[^\-{SEPARATORS}]+(?:\.[a-z0-9]{{2,4}})?$)[^{SEPARATORS}])+"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int,text:string>>").alias("out"))
    placed = F.aggregate(pieces, start, lambda s, x: F.struct(
        (s["at"] + F.octet_length(x)).alias("at"),
        F.concat(s["out"], F.array(F.struct(s["at"].alias("begin"), (s["at"] + F.octet_length(x)).alias("end"), x.alias("text"))).cast("array<struct<begin:int,end:int,text:string>>")).alias("out"),
    ), lambda s: s["out"])
    typed = F.transform(placed, lambda p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), p["text"].alias("text"), F.when(~p["text"].rlike(rf"^[{SEPARATORS}]+$"), piece_type(p["text"])).alias("type")))
    word = lambda p: ~p["text"].rlike(rf"^[\-{SEPARATORS}]+$")
    sure = F.lit(0.5).cast("float")

    def spans(t):
        first = F.get(F.filter(t, lambda p: p["type"].isNotNull() & (p["begin"] > 0)), F.lit(0))
        head = F.filter(t, lambda p: word(p) & (p["begin"] < F.coalesce(first["begin"], F.lit(2**31 - 1))) & (p["type"].isNull() | (p["begin"] == 0)))
        dash = F.try_element_at(F.filter(t, lambda p: p["text"] == "-"), F.lit(-1))
        group = F.get(F.filter(t, lambda p: word(p) & p["type"].isNull() & (p["begin"] == dash["end"]) & (p["begin"] > first["begin"])), F.lit(0))
        main = F.when(F.size(head) > 0, F.array(F.struct(F.lit("MAIN").alias("type"), F.get(head, F.lit(0))["begin"].alias("begin"), F.element_at(head, -1)["end"].alias("end"))))
        rest = F.transform(F.filter(t, lambda p: p["type"].isNotNull() & (p["begin"] > 0)), lambda p: F.struct(p["type"].alias("type"), p["begin"].alias("begin"), p["end"].alias("end")))
        last = F.when(group.isNotNull(), F.array(F.struct(F.lit("release_group").alias("type"), group["begin"].alias("begin"), group["end"].alias("end"))))
        none = F.array().cast("array<struct<type:string,begin:int,end:int>>")
        every = F.array_sort(F.concat(F.coalesce(main, none), rest, F.coalesce(last, none)), lambda a, b: a["begin"] - b["begin"])
        return F.transform(every, lambda p, i: F.struct(i.alias("ord"), p["type"].alias("type"), p["begin"].alias("begin"), p["end"].alias("end"), sure.alias("confidence")))

    found = F.element_at(F.transform(F.array(typed), spans), 1)
    return F.when(guard(name) == "ok", found).otherwise(F.array().cast("array<struct<ord:int,type:string,begin:int,end:int,confidence:float>>"))


def tag(names: DataFrame) -> DataFrame:
    """name_id, name to spans, a row each, with the name."""
    spans = names.select("name_id", "name", F.explode(rule_spans(F.col("name"))).alias("s"))
    return spans.select("name_id", "name", "s.ord", "s.type", "s.begin", "s.end", "s.confidence")
