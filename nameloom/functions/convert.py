"""Converters: the text of a span to its canonical value, as Column expressions.

Unknown values are null.  Markers are structs of first, last, count and stated,
where last is 0 if the marker is no range.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .text import LATIN, FOREIGN_CLASS, ascii_lower, ascii_upper, choose, contains_any, erase, group, groups, has, has_foreign_script, has_latin_word, integer, let, rx, simplified, starts_any, trimmed, without

# What may stand before and after a word of its own.
OPEN, CLOSE = r"(?:^|[ ._\-/\[(,+~&;])", r"(?:$|[ ._\-/\]),+~&;])"


# --- resolution

# Heights and widths that stand for a resolution without a unit, and spellings of sizes.
BARE = [240, 288, 360, 400, 432, 480, 540, 576, 720, 900, 1080, 1440, 2160, 4320, 2560, 3840, 4096, 7680]
DIMENSIONS = r"(?<!\d)(\d{3,4})\s*[xX*]\s*(\d{3,4})(?!\d)"
SCANNED = r"(?<!\d)(\d{3,4})[pi](?:\d{2,3})?\b"
WIDE = 2560


def _lines(number: Column) -> Column:
    """The lines of a single number, which is a width from 2560 on."""
    return F.when(number >= WIDE, F.floor(number * 9 / 16)).otherwise(number).cast("int")


def tier_of_lines(lines: Column) -> Column:
    """The nearest tier; the lower one of two equally near; none under 200 lines."""
    t = vocab.TIERS
    cases = [(lines < 200, F.lit(None).cast("int"))]
    cases += [(lines * 2 <= a + b, F.lit(a)) for a, b in zip(t, t[1:])]
    return choose((lines.isNull(), F.lit(None).cast("int")), *cases, default=F.lit(t[-1]))


def resolution_lines(token: Column) -> Column:
    """The highest tier the token states, in lines."""

    def read(s):
        widths, heights = groups(s, DIMENSIONS, 1, False), groups(s, DIMENSIONS, 2, False)
        sized = F.zip_with(widths, heights, lambda w, h: F.greatest(F.floor(integer(w) * 9 / 16).cast("int"), integer(h)))
        scanned = F.transform(groups(s, SCANNED), lambda x: _lines(integer(x)))
        rest = F.regexp_replace(F.regexp_replace(s, rx(DIMENSIONS, False), "|"), rx(SCANNED), "|")
        bare = F.filter(F.transform(groups(rest, r"(?<!\d)(\d{3,4})(?!\d)", 1, False), integer), lambda x: x.isin(BARE))
        bare = F.transform(bare, _lines)
        exact = F.concat(sized, scanned, bare)
        words = groups(s, OPEN + r"(4K|4\x{041A}|4\x{043A}|UHD|Ultra[ ._-]?HD|8K|FHD|FullHD|Full[ ._-]HD|SD)" + CLOSE)
        words = F.transform(words, lambda w: let(without(ascii_upper(w), " .-_"), lambda v: choose(
            (v == "8K", F.lit(4320)),
            (v.isin("UHD", "ULTRAHD"), F.when(F.size(exact) == 0, F.lit(2160))),  # yields to a size
            (v.startswith("4"), F.lit(2160)),
            (v == "SD", F.lit(480)),
            default=F.lit(1080),
        )))
        thousands = F.transform(groups(s, OPEN + r"([235679])[ ._-]?K" + CLOSE), lambda k: integer(k) * 576)
        return tier_of_lines(F.array_max(F.concat(exact, words, thousands)))

    zeros = F.regexp_replace(token, rx(r"(?<=\d)[oO](?=[\dpi])|(?<=[oO])[oO](?=[\dpi])", False), "0")
    return let(zeros, read)


def resolution(token: Column) -> Column:
    return F.concat(resolution_lines(token).cast("string"), F.lit("p"))


# --- source

# Names of discs and of bare UHD.
DISCS = "AVCHD BD100 BD25 BD5 BD50 BD66 BD9 BDBOX BDISO BDMUX BLURAYRIP BR BRMUX DEBD DS4K FRBD ITBD JPBD UHD UHD2BD UHDBD UKBD USBD".split()
UHD_WORDS = ["UHD", "4K", "UHDRDV", "UHDR", "ULTRAHD"]


def source_key(token: Column) -> Column:
    """Upper case without brackets and separators, and without a resolution at the end."""
    return erase(without(ascii_upper(token), "[](){} ._-"), r"\d{3,4}PI?$")


def source_of_key(v: Column) -> Column:
    return choose(
        (v.isin("UHDRDV", "UHDR", "ULTRAHD"), "BluRay"),
        (v.isin("35MM", "16MM", "LPP") | v.contains("FILMSCAN"), "Film"),
        (v.isin("TS", "TC", "TSHQ", "CAM") | contains_any(v, "TELESYNC", "TELECINE", "HDTS", "HDTC", "CAMRIP", "HDCAM"), "CAM"),
        (v.isin("DCP", "DCPRIP"), "DCP"),
        (v.isin("SCREENER", "SCR", "WORKPRINT", "WEBSCR"), "Screener"),
        (v.contains("WEB") & v.contains("DL"), "WEB-DL"),
        (v.contains("WEB") & v.contains("RIP"), "WEBRip"),
        (v.contains("WEB"), "WEB"),
        (v == "DLMUX", "WEB-DL"),
        (v.isin("DTV", "SITERIP", "SDTV", "DVB", "DSR", "TV", "IPTV", "FEED", "LDTV") | contains_any(v, "HDTV", "TVRIP", "PDTV", "SATRIP", "DVBRIP", "DSRIP", "VHS", "DSRRIP"), "HDTV"),
        (v.isin("R5", "LD", "LASERDISC", "LDRIP", "SVCD", "VCD") | contains_any(v, "DVD", "DVRIP"), "DVD"),
        (v.contains("HDRIP"), "HDRip"),
        (v.isin("DLRIP", "FBRIP", "STREAMRIP"), "WEBRip"),
        (v.isin("VOD", "VODHD"), "WEB-DL"),
        (v.endswith("DL") & starts_any(v, "CR", "NETFLIX", "NF", "AMZN", "DSNP", "ITUNES", "HMAX"), "WEB-DL"),
        (v.endswith("RIP") & starts_any(v, "NETFLIX", "NF", "AMZN", "DSNP", "ITUNES", "HMAX"), "WEBRip"),
        (contains_any(v, "REMUX", "BDMV") | (v == "DISC") | v.isin(DISCS), "BluRay"),
        (contains_any(v, "蓝光", "藍光", "BRDRIP", "ブルーレイ"), "BluRay"),
        (contains_any(v, "BLURAY", "BDRIP", "BRRIP", "BLUURY", "BLUERAY") | v.isin("BD", "BURAY"), "BluRay"),
    )


def source(token: Column) -> Column:
    return let(source_key(token), source_of_key)


def source_is_remux(token: Column) -> Column:
    return source_key(token).contains("REMUX")


def source_is_light(token: Column) -> Column:
    return source_key(token).isin("MICROHD", "HDLIGHT", "MHD")


def source_is_bare_uhd(token: Column) -> Column:
    return source_key(token).isin(UHD_WORDS)


def source_extras(token: Column) -> Column:
    """lines, hdr10, dolby_vision that a compound source token states; null if none."""
    return let(source_key(token), lambda v: F.when(v.isin(UHD_WORDS), F.struct(F.lit(2160).alias("lines"), v.isin("UHDRDV", "UHDR").alias("hdr10"), (v == "UHDRDV").alias("dolby_vision"))))


# --- video

def video_codec(token: Column) -> Column:
    v = ascii_upper(token)
    return choose(
        (v.contains("AV1"), "AV1"),
        (contains_any(v, "265", "HEVC"), "HEVC"),
        (contains_any(v, "262", "MPG2"), "MPEG2"),
        (contains_any(v, "264", "AVC"), "H264"),
        (contains_any(v, "XVID", "DIVX"), "XviD"),
        (contains_any(v, "MPEG2", "MPEG-2"), "MPEG2"),
        (v.contains("VP9"), "VP9"),
        (contains_any(v, "VC-1", "VC1"), "VC1"),
        (starts_any(v, "HI10", "HI444"), "H264"),
        (starts_any(v, "MAIN10", "MA10"), "HEVC"),
        (v.contains("WMV"), "WMV"),
        (contains_any(v, "VVC", "H266", "H.266"), "VVC"),
        (v.contains("VP8"), "VP8"),
        (contains_any(v, "RV10", "RV20", "RV30", "RV40", "REALVIDEO"), "RealVideo"),
        (contains_any(v, "MPEG4", "MPEG-4"), "XviD"),
        (v.contains("MPEG"), "MPEG2"),
    )


# Spellings of HDR formats, strongest first.
HDR_SPELLINGS = [
    (r"\b(DV|DoVi|D\.V|Dolby[ ._-]?Vision)(?:[ ._-]?P[578])?\b", "DV"),
    (r"\b(HDR10\s*(?:\+|Plus|P\b))(?!\d)", "HDR10+"),
    (OPEN + "(HLG)" + CLOSE, "HLG"),
    (r"\b(HDR(?:10)?)\b", "HDR10"),
    (r"\b(SDR)\b", "SDR"),
]


def hdr(token: Column) -> Column:
    """The strongest format by the strict spellings, else by what it contains."""
    v = ascii_upper(token)
    return choose(
        *((has(token, p), label) for p, label in HDR_SPELLINGS),
        (v.contains("DV") & v.contains("HDR"), "DV"),
        (contains_any(v, "HDR10+", "HDR10P"), "HDR10+"),
        (v.contains("HDR"), "HDR10"),
    )


def hdr_rank(format: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, vocab.HDR_ORDER)), format) - 1, F.lit(0)).cast("int")


# Spellings of bit depths, in order.
DEPTH_SPELLINGS = [
    (r"\b(10[ ._-]?bits?)\b", "10bit"),
    (r"\b(10b)\b", "10bit"),
    (r"\b(Hi10P?)\b", "10bit"),
    (r"(?:HEVC|AVC|VP9|AV1|x26[45]|h[ ._-]?26[45])[ ._-]?(10)\b", "10bit"),
    (r"\b(Ma(?:in)?10P?)\b", "10bit"),
    (r"\b(YUV\d{3}P10)\b", "10bit"),
    (r"\b(8[ ._-]?bits?)\b", "8bit"),
    (r"\b(12[ ._-]?bits?)\b", "12bit"),
]


def bit_depth(token: Column) -> Column:
    bare = group(token, r"^\s*(8|10|12)\s*$", 1, False)
    return choose(*((has(token, p), v) for p, v in DEPTH_SPELLINGS), (bare != "", F.concat(bare, F.lit("bit"))))


# --- editions

def edition(token: Column) -> Column:
    """The label of the first spelling that matches."""
    return choose(*((has(token, p), label) for p, label in vocab.EDITIONS))


def editions(token: Column) -> Column:
    """All labels that match, by id."""
    ids = {label: k for k, label in enumerate(vocab.EDITION_LABELS, 1)}
    found = F.array_compact(F.array(*(F.when(has(token, p), F.lit(ids[label])) for p, label in vocab.EDITIONS)))
    return edition_labels(F.array_sort(F.array_distinct(found)))


def edition_labels(ids: Column) -> Column:
    labels = F.array(*map(F.lit, vocab.EDITION_LABELS))
    return F.transform(ids, lambda k: F.element_at(labels, k))


# --- audio

# Fixed value: a layout of channels at the end of a codec.
LAYOUT = r"[ ._-]?(?:2[ ._]?0|5[ ._]?1|7[ ._]?1|6[ ._]?CH|\d[ ._]?\dch|ch)\s*$"


def audio_profile(token: Column) -> Column:
    v = without(ascii_upper(trimmed(token)), " ._-:")
    return choose((v.contains("ATMOS"), "Atmos"), (v.contains("DTSX"), "DTS:X"), (v.contains("AURO3D") | (v == "AURO"), "Auro-3D"))


def _audio_key(token: Column) -> Column:
    v = F.replace(ascii_upper(trimmed(token)), F.lit("ATMOS"), F.lit(""))
    v = erase(erase(erase(trimmed(v), LAYOUT), r"^\d+[ ._-]?X[ ._-]?"), r"[ ._-]?X[ ._-]?\d+$")
    return without(v, " _-.")


def _audio_of_key(v: Column) -> Column:
    return choose(
        (v.contains("TRUEHD") | v.startswith("THD"), "TrueHD"),
        (contains_any(v, "DTSHD", "DTSMA", "DTSHR"), "DTS-HD MA"),
        (v.contains("DTSX"), "DTS:X"),
        (v.contains("DTS"), "DTS"),
        (contains_any(v, "EAC3", "DDP", "DD+", "DOLBYDIGITALPLUS", "DOLBYDPLUS"), "DDP"),
        (contains_any(v, "AC3", "DOLBYD") | (v == "DD"), "DD"),
        (v.contains("AAC") | (v == "ACC"), "AAC"),
        (v.contains("FLAC"), "FLAC"),
        (v.contains("OPUS"), "OPUS"),
        (contains_any(v, "VORBIS", "OGG"), "VORBIS"),
        (v.contains("ALAC"), "ALAC"),
        (v.contains("PCM") | (v == "WAV"), "PCM"),
        (v.contains("MP3"), "MP3"),
        (v.contains("WMA"), "WMA"),
        (v == "APE", "APE"),
        (v.contains("MP2"), "MP2"),
    )


def audio_codec(token: Column) -> Column:
    """Of a key no codec knows, digits at the end go one by one."""

    def shorter(v):
        return _audio_key(F.when((F.length(v) > 2) & v.rlike("[0-9]$"), v.substr(F.lit(1), F.length(v) - 1)).otherwise(F.lit("")))

    def read(v):
        # a step takes a character at least, so the key's length bounds the loop
        steps = F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1)))
        known = _audio_of_key(v)
        return F.when(known.isNotNull() | ~v.rlike("[0-9]$"), known).otherwise(
            _audio_of_key(F.aggregate(steps, v, lambda at, _: F.when(_audio_of_key(at).isNotNull() | (at == ""), at).otherwise(shorter(at)))))

    atmos = ascii_upper(token).contains("ATMOS")
    return F.coalesce(let(_audio_key(token), read), F.when(atmos, F.lit("Atmos")))


def audio_channels(token: Column) -> Column:
    v = F.translate(ascii_upper(token), " _", "..")
    v = F.regexp_replace(F.regexp_replace(v, "CH$", ""), r"\.+$", "")
    return choose((v.isin("8", "8.0"), F.lit("7.1")), (v.isin("6", "6.0"), F.lit("5.1")), (v == "2", F.lit("2.0")), (v == "", F.lit(None).cast("string")), default=v)


# --- numbers

# Numbers as words.
ORDINALS = "FIRST SECOND THIRD FOURTH FIFTH SIXTH SEVENTH EIGHTH NINTH TENTH".split()
ROMANS = "I II III IV V VI VII VIII IX".split()


def _numbers(first, last=0, count=1, stated=True) -> Column:
    value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(value(first).alias("first"), value(last).alias("last"), value(count).alias("count"), (stated if isinstance(stated, Column) else F.lit(stated)).alias("stated"))


def _marker(season, n: Column) -> Column:
    season = season if isinstance(season, Column) else F.lit(season)
    return F.struct(season.cast("int").alias("season"), n["first"].alias("first"), n["last"].alias("last"), n["count"].alias("count"), n["stated"].alias("stated"))


def marker_numbers(token: Column) -> Column:
    """A number, or a rising run of them: first, last, count, stated."""
    upper = ascii_upper(token)
    roman = group(upper, r"(?:^|[^A-Z])(X{0,1}(?:IX|IV|V?I{0,3}))$", 1, False)
    worded = choose(*((upper.contains(w), F.lit(k)) for k, w in enumerate(ORDINALS, 1)), *((roman == r, F.lit(k)) for k, r in enumerate(ROMANS, 1)))

    def fold(found):
        start = F.struct(F.element_at(found, 1).alias("at"), F.lit(0).alias("last"), F.lit(1).alias("count"), F.lit(True).alias("open"))

        def step(s, x):
            go = s["open"] & (x > s["at"])
            return F.struct(F.when(go, x).otherwise(s["at"]).alias("at"), F.when(go, x).otherwise(s["last"]).alias("last"), (s["count"] + go.cast("int")).alias("count"), go.alias("open"))

        return F.aggregate(F.slice(found, F.lit(2), F.size(found)), start, step, lambda s: _numbers(F.element_at(found, 1), s["last"], s["count"]))

    digits = F.transform(groups(token, r"(\d{1,4})", 1, False), integer)
    none = _numbers(0, 0, 0, False)
    wordy = F.when(worded.isNotNull(), _numbers(worded)).otherwise(none)
    return F.when(~upper.rlike("[0-9]"), F.when(worded.isNotNull(), wordy).otherwise(let(digits, lambda d: F.when(F.size(d) > 0, fold(d)).otherwise(none)))).otherwise(let(digits, lambda d: F.when(F.size(d) > 0, fold(d)).otherwise(none)))


# Spellings of markers.
CROSS = r"^(?:ep(?:isode)?[ ._-]?)?(\d{1,2})[ ._-]?[x×][ ._-]?(\d{1,4})(?:[ ._]?[-–][ ._]?(?:(\d{1,2})[x×])?(\d{1,4}))?$"
LETTERED = r"^[st](\d{1,2})[ ._-]?x?[ ._-]?e(\d{1,4})$"
POSITION = r"^(\d{1,4})[ ._-]?of[ ._-]?(\d{1,4})$"
CHAPTER = r"^cap(?:[ií]tulos?)?[ ._-]?\d{3,4}(?:[ ._-]?[x_-][ ._-]?(?:cap[ ._-]?)?\d{3,4})*$"


def episode_marker(token: Column) -> Column:
    """season (0 if not stated), first, last, count, stated."""

    def crossed(t):
        season, first, other, last = (group(t, CROSS, k) for k in (1, 2, 3, 4))
        season, first, last = integer(season), integer(first), integer(last)
        ranged = (last > first) & ((other == "") | (integer(other) == season))
        return _marker(season, F.when(ranged, _numbers(first, last, last - first + 1)).otherwise(_numbers(first)))

    return F.when(has(token, CHAPTER), season_episode_marker(token)).when(has(token, CROSS), crossed(token)).when(
        has(token, LETTERED), _marker(integer(group(token, LETTERED, 1)), _numbers(integer(group(token, LETTERED, 2))))
    ).when(has(token, POSITION), _marker(0, _numbers(integer(group(token, POSITION, 1))))).otherwise(let(marker_numbers(token), lambda n: _marker(0, n)))


def season_episode_marker(token: Column) -> Column:
    """One number for both: the last two digits are the episode."""

    def read(d):
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        left, right = d.substr(F.lit(1), half), d.substr(half + 1, half)
        stem = lambda x, size: x.substr(F.lit(1), size - 2)
        tail = lambda x, size: integer(x.substr(size - 1, F.lit(2)))
        a, b = tail(left, half), tail(right, half)
        ranged = F.when(b > a, _numbers(a, b, b - a + 1)).otherwise(_numbers(a))
        return F.when((n >= 6) & (n % 2 == 0) & (stem(left, half) == stem(right, half)), _marker(integer(stem(left, half)), ranged)).when(
            n < 3, let(marker_numbers(token), lambda m: _marker(0, m))
        ).otherwise(_marker(integer(stem(d, n)), _numbers(tail(d, n))))

    return let(F.regexp_replace(token, "[^0-9]", ""), read)


# --- containers, checksums, depths

MEDIUM_OF = {ext: medium for medium, found in vocab.CONTAINERS.items() if medium != "other" for ext in found}


def medium_of_container(container: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MEDIUM_OF.items() for x in pair))
    return F.try_element_at(table, ascii_lower(container))


def container(token: Column) -> Column:
    v = F.regexp_extract(ascii_lower(trimmed(token)), r"([^.]*)$", 1)
    return F.when(v.rlike("^[a-z0-9]{1,9}$") & v.isin(list(MEDIUM_OF)), v)


def is_checksum(token: Column) -> Column:
    return without(token, "[](){} _-.").rlike("^[0-9A-Fa-f]{8}$")


def states_sample_depth(token: Column) -> Column:
    return has(token, r"\b(?:16|24|32)[ ._-]?(?:bits?|BIT)\b|\b(?:16|24)[ ._-](?:44|48|88|96|176|192)\b|\b(?:16|24|32)[ ._-]?bits?[ ._-]?(?:\d+(?:\.\d+)?[ ._-]?k?hz)?\b")


def states_bitness(token: Column) -> Column:
    return has(token, r"\b(?:32|64)[ ._-]?bits?\b|\bx(?:86|64)[ ._-]?(?:32|64)?\b")


def medium_of_content(content: Column) -> Column:
    return choose(
        (content.isin("movie", "series", "live_action_movie", "live_action_series", "animated_movie", "animated_series"), "video"),
        (content.isin("music", "software", "game"), content), (content == "book_document", "book"), (content == "comic_manga", "comic"),
    )


# --- languages and subtitles

# What may stand around a language, and what decorates it.
EDGE = r"[ ._\-/\[(,+~&;|]", r"[ ._\-/\]),+~&;|]"
DECORATION = r"(?:^\d+[ ._-]?x[ ._-]?)|(?:[ ._-]?x\d+$)|SOFT|HARD|FORCED|FULL|INC|MTL|SUBBED|SUBTITLES?|SUBS?|TITULKY|TIT|NAPISY|LEGENDA(?:DO|S)?|DUB(?:BED)?|AUDIO|SRT|ASS|SSA|SUP|PGS|IDX|VOB"


def _codes(token: Column) -> Column:
    rows = (F.when(has(token, f"(?:^|{EDGE[0]})(?:{p})(?:$|{EDGE[1]})"), F.lit(code)) for p, code in vocab.LANGUAGES)
    return F.array_distinct(F.array_compact(F.array(*rows)))


def _plain_languages() -> dict[str, list[str]]:
    """Codes of the words of ASCII letters that the table spells out, in capitals:
    no edge lies inside such a word, so only a pattern that matches all of it does."""
    words = {w for p, _ in vocab.LANGUAGES for w in p.split("|") if re.fullmatch("[A-Z]{2,}", w)}
    rows = [(re.compile(_python_pattern(p), re.I), code) for p, code in vocab.LANGUAGES]
    return {w: list(dict.fromkeys(code for p, code in rows if p.fullmatch(w))) for w in sorted(words)}


def _python_pattern(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern)


PLAIN_LANGUAGES = _plain_languages()


def languages(token: Column) -> Column:
    """ISO 639-3 codes: of the token, else of the token without decoration, else of its parts."""
    plain = F.create_map(*(c for word, codes in PLAIN_LANGUAGES.items() for c in (F.lit(word), F.array(*map(F.lit, codes)))))
    bare = trimmed(erase(token, DECORATION))
    split = F.filter(F.split(token, r"[ ._\-+|&/,()\[\]]"), lambda x: x != "")
    humps = F.flatten(F.transform(split, lambda p: let(F.split(p, "(?<=[a-z])(?=[A-Z])"), lambda h: F.when(F.size(h) > 1, h).otherwise(F.array().cast("array<string>")))))
    parts = F.flatten(F.transform(F.concat(split, humps), lambda p: F.array(p, trimmed(erase(p, DECORATION)))))
    # one look over all parts in turn: rows of the table in order within each part
    ofparts = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.when(p == "", F.array().cast("array<string>")).otherwise(_codes(p)))))
    first = _codes(token)
    second = F.when((bare != "") & (bare != token), _codes(bare)).otherwise(F.array().cast("array<string>"))
    searched = let(first, lambda a: F.when(F.size(a) > 0, a).otherwise(let(second, lambda b: F.when(F.size(b) > 0, b).otherwise(ofparts))))
    # a word that the table spells out needs no search
    return F.coalesce(F.try_element_at(plain, ascii_upper(token)), searched)


# The patterns of subtitles and of the flag readers below are fixed values too.

def subtitle_format(token: Column) -> Column:
    v = ascii_upper(token)
    return choose((contains_any(v, "VOBSUB", "IDX"), "VobSub"), (contains_any(v, "PGS", "SUP"), "PGS"), (v.contains("SRT"), "SRT"), (v.contains("VTT"), "VTT"), (v.contains("SMI"), "SMI"), (contains_any(v, "SSA", "ASS"), "ASS"))


def states_subtitles(token: Column) -> Column:
    return has(trimmed(token), r"^\W*(?:\d+[ ._-]?x[ ._-]?)?(?:ASS|SSA|SRT|SUP|PGS|IDX|VOB[ ._-]?SUB|DVD[ ._-]?SUB|D[ ._-]?SUB|CC|SOFT[ ._-]?SUBS?|HARD[ ._-]?SUBS?|SOFT|SUBBED|SUBTITLES?|SUBS?|W[ ._-]?SUBS?|INC[ ._-]?SUBS?)(?:[ ._-]?x?\d+)?\W*$")


def states_several_subtitles(token: Column) -> Column:
    return has(token, r"\b(?:MULTI?[ ._-]?(?:SUBS?|SUBTITLES?|SUBBED)|MULTIPLE[ ._-]?SUBTITLES?|DUAL[ ._-]?SUBS?|MORE[ ._-]?SUBTITLES?|MSUBS?|MULTI\d)\b") | has(token, r"\b(?:ASS|SSA|SRT|SUP|SUB)[ ._-]?x[ ._-]?[2-9]\b")


# --- platforms, dates, years

def platform(token: Column) -> Column:
    cleaned = without(trimmed(token), " ")
    table = F.create_map(*(F.lit(x) for pair in vocab.PLATFORMS.items() for x in pair))
    return let(without(ascii_upper(cleaned), "-.+_"), lambda key: F.coalesce(F.try_element_at(table, key), F.when(key == "IP", F.lit("iP")), F.when(cleaned != "", ascii_upper(cleaned))))


def _valid_dates(years: Column, months: Column, days: Column, year) -> Column:
    """The real dates among matches, in order."""
    zipped = F.zip_with(years, months, lambda y, m: F.struct(year(integer(y)).alias("y"), integer(m).alias("m")))
    dated = F.zip_with(zipped, days, lambda t, d: F.struct(t["y"].alias("y"), t["m"].alias("m"), integer(d).alias("d")))

    def real(t):
        y, m = t["y"], t["m"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        return (y >= 1) & m.between(1, 12) & (t["d"] >= 1) & (t["d"] <= last)

    return F.transform(F.filter(dated, real), lambda t: F.make_date(t["y"], t["m"], t["d"]))


def air_date(token: Column) -> Column:
    """The first real date: year first, then short years with separators, then six digits."""
    long = r"(?<!\d)(?=((?:19|20)\d{2})[ ._-]?(\d{2})[ ._-]?(\d{2})(?!\d))"
    parted = r"(?<!\d)(\d{2})[ ._-](\d{2})[ ._-](\d{2})(?!\d)"
    packed = r"(?<!\d)(?=(\d{2})(\d{2})(\d{2})(?!\d))"
    three = lambda p: [groups(token, p, k, False) for k in (1, 2, 3)]
    # a short year out of 06..30 makes no date
    found = (
        _valid_dates(*three(long), lambda y: y),
        _valid_dates(*three(parted), lambda y: F.when(y.between(6, 30), y + 2000).otherwise(F.lit(0))),
        _valid_dates(*three(packed), lambda y: F.when(y <= 79, y + 2000).otherwise(y + 1900)),
    )
    return F.coalesce(*(F.get(x, F.lit(0)) for x in found))


# A year, and a span of years.
YEAR = r"(?:189|19\d|20\d)\d"
# A look ahead for the first digit comes first: it is cheaper than one behind, at every place of a long name.
SPAN_OF_YEARS = rf"(?=[12])(?<![\dxX])({YEAR})[ ._]*(?:-|\x{{2013}}|\x{{2014}}|/|~|to|thru|through|bis|und|and|e|y|a)[ ._]*{YEAR}(?!\d)"


def year(token: Column) -> Column:
    """The start of a range of years, else the last year; frame sizes are none."""
    alone = groups(token, rf"(?=[12])(?<![\dxX])({YEAR})(?![\d]|\s*[xX]\s*\d{{3,4}})", 1, False)
    ranged = group(token, SPAN_OF_YEARS)
    return F.when(ranged != "", ranged.cast("int")).otherwise(let(alone, lambda a: F.when(F.size(a) > 0, F.element_at(a, -1).try_cast("int"))))


# --- titles and groups

def prefer_latin(title: Column) -> Column:
    """Of a title in two scripts the Latin part."""
    return let(simplified(title), _latin_of)


def _latin_of(s: Column) -> Column:
    kept = F.transform(F.split(s, " "), lambda t: F.regexp_replace(simplified(F.regexp_replace(t, f"[{FOREIGN_CLASS}]", " ")), rx(r"^[\s/|:;,\.\-–—]+|[\s/|:;,\.\-–—]+$", False), ""))
    kept = F.filter(kept, lambda t: t.rlike(rf"[{LATIN}]|\p{{Nd}}"))
    return F.when(has_foreign_script(s) & has_latin_word(s) & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(s)


def title(token: Column) -> Column:
    """A readable title: separators as spaces, a doubled title once."""

    def once(words):
        half = F.floor(F.size(words) / 2).cast("int")
        doubled = (F.size(words) >= 4) & (F.size(words) % 2 == 0) & (F.slice(words, F.lit(1), half) == F.slice(words, half + 1, half))
        return F.array_join(F.when(doubled, F.slice(words, F.lit(1), half)).otherwise(words), " ")

    def closed(s):
        # what may stand at the end is looked for there before the whole text is searched
        tail = rx(r"[\s(\[{:;|/\-]+$", False)
        return F.when(F.right(s, F.lit(2)).rlike(tail), F.regexp_replace(s, tail, "")).otherwise(s)

    spaced = F.replace(F.replace(token, F.lit("."), F.lit(" ")), F.lit("_"), F.lit(" "))
    # simplified already, and so is what is left of it without its end
    return let(let(let(F.split(simplified(spaced), " "), once), closed), _latin_of)


def release_group(token: Column) -> Column:
    v = F.regexp_replace(trimmed(token), rx(r"^(?:[\[({]\s*)+|(?:\s*[\])}])+$", False), "")
    v = F.regexp_replace(F.regexp_replace(trimmed(v), "^-+", ""), rx(r"\.(mkv|mp4|avi|ts|m2ts|wmv|mov|mp3|flac)$"), "")
    return F.when((v != "") & ~v.rlike(rx(r"^\d+$", False)), v)


def never_a_group(word: Column) -> Column:
    return ascii_lower(word).isin(vocab.REJECTED_GROUPS) | has(word, r"^(?:S\d{1,2}(?:E\d{1,4})?|E\d{1,4}|EP\d{1,3})$")


# --- flags

def is_multi_audio(c: Column) -> Column:
    return has(c, r"\b(?:Multi[ ._-]?Audio|MULTi(?![ ._-]?Sub))\b")


BEFORE, AFTER = r"(?:^|[ ._\-\[(])", r"(?:$|[^A-Za-z])"


def is_proper(c: Column) -> Column:
    return has(c, BEFORE + r"(?:REAL[ ._-]+)?PROPER(?:FIX)?" + AFTER)


def is_repack(c: Column) -> Column:
    return has(c, BEFORE + r"(?:REPACK(?:ED)?|RERIP(?:PED)?)[ ._-]?\d?" + AFTER)


def stated_revision(c: Column) -> Column:
    tag = integer(group(c, BEFORE + r"v(\d{1,2})(?:$|[^A-Za-z0-9])"))
    return F.greatest(tag, integer(group(c, BEFORE + r"(?:REPACK|RERIP|PROPER)[ ._-]?(\d)(?:$|[^A-Za-z0-9])")))


def real_count(c: Column) -> Column:
    """How often REAL stands alone; neighbours share the separator between them."""
    return F.size(groups(c, r"(?<![^ ._\-\[(])(REAL)(?=$|[^A-Za-z])"))


def is_ai_upscale(c: Column) -> Column:
    return has(c, r"\b(AI[ ._-]?(?:upscal\w*|enhanced?|generated?)|Topaz|upscaled?)\b|AI增强|AI生成|AI強化")


def is_light_encode(c: Column) -> Column:
    return has(c, BEFORE + r"(?:Version[ ._-]?Light|Light[ ._-]?Version|LightEncode)" + AFTER)


def is_hybrid(c: Column) -> Column:
    return has(c, OPEN + "Hybrid" + CLOSE)


def is_three_d(c: Column) -> Column:
    return has(c, r"(?:^|[ ._\-])(3D|(?:Half|Full)[ ._-]?SBS|HSBS|SBS|(?:Half|Full)[ ._-]?OU|HOU|OU|TAB)(?:$|[ ._\-])")


def is_dub(c: Column) -> Column:
    return has(c, r"dub(?:bed)?(?:$|[^a-z])")


def is_bare_dub(c: Column) -> Column:
    return has(c, r"^[\[\(]?\s*dub(?:bed)?\s*[\]\)]?$")


def is_remux(c: Column) -> Column:
    return has(c, r"\b(?:BD|UHD|Blu[ ._-]?Ray)?[ ._-]*REMUX(?=$|[ ._\-]|x26[45])")
