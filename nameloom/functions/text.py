"""Text primitives as Column expressions."""

from __future__ import annotations

import functools
import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import FOREIGN

WHITE = " \t\n\r\f\x0b"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Capitals of Latin-1 that fold to a letter 32 further on.
LATIN1 = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"
FOREIGN_CLASS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in FOREIGN)


def rx(pattern: str, caseless: bool = True) -> str:
    """A Java pattern with the meaning of a Unicode-aware search."""
    flags = ("iu" if caseless else "") + ("U" if re.search(r"\\[bBdDsSwW]", pattern) else "")
    return f"(?{flags}){pattern}" if flags else pattern


def has(c: Column, pattern: str, caseless: bool = True) -> Column:
    return c.rlike(rx(pattern, caseless))


def group(c: Column, pattern: str, n: int = 1, caseless: bool = True) -> Column:
    """Group n of the first match; empty without one."""
    return F.regexp_extract(c, rx(pattern, caseless), n)


def groups(c: Column, pattern: str, n: int = 1, caseless: bool = True) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern, caseless)), F.lit(n))


def erase(c: Column, pattern: str, caseless: bool = True) -> Column:
    return F.regexp_replace(c, rx(pattern, caseless), "")


def without(c: Column, characters: str) -> Column:
    return F.translate(c, characters, "")


def valid_utf8(c: Column) -> Column:
    """A text or its bytes as a valid string: each malformed sequence becomes the
    replacement character."""
    return F.make_valid_utf8(c.cast("string"))


def trimmed(c: Column, characters: str = WHITE) -> Column:
    return F.btrim(c, F.lit(characters))


def simplified(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[ \t\n\r\f\x0B]+", " "), F.lit(" "))


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fold_key(c: Column) -> Column:
    """Lower case of ASCII and Latin-1 letters, by which values are told apart."""
    return F.translate(c, UPPER + LATIN1, LOWER + "".join(chr(ord(x) + 32) for x in LATIN1))


def has_foreign_script(c: Column) -> Column:
    # only a text with more bytes than characters can hold one: the class is slow on long texts
    return (F.octet_length(c) > F.length(c)) & c.rlike(f"[{FOREIGN_CLASS}]")


def has_latin_word(c: Column) -> Column:
    return c.rlike(f"[{LATIN}]{{2}}")


def is_kana(c: Column) -> Column:
    """Kana decide for Japanese; Han alone decides nothing here."""
    return c.rlike(r"[぀-ゟ゠-ヺー-ヿㇰ-ㇿｦ-ﾟ]")


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def byte_slice(c: Column, begin: Column, end: Column | None = None) -> Column:
    """The part of a text between byte offsets; an offset inside a character
    gives the replacement character."""
    data = F.encode(c, "UTF-8")
    size = F.greatest((F.octet_length(c) if end is None else end) - begin, F.lit(0))
    return F.decode(F.substring(data, begin.cast("int") + 1, size.cast("int")), "UTF-8")


def byte_offset(c: Column, characters: Column) -> Column:
    """Bytes before the character of this 0-based index."""
    return F.octet_length(F.substring(c, F.lit(1), characters.cast("int")))


def contains_any(c: Column, *needles: str) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | c.contains(n)
    return found


def starts_any(c: Column, *prefixes: str) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | c.startswith(p)
    return found


def integer(c: Column) -> Column:
    """A number of ASCII digits; 0 if it isn't one or is too large."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(build):
    """Builds an expression over named columns once per gateway: an expression of
    thousands of nodes takes seconds to send, and it can be used again."""
    kept = {}

    @functools.wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def choose(*cases: tuple[Column, object], default=None) -> Column:
    """The value of the first case that holds."""
    found = F
    for condition, value in cases:
        found = found.when(condition, value)
    return found.otherwise(default)


RUN = r"\p{Nd}+|[\p{L}\p{Nl}\p{No}!?。！？～〜\x{FE0F}]+"


def runs_of(c: Column) -> Column:
    """Runs of digits and runs of letters; the cross counts as the letter x."""
    return F.regexp_extract_all(F.translate(c, "×", "x"), F.lit(RUN), F.lit(0))


def full_width_folded(c: Column) -> Column:
    """Full-width forms as ASCII, the ideographic space as a space."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    return F.translate(c, wide + "　", "".join(chr(ord(x) - 0xFEE0) for x in wide) + " ")
