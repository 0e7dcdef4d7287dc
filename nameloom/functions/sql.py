"""The converters and primitives as functions of SQL: expressions that Catalyst
inlines, so that a query over them has no Python in its plan."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import convert, text

#: Functions of one text, by the name that SQL calls them.
FUNCTIONS = {
    f.__name__: f
    for f in (
        text.valid_utf8, text.trimmed, text.simplified, text.ascii_upper, text.ascii_lower, text.fold_key, text.full_width_folded, text.is_kana, text.has_foreign_script, text.has_latin_word,
        convert.resolution, convert.resolution_lines, convert.source, convert.source_is_remux, convert.source_is_light, convert.source_is_bare_uhd, convert.source_extras, convert.video_codec,
        convert.hdr, convert.hdr_rank, convert.bit_depth, convert.edition, convert.editions, convert.audio_profile, convert.audio_codec, convert.audio_channels, convert.marker_numbers,
        convert.episode_marker, convert.season_episode_marker, convert.container, convert.medium_of_container, convert.medium_of_content, convert.is_checksum, convert.states_sample_depth,
        convert.states_bitness, convert.languages, convert.subtitle_format, convert.states_subtitles, convert.states_several_subtitles, convert.platform, convert.air_date, convert.year,
        convert.prefer_latin, convert.title, convert.release_group, convert.never_a_group, convert.is_multi_audio, convert.is_proper, convert.is_repack, convert.stated_revision, convert.real_count,
        convert.is_ai_upscale, convert.is_light_encode, convert.is_hybrid, convert.is_three_d, convert.is_dub, convert.is_bare_dub, convert.is_remux,
    )
}
TOKEN = re.compile(r"\s+|'(?:[^'\\]|\\.)*'|->|<=>|<=|>=|!=|[A-Za-z_0-9.`]+|[^\s]", re.S)
BETWEEN = {"and": "AND", "or": "OR", "=": "=", "<=>": "<=>", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "+": "+", "-": "-", "*": "*", "/": "/", "%": "%"}


class _Reader:
    """Reads the text of a Column, whose operators are written as calls, and writes
    it as SQL."""

    def __init__(self, written: str):
        self.tokens = [t for t in TOKEN.findall(written) if not t.isspace()]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if expected is not None and token.upper() != expected:
            raise ValueError(f"{expected} expected before {' '.join(self.tokens[self.at : self.at + 8])}")
        self.at += 1
        return token

    def arguments(self) -> list[str]:
        self.take("(")
        found = []
        while self.peek() != ")":
            found.append(self.expression())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return found

    def expression(self) -> str:
        made = self.primary()
        while self.peek() == "[":
            self.take()
            made = f"{made}[{self.expression()}]"
            self.take("]")
        if self.peek().upper() == "AS":
            self.take()
            made = f"{made} AS {self.take()}"
        return made

    def primary(self) -> str:
        token = self.peek()
        if token.upper() == "CASE":
            return self.case()
        if token.upper() in ("CAST", "TRY_CAST") and self.peek(1) == "(":
            name = self.take()
            self.take("(")
            value = self.primary()
            while self.peek() == "[":
                self.take()
                value = f"{value}[{self.expression()}]"
                self.take("]")
            self.take("AS")
            kind, depth = "", 0
            while depth or self.peek() != ")":
                depth += (self.peek() in "(<") - (self.peek() in ")>")
                kind += self.take() + " "
            self.take(")")
            return f"{name}({value} AS {kind.strip()})"
        if token == "(":  # the parameters of a lambda
            self.take()
            names = []
            while self.peek() != ")":
                names.append(self.take())
                if self.peek() == ",":
                    self.take()
            self.take(")")
            self.take("->")
            return f"({', '.join(names)}) -> {self.expression()}"
        self.take()
        if self.peek() == "->":
            self.take()
            return f"{token} -> {self.expression()}"
        if self.peek() == "(" and not token.startswith("'"):
            name, given = token.lower(), self.arguments()
            if name in BETWEEN and len(given) == 2:
                return f"({given[0]} {BETWEEN[name]} {given[1]})"
            if name in ("!", "not"):
                return f"(NOT {given[0]})"
            if name in ("-", "negative") and len(given) == 1:
                return f"(- {given[0]})"
            if name == "in":
                return f"({given[0]} IN ({', '.join(given[1:])}))"
            return f"{token}({', '.join(given)})"
        if token == "-":
            return "-" + self.take()
        return token

    def case(self) -> str:
        out = [self.take("CASE")]
        while self.peek().upper() in ("WHEN", "THEN", "ELSE"):
            out.append(self.take())
            out.append(self.expression())
        out.append(self.take("END"))
        return " ".join(out)


def to_sql(column: Column) -> str:
    """A Column as an expression of SQL."""
    reader = _Reader(column._jc.node().sql())
    made = reader.expression()
    if reader.peek():
        raise ValueError(f"unread: {' '.join(reader.tokens[reader.at : reader.at + 8])}")
    return made


def register(spark: SparkSession, prefix: str = "release_", names: list[str] | None = None) -> list[str]:
    """Temporary functions of SQL, all of FUNCTIONS or those named: release_source(token) and so on."""
    made = []
    for name in names or FUNCTIONS:
        body = to_sql(FUNCTIONS[name](F.col("token")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(token STRING) RETURN {body}")
        made.append(prefix + name)
    return made


def parsed_view(spark: SparkSession, names: str, view: str, **options) -> None:
    """A temporary view of the records of a table of names (name_id, name), for SQL."""
    from ..engine import parse

    parse(spark.table(names), **options).createOrReplaceTempView(view)
