"""Converters against literal pairs of text and value."""

import json
import os

import pytest
from pyspark.sql import functions as F

from nameloom.functions import convert

HERE = os.path.dirname(os.path.abspath(__file__))
with open(os.path.join(HERE, "data", "converter_pairs.jsonl"), encoding="utf-8") as lines:
    PAIRS = [json.loads(x) for x in lines]


def plain(value):
    if hasattr(value, "asDict"):
        value = value.asDict()
        return list(value.values()) if "hdr10" in value else value
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted({p["fn"] for p in PAIRS}))
def test_pairs(spark, name):
    pairs = [p for p in PAIRS if p["fn"] == name]
    rows = spark.createDataFrame([(k, p["input"]) for k, p in enumerate(pairs)], "k int, token string")
    found = {r["k"]: plain(r["value"]) for r in rows.select("k", getattr(convert, name)(F.col("token")).alias("value")).collect()}
    wrong = [(p["input"], p["expected"], found[k]) for k, p in enumerate(pairs) if found[k] != p["expected"]]
    assert not wrong


@pytest.mark.parametrize("token", ["", " ", "\t\n", "...", "()[]{}-", None])
def test_nothing_is_read_from_nothing(spark, token):
    names = ["resolution", "source", "edition", "video_codec", "audio_codec", "audio_profile", "hdr", "bit_depth", "container", "air_date", "year", "subtitle_format"]
    row = spark.createDataFrame([(token,)], "token string").select(*(getattr(convert, n)(F.col("token")).alias(n) for n in names)).first()
    assert not {n: row[n] for n in names if row[n] is not None}
