"""The pipeline's stages on a small corpus, and the registered queries."""

import pytest

pytest.importorskip("public_tokenizers")


def corpus(spark, path):
    rng = __import__("random").Random(8)
    good = lambda n: "\n".join(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(12)) for _ in range(n))
    junk = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###"]) for _ in range(60))
    notice = "this site uses a notice that stands on all the sites of the world"
    rows = []
    for k in range(240):
        text = junk() if k % 6 == 0 else good(6) + ("\n" + notice if k % 2 else "")
        rows.append((k, text, "en", f"s{k % 13}", len(text)))
    rows += [(1000 + k, r[1], "en", r[3], r[4]) for k, r in enumerate(rows[1:40:6])]  # exact copies
    rows += [(2000, None, "en", "s0", None), (2001, "", None, None, 0), (None, good(3), "en", "s1", 1), (1, rows[1][1], "en", "s1", rows[1][4])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 6 != 0)) for r in rows[:240]], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    junk, clean = {r[0] for r in rows[:240:6]}, {r[0] for r in rows[:240] if r[0] % 6}
    assert not junk & set(kept[0]) and len(clean & set(kept[0])) >= 0.97 * len(clean)
    assert sum("this site uses" in (t or "") for t in kept[1].values()) == 1
    assert not {1000 + k for k in range(7)} & set(kept[2]) and clean & set(kept[0]) <= set(kept[2])
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(kept[2])
    twice = spark.read.parquet(f"{tmp_path}/stage2").where("doc_id = 1").count()
    assert twice == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_every_operator_is_registered():
    import re

    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_decisions_are_per_row(spark, tmp_path):
    import corpus_pipeline

    rng = __import__("random").Random(9)
    good = lambda n: "\n".join(" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(12)) for _ in range(n))
    junk = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###"]) for _ in range(60))
    corpus(spark, str(tmp_path))
    clean, twin = [good(6) for _ in range(12)], good(6)
    rows = [(None, t) for t in clean[:8]] + [(None, junk()) for _ in range(4)]  # null ids, clean and not
    rows += [(3000, clean[8]), (3000, junk()), (3000, clean[9])]  # an id of distinct texts
    rows += [(4000, twin), (4001, clean[10]), (4001, twin), (4001, twin + " end"), (4002, clean[11]), (4002, clean[11])]
    made = spark.createDataFrame([(k, t, "en", "s1", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 240").dropDuplicates(["doc_id"]).unionByName(made)
    found = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    shown = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.where("doc_id is null or doc_id >= 3000").collect()), key=repr)
    assert shown(found) == sorted([r for r in rows if "BUY" not in r[1] and "$$$" not in r[1]], key=repr)
    kept = shown(corpus_pipeline.drop_near_duplicates(spark, made.where("text not like '%$$$%'"), str(tmp_path)))
    want = [(None, t) for t in clean[:8]] + [(3000, clean[8]), (3000, clean[9]), (4000, twin), (4001, clean[10]), (4002, clean[11])]
    assert kept == sorted(want, key=repr)


def test_run_equals_brute_force(spark, tmp_path):
    """run() against plain Python, given which rows the classifier keeps."""
    import itertools
    import zlib

    import numpy as np
    import public_tokenizers as P
    from test_corpus_ops import closure, shingles
    from tokenizers import Tokenizer

    import corpus_pipeline

    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").dropDuplicates(["doc_id"]).where("doc_id is not null")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.mode("overwrite").parquet(f"{tmp_path}/in/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/in/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    kept = {r["doc_id"]: (r["text"], r["source"]) for r in corpus_pipeline.keep_quality(spark, docs, f"{tmp_path}/in").collect()}

    places = {}
    for k in sorted(kept):
        for p, line in enumerate((kept[k][0] or "").split("\n")):
            if line.strip():
                places.setdefault(line, []).append((k, p))
    bad = {line: min(found) for line, found in places.items() if len({kept[k][1] for k, _ in found} - {None}) >= 10}
    assert bad
    texts = {}
    for k, (text, _) in kept.items():
        lines = (text or "").split("\n")
        left = [x for p, x in enumerate(lines) if x not in bad or bad[x] == (k, p)]
        if len(left) == len(lines):
            texts[k] = text
        elif any(x.strip() for x in left):
            texts[k] = "\n".join(left)
    sets = {k: shingles(t) for k, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    groups = closure(sorted(texts), links)
    single = {k: t for k, t in texts.items() if groups[k] == k}
    assert len(single) < len(texts) < len(kept) + 1
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for k, t in single.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % 2048 + 1
        for piece, at in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[at : first if piece == 0 else at + 2048]
            want.add((k, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = corpus_pipeline.run(spark, f"{tmp_path}/in").collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found} == want and len(found) == len(want)
    assert len({r["sequence_id"] for r in found}) <= -(-sum(r["length"] for r in found) // 2048) + 1


def test_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, 1), (2, 5)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # no documents, no usable label
    long = "the same long line of an ordinary text\n" * 20_000
    rows = [(k, long + str(k), "en", f"s{k}", 1, "x", 2, 0.5) for k in range(3)] + [(9, None, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, schema + ", component_id string, row long, score double")
    for _, stage in corpus_pipeline.STAGES[:3]:
        odd = stage(spark, odd.withColumn("label", odd["doc_id"]), str(tmp_path))
        assert odd.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in odd.collect()} == {0, 9}
