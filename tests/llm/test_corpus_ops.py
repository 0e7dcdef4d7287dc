"""Near duplicates, vectors, lines, quality and pages against brute force."""

import itertools
import random
import re

import numpy as np
import pytest


def closure(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, size=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_near_duplicates(spark, monkeypatch):
    from nameloom.llm import minhash

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeÉßÄ") for _ in range(4))
    passage = [word() for _ in range(120)]
    texts = [None, "", " \t\n", "one two", "One TWO", "one", "É A b c d e", "é a b c d e", "a b c d e f g"]
    for _ in range(25):  # groups of near copies, some far apart
        base = [word() for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 15))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(1, 120))]) for _ in range(40)]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "one two", "x", 2)], "doc_id long, text string, id string, n int")
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    for small in (False, True):
        if small:  # every list and group of more than four is dealt in blocks
            monkeypatch.setattr(minhash, "LIST_BLOCK", 4)
            monkeypatch.setattr(minhash, "SET_BLOCK", 4)
        rows = minhash.near_duplicates(docs).collect()
        assert len(rows) == len(texts) + 1
        for r in rows:
            if r["doc_id"] is not None:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
            else:
                assert r["component_id"] is None and r["kept"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_groups_of_long_documents_meet_in_small_blocks(spark, monkeypatch):
    from nameloom.llm import minhash

    rng = random.Random(5)
    base = ["w%d" % k for k in range(60)]
    texts = []
    for k in range(24):  # neighbours are near, the ends of the chain are not
        base[(3 * k) % 60] = "x%d" % rng.randrange(10**6)
        texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = closure(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    for most in (4_000_000, 300, 10):  # all together, a few, one of a block
        monkeypatch.setattr(minhash, "SET_HASHES", most)
        assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == want


def test_repeated_ids_are_one_document(spark):
    from nameloom.llm.minhash import near_duplicates

    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (5, "q r s t u"), (2, "q r s t u"), (9, "z")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert rows == [(2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (9, 9, True)]


def test_an_id_with_an_empty_text_too(spark):
    from nameloom.llm.minhash import near_duplicates

    long = " ".join("w%d" % k for k in range(40))
    rows = [(1, long), (1, ""), (1, None), (2, long + " end"), (2, " "), (7, "other words that stand alone here"), (7, "")]
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # a row without text is linked with nothing
    assert found == [(1, 0, 1), (1, 0, 1), (1, 36, 1), (2, 0, 2), (2, 37, 1), (7, 0, 7), (7, 2, 7)]


def vectors(spark, rng, extra=()):
    base = rng.standard_normal((12, 16))
    rows = [(int(k), [float(x) for x in base[k % 12] + (0.12 if k < 120 else 1.5) * rng.standard_normal(16)], int(k % 2)) for k in range(200)]
    odd = [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] + [1.0] * 15, 1), (304, [None] * 16, 1), (305, [1.0, 2.0], 1), (306, [1.0, 2.0], None), (None, [1.0] * 16, 1), (307, [], 0), (3, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows + odd + list(extra)], "vec_id long, embedding array<double>, label int, data string")


def test_embedding_near_duplicates(spark):
    from nameloom.llm.vectors import embedding_near_duplicates

    rows, df = vectors(spark, np.random.RandomState(1))
    links = []
    for a, b in itertools.combinations(rows, 2):
        x, y = np.array(a[1]), np.array(b[1])
        if a[2] == b[2] and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
            links.append((a[0], b[0]))
    want = closure([r[0] for r in rows], links)
    for block in (2048, 6):
        found = {r["vec_id"]: r for r in embedding_near_duplicates(df, tables=40, bits=8, block=block).collect()}
        assert set(found) == {r[0] for r in rows} | set(range(300, 308))
        for r in rows:
            assert found[r[0]]["n_links"] == sum(r[0] in x for x in links) and found[r[0]]["component_id"] == want[r[0]]
        assert all(found[k]["n_links"] == 0 and found[k]["kept"] for k in range(300, 308))
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_recall_of_the_production_tables(spark):
    from nameloom.llm.vectors import embedding_near_duplicates

    rng = np.random.RandomState(2)
    base = rng.standard_normal((300, 64))
    far = rng.standard_normal((300, 64))
    far -= (far * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    turn = 0.3725  # tangent at cosine 0.937
    near = base + turn * far * np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(far, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(x) for x in v], 1) for k, v in enumerate(np.vstack([base, near]))], "vec_id long, embedding array<double>, label int")
    assert embedding_near_duplicates(df).where("n_links > 0").count() >= 0.9 * 600


def test_exact_top_k(spark):
    from nameloom.llm.vectors import exact_top_k

    rng = np.random.RandomState(4)
    rows, df = vectors(spark, rng, [(500 + k, [float(x) for x in v], 0) for k, v in enumerate(rng.choice([-1.0, 0.0, 1.0], (60, 16)))])
    rows += [(500 + k, None, 0) for k in range(60)]
    values = {r["vec_id"]: np.floor(256 * np.array(r["embedding"])).astype(int) for r in df.where("vec_id < 300 or vec_id >= 500").collect() if r["embedding"]}
    for shard_rows, query_rows in ((16384, 256), (40, 2)):
        found = [tuple(r) for r in exact_top_k(df, every=10, shard_rows=shard_rows, query_rows=query_rows).collect()]
        want = []
        for q in values:
            if q % 10 == 0:
                best = sorted(((-int(v @ values[q]), i) for i, v in values.items() if i != q))[:5]
                want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
        assert sorted(found) == sorted(want)
    assert exact_top_k(df.limit(0)).count() == 0
    assert exact_top_k(df.where("vec_id in (0, 1, 2)"), every=2).count() == 4  # fewer candidates, fewer ranks


def test_line_dedup(spark):
    from nameloom.llm.line_dedup import line_dedup

    rng = random.Random(5)
    pool = [f"line {k}" for k in range(30)]
    docs = [(k, "\n".join(rng.choice(pool[: 2 + k % 28]) if rng.random() < 0.7 else rng.choice(["", " ", f"own {k}"]) for _ in range(rng.randint(0, 12))), f"s{rng.randint(0, 7)}" if k % 9 else None) for k in range(120)]
    df = spark.createDataFrame([(k, t, s, "clash") for k, t, s in docs] + [(500, None, "s1", "x")], "doc_id long, text string, source string, gone string")
    spread = {}
    for k, t, s in docs:
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                spread.setdefault(line, (set(), []))[1].append((k, p))
                if s is not None:
                    spread[line][0].add(s)
    bad = {line: min(places) for line, (sites, places) in spread.items() if len(sites) >= 5}
    assert bad
    found = {r["doc_id"]: r for r in line_dedup(df, min_sites=5).collect()}
    for k, t, _ in docs:
        lines = [(line, line in bad and (k, p) != bad[line]) for p, line in enumerate(t.split("\n"))]
        assert (found[k]["text"], found[k]["n_lines"], found[k]["n_removed"]) == ("\n".join(x for x, gone in lines if not gone), len(lines), sum(g for _, g in lines))
    assert found[500]["text"] is None and found[500]["gone"] == "x"
    assert line_dedup(df.limit(0)).count() == 0


def test_quality_learns_and_keeps_its_folds(spark):
    import zlib

    from nameloom.llm.quality import isotonic, quality_scores

    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))) + "."
    junk = lambda: " ".join(rng.choice(["BUY!!", "$$$", "###", "CLICK***"]) for _ in range(rng.randint(20, 80)))
    rows = [(k, good() if k % 3 else junk(), k % 3 and 1) for k in range(600)]
    docs = spark.createDataFrame([(k, t, "clash") for k, t, _ in rows] + [(None, "no id", "x"), (900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, q) for k, _, q in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality_scores(docs, labels, features=60).collect()}
    assert len(found) == 603
    for k, _, q in rows:
        assert found[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= found[k]["score"] <= 1 and found[k]["predicted"] == (found[k]["score"] >= 0.5)
    held = [(q, found[k]["predicted"]) for k, _, q in rows if found[k]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert found[None]["held_out"] is False
    flipped = spark.createDataFrame([(k, (1 - q) if zlib.crc32(str(k).encode()) % 3 == 1 else q) for k, _, q in rows], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in quality_scores(docs, flipped, features=60).collect()}
    assert all(abs(again[k] - found[k]["score"]) < 1e-6 for k in again)  # held-out labels change nothing
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0
    x, y = isotonic([(0, 1, 1), (1, 0, 1), (2, 1, 2), (3, 4, 4)])
    assert y == sorted(y) and y[0] == 0.5


def test_quality_equals_dense_normal_equations(spark):
    """Brute force: all rows at once in numpy, isotonic means by their definition."""
    from pyspark.sql import functions as F

    from nameloom.llm.quality import FOLDS, NAMES, Fourier, quality_scores, statistics

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    texts = [" ".join(word() if rng.random() < (0.9 if k % 2 else 0.5) else "$$!" for _ in range(rng.randint(3, 60))) for k in range(300)]
    texts += [texts[0]] * 3 + ["", None, "long " * 60_000, "tie", "tie"]  # repeated rows, ties, a very long text
    labels = {k: int((k % 2) ^ (rng.random() < 0.1)) for k in range(300)}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(40)  # more parts than a task adds up
    found = {r["doc_id"]: r for r in quality_scores(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), features=40).collect()}

    x = np.array([statistics(t or "") for t in texts])
    fourier = Fourier(x.mean(0), np.where(x.std(0) == 0, 1.0, x.std(0)), 40, 1.0, 6)
    z = np.clip((x - fourier.mean) / fourier.spread, -6, 6)
    phi = np.hstack([np.ones((len(x), 1)), np.cos(z @ fourier.w + fourier.b) * np.sqrt(2 / 40)])
    held = {r["doc_id"] for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("f")).collect()}
    train = [k for k in labels if k not in held]
    y = np.array([labels[k] for k in train], float)

    def fitted(rows):
        p = phi[[train[r] for r in rows]]
        return np.linalg.solve(p.T @ p + 1e-3 * len(rows) / 41 * np.eye(41), p.T @ y[rows])

    raw = np.zeros(len(train))
    for f in range(FOLDS):
        own = [r for r, k in enumerate(train) if fold[k] == f]
        raw[own] = phi[[train[r] for r in own]] @ fitted([r for r, k in enumerate(train) if fold[k] != f])
    raw = np.clip(raw, -1, 2)
    bins = np.floor((raw + 1) / 3 * 2000)
    at = sorted(set(bins))
    px, py, pn = (np.array([f(bins == b) for b in at]) for f in (lambda m: raw[m].mean(), lambda m: y[m].sum(), lambda m: m.sum()))
    mean = lambda a, b: py[a : b + 1].sum() / pn[a : b + 1].sum()
    flat = np.array([max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))])
    scores = np.clip(phi @ fitted(range(len(train))), -1, 2)
    knots = [(px[flat == v] @ pn[flat == v] / pn[flat == v].sum(), v) for v in sorted(set(flat))]
    want = 0.999 * np.interp(scores, *zip(*knots)) + 0.001 * (scores + 1) / 3
    assert max(abs(found[k]["score"] - want[k]) for k in found) < 1e-6
    assert found[0]["score"] == found[300]["score"] == found[301]["score"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav>
<div class="ad">Buy</div><div id="cookie-notice">Cookies</div><article><h1>Head &amp; line</h1><script>var t="</p>";</script>
<p><b>First<br>  block &lt;3 &#8212; caf&eacute;<p>Second   block</p><ul><li>one<li>two</ul><form>mail</form><!-- no --><div>Third</div>
<section class="comments"><p>%s</p></section></article><aside>Side</aside><footer>&copy; f</footer></body></html>"""


def test_extract_main_text(spark):
    from nameloom.llm.html_text import extract_main_text

    want = "Head & line\nFirst block <3 — café\nSecond block\none\ntwo\nThird"
    pages = [(k, "http://Example.com/%d" % k, PAGE % ("I disagree. " * (200 if k == 2 else 1)), "c") for k in range(4)]
    pages += [(10, None, None, "c"), (11, "http://example.com/x", "", "c"), (12, "http://b.org/", "just text &am", "c"), (13, "http://b.org/2", "<p>a<p>b", "c"), (None, "http://example.com/1", PAGE % "x", "c"), (14, "http://c.net/", "<div class='post 12'><p>" + "long text " * 30 + "</p></div><div class=side><a href=y>link " * 20, "c")]
    found = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string, paths string")).collect()}
    assert len(found) == len(pages)
    for k in (0, 1, 2, 3, None):
        assert found[k]["text"] == want and found[k]["n_chars"] == len(want)
    assert (found[10]["text"], found[10]["n_chars"], found[11]["text"], found[12]["text"], found[13]["text"]) == ("", 0, "", "just text &am", "a\nb")
    assert found[14]["text"] == ("long text " * 30).strip()


def test_extract_from_no_pages(spark):
    from nameloom.llm.html_text import extract_main_text

    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components(spark):
    from nameloom.llm.common import components

    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)] + [(5, 5)]
    want = closure(range(2000), edges)
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found.get(i, i) == want[i] for i in range(2000))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


ARTICLE = '<article class="post comments-open"><p>Long body text here.</p><p>More of it.</p></article>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="layout with-sidebar">%s<div class="sidebar">x</div></div>', "body"),
        ('<div id="header-fixed">%s<nav>n</nav></div><div class=ad>buy</div>', "body"),
        ('<form id="f"><nav>m</nav><main>%s</main></form>', "body"),
        ('<main>%s<article class="comment">A reply that goes on and on.</article><div id="comments"><p>u</p></div></main>', "body"),
        ('<div class="page-header">h</div><div class="no-banner">%s</div>', "body"),
        ('<nav>a</nav><div class="ad">b</div><footer>c</footer>', ""),
        ('<div class="ad"><article></article>b</div>', ""),
    ],
)
def test_main_text_names_of_containers(html, text):
    from nameloom.llm.html_text import Page

    page = Page(html.replace("%s", ARTICLE))
    found = page.text(page.paths[page.best()]) if page.blocks else ""
    assert found == ("Long body text here.\nMore of it." if text else "")


def test_a_hub_is_split(spark):
    """The joins of components: minima that are tables leave a hub's partition to Spark to split."""
    from pyspark.sql import functions as F

    from nameloom.llm.common import with_least, written

    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        edges = written(spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("u"), F.col("id").alias("v")).repartition(8), "edges")
        least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = with_least(edges, least)
        assert joined.agg(F.count("*"), F.sum("m")).first()[0] == 40_000
        rows = joined.rdd.count()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert rows == 40_000 and "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_in_many_tasks(spark):
    from nameloom.llm.common import components

    rng = random.Random(8)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 1000)]
    want = closure(range(1001), edges)
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), most=60).collect()}
    assert all(found.get(i, i) == want[i] for i in range(1001))


def test_near_duplicates_of_very_long_texts(spark):
    from nameloom.llm.minhash import near_duplicates

    rng = random.Random(12)
    words = ["w%d" % rng.randrange(10**9) for _ in range(30_000)]
    far = words[:15_000] + ["v%d" % k for k in range(15_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:29_000] + ["x"] * 1000)), (3, " ".join(far)), (4, " ".join(words).upper())]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {k: (len(shingles(t)), 3 if k == 3 else 1) for k, t in rows}


def test_equal_vectors_are_one_class(spark):
    from nameloom.llm.vectors import embedding_near_duplicates, tables_for

    rng = np.random.RandomState(5)
    one, other = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(k, one.tolist(), 1) for k in range(50)] + [(100 + k, (one + 0.05 * rng.standard_normal(16)).tolist(), 1) for k in range(3)] + [(200, one.tolist(), 2), (300, other.tolist(), 1)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tables=30, bits=3).collect()}
    assert {found[k] for k in range(50)} == {(52, 0)} and {found[100 + k] for k in range(3)} == {(52, 0)}
    assert found[200] == (0, 200) and found[300] == (0, 300)
    for n in (10, 10**5, 10**9):  # constant recall at any size
        bits, tables = tables_for(n, 0.93, 0.95, 512)
        assert 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables >= 0.95


def test_line_dedup_odd_rows(spark):
    from nameloom.llm.line_dedup import line_dedup

    long = "\n".join(["own line"] + ["shared"] * 50_000)
    rows = [(k, f"shared\nline {k}", f"s{k}") for k in range(12)] + [(3, "shared\nline 3", "s3")] * 2 + [(50, long, "s50"), (None, "shared\nno id", "s60"), (60, "shared\nno site", None)]
    found = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=repr)
    want = [(k, f"line {k}", 1) for k in range(12)] + [(3, "line 3", 1)] * 2 + [(50, "own line", 50_000), (None, "shared\nno id", 0), (60, "no site", 1)]
    assert found == sorted(want, key=repr)  # the null id comes first


def generated_pages():
    """(url, html, text): pages of four templates, whose article is known."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    loud = lambda t: f"{t[:4]}<b>{t[4:8]}</b><A HREF='/x?a=1&amp;b=2' title=\"a > b\">{t[8:12]}</A>{t[12:]}"
    for k in range(80):
        kind = k % 4
        blocks, body = [], []
        for j in range(rng.randint(3, 9)):
            t = said(12, 60) + rng.choice([" & more", " < less", " – dash", ""])
            written = loud(t).replace(" & ", " &amp;\n\t ").replace(" < ", " &lt; ").replace("–", "&#8211;")
            if j == 2:
                items = [said(3, 9) for _ in range(3)]
                body.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
                blocks += items
            body.append(f"<p data-k='{j}'>{written}" + rng.choice(["</p>", ""]))
            blocks.append(t)
            body.append(rng.choice(["", "<script>if (a<b) document.write('<p>no</p>')</script>", "<!-- <p>no</p> -->", "<STYLE>p>a{}</STYLE>"]))
        title = said(4, 8)
        links = "".join(f"<li><a href='/{word()}'>{said(1, 4)}</a></li>" for _ in range(rng.randint(3, 12)))
        notes = "".join(f"<p>{said(5, 20)}</p>" for _ in range(rng.choice([1, 3, 40])))
        top = f"<header class=site-header><div>{said(2, 4)}</div></header><nav><ul>{links}</ul></nav><div class='cookie-notice'>{said(4, 9)}</div>"
        end = f"<footer>&copy; {said(3, 6)}</footer>"
        side = f"<div class='sidebar col-{k}'><ul>{links}</ul></div>"
        whole = "".join(body)
        page = [
            f"{top}<article class='post-{k}'><header><h1>{title}</h1></header>{whole}<section class='comments'>{notes}</section></article><aside>{said(5, 9)}</aside>{end}",
            f"{top}<div class='wrap-{k}'><div class='post'><h1>{title}</h1><div class='entry'>{whole}</div></div>{side}</div><div id='comments'>{notes}</div>{end}",
            f"{top}<main id=main><div class='comment-free body-{k}'><h1>{title}</h1>{whole}</div><form><input><button>{said(1, 2)}</button></form></main>{side}{end}",
            f"<form id=all>{top}<div class='share-story'><article><h1>{title}</h1>{whole}</article></div><p>{said(2, 5)}</p>{end}</form>",
        ][kind]
        yield f"https://host{kind}.example/{k}", f"<!doctype html><html><head><title>{title}</title></head><body>{page}</body></html>", "\n".join([title, *blocks])


def test_generated_pages_give_back_their_articles(spark):
    from nameloom.llm.html_text import extract_main_text

    pages = list(generated_pages())
    rows = [(k, url, html) for k, (url, html, _) in enumerate(pages)]
    rows += [rows[0], rows[0], (500, pages[1][0], pages[1][1].replace("<h1>", "<h1>" + "w" * 400_000))]  # repeated rows, a very long page
    found = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    wrong = [(r["url"], r["text"][:300], pages[r["page_id"]][2][:300]) for r in found if r["page_id"] < 500 and r["text"] != pages[r["page_id"]][2]]
    assert not wrong, wrong[:2]
    assert next(r for r in found if r["page_id"] == 500)["n_chars"] == len(pages[1][2]) + 400_000


def test_ties_of_containers_and_paths(spark):
    from nameloom.llm.html_text import extract_main_text

    half = "equal words here " * 10
    html = f"<div class=a><p>{half}</p></div><div class=b><p>{half}</p></div>"
    other = html.replace("class=a", "class=c").replace("class=b", "class=a").replace("class=c", "class=b")
    rows = [(1, "http://t.org/1", html), (2, "http://t.org/2", other)]
    found = [sorted(r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()) for n in (1, 2)]
    assert found[0] == found[1] and all(half.strip() in t for t in found[0])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="comment-free article-body"><p>Body of it</p></div>', "Body of it"),
        ('<div class="share-story"><article>main</article></div><p>junk line</p>', "main"),
        ('<p title="oops>Hello there</p>', "Hello there"),
        ("<article><header><h1>Title</h1><p>by someone</p></header><p>Body</p></article>", "Title\nBody"),
        ("<p data-x='class=comments'>kept</p>", "kept"),
        ('<p title="a > b" class=x>kept</p', "kept"),
        ("<!--><p>kept</p><!-- gone -->", "kept"),
    ],
)
def test_html_as_it_is_read(html, text):
    from nameloom.llm.html_text import Page

    page = Page(html)
    assert page.text(page.paths[page.best()]) == text
