"""Token counts, byte-level BPE, packing and chat against the libraries they follow."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

TEXTS = ["", None, " ", "a", "the cat", "  two  spaces ", "\n\nx\t梦😀 é▁q", "日本語 テキスト", "it's 1234 !!! don't", "<|endoftext|> <|im_end|>", "word " * 5000, "x" * 3000, "the cat", "a\\b<|c|>"]
SCHEMA = "doc_id long, text string, n_tokens string, pair string"


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, "clash", None) for k, t in enumerate(texts)] + [(None, "no id", None, None), (4, "the cat", "x", "y")], SCHEMA)


def test_token_counts_follow_the_unigram_tokenizer(spark):
    from tokenizers import Tokenizer, models
    import sentencepiece

    from nameloom.llm.token_counts import token_counts

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    unigram = Tokenizer(models.Unigram(vocab, 0, True))
    want = [len(unigram.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0 for t in TEXTS]
    rows = token_counts(docs_of(spark, TEXTS), path).collect()
    found = {r["doc_id"]: r["n_tokens"] for r in rows}
    assert [found[k] for k in range(len(TEXTS))] == want
    assert len(rows) == len(TEXTS) + 2 and found[None] > 0
    assert token_counts(docs_of(spark, TEXTS).limit(0), path).count() == 0


def test_viterbi_keeps_the_piece_that_starts_first_on_ties(tmp_path):
    from nameloom.llm.token_counts import Unigram

    model = Unigram(P.path("piece_bpe_32k.model"))
    model.automaton = __import__("ahocorasick").Automaton()
    for piece, score in {"▁ab": -2.0, "▁a": -1.0, "b": -1.0, "▁": -5.0, "a": -5.0}.items():
        model.automaton.add_word(piece, (len(piece), score))
    model.automaton.make_automaton()
    assert model.viterbi("▁ab") == 1
    assert model.viterbi("▁é") == 3  # an unknown character counts its bytes


def test_bpe_round_trip(spark):
    import tiktoken

    from nameloom.llm.bpe import bpe_round_trip

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe_round_trip(docs_of(spark, TEXTS), path, P.PATTERN, block_chars=2000, bucket_words=5).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = np.array(e.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids"], r["ids_sha256"]) == (len(ids), ids.tolist(), hashlib.sha256(ids.tobytes()).hexdigest())
        assert bytes(r["decoded"]) == text.encode() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_round_trip(docs_of(spark, TEXTS).limit(0), path, P.PATTERN).count() == 0


def best_fit(counts, capacity):
    """Best-fit decreasing, a document at a time."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


def test_a_sweep_is_best_fit_decreasing():
    from nameloom.llm.packing import GAP, LEFT, OVER, PIECE, PLACED, SMALL, sweep

    rng = np.random.RandomState(0)
    for _ in range(60):
        capacity = int(rng.randint(5, 60))
        gaps = [int(x) for x in rng.randint(1, capacity + 1, rng.randint(0, 20))]
        pieces = [int(x) for x in rng.randint(1, capacity + 1, rng.randint(1, 40))]
        rows = [(g, GAP, 1000 + k) for k, g in enumerate(gaps)] + [(n, PIECE, k) for k, n in enumerate(pieces)]
        found = list(sweep(sorted(rows, key=lambda r: (-r[0], r[1], r[2])), capacity))
        free, left = list(gaps), []
        for n in sorted(pieces, reverse=True):
            fit = [g for g in free if g >= n]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - n)
            else:
                left.append(n)
        assert sorted(r[2] for r in found if r[0] == LEFT) == sorted(left)
        assert sorted(r[2] for r in found if r[0] in (OVER, SMALL)) == sorted(g for g in free if g)
        assert sum(r[0] == PLACED for r in found) == len(pieces) - len(left)


def test_ranges_share_their_gaps():
    from nameloom.llm.packing import crossed

    # pieces of range 1 go to the smallest gaps above; those of range 3 first to range 2's
    met = crossed({1: (2, 10), 3: (5, 4)}, {0: (4, 30), 2: (2, 9)})
    assert met == [(1, 0, 2, 0, 3, 3), (3, 0, 4, 2, 1, 2), (3, 4, 1, 0, 2, 7)]
    assert crossed({}, {0: (3, 5)}) == [] == crossed({0: (3, 5)}, {})


def places_of(rows, ids, capacity):
    places = collections.defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and len(piece) == r["length"]
        assert r["length"] == capacity or r["piece"] == 0
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in places.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= capacity
    return places


def test_packing(spark):
    from tokenizers import Tokenizer

    from nameloom.llm.packing import best_fit_pack

    path = P.path("byte_bpe_50k.json")
    k = Tokenizer.from_file(path)
    assert 50256 in k.encode(TEXTS[9], add_special_tokens=False).ids  # a text that spells an added token
    ids = {i: k.encode(t or "", add_special_tokens=False).ids + [0] for i, t in [*enumerate(TEXTS), (None, "no id")]}
    used = set()
    for rows in (400_000, 8):  # one range, and many
        found = best_fit_pack(docs_of(spark, TEXTS), path, P.PATTERN, capacity=64, rows=rows).collect()
        assert sum(r["length"] for r in found) == sum(map(len, ids.values())) + len(ids[4])
        places = places_of(found, ids, 64)
        used.add(len(places))
    total = sum(r["length"] for r in found)
    assert max(used) <= -(-total // 64) + 2
    assert best_fit_pack(docs_of(spark, TEXTS).limit(0), path, P.PATTERN).count() == 0


def test_packing_equal_rows(spark):
    from nameloom.llm.packing import best_fit_pack

    docs = spark.createDataFrame([(None, None)] * 1000 + [(7, "the same text")] * 40, "doc_id long, text string")
    found = best_fit_pack(docs, P.path("byte_bpe_50k.json"), P.PATTERN, capacity=32, rows=200).collect()
    assert len(found) == 1040 and len({(r["sequence_id"], r["offset"]) for r in found}) == 1040
    assert len({r["sequence_id"] for r in found}) == -(-sum(r["length"] for r in found) // 32)


def test_chat_tree(spark):
    from nameloom.llm.bpe import encoding
    from nameloom.llm.chat import chat_tree, escape, escape_role, format_turn, read_back, unescape, unescape_role, unpack_ids

    for t in ["", "\\", "<|", "\\<|", "<\\|", "a\nb", "\\n", "<|im_end|>\n"]:
        assert unescape(escape(t)) == t and unescape_role(escape_role(t)) == t and "<|" not in escape(t)
    convs = {
        1: [("system", "be nice"), ("user", "hi"), ("assistant", "hello")],
        2: [("system", "be nice"), ("user", "hi"), ("assistant", "other <|im_end|>\n")],
        3: [("system", "be nice"), ("user", "bye")],
        5: [("system", "be nice"), ("user", "hi"), ("assistant", "hello")],
        7: [("user", "lone\\"), ("assistant", "")],
        9: [("assistant", "a"), ("assistant", "b"), ("us\ner", "<|")],
        8: [("", "")],
    }
    rows = [(c, t, r or None, x or None, "clash") for c, v in convs.items() for t, (r, x) in enumerate(v)] + [(None, 0, "user", "lost", "clash")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, owner string")
    tree = chat_tree(turns, P.path("byte_bpe_50k.json"), P.PATTERN)
    found = {r["conv_id"]: r for r in read_back(tree).collect()}
    assert set(found) == set(convs)
    for c, v in convs.items():
        said = "".join(x for r, x in v if r == "assistant")
        assert found[c]["n_turns"] == len(v)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in v).encode()).hexdigest()
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert found[c]["formatted_chars"] == sum(len(format_turn(r, x)) for r, x in v)
    nodes = {(n["owner"], n["depth"]): n.asDict() for n in tree.nodes.join(tree.places.drop("n_tokens"), ["owner", "depth"]).collect()}
    assert len(nodes) == 3 + 1 + 1 + 2 + 3 + 1  # shared turns once
    line, at = {}, 0
    for n in sorted(nodes.values(), key=lambda n: n["start"]):
        assert n["start"] == at  # depth first, without holes
        n["ids"] = unpack_ids(n["input_ids"])
        at += len(n["ids"])
        line |= {n["start"] + k: x for k, x in enumerate(n["ids"])}
    attends = {b["owner"]: b["attends"] for b in tree.branches.collect()}
    want = chat_paths(convs)
    for leaf in tree.leaves.collect():
        n = nodes[leaf["owner"], leaf["depth"]]
        spans = [(a["begin"], a["end"]) for a in attends[leaf["owner"]]] + [(n["branch"], n["start"] + len(n["ids"]))]
        seen = [line[k] for a, b in spans for k in range(a, b)]
        assert n["position"] == len(seen) - len(n["ids"])
        assert encoding(tree.source, P.PATTERN).decode(seen) == want[leaf["conv_id"]]
    assert read_back(chat_tree(turns.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


def chat_paths(convs):
    from nameloom.llm.chat import format_turn

    return {c: "".join(format_turn(r, x) for r, x in v) for c, v in convs.items()}


def test_chat_is_read_from_positions_and_intervals(spark):
    from pyspark.sql import functions as F

    from nameloom.llm.chat import ChatTree, chat_tree, read_back

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 2 if t < 2 else c}") for c in range(4) for t in range(4)]
    tree = chat_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), P.path("byte_bpe_50k.json"), P.PATTERN)
    right = sorted(read_back(tree).collect())
    wrong = [
        (tree.places.withColumn("position", F.col("position") + F.when(F.col("depth") == 1, 1).otherwise(0)), tree.branches),
        (tree.places.withColumn("start", F.col("start") + F.when(F.col("depth") == 3, 5).otherwise(0)), tree.branches),
        (tree.places, tree.branches.withColumn("attends", F.transform("attends", lambda a: F.struct(a["begin"].alias("begin"), (a["end"] - 1).alias("end"))))),
    ]
    for places, branches in wrong:
        try:
            found = sorted(read_back(ChatTree(tree.nodes, places, branches, tree.leaves, tree.source, P.PATTERN)).collect())
        except Exception as e:
            assert "position" in str(e)
        else:
            assert found != right


def test_chat_long_texts_ties_and_repeated_rows(spark):
    from nameloom.llm.chat import chat_tree, read_back

    long = "word \\ <|x|> " * 20_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long)] + [(2, t, "assistant", f"t{t % 3}") for t in range(3000)]
    rows += [(3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (3, 5, "user", "tie"), (3, None, "user", "first")] + [(4, 0, "user", "same")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in read_back(chat_tree(df, P.path("byte_bpe_50k.json"), P.PATTERN)).collect()}
    assert {c: r["n_turns"] for c, r in found.items()} == {1: 2, 2: 3000, 3: 4, 4: 2}
    assert found[1]["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest() and found[1]["loss_chars"] == len(long)
    assert found[2]["loss_sha256"] == hashlib.sha256("".join(f"t{t % 3}" for t in range(3000)).encode()).hexdigest()
    assert found[3]["loss_chars"] == 6 and found[4]["turns_sha256"] == hashlib.sha256(b"user\nsame\nuser\nsame\n").hexdigest()


LONG = "The harbour was rebuilt after the storm and ships came back in spring. " * 6


def _main_text(html):
    from nameloom.llm.html_text import Page

    page = Page(html)
    return page.text(page.paths[page.best()]).split("\n")


def test_html_wrappers_of_the_main_text_stay():
    long = LONG.strip()
    assert _main_text(f'<body><a class="skip-link" href="#m">Skip to content</a><div class="layout sidebar-right"><article><p>{long}</p></article></div></body>') == [long]
    assert _main_text(f'<body>stray<form id="aspnetForm"><div class="x"><p>{long}</p></div><div class="comments"><p>me too</p></div></form></body>')[-1] == long
    assert _main_text(f'<body><form><div class="x"><p>{long}</p></div></form></body>') == [long]
    assert _main_text(f'<body><a href="#m">Skip</a><div class="promo-layout"><article><p>{long}</p></article></div></body>') == [long]
    beside = f'<div class="comments"><p>{long}</p><p>{long}</p></div><div class="related"><article><p>{long}</p></article></div>'
    assert _main_text(f'<body><div class="x"><p>Short.</p></div><article><p>{long}</p></article>{beside}</body>') == [long]


def test_html_names_inside_an_article():
    own = ['<h2 id="related-work">Work</h2>', '<p class="share-price">Price</p>', '<section id="advertising-revenue"><p>Revenue</p></section>', '<ul class="menu-items"><li>Soup</li></ul>']
    gone = ['<section class="comments"><p>C</p></section>', '<div class="related-posts"><p>R</p></div>', '<div class="ad"><p>A</p></div>']
    assert _main_text(f"<article><p>{LONG}</p>{''.join(own + gone)}</article>") == [LONG.strip(), "Work", "Price", "Revenue", "Soup"]


def test_html_what_stands_beside_the_longest_container():
    long = LONG.strip()
    links = '<div class="x"><ul><li><a href="/a">One of many links</a></li><li><a href="/b">Another of the links</a></li></ul></div>'
    page = f'<body>{links}<div class="post"><h1>Title</h1><div class="lead">Lead.</div><div class="entry"><p>{long}</p></div></div></body>'
    assert _main_text(page) == ["Title", "Lead.", long]
    deep = f"<article><h1>Title</h1><div><div><div><div><p>{long}</p></div></div></div></div></article>"
    assert _main_text(deep) == ["Title", long]
