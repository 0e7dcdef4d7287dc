"""Byte-level BPE: encoding and decoding over a global shuffle of distinct words.

1. Blocks of documents are split into pre-tokens; a block keeps each distinct
   word once and its documents as positions into that list.
2. The blocks' words go by hash to buckets.  A bucket encodes each distinct word
   of the whole corpus once and sends the ids back to the blocks that asked.
3. Blocks rebuild their documents by position.  To decode them, the table of each
   token's bytes is joined to every block.

Rows are packed (one per block, or per block and bucket that it has words of), so
what is shuffled is a few bytes per distinct word and block, and the positions
once; texts are not.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, per_process, slices

#: Characters of text in a block.  A larger block repeats fewer words.
BLOCK_CHARS = 8_000_000
#: Distinct words (by an estimate) of a bucket.
BUCKET_WORDS = 100_000


def shipped(path: str) -> tuple[str, str, bytes]:
    """A tokenizer's file as it goes to executors, which need not have it: its
    digest, its name and its content."""
    with open(path, "rb") as f:
        data = f.read()
    return hashlib.blake2b(data, digest_size=16).hexdigest(), path, data


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to ids of a .tiktoken file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes:
    printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(data: bytes) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a byte-level tokenizers file whose ids are in the
    order of its merges (else ValueError)."""
    import json

    model = json.loads(data)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
        raise ValueError("added tokens that take what is around them aren't supported")
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["model"]["merges"]]
    order = [model["model"]["vocab"][m] for m in merged]
    if order != sorted(order):
        raise ValueError("ids aren't in the order of merges")
    return ranks, special


def ranks_of(source) -> tuple[dict[bytes, int], dict[str, int]]:
    return ranks_of_json(source[2]) if source[1].endswith(".json") else (read_ranks(source[2]), {})


def encoding(source, pattern: str):
    """encode_ordinary reads every text as plain; encode with allowed_special="all"
    gives added tokens that a text spells their ids."""
    import tiktoken

    ranks, special = ranks_of(source)
    return tiktoken.Encoding("nameloom", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def token_table(spark: SparkSession, source) -> DataFrame:
    """id, bytes of every token; as many rows as the vocabulary has."""
    ranks, special = ranks_of(source)
    every = [*ranks.items(), *((t.encode(), i) for t, i in special.items())]
    return spark.createDataFrame([(i, bytearray(t)) for t, i in every], "id long, bytes binary")


def _zip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_ints(values) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    import numpy as np

    v = np.ascontiguousarray(values, "<u4")
    return _zip(v.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(data: bytes):
    import numpy as np

    planes = np.frombuffer(_unzip(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def _blocks(pattern: str, buckets: int, block_chars: int):
    """Texts to packed blocks: block, doc_ids, lengths (pre-tokens a document),
    codes (of all pre-tokens), and by bucket, if it has words of it, the words'
    codes, lengths, bytes."""

    def block(ids, texts, number):
        import numpy as np
        import regex
        import xxhash

        find = per_process(("pattern", pattern), lambda: regex.compile(pattern)).findall
        codes = _Codes()
        lengths, parts = [], []
        for t in texts:
            words = find(t)
            lengths.append(len(words))
            parts.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
        words = [w.encode() for w in codes]
        where = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.uint32, len(words)) % buckets
        order = np.argsort(where, kind="stable")
        asked = []
        for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(words) else ():
            asked.append({"bucket": int(where[own[0]]), "codes": pack_ints(own), "sizes": pack_ints([len(words[i]) for i in own]), "bytes": _zip(b"".join(words[i] for i in own))})
        key = hashlib.blake2b(digest_size=8)
        key.update(repr((number, ids[:1], ids[-1:], len(ids))).encode())
        return {"block": int.from_bytes(key.digest(), "little", signed=True), "doc_ids": ids, "lengths": lengths, "codes": pack_ints(np.concatenate([np.zeros(0, np.uint32), *parts])), "asked": asked}

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        part, number = task.partitionId() if task else 0, 0
        schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("codes", pa.binary()), ("asked", pa.list_(pa.struct([("bucket", pa.int64()), ("codes", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])))])
        ids, texts, chars = [], [], 0
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                chars += len(texts[-1]) + 16
                if chars >= block_chars:
                    yield pa.RecordBatch.from_pylist([block(ids, texts, (part, number))], schema)
                    ids, texts, chars, number = [], [], 0, number + 1
        if ids:
            yield pa.RecordBatch.from_pylist([block(ids, texts, (part, number))], schema)

    return run


def _encode_bucket(source, pattern: str):
    """Sorted by bucket: every distinct word of a bucket is encoded once."""

    def run(batches):
        import numpy as np

        piece = per_process(("bpe", source[0]), lambda: encoding(source, pattern))._encode_single_piece
        bucket, known = None, {}
        for b in slices(batches, 16):
            for row in b.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                raw, at, found, counts = _unzip(row["bytes"]), 0, [], []
                for size in unpack_ints(row["sizes"]).tolist():
                    word = raw[at : at + size]
                    at += size
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(piece(word), "<u4").tobytes()
                    found.append(ids)
                    counts.append(len(ids) >> 2)
                flat = np.frombuffer(b"".join(found), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([row["codes"]], pa.binary()), pa.array([pack_ints(counts)], pa.binary()), pa.array([pack_ints(flat)], pa.binary())], names=["block", "codes", "counts", "ids"])

    return run


def _packed_tokens(key, t):
    """The token-byte table as one row."""
    import numpy as np

    ids, own = np.asarray(t.column("id")), t.column("bytes").to_pylist()
    return pa.table({"k": pa.array([0], pa.int32()), "ids": pa.array([pack_ints(ids)], pa.binary()), "counts": pa.array([pack_ints([len(x) for x in own])], pa.binary()), "bytes": pa.array([_zip(b"".join(own))], pa.binary())})


def _rebuild(whole: bool):
    """A block's documents from its positions, the ids that came back and the
    bytes of tokens."""

    def run(key, block, answers):
        import numpy as np

        by_id, codes, counts, ids_back = {}, [], [], []
        for row in answers.to_pylist():
            if row["bytes"] is None:
                codes.append(unpack_ints(row["codes"]))
                counts.append(unpack_ints(row["counts"]).astype(np.int64))
                ids_back.append(unpack_ints(row["ids"]))
            else:
                raw, ends = _unzip(row["bytes"]), np.cumsum(unpack_ints(row["counts"]).astype(np.int64)).tolist()
                by_id = {i: raw[a:b] for i, a, b in zip(unpack_ints(row["ids"]).tolist(), [0, *ends], ends)}
        flat = np.concatenate([np.zeros(0, np.uint32), *ids_back])
        size = sum(map(len, codes))
        count, start = np.zeros(size, np.int64), np.zeros(size, np.int64)
        decoded, at = [b""] * size, 0
        for c, n, ids in zip(codes, counts, ids_back):
            count[c] = n
            start[c] = at + np.cumsum(n) - n
            at += int(n.sum())
            tokens, ends = [by_id[i] for i in ids.tolist()], np.cumsum(n).tolist()
            for code, a, b in zip(c.tolist(), [0, *ends], ends):
                decoded[code] = b"".join(tokens[a:b])
        out = []
        for row in block.to_pylist():
            places = unpack_ints(row["codes"])
            at = 0
            for doc_id, n in zip(row["doc_ids"], row["lengths"]):
                own = places[at : at + n]
                at += n
                c = count[own]
                ends = np.cumsum(c)
                total = int(ends[-1]) if n else 0
                ids = flat[np.repeat(start[own] - ends + c, c) + np.arange(total)].astype("<u4")
                text = b"".join([decoded[k] for k in own.tolist()])
                made = {"doc_id": doc_id, "n_tokens": total, "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(text).hexdigest()}
                out.append(made | ({"ids": ids.tolist(), "decoded": text} if whole else {}))
        return pa.Table.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int64())), ("decoded", pa.binary())] if whole else [])))

    return run


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_chars: int = BLOCK_CHARS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns doc_id, n_tokens, the SHA-256 of the ids (little-endian unsigned
    32-bit) and of the decoded bytes, and with_ids the ids and the bytes.  Null
    texts count as empty; empty texts have no ids.  Null ids and repeated rows
    each return a row of their own; other columns are left out.

    Buckets follow from an estimate of the corpus's distinct words, which grow far
    slower than its texts.
    """
    spark = docs.sparkSession
    source = shipped(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = rows.select(F.explode(F.split("text", " ")).alias("word")).agg(F.approx_count_distinct("word")).first()[0] or 0
    buckets = max(1, -(-words // bucket_words), min(2 * spark.sparkContext.defaultParallelism, words // 5000))
    blocks = bucketed(rows.mapInArrow(_blocks(pattern, buckets, block_chars), "block long, doc_ids array<long>, lengths array<long>, codes binary, asked array<struct<bucket long, codes binary, sizes binary, bytes binary>>"), "block", "bpe")
    asked = blocks.select("block", F.explode("asked").alias("a")).select("a.bucket", "block", "a.codes", "a.sizes", "a.bytes")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_bucket(source, pattern), "block long, codes binary, counts binary, ids binary")
    # one row of the vocabulary's size, for every block
    tokens = token_table(spark, source).groupBy(F.lit(0).alias("k")).applyInArrow(_packed_tokens, "k int, ids binary, counts binary, bytes binary")
    tokens = blocks.select("block", F.pmod("block", F.lit(1)).cast("int").alias("k")).join(F.broadcast(tokens), "k").select("block", F.lit(None).cast("binary").alias("codes"), "counts", "ids", "bytes")
    known = answers.withColumn("bytes", F.lit(None).cast("binary")).unionByName(tokens)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded binary" if with_ids else "")
    return blocks.select("block", "doc_ids", "lengths", "codes").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_rebuild(with_ids), schema)
