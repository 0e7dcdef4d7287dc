"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Each document becomes its set of word shingles (64-bit hashes), a digest of
   the set and a signature of `coordinates` minima.  Documents of equal sets form
   a class; only its smallest id goes on.
2. Each class is posted under every coordinate-value pair of its prefix: two
   signatures that agree in at least `matches` of `coordinates` places agree
   somewhere in the first coordinates - matches + 1, so later ones need no
   postings, and lists of one are skipped.
3. The members of a list meet with their signatures, collisions are counted over
   whole signatures, and members that reach `matches` with another are tied.  What
   is tied is skipped from then on, so a list gives a forest and never its pairs.
   A long list is dealt in blocks, each with the list's leaders.  What these leave
   untied meets again: a few strays meet every block; a list of many strangers is
   posted again under bands of further coordinates.  Signatures that are near may
   differ in few of these, so cut into one band more than that, a band agrees.
4. The ties' components are the candidates.  Their members meet with full shingle
   sets, in blocks with leaders as before, then strays against all, and those that
   share enough are linked.  The links' components are the result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, per_process, runs, slices, written

#: Members of a list that meet in one task.
LIST_BLOCK = 4096
#: Members of a candidate group that meet in one task, with their shingle sets.
SET_BLOCK = 1024
#: Shingles that these may hold together (8 MB), so that groups of very long documents meet in smaller blocks.
SET_HASHES = 1_000_000
#: Members of a long list or large group that every block of it meets.
LEADERS = 8


def _lower():
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    """Hashes of words; emptied when it has grown large."""

    def __missing__(self, word):
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 100_000:
                self.clear()
            self[word] = h
        return h


def _constants(n: int, seed: int):
    import numpy as np

    return np.random.RandomState(seed).randint(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text, size: int):
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    import numpy as np

    if not text:
        return np.zeros(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(per_process("lower", _lower)).split()
    if not words:
        return np.zeros(0, np.uint64)
    seen = per_process("words", _Words)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    odd = per_process(("shingle", size), lambda: _constants(size + 1, 5))
    n = len(words)
    if n < size:
        s = np.array([np.uint64(n)], np.uint64) * odd[size]
        for k in range(n):
            s += h[k : k + 1] * odd[k]
    else:
        s = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            s += h[k : n - size + 1 + k] * odd[k]
    s ^= s >> np.uint64(33)
    s *= np.uint64(0xFF51AFD7ED558CCD)
    s ^= s >> np.uint64(33)
    return np.unique(s)


def signature(shingles, coordinates: int):
    """The minimum of each of `coordinates` permutations of 32-bit hashes."""
    import numpy as np

    a, b = per_process(("minhash", coordinates), lambda: (_constants(coordinates, 7).astype(np.uint32)[:, None] | np.uint32(1), _constants(coordinates, 11).astype(np.uint32)[:, None]))
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    best = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        x = low[at : at + 2048] * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= b
        np.minimum(best, x.min(1), out=best)
    return best


def signatures(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (binary)."""

    def sign(batches):
        import hashlib

        for b in slices(batches):
            counts, digests, signs = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, size)
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s, coordinates).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "digest", "signature"])
        per_process("words", _Words).clear()  # an idle worker holds none

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, digest binary, signature binary")


def _post(prefix: int):
    """Each signature under its prefix's coordinate-value pairs."""

    def run(batches):
        import numpy as np

        for b in batches:
            if not b.num_rows:
                continue
            signs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1)[:, :prefix]
            pairs = (np.arange(prefix, dtype=np.int64) << 32) | signs.astype(np.int64)
            ids = np.repeat(np.asarray(b.column(0)), prefix)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.ravel()), pa.array(ids)], names=["pair", "id"])

    return run


def grow(n: int, near):
    """A forest over 0..n-1 as (member, root) pairs, by breadth: near(x, rest)
    says which of the members not yet reached are near x."""
    import numpy as np

    rest = np.arange(n)
    ties = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            found = rest[hit]
            if len(found):
                ties.append((found, root))
                queue.extend(found.tolist())
                rest = rest[~hit]
    return ties


def _ties_out(ids, ties):
    import numpy as np

    u = [ids[x] for x, _ in ties]
    v = [np.full(len(x), ids[r]) for x, r in ties]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + u), np.concatenate(none + v)


def _collide(matches: int):
    """Runs of (pair, i, j): the list's members that agree often enough, tied."""

    def run(batches):
        import numpy as np

        us, vs, held = [], [], 0

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (us, vs)], names=["u", "v"])
            us.clear()
            vs.clear()
            return made

        for t in runs(batches, ["pair", "i", "j"]):
            n = t.num_rows
            if n < 2:
                continue
            ids = t.column("id").to_numpy()
            signs = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(n, -1)
            u, v = _ties_out(ids, grow(n, lambda x, rest: (signs[rest] == signs[x]).sum(1) >= matches))
            us.append(u)
            vs.append(v)
            held += len(u)
            if held > 100_000:
                yield out()
                held = 0
        yield out()

    return run


def _sets(size: int):
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([shingle_set(t, size).tobytes() for t in b.column(4).to_pylist()], pa.binary())], names=["id", "part", "i", "j", "shingles"])
        per_process("words", _Words).clear()

    return run


def _confirm(percent: int):
    """Runs of (part, i, j): candidates linked by what their full sets share."""

    def run(batches):
        import numpy as np

        us, vs = [], []

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (us, vs)], names=["u", "v"])
            us.clear()
            vs.clear()
            return made

        for t in runs(batches, ["part", "i", "j"]):
            n = t.num_rows
            if n < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(n), sizes)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]

            def near(x, rest):
                first, last = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
                count = last - first
                ends = np.cumsum(count)
                both = np.bincount(owner[np.repeat(first - ends + count, count) + np.arange(ends[-1])], minlength=n)[rest]
                return 100 * both >= percent * (sizes[x] + sizes[rest] - both)

            u, v = _ties_out(t.column("id").to_numpy(), grow(n, near))
            us.append(u)
            vs.append(v)
            if len(us) > 1000:
                yield out()
        yield out()

    return run


def _blocks(n, held, block: int, most: int):
    """Blocks for n members that hold so much: one if they fit, else such that
    about half of either limit falls to each, and no more than members."""
    fits = (n <= block) & (held <= most)
    halves = F.greatest(F.ceil(n / F.lit(max(1, block // 2))), F.ceil(held / F.lit(max(1, most // 2))))
    return F.when(fits, F.lit(1)).otherwise(F.least(halves, n)).cast("int")


def _salt(blocks):
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def _first(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, id, i, j): the units in which members first meet.  A key of one block
    meets whole; the blocks of another have its leaders in common, so the work is
    in proportion to its members.  sizes: (key, blocks), a table."""
    units = rows.join(sizes, key).select(key, "id", _salt(F.col("blocks")).alias("i"), F.lit(0).alias("j"))
    hot = sizes.where("blocks > 1").select(key, "blocks")
    own = F.xxhash64("id", F.lit(key))
    leaders = rows.join(hot, key).groupBy(key, "blocks", F.pmod(own, F.lit(LEADERS))).agg(F.min(F.struct(own, "id")).alias("x"))
    leaders = leaders.select(key, F.col("x.id").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"))
    return units.unionByName(leaders)


def _tagged(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the component that each id is tied into so far."""
    named = groups.select("id", "component")
    return written(rows.join(named, "id", "left").select(*rows.columns, F.coalesce("component", "id").alias("comp")), "tagged")


def _untied(tagged: DataFrame, keys: list[str], block: int, most: int) -> DataFrame:
    """(keys, big, strays, others): for each key whose members aren't all tied
    together its largest component, and the blocks of the members in it (others)
    and of those outside (strays).  A table."""
    per = tagged.groupBy(*keys, "comp").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    top = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.max(F.struct("n", "held", "comp")).alias("top")).where("n > top.n")
    strays = _blocks(F.col("n") - F.col("top.n"), F.col("held") - F.col("top.held"), block, most)
    return written(top.select(*keys, F.col("top.comp").alias("big"), strays.alias("strays"), _blocks(F.col("top.n"), F.col("top.held"), max(2, block // 2), max(2, most // 2)).alias("others")), "untied")


def _rest(tagged: DataFrame, untied: DataFrame, key: str) -> DataFrame:
    """(key, id, i, j): the units in which what is outside a key's largest
    component meets all of the key; pairs within that component don't meet again."""
    rows = tagged.join(untied, key)
    inside = rows.where("comp = big").select(key, "id", _salt(F.col("others")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("j"))
    outside = rows.where("comp <> big").select(key, "id", _salt(F.col("strays")).alias("k"), "strays", "others")
    against = outside.select(key, "id", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("i"), F.col("k").alias("j"))
    each = outside.where("strays > 1").select(key, "id", "k", "others", F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("o")).where("k <> o")
    each = each.select(key, "id", (F.col("others") + F.least("k", "o")).cast("int").alias("i"), F.greatest("k", "o").alias("j"))
    return inside.unionByName(against).unionByName(each)


def _together(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "id")


def _again(last: int):
    """Lists' members (pair, at, misses, id, comp, signature) to posts under bands.

    Members that are near agree up to place `at` as their list says and differ in
    at most `misses` of the places from there to `last`.  These are cut into
    misses + 1 bands, of which one must agree; if it is band j, those before it
    used up j misses."""

    def run(batches):
        import numpy as np
        import xxhash

        for b in slices(batches, 2048):
            pair, at, misses, ids, comp = (b.column(k).to_pylist() for k in range(5))
            rows = []
            for p, a, m, i, c, sign in zip(pair, at, misses, ids, comp, b.column(5).to_pylist()):
                size = (last - a) // (m + 1)
                for j in range(m + 1):
                    end = a + (j + 1) * size
                    key = xxhash.xxh64_intdigest(p.to_bytes(8, "little", signed=True) + bytes((j,)) + sign[end - size + 1 : end + 1])
                    rows.append((key - 2**63, end, m - j, i, c))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["pair", "at", "misses", "id", "comp"])

    return run


def _candidates(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(id, component) over signatures (id, signature) that agree in `matches`."""
    misses, last = coordinates - matches, coordinates - 1
    short = written(classes.select("id", "signature").mapInArrow(_short(coordinates), "id long, signature binary"), "short")
    posts = classes.select("id", "signature").mapInArrow(_post(misses + 1), "pair long, id long")
    blocks = _blocks(F.col("n"), F.lit(0), LIST_BLOCK, 1)
    lists = written(posts.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1").select("pair", blocks.alias("blocks")), "lists")

    def tied(units):
        return _together(units.join(short, "id"), "pair").select("pair", "i", "j", "id", "signature").mapInArrow(_collide(matches), "u long, v long")

    found = [written(tied(_first(posts, lists, "pair")), "ties")]
    groups = components(found[0], "candidates")
    hot = lists.where("blocks > 1").select("pair")
    if hot.isEmpty():
        return groups
    # a list's place is where its members agree first, so they differ in all before it
    place = F.shiftright("pair", 32).cast("int")
    state = ["pair", "at", "misses"]
    tagged = _tagged(posts.join(hot, "pair").select("pair", place.alias("at"), (misses - place).alias("misses"), "id", F.lit(0).alias("held")), groups)
    while True:
        untied = _untied(tagged, state, LIST_BLOCK, 1)
        cut = (F.col("strays") > 1) & (F.lit(last) - F.col("at") > F.col("misses"))
        found.append(written(tied(_rest(tagged, untied.where(~cut).drop("at", "misses"), "pair").select("pair", "id", "i", "j")), "ties"))
        many = untied.where(cut).select("pair")
        if many.isEmpty():
            break
        rows = tagged.join(many, "pair").join(short, "id").select(*state, "id", "comp", "signature")
        posts = written(rows.mapInArrow(_again(last), "pair long, at int, misses int, id long, comp long"), "posts")
        lists = posts.groupBy("pair").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("n > 1 and a < b")
        lists = written(lists.select("pair", blocks.alias("blocks")), "lists")
        found.append(written(tied(_first(posts.select("pair", "id"), lists, "pair")), "ties"))
        hot = lists.where("blocks > 1").select("pair")
        if hot.isEmpty():
            break
        tagged = written(posts.join(hot, "pair").select(*state, "id", F.lit(0).alias("held"), "comp"), "tagged")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return components(every, "candidates")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, coordinates: int = 64, matches: int = 34, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept: documents
    are linked if 100 * |intersection| >= percent * |union| of their shingle sets.

    Only A-Z are lower-cased; words are runs without ASCII white space; a text
    of fewer than `size` words is one shingle.  Null, empty and blank texts have
    an empty set and stand alone.  Rows with a null id stand alone too, with a
    null component, and are kept.  Rows that repeat an id return a row each and
    are one document, which is linked by any of its texts.  Other columns are
    left out.

    `matches` of `coordinates` = 34 of 64 loses a link at exactly 0.75 about once
    in 30,000 and those above far more rarely; no link is reported that the full
    sets don't confirm.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(signatures(rows, size, coordinates), "signatures")
    usable = signed.where("digest is not null and doc_id is not null")
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "classes")

    groups = _candidates(classes, coordinates, matches)
    members = groups.select("id", F.col("component").alias("part")).unionByName(groups.select(F.col("component").alias("id"), F.col("component").alias("part")).distinct())
    members = members.distinct().join(usable.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_shingles").alias("held")), "id")
    members = written(members, "members")

    def linked(units):
        """Units meet with full sets, made from the texts again."""
        texts = rows.join(units, F.col("doc_id") == F.col("id")).select("id", "part", "i", "j", "text")
        sets = texts.mapInArrow(_sets(size), "id long, part long, i int, j int, shingles binary").where(F.octet_length("shingles") > 0)
        return _together(sets, "part").mapInArrow(_confirm(percent), "u long, v long")

    blocks = _blocks(F.col("n"), F.col("held"), SET_BLOCK, SET_HASHES)
    sizes = members.groupBy("part").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
    sizes = written(sizes.select("part", blocks.alias("blocks")), "sizes")
    links = written(linked(written(_first(members, sizes, "part"), "units")), "links")
    hot = sizes.where("blocks > 1").select("part")
    if not hot.isEmpty():
        tagged = _tagged(members.join(hot, "part").select("part", "id", "held"), components(links, "links"))
        untied = _untied(tagged, ["part"], SET_BLOCK, SET_HASHES)
        if not untied.isEmpty():
            links = links.unionByName(linked(written(_rest(tagged, untied, "part"), "units")))

    same = usable.join(written(classes.select("digest", "id"), "digests"), "digest").where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    found = components(links.unionByName(same), "links")
    out = signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _short(coordinates: int):
    """A byte of each coordinate, which can only make collisions of more pairs."""

    def run(batches):
        import numpy as np

        for b in batches:
            if b.num_rows:
                signs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, coordinates)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in signs.astype(np.uint8)], pa.binary())], names=["id", "signature"])

    return run


def oracle(size: int = 5, percent: int = 75) -> str:
    """DuckDB SQL for near_duplicates over documents (its ids don't repeat)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {size} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i : i + {size - 1}], ' '))) end as s from words
), shingles as (
  select doc_id, unnest(s) as g from sets
), pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as n from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select u, v from pairs join sets x on x.doc_id = u join sets y on y.doc_id = v where 100 * n >= {percent} * (len(x.s) + len(y.s) - n)
), edges as (
  select u, v from links union all select v, u from links
), reached(id, other) as (
  select doc_id, doc_id from documents union select r.id, e.v from reached r join edges e on e.u = r.other
), least as (
  select id, min(other) as component_id from reached group by id
)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from sets join least on id = doc_id
"""
