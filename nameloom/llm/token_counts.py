"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a chunk; the
dynamic programme carries the best score and its number of pieces for each end,
and no back pointers.  Ties go as in the reference unigram tokenizers: of equal
scores the piece that starts first stays, since a later candidate must be
strictly better.  A character that no single-character piece covers may be
unknown (lowest score less 10) and counts its UTF-8 bytes (byte fallback).

White space only begins pieces (checked when the vocabulary is read), so a text
falls into chunks whose optima add up; each worker keeps the counts of the
distinct chunks it met, in a store of bounded size.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shipped
from .common import per_process, slices

SPACE = "▁"


class Unigram:
    """A unigram vocabulary read from a sentencepiece file; scores are kept as
    they stand, so any scored piece list serves."""

    def __init__(self, model: bytes | str, keep: int = 600_000):
        import ahocorasick
        import sentencepiece

        given = {"model_file": model} if isinstance(model, str) else {"model_proto": model}
        model = sentencepiece.SentencePieceProcessor(**given)
        skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)}
        if model.normalize("a  b") != f"{SPACE}a{SPACE}{SPACE}b":
            raise ValueError("only vocabularies that keep all white space and put one space first are supported")
        self.whole = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.unknown = min(pieces.values()) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.keep = keep
        self.seen: dict[str, int] = {}

    def viterbi(self, chunk: str) -> int:
        """Pieces of the best path over one chunk (its spaces already SPACE)."""
        n = len(chunk)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        at = 0
        single = False

        def unknown(end):
            # the last candidate of an end, as it starts last
            score = best[end] + self.unknown
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1] = score
                count[end + 1] = count[end] + len(chunk[end].encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.automaton.iter(chunk):
            while at < end:
                if not single:
                    unknown(at)
                at += 1
                single = False
            start = end + 1 - length
            score += best[start]
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1] = score
                count[end + 1] = count[start] + 1
            single = single or length == 1
        while at < n:
            if not single:
                unknown(at)
            at += 1
            single = False
        return count[n]

    def _chunk(self, word: str) -> int:
        found = self.viterbi(SPACE + word)
        if len(word) <= 64:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            self.seen[word] = found
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.whole or "  " in text or text[0] == " " or SPACE in text:
            chunks = [SPACE + text.replace(" ", SPACE)]
            if not self.whole:
                chunks = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", chunks[0])
            get, word = self.seen.get, self._chunk
            total = 0
            for c in chunks:
                if c.rfind(SPACE) == 0:
                    known = get(c[1:])
                    total += word(c[1:]) if known is None else known
                else:
                    total += self.viterbi(c)
            return total
        total = 0
        get, word = self.seen.get, self._chunk
        for w in text.split(" "):
            known = get(w)
            total += word(w) if known is None else known
        return total


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_chars) of every row, by the unigram vocabulary at path.

    Null and empty texts have 0 tokens; repeated rows and null ids stay as they
    are; other columns are left out.  No shuffle: rows stay where they are read.
    """

    source = shipped(path)

    def count(batches):
        model = per_process(("unigram", source[0]), lambda: Unigram(source[2]))
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([model.count(t or "") for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())],
                names=["doc_id", "n_tokens", "n_chars"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long, n_chars long")
