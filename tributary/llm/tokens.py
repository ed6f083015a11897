"""Token counts under a unigram vocabulary, without making the tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import ROW, by_batches, documents, rows

#: The mark that stands for a space, and what an unknown character costs below the least score of the vocabulary.
SPACE, PENALTY = "▁", 10.0
#: Words whose counts a worker remembers. Others are counted anew, so this bounds memory, not results.
REMEMBERED = 400_000


class Counter:
    """Counts the pieces of the best segmentation under a unigram vocabulary, as tokenizers' Unigram finds it.

    vocab is a list of (piece, score). An Aho-Corasick automaton gives all pieces that end at each character; dynamic
    programming carries the best score and its number of pieces. Ties go as in the tokenizer: candidates for a place
    come by their start, earliest first, and a later one must score higher to win. A character that no piece of one
    character covers may also be unknown, at the least score minus 10; neighbouring unknown characters are one piece,
    or, with byte fallback and all bytes in the vocabulary, a piece for each byte.
    """

    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in dict(reversed(vocab)).items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - PENALTY
        pieces = {p for p, _ in vocab}
        self.by_bytes = byte_fallback and all(f"<0x{b:02X}>" in pieces for b in range(256))
        #: No piece goes on past a space mark, so words can be counted one by one.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.seen: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """The number of pieces of a text in which spaces are marks already."""
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (size, score) in self.automaton.iter(text):
            ends[last + 1].append((size, score))
        best, count, fused = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for at in range(1, n + 1):
            found, top, own, unknown = False, 0.0, 0, False
            single = False
            for size, score in sorted(ends[at], reverse=True):  # the longest piece starts earliest
                single = single or size == 1
                now = best[at - size] + score
                if not found or now > top:
                    found, top, own, unknown = True, now, count[at - size] + 1, False
            if not single:
                now = best[at - 1] + self.unknown
                if not found or now > top:
                    if self.by_bytes:
                        own = count[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
                    else:
                        own = count[at - 1] + (not fused[at - 1])
                    top, unknown = now, True
            best[at], count[at], fused[at] = top, own, unknown
        return count[n]

    def count(self, text: str) -> int:
        """The number of pieces of a text; one space goes before it, as the vocabulary's words have."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return self.segment(marked)
        # A word is its marks and what follows up to the next mark.
        parts = marked.split(SPACE)
        total, marks, seen = 0, 0, self.seen
        for part in parts[1:]:
            marks += 1
            if part:
                word = SPACE * marks + part if marks > 1 else part
                n = seen.get(word)
                if n is None:
                    n = self.segment(SPACE * marks + part)
                    if len(seen) < REMEMBERED and len(word) < 64:
                        seen[word] = n
                total, marks = total + n, 0
        return total + (self.segment(SPACE * marks) if marks else 0)


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol buffer; varints are ints, the others bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = raw[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file, in order of their ids."""
    with open(path, "rb") as f:
        raw = f.read()
    out = []
    for number, value in _fields(raw):
        if number == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0" * 4), "<f4")[0])))
    return out


#: Added to a piece's place in the law by which its probability falls.
OFFSET = 50


def log_probabilities(vocab: list[tuple[str, float]], offset: float = OFFSET) -> list[tuple[str, float]]:
    """The pieces, in their order, with log-probabilities by the law of Zipf and Mandelbrot: one over place and offset.

    A merge vocabulary's scores only rank its pieces, so the place is that by score, then by id; pieces without a score
    (0), which are controls and bytes, come last. Nothing is fitted: tokenizers are not trained here.
    """
    order = sorted(range(len(vocab)), key=lambda i: (vocab[i][1] == 0, -vocab[i][1], i))
    weight = np.empty(len(vocab))
    weight[order] = 1 / (np.arange(1, len(vocab) + 1) + offset)
    return [(piece, float(x)) for (piece, _), x in zip(vocab, np.log(weight / weight.sum()), strict=True)]


@lru_cache(maxsize=2)
def unigram(path: str) -> list[tuple[str, float]]:
    """The unigram vocabulary of a SentencePiece model file: its own scores if they are log-probabilities, those of
    log_probabilities() if they are ranks, as a merge vocabulary's whole numbers are."""
    vocab = read_vocabulary(path)
    return log_probabilities(vocab) if all(s == int(s) for _, s in vocab) else vocab


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(unigram(path))


def count_tokens(df: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(__row, id, n_chars, n_tokens) of each row, under the unigram vocabulary that unigram() makes of the SentencePiece model in path.

    Count-only Viterbi over Aho-Corasick matches, exact to the tokenizer's ties. Words repeat, so each worker
    remembers a bounded number of them. Nothing is shuffled. Null and empty texts have 0 tokens; repeated rows each
    get a row; an empty table gives an empty result; other columns are ignored. Every worker reads path.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            n = pa.array([of.count(t) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(map(len, texts), pa.int64()), n], names=[ROW, "id", "n_chars", "n_tokens"])

    of = rows(df, id=id, text=text).withColumn("text", F.col("text").cast("string"))
    return by_batches(of, work, f"{ROW} long, id {df.schema[id].dataType.simpleString()}, n_chars long, n_tokens long")


def op9_tokens(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Tokens of every document under the 32,000 pieces of a public vocabulary, as a unigram model."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    out = count_tokens(documents(spark, sf_dir), vocabulary)
    return out.select(F.col("id").alias("doc_id"), "n_chars", "n_tokens")
