"""Packing documents into training sequences: best-fit decreasing, certified by bounds and repacked where there are gaps."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import ROW, by_batches, cut, documents, rows

END = 2
CAPACITY = 1024


@lru_cache(maxsize=4)
def encoder(path: str):
    """Encodes a list of texts into lists of ids, as the byte-level BPE tokenizer in path does with add_special_tokens=False.

    Texts below U+0250 go to tiktoken with the same vocabulary, which gives the same ids several times as fast. Others
    go to tokenizers itself, as the two may class rare letters by different versions of Unicode; so do texts that hold
    the string of an added token, which tokenizers takes for that token.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, added = file["model"], [t["content"] for t in file.get("added_tokens") or ()]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    words = [w for w, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
    ranks = {bytes(as_byte[c] for c in w): model["vocab"][w] for w in words if all(c in as_byte for c in w)}
    fast = tiktoken.Encoding("packing", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks={k: v for k, v in ranks.items() if k not in [a.encode() for a in added]}, special_tokens={})
    odd = re.compile("|".join(["[^\x00-ɏ]", *map(re.escape, added)])).search

    def encode(texts: list[str]) -> list[list[int]]:
        return [exact.encode(t, add_special_tokens=False).ids if odd(t) else fast.encode_ordinary(t) for t in texts]

    return encode


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else full ones after a shorter first one, if any is left."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(df: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(__row, id, piece, start, length, ids): each document's ids and the end id, cut into pieces of capacity ids at most.

    ids is binary: unsigned 32-bit, little-endian. A null or empty text is the end id alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(encode([t or "" for t in batch.column(2).to_pylist()])):
                raw = np.array([*ids, end], dtype="<u4").tobytes()
                for piece, (start, length) in enumerate(cut_points(len(ids) + 1, capacity)):
                    for column, x in zip(out, (i, piece, start, length, raw[4 * start : 4 * (start + length)]), strict=True):
                        column.append(x)
            at = pa.array(out[0], pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=[ROW, "id", "piece", "start", "length", "ids"])

    of = rows(df, id=id, text=text).withColumn("text", F.col("text").cast("string"))
    return by_batches(of, work, f"{ROW} long, id {df.schema[id].dataType.simpleString()}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each item, and the room left in each bin. Ties keep the items' order."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r left
    for i in order.tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_ &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        where[i], offset[i] = b, capacity - r
        room[b] = r - size
        by_room[r - size].append(b)
        if r > size:
            open_ |= 1 << (r - size)
    return where, offset, np.array(room, dtype=np.int64)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that these items need at least; counts[s] items have length s. The most of the total and of two families of
    dual-feasible functions: in the first, for a limit t up to half, items over capacity - t count whole and items
    under t not at all; the second rounds every length down to a step of 1/j-th."""
    size = np.arange(len(counts))
    best = -(-int((size * counts).sum()) // capacity)
    above = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])
    mass = np.concatenate([[0], np.cumsum(size * counts)])
    for t in range(1, capacity // 2 + 1):
        whole = int(above[capacity - t + 1])
        rest = int(mass[capacity - t + 1] - mass[t])
        best = max(best, whole + -(-rest // capacity))
    for j in range(1, 101):
        # x -> floor((j + 1) x) / j, but x where (j + 1) x is whole; in units of 1 / (j * capacity)
        scaled = (j + 1) * size
        value = np.where(scaled % capacity == 0, j * size, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (j * capacity)))
    return best


def _pack(round_: int, parts: int, last: bool, capacity: int):
    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ROW, "piece"], kind="stable")
        lengths = pdf["length"].to_numpy()
        where, offset, room = best_fit(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        # A partition at its bound gives the bins that are less than nine tenths full: several partitions' make fewer.
        spare = np.where(len(room) > bound, 0, capacity // 10 if parts > 1 else capacity)
        return pd.DataFrame(
            {
                ROW: pdf[ROW],
                "piece": pdf["piece"],
                "length": lengths,
                "sequence_id": (np.int64(round_) << 56) + (np.int64(key[0]) << 28) + where,
                "offset": offset,
                "room": room[where],
                "open": (not last) & (room[where] > spare),
                "bins": len(room),
                "bound": bound,
            }
        )

    return work


def pack(pieces: DataFrame, capacity: int = CAPACITY, share: int = 8192, rounds: int = 4) -> DataFrame:
    """(__row, piece, sequence_id, offset, room): where each piece (__row, piece, length) goes, by best-fit decreasing.

    Full pieces are sequences of their own. The others are dealt by a hash of their keys into partitions of about
    share pieces. Each is packed alone, and a lower bound from dual-feasible functions certifies its count of bins.
    Where the count is above the bound, the documents of the bins with gaps are exchanged, and of partitions at their
    bound those of the emptier bins: all these are dealt anew and packed again, for some rounds or until no partition
    has a gap to give. An exchange can't lose: if the new packing needs more bins than the documents had, the round's
    old bins stay. certificate() tells how far all of it is from the bound over all pieces.
    """
    key = F.xxhash64(ROW, "piece")
    full = pieces.where(F.col("length") == capacity).select(ROW, "piece", (-(F.monotonically_increasing_id() + 1)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("room"))
    todo, done = pieces.where(F.col("length") < capacity).select(ROW, "piece", "length"), [full]
    n, had, old = todo.count(), None, None
    schema = f"{ROW} long, piece int, length long, sequence_id long, offset long, room long, open boolean, bins long, bound long"
    for i in range(rounds):
        parts = max(1, -(-n // share))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64(key, F.lit(i)), F.lit(parts)))
        now = cut(dealt.groupBy("part").applyInPandas(_pack(i, parts, i == rounds - 1, capacity), schema))
        closed, left = now.where("not open"), now.where("open")
        counts = now.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("open"), F.col("sequence_id"))), F.sum(F.col("open").cast("long"))).first()
        if had is not None and counts[0] >= had:
            done.append(old)
            return _placed(done)
        done.append(closed)
        if not counts[2]:
            return _placed(done)
        had, old, n, todo = counts[1], left, counts[2], left.select(ROW, "piece", "length")
    return _placed(done)


def _placed(tables: list[DataFrame]) -> DataFrame:
    out = None
    for t in tables:
        t = t.select(ROW, "piece", "sequence_id", "offset", "room")
        out = t if out is None else out.unionByName(t)
    return out


def pack_documents(df: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(__row, id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Null texts count as empty; such documents are the end id alone. Repeated rows are packed as often as they occur.
    An empty table gives an empty result. Other columns of df are ignored, whatever their names. sequences() gives
    the packed ids themselves.
    """
    made = tokenize(df, path, text, id, capacity, end)
    pieces = cut(made.select(ROW, "id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pieces.join(pack(pieces, capacity), [ROW, "piece"]).select(ROW, "id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(df: DataFrame, path: str, text: str = "text", id: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(sequence_id, ids, length): the packed sequences, ids as an array of ints in order of offset.

    Null texts count as empty; repeated rows are packed as often as they occur, long texts over several sequences. An
    empty table gives an empty result; other columns of df are ignored, whatever their names.
    """
    pieces = cut(tokenize(df, path, text, id, capacity, end))
    placed = pieces.join(pack(pieces, capacity), [ROW, "piece"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), dtype="<u4").astype(np.int32)
        return pa.table({"sequence_id": [key[0].as_py()], "ids": [ids], "length": [len(ids)]})

    return placed.groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids array<int>, length long")


def certificate(placed: DataFrame, pieces: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, lower bound over all pieces); only the counts by length come to the driver."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    return placed.agg(F.count_distinct("sequence_id")).first()[0], lower_bound(counts, capacity)


def op3_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents, tokenized and packed into sequences of 1024 ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = pack_documents(documents(spark, sf_dir), tokenizer)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
