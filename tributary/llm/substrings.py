"""Exact substring deduplication: byte strings of a fixed length that also start in a document with a smaller id.

Positions are dealt out by the minimizer of their string, as runs of neighbours that share it, and each bucket sorts its
positions by bucket-pointer refinement. A deal fills FAN buckets at most, whatever the input's size, so that what a task
sends to one bucket stays worth a blob; buckets that are too large are dealt out once more. Crowded buckets are split by
a second minimizer, runs of equal bytes are sent once by each task, and of a run that goes round in circles one round is
sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import ROW, by_batches, cut, documents, maybe_broadcast, ordered_ids, release, rows

LENGTH = 50
GRAM = 8
#: Bytes of text that a task turns into runs before it sends them, and that it hashes at a time.
FLUSH, CHUNK = 16 << 20, 2 << 20
#: Bytes of runs that a bucket sorts at a time, and numbers that are hashed at a time, so that they stay in the cache.
SLICE, BLOCK = 8 << 20, 1 << 15
#: Buckets that one deal fills at most, and bytes of text that a bucket should hold at most.
FAN, MOST = 2048, 16 << 20
LAST = np.iinfo(np.int64).max

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: Orders of 8-grams by which buckets that are too large are dealt out again, one after the other. The first is that of
#: the first deal, so runs stay whole; by the others they are cut where their minimizer changes.
_ORDERS = (_A, _B, _D)
DEALT = "bucket long, kind long, n long, numbers binary, bytes binary"


def _mix(x: np.ndarray, y: np.ndarray | None = None, by: np.uint64 = _A) -> np.ndarray:
    """A hash of each x, or of each pair (x, y); by chooses among hashes."""
    out = np.empty(len(x), dtype=np.uint64)
    for at in range(0, len(x), BLOCK):
        h = np.multiply(x[at : at + BLOCK], by, out=out[at : at + BLOCK])
        if y is not None:
            other = y[at : at + BLOCK]
            h += (other ^ (other >> np.uint64(31))) * _C
        h ^= h >> np.uint64(29)
        h *= _B
        h ^= h >> np.uint64(32)
    return out


def _grams(buf: bytes) -> np.ndarray:
    """The 8 bytes from each position of buf as a number; buf is padded by 8 bytes at least."""
    return np.ndarray((len(buf) - GRAM,), dtype="<u8", buffer=buf, strides=(1,))


def minimizers(buf: bytes, length: int = LENGTH, by: np.uint64 = _A) -> np.ndarray:
    """The least hash of an 8-gram in the string of this length at each position of buf, which is padded by 8 bytes."""
    grams, width = _grams(buf), length - GRAM + 1
    out = np.empty(max(0, len(grams) - width + 1), dtype=np.uint64)
    for at in range(0, len(out), BLOCK):
        low, have = _mix(grams[at : at + BLOCK + width - 1], by=by), 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        n = min(BLOCK, len(out) - at)
        np.minimum(low[:n], low[width - have : width - have + n], out=out[at : at + n])
    return out


def runs(texts: list[bytes], length: int = LENGTH, by: np.uint64 = _A) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, minimizer) of each run: neighbouring positions of a text whose strings share a minimizer.

    The bytes from start to end hold all the strings of the run. Texts shorter than length have no run.
    """
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    buf = b"".join(texts) + b"\0" * (length + GRAM)
    begin = np.cumsum(lens) - lens
    low = minimizers(buf, length, by)[: int(lens.sum())]
    turn = np.empty(len(low), dtype=bool)
    turn[:1] = True
    np.not_equal(low[1:], low[:-1], out=turn[1:])
    has = lens >= length
    turn[begin[has]] = True
    over = begin[has] + lens[has] - length + 1  # the first position whose string would leave the text
    turn[over[over < len(low)]] = True
    start = np.flatnonzero(turn)
    end = np.append(start[1:], len(low))
    text = np.searchsorted(begin, start, side="right") - 1
    fits = start + length <= begin[text] + lens[text]
    start, end, text = start[fits], end[fits], text[fits]
    low = low[start]
    # A run may still reach past the last string of its text where the next text goes on with the same minimizer.
    end = np.minimum(end, begin[text] + lens[text] - length + 1)
    return text, start - begin[text], end - begin[text] + length - 1, low


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as differences, compressed; first bytes first, then second bytes, as those are alike."""
    raw = b"".join(np.diff(np.asarray(a, dtype="<i8"), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=6).compress(raw)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(n, 8, -1)
    return [np.cumsum(np.ascontiguousarray(x.T).view("<i8").ravel()) for x in planes]


def _by_target(row: np.ndarray, start: np.ndarray, end: np.ndarray, per: int) -> Iterator[tuple[int, bytes]]:
    """Spans as one blob for each group of rows (row // per)."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    target = row // per
    edges = np.flatnonzero(np.diff(target, prepend=-1)).tolist() + [len(row)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(target[a]), _pack(row[a:b], start[a:b], end[a:b] - start[a:b])


def period(part: bytes, length: int = LENGTH) -> int:
    """The period of a long run, or 0: a text that goes round in circles has few strings, however long it is."""
    if len(part) <= 4 * length:
        return 0
    p = part.find(part[:length], 1)
    return p if 0 < p <= len(part) // 2 - length and part[p:] == part[:-p] else 0


def _all_runs(texts: list[bytes], length: int, by: np.uint64 = _A) -> tuple[np.ndarray, ...]:
    """runs() of any number of texts, CHUNK bytes at a time."""
    chunks, at, size = [runs([], length, by)], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            text, start, end, low = runs(texts[at : i + 1], length, by)
            chunks.append((text + at, start, end, low))
            at, size = i + 1, 0
    return tuple(np.concatenate(x) for x in zip(*chunks, strict=True))


def _texts(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[tuple[list, list, list[bytes]]]:
    """(row ids, ids, texts) of rows with a string, most bytes at a time."""
    row, ids, texts, size = [], [], [], 0
    for batch in batches:
        for r, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if t and len(t) >= length:
                row.append(r)
                ids.append(LAST if i is None else i)
                texts.append(t)
                size += len(t)
                if size >= most:
                    yield row, ids, texts
                    row, ids, texts, size = [], [], [], 0
    if texts:
        yield row, ids, texts


def _count(buckets: int, length: int):
    """Strings by bucket, over all texts of a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, _, texts in _texts(batches, length, CHUNK):
            _, start, end, low = runs(texts, length)
            bucket = (low % np.uint64(buckets)).astype(np.int64)
            total += np.bincount(bucket, weights=np.minimum(end - start, 4 * length) - length + 1, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return work


def _blobs(row: np.ndarray, id_: np.ndarray, offset: np.ndarray, texts: list[bytes], place: Callable, per: int, length: int) -> pa.RecordBatch:
    """The runs of texts, which start at offset of their documents, as a blob for each bucket (DEALT; kind 0).

    place(texts, order) gives (text, start, end, bucket) of the runs of texts, which are in that order of what was
    given. Of runs with equal bytes only those of the smallest id go on. The others are found: their spans are
    blobs for groups of rows (kind is the group and 1).
    """
    # In order of ids, so that the first of equal runs has the smallest id.
    order = np.argsort(id_, kind="stable")
    texts, id_, row, offset = [texts[i] for i in order.tolist()], id_[order], row[order], offset[order]
    text, start, end, bucket = place(texts, order)
    order = np.lexsort((start, text, bucket))
    text, start, end, bucket = text[order], start[order], end[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
    out: list[list] = [[], [], [], [], []]
    press = zstandard.ZstdCompressor(level=6)
    found: list[np.ndarray] = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        first: dict[bytes, int] = {}
        parts, keep, again, whole = [], [], [], []
        for k, d, t, s, e in zip(range(lo, hi), id_[text[lo:hi]].tolist(), text[lo:hi].tolist(), start[lo:hi].tolist(), end[lo:hi].tolist(), strict=True):
            part = texts[t][s:e]
            circle = period(part, length) if e - s > 4 * length else 0
            if circle:
                part = part[: circle + length - 1]
            if first.setdefault(part, d) == d:
                parts.append(part)
                keep.append(k)
                whole.append(e - s if circle else 0)
            else:
                again.append(k)
        kept = np.array(keep)
        joined = b"".join(parts)
        numbers = _pack(id_[text[kept]], row[text[kept]], offset[text[kept]] + start[kept], np.array(list(map(len, parts))), np.array(whole))
        for column, x in zip(out, (int(bucket[lo]), 0, len(joined), numbers, press.compress(joined)), strict=True):
            column.append(x)
        if again:
            found.append(np.array(again))
    if found:
        every = np.concatenate(found)
        at = offset[text[every]]
        for target, blob in _by_target(row[text[every]], at + start[every], at + end[every], per):
            for column, x in zip(out, (target, target + 1, 0, blob, None), strict=True):
                column.append(x)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["bucket", "kind", "n", "numbers", "bytes"])


def _deal(buckets: int, length: int, per: int, hot: dict[int, tuple[int, int]]):
    """Runs of a task's texts, by bucket.

    hot maps a crowded bucket to the first of the buckets that take its place and their number: its runs are cut
    where a second minimizer changes, which then says which of these they go to.
    """

    def place(texts: list[bytes], _: np.ndarray) -> tuple[np.ndarray, ...]:
        text, start, end, low = _all_runs(texts, length)
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        crowded = np.isin(bucket, list(hot))
        if not crowded.any():
            return text, start, end, bucket
        which = np.flatnonzero(crowded)
        parts = [texts[t][a:b] for t, a, b in zip(text[which].tolist(), start[which].tolist(), end[which].tolist(), strict=True)]
        of, a, b, second = _all_runs(parts, length, _C)
        which = which[of]
        first, n = (np.array([hot[x][k] for x in bucket[which].tolist()], dtype=np.int64) for k in (0, 1))
        again = text[which], start[which] + a, start[which] + b, first + (second % n.astype(np.uint64)).astype(np.int64)
        return tuple(np.concatenate([x[~crowded], y]) for x, y in zip((text, start, end, bucket), again, strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids, texts in _texts(batches, length, FLUSH):
            yield _blobs(np.array(row, dtype=np.int64), np.array(ids, dtype=np.int64), np.zeros(len(row), dtype=np.int64), texts, place, per, length)

    return work


def _unrolled(part: bytes, whole: int, length: int) -> bytes:
    """The bytes of a run of which one round was sent."""
    circle = len(part) - length + 1
    return (part[:circle] * (-(-whole // circle)))[:whole] if whole else part


def _deal_again(length: int, per: int, by: np.uint64):
    """Rows of DEALT and parts: each bucket's runs dealt out to as many buckets as its parts say, by the hash of their minimizer."""

    def flush(held: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        press = zstandard.ZstdDecompressor()
        texts, numbers, parent, parts = [], [], [], []
        for bucket, n, blob, packed in held:
            own = _unpack(blob, 5)
            raw, size, whole = press.decompress(packed), own[3], own[4]
            begin = np.cumsum(size) - size
            texts += [_unrolled(raw[a : a + k], w, length) for a, k, w in zip(begin.tolist(), size.tolist(), whole.tolist(), strict=True)]
            numbers.append(own[:3])
            parent.append(np.full(len(size), bucket))
            parts.append(np.full(len(size), n))
        id_, row, start = (np.concatenate(x) for x in zip(*numbers, strict=True))
        of, into = np.concatenate(parent), np.concatenate(parts).astype(np.uint64)

        def place(texts: list[bytes], order: np.ndarray) -> tuple[np.ndarray, ...]:
            text, a, b, low = _all_runs(texts, length, by)
            own = order[text]
            # Two buckets that get the same number share a task, and nothing else.
            return text, a, b, (_mix(_mix(low, by=_C) % into[own], of[own].view(np.uint64)) >> np.uint64(1)).astype(np.int64)

        return _blobs(row, id_, start, texts, place, per, length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            done = batch.filter(pa.array(kind > 0))
            if done.num_rows:
                yield done.select(["bucket", "kind", "n", "numbers", "bytes"])
            for r in batch.filter(pa.array(kind == 0)).to_pylist():
                held.append((r["bucket"], r["parts"], r["numbers"], r["bytes"]))
                size += r["n"]
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return work


def deal_again(dealt: DataFrame, most: int, length: int = LENGTH, per: int = 1024, fan: int = FAN) -> DataFrame:
    """dealt, where buckets of more than most bytes of runs are dealt out again, to fan buckets at most each.

    Each deal sends every byte of such a bucket once more, so the work a byte grows with the number of deals: the
    logarithm of the input to the base of fan. Sizes are aggregated, and joined as a table; the driver sees a count.
    """
    for by in _ORDERS:
        stored = cut(dealt)
        sizes = stored.groupBy("bucket").agg(F.sum("n").alias("size")).where(F.col("size") > most)
        large = cut(sizes.select(F.col("bucket").alias("of"), F.least(F.lit(fan), F.ceil(F.col("size") * 2 / most)).cast("int").alias("parts")))
        if not (n := large.count()):
            release(large)
            return stored
        marked = stored.join(maybe_broadcast(large, n), F.col("bucket") == F.col("of"), "left").drop("of")
        again = marked.where("parts is not null").repartition("bucket").mapInArrow(_deal_again(length, per, by), DEALT)
        dealt = marked.where("parts is null").drop("parts").unionByName(again)
    return dealt


def refine(buf: bytes, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the positions of at whose strings of this length occur again, sorted, and the group of equal ones.

    Bucket-pointer refinement: the first buckets are those of 16-grams. A bucket's positions are then sorted by the
    bucket identifiers at a later offset: that 16 bytes on makes buckets of 32-grams, and of those the identifier
    length - 32 bytes on makes buckets of whole strings. Positions alone in a bucket are left out at once. Identifiers
    are hashes of the grams; at the end the bytes of each group are compared, so groups are exact.
    """
    assert 32 < length <= 64
    grams = _grams(buf)
    ident = _mix(grams[:-GRAM], grams[GRAM:])
    alive = np.arange(len(at))

    def keep(key: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), dtype=bool)
        again[1:] = same
        again[:-1] |= same
        return alive[order[again]], key[again]

    p = at
    alive, _ = keep(ident[p], alive)
    p = at[alive]
    alive, _ = keep(_mix(ident[p], ident[p + 16]), alive)
    p, q = at[alive], at[alive] + (length - 32)
    alive, key = keep(_mix(_mix(ident[p], ident[p + 16]), _mix(ident[q], ident[q + 16])), alive)
    if not len(alive):
        return alive, alive
    head = np.empty(len(key), dtype=bool)
    head[0] = True
    np.not_equal(key[1:], key[:-1], out=head[1:])
    group = np.cumsum(head) - 1
    p = at[alive]
    first = p[np.flatnonzero(head)][group]
    differ = np.zeros(len(p), dtype=bool)
    for off in [*range(0, length - GRAM, GRAM), length - GRAM]:
        differ |= grams[p + off] != grams[first + off]
    if differ.any():  # two strings with one identifier: part the group by its bytes
        for g in np.unique(group[differ]).tolist():
            own, names = np.flatnonzero(group == g), {}
            for i in own.tolist():
                text = buf[p[i] : p[i] + length]
                group[i] = names.setdefault(text, g if not names else int(group.max()) + 1)
        order = np.argsort(group, kind="stable")
        alive, group = alive[order], group[order]
    return alive, group


def repeated(text: bytes, size: np.ndarray, whole: np.ndarray, id_: np.ndarray, row: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, start, end) of the strings in these runs that also start in a run with a smaller id.

    text is the runs' bytes, one after the other; size, id_, row and start say how many bytes each has and whence. Of
    a run that goes round in circles these are the bytes of one round, and whole says how long it is; else that is 0.
    """
    if len(text) <= SLICE or len(size) < 2:
        return _repeated(text, size, whole, id_, row, start, length)
    # All strings of a run share its minimizer: that of its first string tells which slice it goes to.
    begin, low = np.cumsum(size) - size, np.full(len(size), 2**64 - 1, dtype=np.uint64)
    grams = _grams(text + b"\0" * GRAM)
    for off in range(length - GRAM + 1):
        np.minimum(low, _mix(grams[begin + off]), out=low)
    n, out = len(text) // SLICE + 1, []
    part = (_mix(low // np.uint64(65_537)) % np.uint64(n)).astype(np.int64)
    for k in range(n):
        own = np.flatnonzero(part == k)
        if len(own):
            joined = b"".join([text[a:b] for a, b in zip(begin[own].tolist(), (begin + size)[own].tolist(), strict=True)])
            out.append(_repeated(joined, size[own], whole[own], id_[own], row[own], start[own], length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _repeated(text: bytes, size: np.ndarray, whole: np.ndarray, id_: np.ndarray, row: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.empty(0, dtype=np.int64)
    strings = size - length + 1
    run = np.repeat(np.arange(len(size), dtype=np.int32), strings)
    at = np.arange(len(run)) + run.astype(np.int64) * (length - 1)
    order, group = refine(text + b"\0" * (2 * GRAM), at, length)
    if not len(order):
        return none, none, none
    ids = id_[run[order]]
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(ids, heads)
    counts = np.diff(np.append(heads, len(group)))
    found = np.sort(order[ids > np.repeat(least, counts)])
    if not len(found):
        return none, none, none
    own = run[found]
    breaks = (np.diff(found, prepend=-2) != 1) | (np.diff(own, prepend=-1) != 0)
    a = np.flatnonzero(breaks)
    b = np.append(a[1:], len(found)) - 1
    r = own[a]
    # The first and the last string of each span, counted within its run; those of a round come again in each round.
    begin = (np.cumsum(size) - size)[r]
    low, high, round_, last = at[found[a]] - begin, at[found[b]] - begin, strings[r], np.maximum(whole, size)[r] - length
    full = (low == 0) & (high == round_ - 1)
    round_, high = np.where(full, last + 1, round_), np.where(full, last, high)
    times = (last - low) // round_ + 1
    k = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    i = np.repeat(np.arange(len(r)), times)
    r, low, high = r[i], low[i] + k * round_[i], np.minimum(high[i] + k * round_[i], last[i])
    return row[r], start[r] + low, start[r] + high + length


def _sort(length: int, per: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        targets, blobs = [], []
        texts, numbers = [], []
        press = zstandard.ZstdDecompressor()
        for kind, blob, text in zip(table.column("kind").to_pylist(), table.column("numbers"), table.column("bytes"), strict=True):
            if kind:
                targets.append(kind - 1)
                blobs.append(blob.as_py())
                continue
            numbers.append(_unpack(blob.as_py(), 5))
            texts.append(press.decompress(text.as_py()))
        if texts:
            id_, row, start, size, whole = (np.concatenate(x) for x in zip(*numbers, strict=True))
            for target, blob in _by_target(*repeated(b"".join(texts), size, whole, id_, row, start, length), per):
                targets.append(target)
                blobs.append(blob)
        return pa.table({"target": pa.array(targets, pa.int64()), "numbers": pa.array(blobs, pa.binary())})

    return work


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """The maximal spans of each row: starts and ends as one array of numbers."""
    row, start, size = (np.concatenate(x) for x in zip(*(_unpack(b, 3) for b in table.column("numbers").to_pylist()), strict=True))
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + size)[order]
    edges = np.flatnonzero(np.diff(row, prepend=-1)).tolist() + [len(row)]
    spans = []
    for a, b in zip(edges, edges[1:], strict=False):
        s, reach = start[a:b], np.maximum.accumulate(end[a:b])
        new = np.flatnonzero(np.append(True, s[1:] > reach[:-1]))
        spans.append(np.stack([s[new], reach[np.append(new[1:], b - a) - 1]]).ravel())
    return pa.table({"of": pa.array(row[edges[:-1]], pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64()))})


def repeats(df: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, bucket: int = 1 << 20, per: int = 1024, fan: int = FAN, most: int = MOST) -> DataFrame:
    """(of, spans): for each __row with a repeated string, starts and then ends of its maximal spans, in bytes.

    df, read alike each time, has __row, text and id; per rows in turn are merged together. Buckets are to hold bucket
    bytes of text, or more where they would be more than fan; beyond most bytes they are dealt out again.
    """
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(min(max(1, -(-total // bucket)), fan))
    of = df.select(ROW, id, text)
    # Buckets of common 8-grams hold many times their share; fewer than a third of all buckets can.
    share = max(1, total // buckets)
    crowded = by_batches(of, _count(buckets, length), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > 3 * share)
    hot, next_ = {}, buckets
    for r in sorted(crowded.collect()):
        n = -(-r["n"] // share)
        hot[r["bucket"]] = (next_, n)
        next_ += n
    dealt = by_batches(of, _deal(buckets, length, per, hot), DEALT)
    if share > most:
        dealt = deal_again(dealt, 4 * most, length, per, fan)  # runs hold about three times the bytes of their text
    found = dealt.groupBy("bucket").applyInArrow(_sort(length, per), "target long, numbers binary")
    return found.groupBy("target").applyInArrow(_merge, "of long, spans array<long>")


def dedup_substrings(df: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, bucket: int = 1 << 20) -> DataFrame:
    """(__row, id, n_bytes, n_removed, spans, kept): each text in UTF-8 without the bytes of repeated strings.

    A byte goes if a string of length bytes (33 to 64) covers it that also starts in a row with a smaller id, judged
    on the input; matches never cross texts. spans holds starts, then ends, of the maximal removed runs (null: none).
    The strings of rows with equal ids don't remove each other. A null id counts as larger than any other. Null texts
    are empty; texts shorter than length keep everything. Ids are whole numbers, or of any other type that Spark
    sorts. An empty table gives an empty result; other columns are ignored. df is a stored table, read alike each
    time: rows are told apart by their place in it.
    """
    of = rows(df, id=id, text=text).withColumn("text", F.col("text").cast("string"))
    whole = df.schema[id].dataType.typeName() in ("byte", "short", "integer", "long")
    of = of.withColumn("order", F.col("id").cast("long")) if whole else ordered_ids(of)
    kind = df.schema[id].dataType.simpleString()
    spans = repeats(of, "text", "order", length, bucket)
    of = of.select(ROW, "id", "text")

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts go through the shuffle compressed one by one, better than its blocks of rows are."""
        to = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            made = [to.compress(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=[ROW, "id", "pressed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, gone, kept = [], [], []
            for blob, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                t, n = back.decompress(blob), len(s or ()) // 2
                starts, ends = (s[:n], s[n:]) if s else ([], [])
                sizes.append(len(t))
                gone.append(sum(ends) - sum(starts))
                kept.append(b"".join(t[a:b] for a, b in zip([0, *ends], [*starts, len(t)], strict=True)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), batch.column(3), pa.array(kept, pa.binary())], names=[ROW, "id", "n_bytes", "n_removed", "spans", "kept"])

    pressed = by_batches(of, press, f"{ROW} long, id {kind}, pressed binary")
    joined = pressed.join(spans, pressed[ROW] == spans["of"], "left").select(ROW, "id", "pressed", "spans")
    return joined.mapInArrow(work, f"{ROW} long, id {kind}, n_bytes long, n_removed long, spans array<long>, kept binary")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings that an earlier one has."""
    out = dedup_substrings(documents(spark, sf_dir))
    n_spans = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans") / 2).cast("long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same, by all strings of 50 bytes.
SQL = """with docs as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as k, encode(coalesce(text, '')) as b from documents),
strings as (select r, k, p, b[p:p + 49] as s from (select r, k, b, unnest(range(1, octet_length(b) - 48)) as p from docs where octet_length(b) >= 50)),
firsts as (select s, min(k) as k from strings group by s having count(*) > 1),
found as (select strings.r, p from strings join firsts using (s) where firsts.k < strings.k),
marked as (select r, p, case when p <= lag(p) over w + 50 then 0 else 1 end as new from found window w as (partition by r order by p)),
runs as (select r, g, min(p) as a, max(p) + 50 as z from (select *, sum(new) over (partition by r order by p) as g from marked) group by r, g),
kept as (select r, a, coalesce(lag(z) over (partition by r order by a), 1) as f, z, lead(a) over (partition by r order by a) as next from runs),
pieces as (select kept.r, f as o, hex(b[f:a - 1]) as x from kept join docs using (r) union all select kept.r, z, hex(b[z:octet_length(b)]) from kept join docs using (r) where next is null),
left_ as (select r, unhex(string_agg(x, '' order by o)) as b from pieces group by r),
sums as (select r, sum(z - a)::bigint as n_removed, count(*)::bigint as n_spans from runs group by r)
select doc_id, octet_length(docs.b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(coalesce(left_.b, docs.b)) as kept_sha256 from docs left join sums using (r) left join left_ using (r)"""
