"""Near-duplicate documents by SimHash fingerprints, searched with a generalised pigeonhole."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.llm.common import ROW, by_batches, cut, documents, keep, maybe_broadcast, numbered, renamed, rows, scope, unsigned_hex
from tributary.llm.components import components, forest

BITS = 64


def _words(hashes: np.ndarray, n: int) -> np.ndarray:
    """The shingles' hashes, a column for each 64-bit word of the fingerprint: as they are in the first, mixed anew in the others."""
    if n == 1:
        return hashes[:, None]
    x = hashes[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(n, dtype=np.uint64)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = hashes
    return x


def shingles(text: bytes | None, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of a text in UTF-8. A text of fewer words than a shingle is one shingle; one without words has none."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, dtype="<u8")
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return np.array([digest(joined, seed)], dtype="<u8")
    ends = list(itertools.accumulate(len(w) + 1 for w in parts))
    return np.array([digest(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[shingle - 1 :])], dtype="<u8")


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42, words: int = 1) -> list[int]:
    """The SimHash of a text in UTF-8, as 64-bit words: a bit is 1 if more than half of the shingles' hashes have it.

    The first word's hash is XXH64. A text of fewer words than a shingle is one shingle; one without words has 0.
    """
    hashes = shingles(text, shingle, seed)
    if not len(hashes):
        return [0] * words
    out = []
    for of in _words(hashes, words).T.copy():
        counts = np.unpackbits(of.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        out.append(int.from_bytes(np.packbits(2 * counts > len(of), bitorder="little").tobytes(), "little"))
    return out


def _names(words: int) -> list[str]:
    return [f"f{i}" for i in range(words)]


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """(__row, id, f0, f1, ...) of each row: the fingerprint's words as signed longs. A null or wordless text has 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t, shingle, seed, words) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            table = np.array(made, dtype="<u8").reshape(len(made), words).view("<i8")
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(table[:, i].copy()) for i in range(words)]], names=[ROW, "id", *_names(words)])

    of = rows(df, id=id, text=text).withColumn("text", F.col("text").cast("string"))
    return by_batches(of, work, f"{ROW} long, id {df.schema[id].dataType.simpleString()}, " + ", ".join(f"{f} long" for f in _names(words)))


@dataclass(frozen=True)
class Part:
    """A group of one word's bits, and how many of them may differ; -1 leaves the group out."""

    word: int
    bits: tuple[int, ...]
    limit: int


def allocate(cost: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Dynamic programming over the groups: limits from -1 that sum to total at the least cost. cost[i][t + 1]: of limit t."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for options in cost:
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (price, chosen) in best.items():
            for limit in range(-1, len(options) - 1):
                now = (price + options[limit + 1], (*chosen, limit))
                if spent + limit not in new or now < new[spent + limit]:
                    new[spent + limit] = now
        best = new
    return best.get(total, (float("inf"), ()))


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[tuple[int, ...]]:
    """m groups of about 64/m bits: each takes the bits that correlate most with those it has. both[i, j]: rows with both bits."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, parts = set(range(BITS)), []
    for size in (BITS // m + (i < BITS % m) for i in range(m)):
        part = [max(free, key=lambda b: (related[b, sorted(free)].max(initial=0), -b))]
        free.discard(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (related[b, part].sum(), -b)))
            free.discard(part[-1])
        parts.append(tuple(sorted(part)))
    return parts


def plan_search(both: list[np.ndarray], n: int, k: int, most: int = 3) -> list[Part]:
    """The cheapest groups and limits, by probes and estimated candidates.

    M groups need limits that sum to k - M + 1. both holds, for each word, counts of single bits and of pairs of bits
    over all fingerprints. Groups are tried in each size; limits above most are not, for their probes are too many.
    """
    plans = []
    for m in range(1, 9):
        groups, cost = [], []
        for word, counts in enumerate(both):
            p = np.diag(counts) / max(n, 1)
            for part in correlated_parts(counts, n, m):
                within = np.zeros(most + 1)  # chance that a pair differs in exactly e of the group's bits
                within[0] = 1
                for d in 2 * p[list(part)] * (1 - p[list(part)]):
                    within[1:] = within[1:] * (1 - d) + within[:-1] * d
                    within[0] *= 1 - d
                options, probes = [0.0], 0
                for e in range(min(most, k) + 1):
                    probes += comb(len(part), e)
                    options.append(float(n * (probes + 1) + n * (n - 1) / 2 * within[: e + 1].sum()) if probes <= 3000 else float("inf"))
                groups.append((word, part))
                cost.append(options)
        price, limits = allocate(cost, k - len(groups) + 1)
        if price < float("inf"):
            plans.append((price, [Part(w, p, t) for (w, p), t in zip(groups, limits, strict=True) if t >= 0]))
    if not plans:
        raise ValueError(f"k = {k} is too large")
    return min(plans, key=lambda x: x[0])[1]


def bit_counts(of: DataFrame, words: int = 1) -> list[np.ndarray]:
    """For each word 64 x 64: fingerprints that have both bits, over all rows of of (f0, ...); 4096 numbers a word come back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, BITS, BITS))
        for batch in batches:
            for w in range(words):
                x = np.ascontiguousarray(batch.column(w).to_numpy()).astype("<i8")
                bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[w] += bits.T @ bits
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    out = np.zeros(words * BITS * BITS)
    for at, n in of.select(*_names(words)).mapInArrow(work, "at long, n double").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    return list(out.reshape(words, BITS, BITS))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(bits: tuple[int, ...]) -> int:
    return _signed(sum(1 << b for b in bits))


def _probes(plan: list[Part]) -> Column:
    """Rows (part, sig) for every value within a group's limit of the fingerprint's bits in it."""
    out = []
    for i, part in enumerate(plan):
        own = F.col(f"f{part.word}").bitwiseAND(F.lit(_mask(part.bits)))
        flips = F.array(*[F.lit(_mask(x)) for e in range(part.limit + 1) for x in itertools.combinations(part.bits, e)])
        out.append(F.transform(flips, (lambda i, own: lambda f: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(f).alias("sig")))(i, own)))
    return F.explode(F.concat(*out))


def _own(plan: list[Part]) -> Column:
    """Rows (part, sig) of the fingerprint's own bits in each group."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"f{p.word}").bitwiseAND(F.lit(_mask(p.bits))).alias("sig")) for i, p in enumerate(plan)]))


def _blocks(words: int, limit: int):
    """Links within a block, or between two, of a large bucket: as spanning stars, never as all pairs."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        side = table.column("block").to_numpy()
        f = [table.column(x).to_numpy() for x in _names(words)]
        one, two = np.flatnonzero(side == key[2].as_py()), np.flatnonzero(side == key[3].as_py())
        a, b = [], []
        for at in range(0, len(one), 256):
            rows_ = one[at : at + 256]
            apart = sum(np.bitwise_count((x[rows_][:, None] ^ x[two][None, :]).view(np.uint64)).astype(np.int16) for x in f)
            i, j = np.nonzero(apart <= limit)
            u, v = forest(node[rows_[i]], node[two[j]])
            a.append(u)
            b.append(v)
        u, v = forest(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"a": u, "b": v})

    return work


def links(distinct: DataFrame, n: int, k: int = 2, limit: int | None = None, words: int = 1, probed: int | None = None, hot: int = 64, block: int = 1024) -> DataFrame:
    """Edges (a, b) that connect the nodes of distinct (node, f0, ...; one row a fingerprint; n rows) by their fingerprints.

    Any two that differ in k bits or fewer are found by the generalised pigeonhole over the first probed words (all
    unless given); of all candidates those within limit bits of all words (k unless given) are linked. Buckets of up to hot values are joined. Larger ones are dealt out in
    blocks of about block values, every pair of blocks to a task of its own, and yield spanning stars: the same
    components, without a row for each pair.
    """
    limit, names = k if limit is None else limit, _names(words)
    plan = plan_search(bit_counts(distinct, probed or words), n, k)
    data = distinct.select("node", *names, _own(plan).alias("x")).select("x.part", "x.sig", "node", *names)
    large = cut(data.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))
    n_large = large.count()
    probing = any(p.limit for p in plan)
    probe = distinct.select("node", *names, _probes(plan).alias("x")).select("x.part", "x.sig", "node", *names) if probing else data
    near = sum(F.bit_count(F.col(f"a.{f}").bitwiseXOR(F.col(f"b.{f}"))) for f in names) <= limit
    if not n_large:
        return probe.alias("a").join(data.alias("b"), ["part", "sig"]).where("a.node < b.node").where(near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    keys = maybe_broadcast(large, n_large)
    cold = data.join(keys, ["part", "sig"], "left_anti")
    cold_probe = probe.join(keys, ["part", "sig"], "left_anti") if probing else cold
    found = cold_probe.alias("a").join(cold.alias("b"), ["part", "sig"]).where("a.node < b.node").where(near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    # All that probe a large bucket take part in it.
    dealt = probe.join(keys, ["part", "sig"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("part", "sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", *names)
    return found.unionByName(dealt.groupBy("part", "sig", "i", "j").applyInArrow(_blocks(words, limit), "a long, b long"))


def simhash_dedup(df: DataFrame, text: str = "text", id: str = "doc_id", k: int = 2, shingle: int = 3, seed: int = 42, words: int = 1, limit: int | None = None, probed: int | None = None) -> DataFrame:
    """Fingerprint and class of each row: (__row, id, f0, ..., component, keep).

    Rows whose fingerprints (of 64 bits times words) differ in k bits or fewer are linked; component is the smallest
    id that a row reaches by links (nulls don't count; null if it reaches none), and keep marks one row of each class:
    that with the smallest id, then the smallest __row. Method: generalised pigeonhole. Correlated bits are grouped,
    the groups' unequal limits are allocated by dynamic programming on estimated candidates, signatures are probed
    and every candidate is verified; with limit, candidates that differ in up to limit bits are linked as well.

    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows each get a row. An empty
    table gives an empty result. Other columns of df are ignored, whatever their names. df is a stored table, read alike each
    time: rows are told apart by their place in it.
    """
    names = _names(words)
    with scope():
        marked = keep(cut(fingerprints(df, text, id, shingle, seed, words)))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(ROW)))
        distinct = cut(marked.groupBy(*names).agg(F.min(ROW).alias("node"), F.min("id").alias("least"), first.alias("first")))
        n = distinct.count()
        if n < 2:
            roots = distinct.select("node", F.col("node").alias("root"))
        else:
            roots = components(cut(links(distinct.select("node", *names), n, k, limit, words, probed)))
        joined = cut(distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        of = cut(joined.groupBy("root").agg(F.min("least").alias("component"), F.min("first").alias("chosen")).select("root", "component", F.col(f"chosen.{ROW}").alias("chosen")))
        classes = keep(cut(joined.select(*names, "root").join(of, "root").select(*names, "component", "chosen")))
    return marked.join(classes, names).select(ROW, "id", *names, "component", (F.col(ROW) == F.col("chosen")).alias("keep"))


def wide_counts(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit of a fingerprint with that many words, lowest bits first; counted in bytes of longs."""
    counts, ones = np.zeros((8, words, 8), dtype=np.int64), np.uint64(0x0101010101010101)
    for at in range(0, len(hashes), 255):
        x = _words(hashes[at : at + 255], words)
        for j in range(8):
            counts[j] += np.add.reduce((x >> np.uint64(j)) & ones, axis=0).astype("<u8").view(np.uint8).reshape(words, 8)
    return counts.transpose(1, 2, 0).reshape(-1)


def _hadamard(n: int) -> np.ndarray:
    out = np.ones((1, 1), dtype=np.float32)
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def strongest(lean: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n hashes below 128 of each row of lean, the fingerprints' counts above or below one half, 64 for each word.

    Each turns the counts by random signs and a Hadamard matrix, and tells which of 64 counters is the strongest, and
    its sign. Close sets agree in that far more often than in seven bits.
    """
    m, width = lean.shape
    words = width // BITS
    rnd, small, large = np.random.default_rng(seed), _hadamard(BITS), _hadamard(words)
    out = np.empty((m, -(-n // words) * words), dtype=np.int64)
    for at in range(0, n, words):
        turned = (lean * rnd.choice(np.array([-1, 1], dtype=np.float32), width)).reshape(-1, BITS) @ small
        turned = np.einsum("vw,mwb->mvb", large, turned.reshape(m, words, BITS), optimize=True)
        best = np.abs(turned).argmax(axis=2)
        out[:, at : at + words] = 2 * best + (np.take_along_axis(turned, best[:, :, None], 2)[:, :, 0] > 0)
    return out[:, :n]


def cosine(similarity: float) -> float:
    """The cosine of two sets of equal size with that Jaccard similarity."""
    return 2 * similarity / (1 + similarity)


def agreement(similarity: float, samples: int = 20_000) -> float:
    """The chance that two sets with that similarity have one of strongest()'s hashes in common, from seeded normal samples, less two deviations."""
    rnd, c = np.random.default_rng(1), cosine(similarity)
    x = rnd.standard_normal((samples, BITS), dtype=np.float32)
    y = c * x + np.sqrt(1 - c * c) * rnd.standard_normal((samples, BITS), dtype=np.float32)
    i, j = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1)
    at = np.arange(samples)
    p = float(((i == j) & ((x[at, i] > 0) == (y[at, j] > 0))).mean())
    return p - 2 * np.sqrt(p * (1 - p) / samples)


def key_plan(n: int, similarity: float, miss: float, hashes: int | None = None) -> tuple[int, int]:
    """(hashes of a key, keys of a text) for n texts: so many hashes that 8 other texts at most share a key by chance, so
    many keys that two texts with that similarity share none with a chance of miss at most, whatever n is."""
    hashes = hashes or next(h for h in range(3, 9) if n <= 8 * 128**h)
    return hashes, int(np.ceil(np.log(miss) / np.log(1 - agreement(similarity) ** hashes)))


def bit_limit(bits: int, similarity: float, deviations: float) -> int:
    """Bits in which two fingerprints of sets with that similarity differ, and so many deviations more (or less)."""
    d = np.arccos(cosine(similarity)) / np.pi
    return int(d * bits + deviations * np.sqrt(d * (1 - d) * bits))


def _sketches(shingle: int, seed: int, words: int, hashes: int, tables: int):
    """(__row, id, d0, d1, f0, ..., keys) of each text's set of shingles: its digest, a fingerprint, its keys."""
    powers = 128 ** np.arange(hashes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, lean = [], np.empty((batch.num_rows, BITS * words), dtype=np.float32)
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                own = np.unique(shingles(text, shingle, seed))
                lean[i] = 2 * wide_counts(own, words) - len(own)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype="<i8"))
            f = np.packbits(lean > 0, axis=1, bitorder="little").view("<i8").reshape(-1, words)
            keys = strongest(lean, hashes * tables).reshape(-1, tables, hashes) @ powers
            d = np.array(digests).reshape(-1, 2)
            columns = [d[:, 0], d[:, 1], *f.T]
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(c.copy()) for c in columns], pa.array(list(keys), pa.list_(pa.int64()))], names=[ROW, "id", "d0", "d1", *_names(words), "keys"])

    return work


def _sets(shingle: int, seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(t, shingle, seed)).view("<i8") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])

    return work


def _apart(one: str, two: str, words: range) -> str:
    return " + ".join(f"bit_count({one}.f{i} ^ {two}.f{i})" for i in words)


def _apart(one: str, two: str, words: int) -> str:
    return " + ".join(f"bit_count({one}f{i} ^ {two}f{i})" for i in range(words))


#: Rows that a key may have for neighbours() to compare all of them.
FEW = 3


def neighbours(met: DataFrame, apart: int, few_apart: int) -> DataFrame:
    """Pairs (a, b) of rows of met (sig, n, node, comp, f0, f1) with other comps that come next to each other or next but one
    in their sig: as many as there are rows, twice at most. Their f0, f1 are at most apart bits apart, or few_apart where a
    sig has no more than FEW rows, for there these are all its pairs."""
    w = Window.partitionBy("sig").orderBy("f0", "node")
    of = lambda k: F.struct(*[F.lag(c, k).over(w).alias(c) for c in ("node", "comp", "f0", "f1")])
    placed = met.select("n", "node", "comp", "f0", "f1", F.array(of(1), of(2)).alias("beside"))
    near = f"x -> x.comp <> comp and {_apart('', 'x.', 2)} <= if(n <= {FEW}, {few_apart}, {apart})"
    return placed.select("node", F.explode(F.expr(f"filter(beside, {near})")).alias("x")).select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()


def sharing(of: DataFrame, words: int, limit: int) -> DataFrame:
    """Pairs (a, b) of rows of of (sig, node, comp, f0, ...) with one sig, other comps and at most limit bits apart."""
    near = F.expr(f"a.node < b.node and a.comp <> b.comp and {_apart('a.', 'b.', words)} <= {limit}")
    return of.alias("a").join(of.alias("b"), "sig").where(near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def _crowd(words: int, limit: int):
    """Pairs (a, b) with other comps and at most limit bits apart, within a block of a crowded key or between two; each at
    the first key only that the two share."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(key: tuple, table: pa.Table) -> pa.Table:
        node, comp, side = (table.column(x).to_numpy() for x in ("node", "comp", "block"))
        f = [table.column(x).to_numpy() for x in _names(words)]
        one, two = np.flatnonzero(side == key[1].as_py()), np.flatnonzero(side == key[2].as_py())
        if not len(one) or not len(two):
            return schema.empty_table()
        table_of, keys = table.column("table")[0].as_py(), np.array(table.column("keys").to_pylist())
        a, b = [], []
        for at in range(0, len(one), 128):
            own = one[at : at + 128]
            away = sum(np.bitwise_count((x[own][:, None] ^ x[two][None, :]).view(np.uint64)).astype(np.int16) for x in f)
            i, j = np.nonzero((away <= limit) & (comp[own][:, None] != comp[two][None, :]))
            i, j = own[i], two[j]
            for lo in range(0, len(i), 4096):
                x, y = i[lo : lo + 4096], j[lo : lo + 4096]
                fresh = np.argmax(keys[x] == keys[y], axis=1) == table_of
                a.append(node[x[fresh]])
                b.append(node[y[fresh]])
        a, b = (np.concatenate(z) if z else np.empty(0, dtype=np.int64) for z in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=schema)

    return work


def crowded(of: DataFrame, own: DataFrame, words: int, limit: int, block: int = 512) -> DataFrame:
    """Pairs (a, b) among the rows of crowded keys, of (sig, table, node, comp, n, f0, ...): see _crowd(). own has (node, keys)."""
    dealt = of.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.hint("merge").join(own.select("node", "keys"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "table", "node", "comp", "keys", *_names(words))
    return dealt.groupBy("sig", "i", "j").applyInArrow(_crowd(words, limit), "a long, b long").distinct()


def shingle_sets(texts: DataFrame, need: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """(node, own): the sets of shingles of those rows of texts (__row, text) that need (node) names."""
    of = texts.hint("merge").join(need.select(F.col("node").alias("of")).distinct(), F.col(ROW) == F.col("of"), "left_semi").select(ROW, "text")
    return cut(by_batches(of, _sets(shingle, seed), "node long, own array<long>", 256))


def jaccard_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, own) have a Jaccard similarity of at least similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.to_numpy() for c in batch.columns[:2])
            x, y = batch.column(2), batch.column(3)
            stays = []
            for i in range(batch.num_rows):
                one, two = x[i].values.to_numpy(), y[i].values.to_numpy()
                both = len(np.intersect1d(one, two, assume_unique=True))
                stays.append(both >= similarity * (len(one) + len(two) - both) - 1e-9)
            keep_ = np.array(stays, dtype=bool)
            yield pa.record_batch([pa.array(a[keep_]), pa.array(b[keep_])], names=["a", "b"])

    one, two = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long")


def _classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes."""
    return nodes.select("node").join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("comp"))


def near_duplicates_out(df: DataFrame, text: str = "text", id: str = "doc_id", similarity: float = 0.8, shingle: int = 5, words: int = 16, k: int = 4, miss: float = 0.002, hashes: int | None = None, hot: int = 64, seed: int = 42) -> DataFrame:
    """The rows of df, a stored table, that stay: of each class of near-duplicates the one with the smallest id.

    Rows are linked if their sets of shingles have a Jaccard similarity of similarity or more. Equal sets are one from
    the start. Sets whose fingerprints differ in k of 128 bits or fewer are found by the generalised pigeonhole, and
    linked at once: at 0.8 19 bits differ, so that is 3.8 deviations off. No pigeonhole reaches 19 bits at a price
    that can be paid; so beyond it candidates share a key of several of strongest()'s hashes. key_plan() takes as many
    keys as hold the chance that a pair at similarity shares none to miss, whatever the number of rows (sets of a few
    shingles, which vary more, may be missed more often). Candidates up to 2.8 deviations beyond the mean of 1024 bits
    are verified by their exact Jaccard similarity; that line costs a pair at similarity a chance of 0.0026 more.

    Rows that come next to each other under a key are verified first, which joins most of a group, however large it is;
    then all pairs between classes that are still apart. Keys that more than hot rows share are compared in blocks for
    that, a task each, and a pair at the first key that the two share.

    Null and wordless texts are one class. Of rows with equal ids, and of those without an id if a class has no other, the
    first in df stays. Repeated rows are near-duplicates; long texts are taken whole. An empty table gives an empty
    result. All columns are kept, whatever their names.
    """
    names = _names(words)
    kind = df.schema[id].dataType.simpleString()
    texts = rows(df, id=id, text=text).withColumn("text", F.col("text").cast("string"))
    hashes, tables = key_plan(df.count(), similarity, miss, hashes)
    schema = f"{ROW} long, id {kind}, d0 long, d1 long, " + ", ".join(f"{f} long" for f in names) + ", keys array<long>"
    with scope():
        marked = cut(by_batches(texts, _sketches(shingle, seed, words, hashes, tables), schema))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(ROW)))
        nodes = cut(marked.groupBy("d0", "d1").agg(F.min(ROW).alias("node"), first.alias("first")).select("node", "first"))
        n = nodes.count()
        chosen = nodes.select(F.col(f"first.{ROW}").alias("of"))
        if n > 1:
            own = cut(marked.hint("merge").join(nodes.select("node"), F.col(ROW) == F.col("node")).select("node", *names, "keys"))
            # Each step that works in Python is written before the next one, so that a task never has two workers.
            close = cut(links(own.select("node", "f0", "f1"), n, k, words=2))
            comps = cut(_classes(nodes, close))
            limit = bit_limit(BITS * words, similarity, 2.8)
            table = F.posexplode("keys").alias("table", "key")
            data = own.hint("merge").join(comps, "node").select("node", "comp", "f0", "f1", table).select((F.col("table").cast("long") * 128**hashes + F.col("key")).alias("sig"), "table", "node", "comp", "f0", "f1")
            w = Window.partitionBy("sig")
            several = lambda df: df.select("*", F.count(F.lit(1)).over(w).alias("n"), F.min("comp").over(w).alias("lo"), F.max("comp").over(w).alias("hi")).where("lo <> hi").drop("lo", "hi")
            met = cut(several(data))
            known = lambda: comps.where("node <> comp").toDF("a", "b")
            verified = lambda pairs: cut(jaccard_links(pairs, sets, similarity), 128)
            # Neighbours first, if they look close enough: they join most of a group, however large it is. Keys that a few
            # rows share, by chance for the most part, are done with then.
            near = cut(neighbours(met, bit_limit(2 * BITS, similarity, 1), bit_limit(2 * BITS, similarity, 3.5)))
            # Sets are made once, of all that is or may be compared.
            sets = shingle_sets(texts, near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(met.where(F.col("n") > FEW).select("node")), shingle, seed)
            comps = cut(_classes(nodes, known().unionByName(verified(near))))
            # Then all pairs of classes that are still apart.
            apart = several(met.where(F.col("n") > FEW).select("sig", "table", "node").hint("merge").join(comps, "node"))
            apart = cut(apart.hint("merge").join(own.select("node", *names), "node"))
            pairs = sharing(apart.where(F.col("n") <= hot), words, limit)
            large = apart.where(F.col("n") > hot)
            if not large.isEmpty():
                pairs = pairs.unionByName(crowded(large, own, words, limit)).distinct()
            comps = _classes(nodes, known().unionByName(verified(cut(pairs))))
            chosen = nodes.join(comps, "node").groupBy("comp").agg(F.min("first").alias("first")).select(F.col(f"first.{ROW}").alias("of"))
        stays = keep(cut(chosen))
    return renamed(numbered(df).hint("merge").join(stays, F.col(ROW) == F.col("of"), "left_semi"), df)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (3-word shingles) and near-duplicate class (2 bits) of every document."""
    out = simhash_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), unsigned_hex(F.col("f0")).alias("fingerprint"), F.col("component").alias("component_id"), "keep")
