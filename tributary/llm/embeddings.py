"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping cluster shards and searched by range.

Every vector is in its two nearest cells, so the graph's united lists lead from a shard to others through the vectors
that they share. A search walks a shard; where it comes into range of a vector that is also in another shard, it goes on
there in the next round, from that vector.
"""

from __future__ import annotations

import functools
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import ROW, cut, documents, keep, maybe_broadcast, release, scope
from tributary.llm.components import components, forest

_log = logging.getLogger(__name__)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """k unit centres of the sample's unit vectors by spherical k-means, started from spread-out members."""
    rnd = np.random.default_rng(seed)
    k = min(k, len(sample))
    chosen = [int(rnd.integers(len(sample)))]
    near = sample @ sample[chosen[0]]
    for _ in range(1, k):
        weight = np.maximum(1 - near, 0) ** 2
        total = weight.sum()
        chosen.append(int(rnd.choice(len(sample), p=weight / total)) if total > 0 else int(rnd.integers(len(sample))))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    centre = sample[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centre)
    return centre


def robust_prune(x: np.ndarray, degree: int = 16, far: int = 8, pool: int = 64, alpha: float = 1.2, seed: int = 7) -> list[np.ndarray]:
    """Neighbours of each unit vector of a shard, by their positions.

    A vector's candidates are its pool nearest ones and some at random. The nearest is taken, and it rules out those
    that are alpha times nearer to it than to the vector; then the nearest of the rest, and so on, up to degree, and
    up to far more among the random ones, which lead across the shard. Edges are also taken backwards.
    """
    n = len(x)
    if n < 2:
        return [np.empty(0, dtype=np.int64) for _ in range(n)]
    x = x.astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    near = min(pool, n - 1)
    own = np.argpartition(-s, near - 1, axis=1)[:, :near]
    rnd = np.random.default_rng(seed)
    other = rnd.integers(0, n, size=(n, 4 * far))
    other[:, 0] = int(np.argmax(x @ x.mean(axis=0)))  # the medoid

    def prune(candidates: np.ndarray, most: int) -> np.ndarray:
        rows = np.arange(n)[:, None]
        score = s[rows, candidates]
        order = np.argsort(-score, axis=1, kind="stable")
        candidates, score = candidates[rows, order], score[rows, order]
        away = np.sqrt(np.maximum(2 - 2 * score, 0))
        alive = score > -1.5
        alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
        out = np.full((n, most), -1)
        for j in range(most):
            any_ = alive.any(axis=1)
            if not any_.any():
                break
            first = np.argmax(alive, axis=1)
            picked = candidates[np.arange(n), first]
            out[any_, j] = picked[any_]
            alive[np.arange(n), first] = False
            apart = np.sqrt(np.maximum(2 - 2 * s[picked[:, None], candidates], 0))
            alive &= alpha * apart > away
        return out

    edges = np.concatenate([prune(own, degree), prune(other, far)], axis=1)
    u, j = np.nonzero(edges >= 0)
    v = edges[u, j]
    a, b = np.concatenate([u, v]), np.concatenate([v, u])
    key = np.unique(a * np.int64(n) + b)
    a, b = key // n, key % n
    # Backward edges may crowd at a few vectors: the nearest are kept, and those pruned from it.
    order = np.lexsort((-s[a, b], a))
    a, b = a[order], b[order]
    start = np.searchsorted(a, np.arange(n + 1))
    return [b[start[i] : min(start[i + 1], start[i] + 2 * (degree + far))] for i in range(n)]


def _build(dim: int):
    def work(key: tuple, table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        adjacent = robust_prune(_unit(_matrix(table.column("vec"), dim)))
        return pa.table({"of": node, "adjacent": pa.array([node[a] for a in adjacent], pa.list_(pa.int64()))})

    return work


def range_search(x: np.ndarray, adjacent: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float, beam: int, margin: float = 0.04) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (query, vector, dot product) within margin below threshold, or above it, that walking the graph found.

    x and q hold unit vectors, adjacent the neighbours' positions padded with -1, own a position in x for each query or
    -1. A walk starts at the medoid, and at own if there is one, and beam times opens the best place not yet opened.
    Then the range expands: every place in range is opened too, until none is left.
    """
    x, q = x.astype(np.float32), q.astype(np.float32)
    m, c = len(x), len(q)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    seen = np.full((c, m), -2, dtype=np.float32)  # the dot product, once known
    fresh = np.full((c, m), -2, dtype=np.float32)  # the same, until opened
    rows = np.arange(c)

    def meet(qi: np.ndarray, vi: np.ndarray) -> None:
        new = seen[qi, vi] < -1.5
        key = np.unique(qi[new] * np.int64(m) + vi[new])
        qi, vi = key // m, key % m
        for a in range(0, len(qi), 1 << 17):
            one, two = qi[a : a + (1 << 17)], vi[a : a + (1 << 17)]
            dot = np.einsum("ij,ij->i", q[one], x[two])
            seen[one, two] = dot
            fresh[one, two] = dot

    meet(rows, np.full(c, medoid))
    meet(rows[own >= 0], own[own >= 0])
    for _ in range(beam):
        best = np.argmax(fresh, axis=1)
        on = np.flatnonzero(fresh[rows, best] > -1.5)
        if not len(on):
            break
        fresh[on, best[on]] = -2
        to = adjacent[best[on]]
        i, j = np.nonzero(to >= 0)
        meet(on[i], to[i, j])
    while True:
        qi, vi = np.nonzero(fresh >= threshold - margin)
        if not len(qi):
            break
        fresh[qi, vi] = -2
        for a in range(0, len(qi), 1 << 15):
            to = adjacent[vi[a : a + (1 << 15)]]
            i, j = np.nonzero(to >= 0)
            meet(qi[a : a + (1 << 15)][i], to[i, j])
    qi, vi = np.nonzero(seen >= threshold - margin)
    return qi, vi, seen[qi, vi]


#: What _search() gives out: FOUND (a, shard, links), EDGE (a, b), ASKED and REACHED (a is to search shard from b on).
FOUND, EDGE, ASKED, REACHED = range(4)
_MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("shard", pa.int64()), ("links", pa.int64())])


def _search(dim: int, threshold: float, beam: int, exact: bool, chunk: int = 256):
    """One shard and some of its queries.

    A query whose walk meets a link is held against the whole shard in double precision, so its links there don't
    depend on how the walk went. Of these links those whose first home this is count, so that each counts once.
    """

    def work(key: tuple, members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return _MET.empty_table()
        shard = key[0].as_py()
        node, mult, homes = members.column("node").to_numpy(), members.column("mult").to_numpy(), np.array(members.column("homes").to_pylist())
        raw, asked = _matrix(members.column("vec"), dim), _matrix(queries.column("vec"), dim)
        name, home = queries.column("node").to_numpy(), queries.column("home").to_numpy()
        entry = queries.column("entry").fill_null(-1).to_numpy()
        order = np.argsort(node)

        def find(of: np.ndarray) -> np.ndarray:
            at = order[np.minimum(np.searchsorted(node[order], of), len(node) - 1)]
            return np.where(node[at] == of, at, -1)

        x, q = _unit(raw), _unit(asked)
        raw_size, asked_size = np.linalg.norm(raw, axis=1), np.linalg.norm(asked, axis=1)
        first = homes[:, 0] == shard
        if not exact:
            lists = members.column("adjacent").to_pylist()
            adjacent = np.full((len(node), max(1, max(len(a or ()) for a in lists))), -1)
            for i, a in enumerate(lists):
                if a:
                    adjacent[i, : len(a)] = find(np.array(a))
        out: list[list[np.ndarray]] = [[], [], [], [], []]

        def tell(kind: int, a: np.ndarray, b: np.ndarray, of: np.ndarray, links: np.ndarray) -> None:
            for column, values in zip(out, (np.full(len(a), kind, dtype=np.int32), a, b, of, links), strict=True):
                column.append(values)

        def once(kind: int, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> None:
            """One row for each of a and shard."""
            at = np.unique(np.stack([a, of]), axis=1, return_index=True)[1]
            tell(kind, a[at], b[at], of[at], np.zeros(len(at), dtype=np.int64))

        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, len(name), chunk):
            part = np.arange(lo, min(lo + chunk, len(name)))
            if exact:
                hit = part
            else:
                start = np.where(entry[part] >= 0, find(entry[part]), find(name[part]))
                qi, vi, dot = range_search(x, adjacent, q[part], start, threshold, beam)
                qi = part[qi]
                hit = np.unique(qi[(dot >= threshold - 1e-4) & (name[qi] != node[vi])])
                for h in range(homes.shape[1]):  # other shards of the places in range
                    on = homes[vi, h] != shard
                    once(REACHED, name[qi[on]], node[vi[on]], homes[vi[on], h])
            if not len(hit):
                continue
            cosine = asked[hit] @ raw.T / (asked_size[hit][:, None] * raw_size)
            i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)  # near the line all tasks add up alike
            cosine[i, j] = np.einsum("ij,ij->i", asked[hit[i]], raw[j]) / (asked_size[hit[i]] * raw_size[j])
            linked = (cosine >= threshold) & (name[hit][:, None] != node)
            with_links = linked.any(axis=1)
            hit, linked = hit[with_links], linked[with_links]
            tell(FOUND, name[hit], name[hit], np.full(len(hit), shard), (linked[:, first] * mult[first]).sum(axis=1))
            i, j = np.nonzero(linked)
            one, two = hit[i], j
            edges.append(forest(name[one], node[two]))
            if not exact:  # a link holds both ways: each is to be searched for in the other's first home
                once(ASKED, node[two], name[one], home[one])
                once(ASKED, name[one], node[two], homes[two, 0])
        if edges:
            u, v = forest(*(np.concatenate(e) for e in zip(*edges, strict=True)))
            tell(EDGE, u, v, np.zeros(len(u), dtype=np.int64), np.zeros(len(u), dtype=np.int64))
        if not out[0]:
            return _MET.empty_table()
        return pa.table([pa.array(np.concatenate(c), f.type) for c, f in zip(out, _MET, strict=True)], schema=_MET)

    return work


def _assign(centre: np.ndarray, dim: int, visits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _unit(_matrix(batch.column(1), dim)) @ centre.T
            cells = np.argsort(-near, axis=1, kind="stable")[:, :visits].astype(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(list(cells), pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return work


def _assign_below(dim: int, visits: int):
    """Vectors of one head after the other, each after the centres (cell not null) that it may go to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells, rows, centre = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            head, salt = batch.column("head").to_numpy(), batch.column("salt").to_numpy()
            is_centre = batch.column("cell").is_valid().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (np.diff(head) != 0) | (np.diff(salt) != 0) | (np.diff(is_centre.astype(np.int8)) != 0))).tolist() + [batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                run = batch.slice(a, b - a)
                if key != (head[a], salt[a]):
                    key, cells, rows, centre = (head[a], salt[a]), [], [], None
                matrix = _unit(_matrix(run.column("vec"), dim))
                if is_centre[a]:
                    cells.append(run.column("cell").to_numpy())
                    rows.append(matrix)
                    centre = None
                    continue
                if centre is None:
                    centre, names = np.concatenate(rows), np.concatenate(cells)
                near = np.argsort(-(matrix @ centre.T), axis=1, kind="stable")[:, :visits]
                yield pa.record_batch([run.column("node"), run.column("vec"), run.column("mult"), pa.array(list(names[near]), pa.list_(pa.int64()))], names=["node", "vec", "mult", "cells"])

    return work


def _placed(nodes: DataFrame, dim: int, n: int, shard: int, overlap: int, visits: int, sample: int, most: int) -> DataFrame:
    """nodes (node, vec, mult) with cells, the visits nearest ones of each, nearest first.

    Up to most cells have centres fitted on a sample of at most sample vectors. Where more are needed, such centres are
    heads: each head's vectors have centres of their own, most at most, fitted on a hashed share of them (16 for each
    centre), and a vector's cells are the nearest among those of its head and of the seven heads next to it.
    """
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(3))).limit(sample).select("vec").collect()
    drawn = _unit(np.array([r[0] for r in drawn], dtype=np.float64))
    cells = -(-n * overlap // shard)
    kind = nodes.schema["vec"].dataType.simpleString()
    schema = f"node long, vec {kind}, mult long, cells array<long>"
    heads = centroids(drawn, max(1, min(cells, len(drawn) // 16, most)))
    if cells <= most:
        return nodes.select("node", "vec", "mult").mapInArrow(_assign(heads, dim, visits), schema)
    headed = cut(nodes.select("node", "vec", "mult").mapInArrow(_assign(heads, dim, 1), schema).withColumn("head", F.col("cells")[0]).drop("cells"))
    share = int(min(1.0, 16 * overlap / shard) * 1_000_000)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        own = _unit(_matrix(table.column("vec"), dim))
        centre = centroids(own, max(1, min(len(own) // 16, most)))
        head = key[0].as_py()
        return pa.table({"of": np.full(len(centre), head), "cell": head * (1 << 20) + np.arange(len(centre)), "vec": pa.array(list(centre), pa.list_(pa.float64()))})

    subs = headed.where(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1_000_000)) < share).groupBy("head").applyInArrow(fit, "of long, cell long, vec array<double>")
    near = np.argsort(-(heads @ heads.T), axis=1, kind="stable")[:, :8]
    next_to = nodes.sparkSession.createDataFrame([(int(h), int(o)) for h in range(len(heads)) for o in near[h]], "head long, of long")
    sizes = headed.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / 200_000).cast("int").alias("salts"))  # as many rows as heads
    subs = cut(subs).join(F.broadcast(next_to), "of").join(F.broadcast(sizes), "head").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None).cast("long")
    centres = subs.select("head", "salt", "cell", none.alias("node"), F.col("vec").cast(kind).alias("vec"), none.alias("mult"))
    rows = headed.join(F.broadcast(sizes), "head").select("head", F.pmod(F.xxhash64("node", F.lit(8)), F.col("salts")).cast("int").alias("salt"), none.alias("cell"), "node", "vec", "mult")
    dealt = centres.unionByName(rows).repartition("head", "salt").sortWithinPartitions("head", "salt", F.col("cell").asc_nulls_last())
    return dealt.mapInArrow(_assign_below(dim, visits), schema)


def audit(nodes: DataFrame, found: DataFrame, dim: int, threshold: float, sample: int = 512) -> float:
    """The mean recall of a sample of vectors with links: the share of each one's links, by brute force over all rows, that
    found (a, links) has. A vector of a large group weighs no more than one of a pair."""
    asked = [(r["node"], r["vec"]) for r in nodes.orderBy(F.xxhash64("node", F.lit(11))).limit(sample).select("node", "vec").collect()]
    names, q = np.array([a for a, _ in asked]), np.array([v for _, v in asked], dtype=np.float64)
    q_size = np.linalg.norm(q, axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x, node, mult = _matrix(batch.column(1), dim), batch.column(0).to_numpy(), batch.column(2).to_numpy()
                linked = (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * q_size) >= threshold
                total += ((linked & (node[:, None] != names)) * mult[:, None]).sum(axis=0)
        yield pa.record_batch([pa.array(names), pa.array(total)], names=["a", "n"])

    true = dict(nodes.select("node", "vec", "mult").mapInArrow(work, "a long, n long").groupBy("a").agg(F.sum("n")).collect())
    got = dict(found.where(F.col("a").isin(names.tolist())).select("a", "links").collect())
    shares = [min(n, got.get(a, 0)) / n for a, n in true.items() if n]
    return float(np.mean(shares)) if shares else 1.0


def _walked(nodes: DataFrame, dim: int, n: int, threshold: float, shard: int, overlap: int, visits: int, beam: int, sample: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(a, links) of each vector with any, and edges (a, b) that span the linked ones, by rounds of searches."""
    placed = cut(_placed(nodes, dim, n, shard, overlap, visits, sample, most))
    overlap = min(overlap, visits)
    # A cell with too many members is several shards, which all who visit the cell visit.
    in_cell = placed.select(F.explode(F.slice("cells", 1, overlap)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parts = cut(in_cell.select("cell", F.ceil(F.col("n") / (2 * shard)).cast("long").alias("parts")))
    n_parts = parts.count()
    number = lambda cell, part: cell * (1 << 20) + part
    own = placed.select("node", F.posexplode(F.slice("cells", 1, overlap)).alias("rank", "cell")).join(maybe_broadcast(parts, n_parts), "cell")
    own = own.select("node", "rank", number(F.col("cell"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts"))).alias("shard"))
    homes = own.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "shard"))), lambda x: x["shard"]).alias("homes"))
    # A vector that is in fewer cells than others has its first home again.
    member = cut(placed.select("node", "vec", "mult").join(homes, "node").withColumn("homes", F.transform(F.sequence(F.lit(1), F.lit(overlap)), lambda i: F.coalesce(F.try_element_at("homes", i), F.col("homes")[0]))))
    spread = member.withColumn("shard", F.explode(F.array_distinct("homes")))
    lists = spread.groupBy("shard").applyInArrow(_build(dim), "of long, adjacent array<long>")
    united = cut(lists.groupBy("of").agg(F.array_distinct(F.flatten(F.collect_list("adjacent"))).alias("adjacent")))
    members = cut(spread.join(united, F.col("node") == F.col("of")).select("shard", "node", "vec", "mult", "homes", "adjacent"))
    todo = placed.select("node", F.explode("cells").alias("cell")).join(maybe_broadcast(parts, n_parts), "cell")
    todo = todo.select("node", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    todo = cut(todo.select("node", number(F.col("cell"), F.col("part")).alias("shard"), F.lit(None).cast("long").alias("entry")))
    visited, found = [], []
    while True:
        met = _round(members, member, todo, dim, threshold, shard, beam, False)
        visited.append(todo.select("node", "shard"))
        found.append(met)
        every = lambda tables: functools.reduce(DataFrame.unionByName, tables)
        told = every([m.where(F.col("kind") == FOUND).select(F.col("a").alias("node"), "shard") for m in found])
        wanted = lambda kind: met.where(F.col("kind") == kind).select(F.col("a").alias("node"), "shard", "b")  # noqa: E731, B023
        # Nobody goes twice to a shard, but where a link is known that an earlier walk there has missed.
        new = wanted(ASKED).join(told, ["node", "shard"], "left_anti").unionByName(wanted(REACHED).join(every(visited), ["node", "shard"], "left_anti"))
        todo = cut(new.groupBy("node", "shard").agg(F.min("b").alias("entry")))
        if todo.isEmpty():
            break
    all_ = every(found)
    counts = all_.where(F.col("kind") == FOUND).groupBy("a").agg(F.sum("links").alias("links"))
    return counts, all_.where(F.col("kind") == EDGE).select("a", "b")


def _round(members: DataFrame, vectors: DataFrame, todo: DataFrame, dim: int, threshold: float, shard: int, beam: int, exact: bool) -> DataFrame:
    """_search() for todo (node, shard, entry); a shard's queries are cut into blocks, each of which meets its members."""
    blocks = cut(todo.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (4 * shard)).cast("int").alias("blocks")))
    blocks_hint = maybe_broadcast(blocks, blocks.count())
    query = todo.join(blocks_hint, "shard").join(vectors.select("node", "vec", F.col("homes")[0].alias("home")), "node")
    block = F.pmod(F.xxhash64("node", F.lit(6)), F.col("blocks")).cast("int").alias("block")
    query = query.select(block, *[F.col(c).alias(c) for c in ("shard", "node", "vec", "home", "entry")])
    met = members.join(blocks_hint, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return cut(met.groupBy("shard", "block").cogroup(query.groupBy("shard", "block")).applyInArrow(_search(dim, threshold, beam, exact), "kind int, a long, b long, shard long, links long"))


def _exhausted(nodes: DataFrame, dim: int, n: int, threshold: float, shard: int) -> tuple[DataFrame, DataFrame]:
    """The same by comparing all vectors with all, a shard and some of its queries at a time."""
    shards = -(-n // (2 * shard))
    member = cut(nodes.select("node", "vec", "mult", F.array(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(shards))).alias("homes")))
    members = member.withColumn("shard", F.col("homes")[0])
    todo = member.select("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(None).cast("long").alias("entry"))
    met = _round(members, member, todo, dim, threshold, shard, 0, True)
    return met.where(F.col("kind") == FOUND).groupBy("a").agg(F.sum("links").alias("links")), met.where(F.col("kind") == EDGE).select("a", "b")


def _links(nodes: DataFrame, dim: int, n: int, threshold: float, shard: int, overlap: int, visits: int, beam: int, sample: int, recall: float, most: int, told: list) -> tuple[DataFrame, DataFrame]:
    """_walked(), audited: below recall it is done again, wider; if that isn't enough either, all vectors are compared."""
    for attempt in range(3):
        with scope():
            if attempt < 2:
                counts, edges = _walked(nodes, dim, n, threshold, shard, overlap, max(overlap, visits) * 2**attempt, beam * 2**attempt, sample, most)
            else:
                counts, edges = _exhausted(nodes, dim, n, threshold, shard)
            counts, edges = cut(counts), cut(edges)
            reached = audit(nodes, counts, dim, threshold)
            told.append({"dimension": dim, "vectors": n, "attempt": attempt, "recall": reached})
            _log.info("recall %.4f of %d vectors of %d numbers, attempt %d", reached, n, dim, attempt)
            if reached >= recall:
                return keep(counts), keep(edges)
    raise RuntimeError(f"a recall of {recall} was not reached: {told}")


def embedding_dedup(df: DataFrame, vec: str = "embedding", id: str = "vec_id", threshold: float = 0.9, shard: int = 1500, overlap: int = 2, visits: int = 3, beam: int = 16, sample: int = 20_000, recall: float = 0.97, most: int = 1024, told: list | None = None) -> DataFrame:
    """(__row, id, n_links, component, keep) of each row: other rows at a cosine of threshold or more, and their class.

    Equal vectors are searched once. Centres are fitted on sample vectors at most, in order of a hash, or, where more
    than most cells of about shard vectors are needed, in two levels on hashed shares of the vectors; every vector is then
    put in its overlap nearest cells. Each cell's shard builds a graph by robust pruning; the lists that a vector has in
    its shards are united. Every vector searches its visits nearest cells, from their medoids and from itself, greedily,
    then expanding the range; vectors in range lead on to the other shards that hold them, round after round until none
    is new. A link is searched from both sides, and counted, once, in the first home of the vector found, so n_links is
    symmetric. Links are verified in double precision, and come back as counts and spanning edges, not as pairs.

    The recall is audited against brute force over all rows, for a sample of 512 vectors, and told as a dict in the list
    told and in the log. Below recall the search is repeated with twice the visits and the beam; if that too stays below,
    all vectors are compared with all. component is the smallest id that a row reaches (nulls don't count), keep whether
    that is its own.

    Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of different lengths
    don't link, and each length that several have is searched by itself, one after the other. Repeated rows are equal
    vectors. An empty table gives an empty result; other columns are ignored. df is a stored table, read alike each time.
    """
    told = [] if told is None else told
    base = df.select(F.monotonically_increasing_id().alias(ROW), df[id].alias("id"), df[vec].alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    valid = F.coalesce(F.col("vec").isNotNull() & finite, F.lit(False))
    good = base.where(valid)
    with scope():
        nodes = cut(good.groupBy("vec").agg(F.min(ROW).alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("mult")).withColumn("dim", F.size("vec")))
        sizes = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
        spark = df.sparkSession
        counts, edges = spark.createDataFrame([], "a long, links long"), spark.createDataFrame([], "a long, b long")
        for dim, n in sorted(sizes.items()):
            if n > 1:  # of a length that one vector has there is nothing to search
                one, two = _links(nodes.where(F.col("dim") == dim), dim, n, threshold, shard, overlap, visits, beam, sample, recall, most, told)
                counts, edges = counts.unionByName(one), edges.unionByName(two)
        roots = components(edges)
        joined = cut(nodes.join(counts, F.col("node") == F.col("a"), "left").join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("node", "least", "mult", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
        classes = cut(joined.groupBy("root").agg(F.min("least").alias("component")))
        each = keep(cut(joined.join(classes, "root").select("node", (F.col("links") + F.col("mult") - 1).alias("n_links"), "component")))
        twice = keep(cut(nodes.where("mult > 1").select(F.col("vec").alias("twin"), F.col("node").alias("shared"))))
    n_twice = twice.count()
    row = good.join(maybe_broadcast(twice, n_twice, 2000), F.col("vec") == F.col("twin"), "left") if n_twice else good.withColumn("shared", F.lit(None).cast("long"))
    row = row.select(ROW, "id", F.coalesce("shared", ROW).alias("of"))
    linked = row.join(each, F.col("of") == F.col("node")).select(ROW, "id", "n_links", "component")
    alone = base.where(~valid).select(ROW, "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("keep", F.col("id").eqNullSafe(F.col("component")))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors at a cosine of 0.9."""
    out = embedding_dedup(documents(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("keep").alias("kept"))


SQL = """with recursive v as (select vec_id, embedding::double[] as e from embeddings),
good as (select * from v where e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_dot_product(e, e) > 0),
pairs as (select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9),
reach as (select vec_id as a, vec_id as b from v union select r.a, p.b from reach r join pairs p on r.b = p.a)
select v.vec_id, (select count(*) from pairs where a = v.vec_id)::bigint as n_links, min(reach.b) as component_id, min(reach.b) = v.vec_id as kept from v join reach on reach.a = v.vec_id group by v.vec_id"""
