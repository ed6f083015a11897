import numpy as np

from tests.llm.oracle import same
from tributary.llm import embeddings


def brute(vectors, threshold=0.9):
    good = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    links = np.zeros((n, n), dtype=bool)
    for dim in {len(v) for v, g in zip(vectors, good, strict=True) if g}:
        at = [i for i in range(n) if good[i] and len(vectors[i]) == dim]
        x = np.array([vectors[i] for i in at], dtype=np.float64)
        size = np.linalg.norm(x, axis=1)
        links[np.ix_(at, at)] = x @ x.T / np.outer(size, size) >= threshold
    np.fill_diagonal(links, False)
    return links


def classes(links):
    label = list(range(len(links)))
    for i in range(len(links)):
        todo = [i] if label[i] == i else []
        while todo:
            for k in np.flatnonzero(links[todo.pop()]):
                if label[k] > i:
                    label[k] = i
                    todo.append(k)
    return label


def clustered(n, dim, seed, groups):
    rnd = np.random.default_rng(seed)
    out = rnd.normal(size=(n, dim))
    for size, noise in groups:
        at = rnd.choice(n, size, replace=False)
        out[at] = out[at[0]] + rnd.normal(size=(size, dim)) * noise
    return out.astype(np.float32)


def check(spark, vectors, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, n_links int")
    got = {r.id: r for r in embeddings.embedding_dedup(df, **kw).collect()}
    links = brute([None if v is None else [None if x is None else np.float32(x) for x in v] for v in vectors])
    label = classes(links)
    return got, links, label


def test_against_brute_force(spark):
    vectors = list(clustered(1500, 24, 1, [(120, 0.05), (300, 0.2), (2, 0.01), (5, 0.1)]))
    vectors += [vectors[0]] * 200 + [2 * vectors[1], None, np.zeros(24), [None] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.1], []]
    for kw in ({}, {"shard": 120}):
        got, links, label = check(spark, vectors, **kw)
        assert len(got) == len(vectors)
        found, true = sum(r.n_links for r in got.values()), links.sum()
        assert 0.97 * true <= found <= true
        assert all(got[i].n_links <= links[i].sum() for i in got)
        assert sum(got[i].component == label[i] for i in got) / len(got) > 0.98
        assert all(r.keep == (r.id == r.component) for r in got.values())


def test_one_crowded_cell_is_split(spark):
    vectors = list(clustered(900, 16, 2, [(900, 0.12)]))
    got, links, label = check(spark, vectors, shard=100, sample=32)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links.sum()
    assert sum(got[i].component == label[i] for i in got) / len(got) > 0.98


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 0.01]), (2, [0.0, -1.0]), (2, [0.0, -1.0])]
    got = sorted((str(r.id), r.n_links, str(r.component), r.keep) for r in embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [("2", 1, "2", True), ("2", 1, "2", True), ("3", 1, "3", True), ("None", 0, "None", True), ("None", 1, "3", False)]


def test_sf_against_sql(spark):
    same(spark, embeddings.op4_embeddings, embeddings.SQL)


def test_empty_table(spark):
    assert embeddings.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def pairs(spark, n, dim, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n // 4, dim))
    return list((np.repeat(base, 4, axis=0) + rnd.normal(size=(n, dim)) * 0.25).astype(np.float32))


def test_two_levels_of_centres(spark):
    vectors = pairs(spark, 2400, 24, 5)
    told = []
    got, links, label = check(spark, vectors, shard=60, most=8, told=told)
    assert told[-1]["recall"] >= 0.97 and told[-1]["attempt"] < 2
    assert sum(r.n_links for r in got.values()) >= 0.96 * links.sum()
    assert sum(got[i].component == label[i] for i in got) / len(got) > 0.97


def test_links_count_on_both_sides(spark):
    """Whatever is missed, is missed from both sides: in a pair without other links both count one or none."""
    vectors = pairs(spark, 3000, 16, 6)
    got, links, _ = check(spark, vectors, shard=80, visits=2, beam=2, recall=0.0)
    alone = [(i, int(np.flatnonzero(links[i])[0])) for i in range(len(vectors)) if links[i].sum() == 1]
    alone = [(i, j) for i, j in alone if links[j].sum() == 1]
    assert len(alone) > 50 and all(got[i].n_links == got[j].n_links for i, j in alone)
    assert sum(r.n_links for r in got.values()) % 2 == 0


def test_a_low_recall_ends_in_brute_force(spark, monkeypatch):
    vectors = pairs(spark, 400, 16, 7)
    monkeypatch.setattr(embeddings, "range_search", lambda x, adjacent, q, own, *a: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)))
    real = embeddings._walked
    monkeypatch.setattr(embeddings, "_walked", lambda nodes, *a: (real(nodes, *a)[0].where("false"), real(nodes, *a)[1].where("false")))
    told = []
    got, links, label = check(spark, vectors, shard=50, told=told)
    assert [t["attempt"] for t in told] == [0, 1, 2] and told[0]["recall"] == 0.0 and told[2]["recall"] == 1.0
    assert all(got[i].n_links == links[i].sum() and got[i].component == label[i] for i in got)


def test_lengths_of_one_vector_each(spark):
    rows = [(i, [1.0] * (i // 2 + 1)) for i in range(12)] + [(20, [1.0, 2.0, 3.0, 4.0])]
    got = {r.id: (r.n_links, r.component, r.keep) for r in embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (1, i - i % 2, i % 2 == 0) for i in range(12) if i not in (6, 7)}, 6: (2, 6, True), 7: (2, 6, False), 20: (2, 6, False)}
