import random

import xxhash

from tributary.llm import simhash
from tributary.llm.components import components


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_classes(fps, k):
    label = {i: i for i in range(len(fps))}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= k:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "É\x85x", "a b"]
    out = []
    for i in range(120):
        t = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 30, 120]))]
        out.append((i, " ".join(t)))
        for j in range(rnd.choice([0, 0, 1, 3])):
            u = list(t)
            u[rnd.randrange(len(u))] = "changed"
            out.append((1000 + 10 * i + j, "\t".join(u).upper()))
    return out + [(5000, None), (5001, ""), (5002, " \n"), (None, "w1"), (5003, "w1"), (5003, "w1")]


def test_against_brute_force(spark):
    data = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, fp string")
    got = simhash.simhash_dedup(df).collect()
    assert len(got) == len(data)
    fps = [brute_fp(t) for _, t in data]
    classes = brute_classes(fps, 2)
    least = {}
    for (i, _), c in zip(data, classes, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), f, least.get(c)) for (i, _), f, c in zip(data, fps, classes, strict=True))
    assert sorted((str(r["id"]), r.f0 % 2**64, r.component) for r in got) == want
    assert sum(r.keep for r in got) == len(set(classes))


def test_large_buckets_give_the_same_components(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = list({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.choice([0, 1, 2, 3]))) for b in base for _ in range(150)})
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in enumerate(fps)], "node long, f0 long")
    want = brute_classes(fps, 2)
    for hot, block in ((64, 1024), (3, 16), (10_000, 1024)):
        roots = dict(components(simhash.links(df, len(fps), 2, hot=hot, block=block)).collect())
        assert [roots.get(i, i) for i in range(len(fps))] == want


def test_every_pair_within_k_is_found_on_wide_fingerprints(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        f = [rnd.getrandbits(64) for _ in range(2)]
        rows.append((2 * i, *f))
        for x in rnd.sample(range(128), rnd.choice([0, 3, 7, 8, 30])):
            f[x // 64] ^= 1 << x % 64
        rows.append((2 * i + 1, *f))
    df = spark.createDataFrame([(i, simhash._signed(a), simhash._signed(b)) for i, a, b in rows], "node long, f0 long, f1 long")
    got = {tuple(r) for r in simhash.links(df, len(rows), 7, words=2).distinct().collect()}
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and sum((a ^ b).bit_count() for a, b in zip(x[1:], y[1:], strict=True)) <= 7}
    assert got == want


def test_limits_are_the_cheapest(spark):
    cost = [[0, 5, 9], [0, 1, 2], [0, 4, 4]]
    price, limits = simhash.allocate(cost, 0)
    assert sum(limits) == 0
    assert price == min(cost[0][a + 1] + cost[1][b + 1] + cost[2][c + 1] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a + b + c == 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_dedup(df).collect() == []


def test_long_text_is_read_whole():
    text = "a b c " * 40_000 + "d e f"
    assert simhash.fingerprint(text.encode()) == [brute_fp(text)]
