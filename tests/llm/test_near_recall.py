import random

import numpy as np
import pytest

from tributary.llm import simhash
from tributary.llm.common import cut


def sets(texts):
    return [set(simhash.shingles(t.encode(), 5).tolist()) for t in texts]


def edited(rnd, words, similarity):
    """words with a run of new ones in the middle, so that about that Jaccard similarity, and no less, is left."""
    n = len(words) - 4
    r = int(n * (1 - similarity) / (1 + similarity)) - 4
    at = rnd.randrange(5, n - r - 5)
    return [*words[:at], *(f"new{rnd.getrandbits(40)}" for _ in range(r)), *words[at + r :]]


@pytest.mark.parametrize("n", [400, 6000])
def test_recall_of_pairs_from_the_asked_similarity_on(spark, n):
    rnd = random.Random(n)
    texts, wanted, below = [], [], []
    for g in range(n // 2):
        base = [f"w{rnd.getrandbits(30)}" for _ in range(rnd.randint(120, 300))]
        other = edited(rnd, base, (0.8, 0.8, 0.85, 0.9, 0.7)[g % 5])
        texts += [" ".join(base), " ".join(other)]
    own = sets(texts)
    for i in range(0, n, 2):
        s = len(own[i] & own[i + 1]) / len(own[i] | own[i + 1])
        (wanted if s >= 0.8 else below).append(i)
    assert len(wanted) > 0.35 * n and len(below) > 0.05 * n
    df = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stays = {r.doc_id for r in simhash.near_duplicates_out(df).collect()}
    assert all(i in stays for i in range(0, n, 2))  # the smaller id stays
    assert all(i + 1 in stays for i in below)  # nothing below goes
    assert np.mean([i + 1 not in stays for i in wanted]) >= 0.985


def test_hot_group_of_distinct_classes(spark):
    """Buckets over the limit: close copies of one text, and others at 0.8 to one of them and less to the rest."""
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(150):
        copy = list(base)
        copy[100] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(edited(rnd, base, 0.82)) for _ in range(100)] + [" ".join(edited(rnd, base, 0.6)) for _ in range(30)]
    own = sets(texts)
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    df = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stays = {r.doc_id for r in simhash.near_duplicates_out(df).collect()}
    assert stays == {find(i) for i in range(len(texts))}


def test_bits_are_the_fingerprints():
    rnd = random.Random(2)
    for n in (1, 5, 9, 300, 2000):
        text = " ".join(f"w{rnd.getrandbits(30)}" for _ in range(n)).encode()
        hashes = simhash.shingles(text, 5)
        bits = 2 * simhash.wide_counts(hashes, 8) > len(hashes)
        assert np.packbits(bits, bitorder="little").view("<u8").tolist() == simhash.fingerprint(text, 5, words=8)


def test_keys_agree_as_planned():
    """Sets at 0.8 share a key as often as key_plan() counts on, whatever a key's length."""
    rnd = np.random.default_rng(3)
    for size in (60, 400):
        lean = []
        both = round(simhash.cosine(0.8) * size)
        for _ in range(150):
            same, one, two = (rnd.integers(0, 2**64, k, dtype=np.uint64) for k in (both, size - both, size - both))
            lean += [2 * simhash.wide_counts(np.concatenate([same, x]), 8) - size for x in (one, two)]
        got = simhash.strongest(np.array(lean, dtype=np.float32), 210)
        assert abs((got[::2] == got[1::2]).mean() - simhash.agreement(0.8)) < 0.03
    for n in (10**5, 10**8, 10**11):
        hashes, tables = simhash.key_plan(n, 0.8, 0.002)
        assert n <= 8 * 128**hashes and (1 - simhash.agreement(0.8) ** hashes) ** tables <= 0.002


def test_recall_with_longer_keys(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(150):
        base = [f"w{rnd.getrandbits(30)}" for _ in range(rnd.randint(120, 300))]
        texts += [" ".join(base), " ".join(edited(rnd, base, 0.8))]
    own = sets(texts)
    wanted = [i for i in range(0, 300, 2) if len(own[i] & own[i + 1]) >= 0.8 * len(own[i] | own[i + 1])]
    df = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    stays = {r.doc_id for r in simhash.near_duplicates_out(df, hashes=4).collect()}
    assert np.mean([i + 1 not in stays for i in wanted]) >= 0.98
