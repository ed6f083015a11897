import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tributary.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
MARK = "<|endoftext|>"
ODD = ["", "a", f"{MARK} in a text", f"at the end {MARK}", f"a {MARK} b", f"{MARK}{MARK}", f"x{MARK}{MARK} y", f"日本{MARK}語", "<|endoftext", "|endoftext|>", "naïve café  \n\n tabs\t\t x", "日本語 текст ألف", "Ᲊ\U0001e4d0 new letters Ⱟ", "it's we'll 123 45,6 !?", "x" * 5000, "\x00\x85\xa0　 ", "👩‍👩‍👧 emoji"]


def exact(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_ids_are_the_tokenizers(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    latin = "".join(chr(c) for c in range(0x250))
    assert packing.encoder(PATH)(ODD + docs + [latin]) == exact(ODD + docs + [latin])


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 5000])
def test_cut_points(n):
    cuts = packing.cut_points(n)
    assert sum(x for _, x in cuts) == n and all(a + b == c for (a, b), (c, _) in zip(cuts, cuts[1:], strict=False))
    assert all(x == 1024 for _, x in cuts[1:]) and cuts[0][0] == 0


def best_by_search(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins) if x + sizes[i] <= capacity}.values():
            go(i + 1, [*bins[:b], bins[b] + sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bounds_hold_and_packings_are_valid():
    rnd = random.Random(1)
    for _ in range(60):
        sizes = np.array(sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))), reverse=True))
        where, offset, room = packing.best_fit(sizes, 20)
        least = best_by_search(sizes.tolist(), 20)
        assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= least <= len(room)
        for b in range(len(room)):
            own = sorted((o, s) for o, s, w in zip(offset, sizes, where, strict=True) if w == b)
            assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]
            assert sum(s for _, s in own) == 20 - room[b]


def test_documents_round_trip(spark):
    rnd = random.Random(2)
    texts = [*ODD, None, *(" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 3000))) for _ in range(60))]
    data = [(i if i % 7 else None, t, 5) for i, t in enumerate(texts)] + [(3, "twice", 1), (3, "twice", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, length long")
    got = packing.pack_documents(df, PATH).collect()
    ids = [x + [2] for x in exact([t or "" for _, t, _ in data])]
    want = sorted(zlib.crc32(np.array(x[s : s + n], dtype="<u4").tobytes()) for x in ids for s, n in packing.cut_points(len(x)))
    assert sorted(r.ids_crc32 for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 1024
    packed = packing.sequences(df, PATH).collect()
    assert sorted(x for r in packed for x in r.ids) == sorted(x for y in ids for x in y)
    assert all(r.length == len(r.ids) <= 1024 for r in packed)


def test_exchange_closes_gaps(spark):
    rnd = random.Random(3)
    pieces = spark.createDataFrame([(i, 0, rnd.choice([300, 350, 400, 513, 600, 1024])) for i in range(4000)], f"{packing.ROW} long, piece int, length long")
    one = packing.pack(pieces, share=300, rounds=1)
    more = packing.pack(pieces, share=300, rounds=4)
    used, bound = packing.certificate(more, pieces)
    assert bound <= used <= packing.certificate(one, pieces)[0]
    assert more.count() == 4000
    whole = more.join(pieces, [packing.ROW, "piece"]).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert whole.where("n > 1024").count() == 0


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
