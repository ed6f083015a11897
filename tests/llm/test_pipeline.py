import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import brute_targets, words
from tributary.llm import pii, quality, simhash
from tributary.llm.common import cut

D = "/root/testdata/sf0.01"


def stages(spark):
    docs = [spark.read.parquet(f"{D}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(cut(stage(spark, docs[-1], D)))
    return docs


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_each_stage_against_brute_force(spark):
    docs = stages(spark)
    names = docs[0].columns
    assert all(d.columns == names for d in docs[:-1])
    read = [{r.doc_id: r for r in d.collect()} for d in docs[:4]]
    # Quality rules: documents that they reject go, texts lose failed lines.
    verdict = {i: quality.judge(r.text.encode()) for i, r in read[0].items()}
    assert {i: r.text for i, r in read[1].items()} == {i: v[-1].decode() for i, v in verdict.items() if v[6]}
    assert all(r.n_chars == len(r.text) for r in read[1].values())
    # Near-duplicates: exact copies and all pairs at the guaranteed distance are in one class; texts are unchanged.
    stays = read[2]
    assert {r.text for r in stays.values()} <= {r.text for r in read[1].values()}
    assert len({r.text for r in stays.values()}) == len(stays)
    fps = {i: simhash.fingerprint(r.text.encode(), 5, words=8) for i, r in read[1].items()}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            apart = [(x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)]
            if a < b and sum(apart[:4]) <= 15 and sum(apart) <= 77:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(stays) <= {i for i in ids if find(i) == i}
    for i in set(ids) - set(stays):  # what went has a near copy that is about as similar as asked
        own = shingles(read[1][i].text)
        assert max(len(own & s) / max(1, len(own | s)) for s in (shingles(read[1][j].text) for j in ids if j != i)) > 0.65
    # Personal data: the base spans of the texts are gone, other text stays.
    assert set(read[3]) == set(stays)
    for i, r in read[3].items():
        before = stays[i].text
        assert (r.text == before) or re.search(r"\[(EMAIL|IP|CARD|PHONE|IBAN|SSN)\]", r.text)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)
    assert pii.find_pii(docs[3]).where("exists(spans, x -> x.kind in (0, 2))").count() == 0
    # Mixing: sources come near their targets, no row over three times.
    mixed = docs[4].collect()
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= set(read[3])
    sources = sorted({r.source for r in read[3].values()})
    sizes = [sum(words(r.text) for r in read[3].values() if r.source == s) for s in sources]
    for s, target in zip(sources, brute_targets(sizes, [1 + i % 3 for i in range(len(sources))]), strict=True):
        own = [words(r.text) for r in mixed if r.source == s]
        assert abs(sum(own) - target) <= max(own)
    # Packing: every row of the mix, whole.
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r.doc_id: r.text for r in mixed}
    length = {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in text.items()}
    packed = docs[5].collect()
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == Counter({i: n * times[i] for i, n in length.items()})


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(11)
    vocab = [f"word{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(120):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([120, 300, 900]))]
        for j in range(rnd.choice([1, 1, 2, 5, 40 if g < 2 else 3])):
            copy = list(base)
            for _ in range(max(1, len(base) // 100) if j else 0):
                copy[rnd.randrange(len(copy))] = "edit"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    df = cut(spark.createDataFrame(rows, "doc_id long, text string"))
    stays = [r.doc_id for r in simhash.near_duplicates_out(df).collect()]
    assert {group[i] for i in stays} == set(range(120))
    assert len(stays) <= 120 * 1.05


def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    spark.read.parquet(f"{D}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rnd = random.Random(12)
    long_ = " ".join(f"long{i}." for i in range(40_000))
    prose = [" ".join(f"w{rnd.randint(0, 9999)}" for _ in range(80)) + "." for _ in range(12)]
    rows = [(i, prose[i % 12], None if i % 3 == 0 else f"s{i % 2}") for i in range(24)]
    rows += [(None, prose[0] + " extra", "s0"), (7, None, None), (8, "", "s1"), (9, long_, "s0"), (3, prose[3], "s0"), (3, prose[3], "s0"), (None, None, None)]
    extra = ["__row", "of", "copies", "spans", "size", "c0", "id", "fp", "keep", "times", "copy", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    spark.createDataFrame([(i, t, None, s, None, *["x"] * len(extra)) for i, t, s in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns, name
        if name.startswith("SimHash"):
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(set(texts)) == 13 and long_ in texts
        assert all(r["a.b"] == r["c0"] == "x" and r.n_chars == len(r.text) for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed) > 40_000
