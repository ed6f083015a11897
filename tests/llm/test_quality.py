import random
import re
from collections import Counter

from tests.llm.oracle import same
from tributary.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def data():
    rnd = random.Random(8)
    vocab = ["é", "日本", "a", "b.", "c|", "#x", "\x85", "\xa0y", "z z", "w1", "w2", "w3"]
    out = [None, "", " \n\n", "one", "a b a b a", "x y z x y z x", "same line.\nsame line.\n same line.\nother", "w " * 60_000]
    for _ in range(80):
        out.append("\n".join(" ".join(rnd.choice(vocab) + (str(rnd.randint(0, 50)) if rnd.random() < 0.7 else "") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 9))))
    return out


def test_figures(spark):
    texts = data()
    df = spark.createDataFrame([(i if i else None, t, True) for i, t in enumerate(texts)] + [(4, texts[4], True)], "doc_id long, text string, kept boolean")
    got = quality.apply_rules(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.id or 0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert r.kept == (r.reason is None) and not (r.base_failed and r.kept)


def test_lines_first():
    prose = " ".join(f"word{i} and é{i} more." for i in range(30))
    menu = "Home | About | Contact | Login"
    *_, kept, reason, cut, cleaned = quality.judge(f"{menu}\n{prose}\nAll Rights Reserved.\n\n{prose[:200]}".encode())
    assert kept and cut == 2 and cleaned.decode() == f"{prose}\n\n{prose[:200]}"
    *_, kept, reason, cut, cleaned = quality.judge("\n".join(f"A{i} | B{i} | C{i} | D{i} | E{i}" for i in range(30)).encode())
    assert not kept and reason == "lines"
    assert quality.judge(prose.encode())[-1] == prose.encode()
    accented = "\n".join(f"û{i} ü{i} “quoted{i}” text{i} goes{i} on." for i in range(20))
    assert quality.judge(accented.encode())[6]


def test_good_labels_are_kept(spark):
    d = "/root/testdata/sf0.1"
    out = quality.apply_rules(spark.read.parquet(f"{d}/documents.parquet"), cleaned=False).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("doc_id", "id"), "id")
    rows = out.where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


def test_sf_against_sql(spark):
    same(spark, quality.op8_quality, quality.SQL)


def test_empty_table(spark):
    assert quality.apply_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
