import random
import re

import pytest

from tests.llm.oracle import same
from tributary.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CASES = [
    None,
    "",
    "Released Under-The MIT License; under the mit licenses, UNDER the MIT license",
    "Apache License, Version 2.0 and cc-by-nc cc by nc-sa 4.0",
    "é under the mit license é",
    "éunder the mit license",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "licensed under the GNU Lesser General Public License v2.1",
    "the limit licensee reads all rights reserved",
    "see the terms of nothing, İstanbul K",
    "cc by nc " * 20_000,
    "This work is under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 license.",
]


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def labels(text):
    return {m.label for m in licenses.scan(text.encode())[2]}


def test_base_places(spark):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(CASES)] + [(None, CASES[2], 1.0), (3, CASES[3], 1.0)], "doc_id long, text string, score double")
    got = licenses.scan_licenses(df).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        n, places = brute(CASES[2] if r.id is None else CASES[r.id])
        assert (r.n_words, [tuple(p) for p in r.places]) == (n, places)
        assert 0 <= r.score <= 1


def test_rules_and_suppression():
    assert len(licenses.rules()) > 300
    assert labels(CASES[6]) == {"gpl-3"}
    assert labels(CASES[7]) == {"lgpl-2"}
    assert labels(CASES[8]) == {"all-rights-reserved"}
    assert labels(CASES[9]) == set()
    assert labels(CASES[11]) == {"cc-by-nc-sa"}
    assert labels("MIT license") == {"mit"} and labels("the BSD 3-clause license") == {"bsd-3-clause"}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this") == {"mit"}


def test_gates_miss_nothing():
    """A text that any rule matches passes the gates and the rule's own keywords."""
    for _, name, spdx, _ in licenses._LICENSES:
        for mention, _, _, _ in licenses._MENTIONS:
            text = re.sub(r"\(\?:([^()|]*)(\|[^()]*)?\)\??", r"\1", mention)
            for n in name.split("|")[:1]:
                plain = lambda x: re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", x)).replace("?", "")
                joined = b" " + plain(text.replace("{n}", plain(n)).replace("{s}", plain(spdx))).encode() + b" "
                hit = [r for r in licenses.rules() if r.pattern.search(joined)]
                if hit:
                    assert any(g in joined for g in licenses.GATES), joined
                    assert all(k in joined for r in hit for k in r.keywords), (joined, hit)


def test_contained_intervals_go():
    m = lambda a, b, label, p: licenses.Match(a, b, label, p, 0.5)
    got = licenses.suppress([m(0, 5, "x", 1), m(1, 3, "y", 9), m(1, 4, "z", 9), m(4, 8, "w", 1), m(1, 2, "v", 1)])
    assert [x.label for x in got] == ["x", "z", "w"]
    rnd = random.Random(2)
    for _ in range(50):
        found = [m(a := rnd.randint(0, 12), a + rnd.randint(1, 6), f"l{i}", rnd.randint(0, 3)) for i in range(rnd.randint(0, 25))]
        kept = []
        for x in sorted(found, key=lambda x: (-x.priority, x.start - x.end, x.start, x.label)):
            if not any(k.start <= x.start and x.end <= k.end for k in kept):
                kept.append(x)
        assert sorted(licenses.suppress(found), key=repr) == sorted(kept, key=repr)


def test_sf(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r.doc_id: r.text for r in df.collect()}
    for r in licenses.op10_licenses(spark, "/root/testdata/sf0.01").collect():
        n, places = brute(text[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_empty_table(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sf_against_sql(spark):
    same(spark, licenses.op10_licenses, licenses.sql())


def test_odd_texts_against_sql(spark, tmp_path):
    rnd = random.Random(5)
    words = "licensed under the mit license apache version 2 0 cc by nc sa gpl v3 bsd 3 clause all rights reserved see terms of".split()
    texts = [*(t for t in CASES if len(t or "") < 1000), *(" ".join(rnd.choice(words) for _ in range(60)) for _ in range(40))]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(licenses.sql())
    names = [d[0] for d in want.description]
    got = licenses.op10_licenses(spark, str(tmp_path)).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", {"apache-2", "mit"}),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause", {"apache-2", "bsd-3-clause", "mit"}),
        ("Dual licensed under MIT and Apache 2.0.", {"apache-2", "mit"}),
        ("released under the MIT or GPLv3", {"gpl-3", "mit"}),
        ("licensed under the MIT, Apache 2.0 or GPLv3 licenses", {"apache-2", "gpl-3", "mit"}),
        ("License: MIT or Apache-2.0", {"apache-2", "mit"}),
        ("GPL-3.0", {"gpl-3"}),
        ("MPL-2.0 only", {"mpl-2"}),
        ("GNU GPL version 3", {"gpl-3"}),
        ("LGPL-2.1-or-later", {"lgpl-2"}),
        ("the mit of an epic, and a general public", set()),
        ("the software is provided as is, and permission notices", set()),
    ],
)
def test_expressions_lists_and_bare_identifiers(text, labels):
    _, places, found = licenses.scan(text.encode())
    assert {m.label for m in found} | {x for _, x in places} == labels
