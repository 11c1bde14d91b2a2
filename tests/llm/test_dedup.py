import hashlib
import random

import pytest

from tests.llm.plain import LOWER, near_components, without_repeated_lines
from tripflow.llm import components, exact_dedup, line_dedup, partenum, sieve


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def test_exact_dedup_against_plain(make_extra):
    rng = random.Random(1)
    texts = [None, "", "A", "a", "Ä", "ä", "x" * 64 + "1", "X" * 64 + "1", "x" * 64 + "2", "same", "SAME", "z" * 200_000, "Z" * 200_000]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(7, "same"), (7, "same"), (None, "same"), (None, "only null"), (None, "only null")]
    got = exact_dedup.exact_dedup(make_extra(rows), digest_col="text_sha256").collect()
    assert len(got) == len(rows)
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        want += [(i, keep, len(ids), i == keep, sha) for i in ids]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(make_extra([])).collect() == []


def test_exact_dedup_is_native(make_docs):
    plan = exact_dedup.exact_dedup(make_docs([(1, "a"), (2, "A")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sieve_never_misses(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    d = spark.range(5000).withColumnRenamed("id", "k")
    assert sieve.only(d, keys, "k").count() == keys.count()
    assert sieve.without(d, keys, "k").count() == 5000 - keys.count()
    assert sieve.only(d, keys.limit(0), "k").count() == 0 and sieve.without(d, keys.limit(0), "k").count() == 5000


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "x long, y long")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in x and x[0] != x[1] for x in links)}
    assert components.components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_line_dedup_against_plain(make_extra):
    rng = random.Random(5)
    pool = [words(rng, 4) for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) if rng.random() < .6 else words(rng, 4) for _ in range(rng.randrange(0, 9))]
        rows.append((i, "\n".join(x + rng.choice(["", " ", "\r"]) if rng.random() < .2 else x for x in lines)))
        if rng.random() < .3:
            rows[-1] = (i, rows[-1][1] + "\n\n \n")
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "one\ntwo"), (204, "one\ntwo"), (205, "l\n" * 9), (206, "\n".join(words(rng, 3) for _ in range(4000)))]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(make_extra(rows)).collect()}
    assert got == without_repeated_lines(rows)
    assert got[204] == ("", 2) and got[205][0] == "l\n"  # its last piece is a blank line
    assert line_dedup.line_dedup(make_extra([])).collect() == []


def test_line_dedup_keeps_columns_and_repeated_rows(make_extra):
    rows = [(1, "a\nb\nc", "en"), (1, "a\nb\nc", "en"), (2, "x\na\nb\nc", "de"), (None, "q\nr\ns", None)]
    d = make_extra(rows)
    out = line_dedup.line_dedup(d)
    assert out.columns == [*d.columns, "n_lines", "n_removed"]
    assert sorted((str(r.doc_id), r.text, r.lang) for r in out.collect()) == [("1", "a\nb\nc", "en"), ("1", "a\nb\nc", "en"), ("2", "x", "de"), ("None", "q\nr\ns", None)]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        kind = rng.random()
        w[k:k + 1] = [] if kind < .3 and len(w) > 5 else [w[k], "new" + str(rng.random())] if kind < .6 else ["sub" + str(rng.random())]
    return " ".join(w)


def near_rows(rng):
    rows, passage = [], words(rng, 60)
    for base in range(30):
        text = words(rng, rng.choice([3, 6, 9, 15, 40, 150, 400]))
        rows.append(text)
        rows += [edited(rng, text, rng.randrange(0, max(1, len(text.split()) // 18) + 1)) for _ in range(rng.randrange(0, 5))]
        rows.append(words(rng, 30) + " " + passage + " " + words(rng, 30))
    chain = words(rng, 120)
    for _ in range(8):
        chain = edited(rng, chain, 2)
        rows.append(chain)
    family = words(rng, 150)
    rows += [edited(rng, family, rng.randrange(1, 6)) for _ in range(60)]
    rows += ["", " \t", None, "one", "ONE", "one two three four", "one  two\tthree\nfour", "a b c d e", "A B C D E"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components_against_all_pairs(make_extra, seed):
    rows = near_rows(random.Random(seed))
    got = {r.id: (r.n_shingles, r.component_id) for r in partenum.jaccard_components(make_extra(rows)).collect()}
    assert got == near_components(rows)


def test_jaccard_edges(make_docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A B C D E F"), (None, "a b c d e f"), (None, "z z z"), (3, None), (4, "")]
    got = sorted((str(r.id), r.n_shingles, r.component_id) for r in partenum.jaccard_components(make_docs(rows)).collect())
    assert got == [("3", 0, 3), ("4", 0, 4), ("5", 2, 5), ("5", 2, 5), ("9", 2, 5), ("None", 1, None), ("None", 2, 5)]
    assert partenum.jaccard_components(make_docs([])).collect() == []


def test_similar_sets_share_a_signature_and_enough_first_elements():
    import numpy as np
    rng = np.random.default_rng(5)
    pairs = 0
    for _ in range(3000):
        a = int(rng.choice([*range(2, 31), 50, 80, 146, 300, 700, 1500]))
        x = rng.integers(-2 ** 63, 2 ** 63 - 1, a)
        lost = int(rng.integers(0, a // 4 + 1))
        room = int((a - lost) / .75 - a) if (a - lost) / .75 >= a else 0
        y = np.unique(np.concatenate([x[lost:], rng.integers(-2 ** 63, 2 ** 63 - 1, room if rng.random() < .5 else int(rng.integers(0, room + 1)))]))
        x = np.unique(x)
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both) or np.array_equal(x, y):
            continue
        pairs += 1
        assert len(np.intersect1d(partenum.signatures(x), partenum.signatures(y)))
        first = [s[:len(s) // 4 + partenum.more(len(s))] for s in (x, y)]
        assert len(np.intersect1d(*first)) >= max(partenum.must_share(len(x)), partenum.must_share(len(y)))
    assert pairs > 1000
