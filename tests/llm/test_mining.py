"""Periodic runs, source mixing and collocations against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm import plain
from tripflow.llm import collocations, mixing, periodic, queries


def sha(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def noisy(rng, parts, letters="abcd"):
    words = [rng.choice(letters) for _ in range(rng.randrange(0, 30))]
    for _ in range(parts):
        unit = [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
        words += (unit * rng.randrange(1, 8))[:rng.randrange(1, 160)] + [rng.choice(letters) for _ in range(rng.randrange(0, 6))]
    return words


def test_runs_of_blocks_equal_brute_force():
    rng = random.Random(1)
    total = 0
    for _ in range(500):
        docs = [noisy(rng, rng.randrange(0, 3), "abcd"[:rng.randrange(1, 5)]) for _ in range(rng.randrange(1, 5))]
        for least, times in ((6, 4), (2, 2), (9, 3)):
            got = periodic._block([[w.encode() for w in d] for d in docs], least, times)
            want = [plain.periodic_runs(d, least, times) for d in docs]
            assert [(runs, kept.decode().split()) for runs, kept in got] == [(r, k) for r, k in want]
            total += sum(len(r) for r, _ in want)
    assert total > 1500


def test_long_repetitions_stay_cheap():
    cases = [(["x"] * 100_000, (0, 100_000, 1)), (["a", "b"] * 50_000, (0, 100_000, 2)), ([str(i % 25_000) for i in range(100_000)], (0, 100_000, 25_000))]
    for words, run in cases:
        (runs, kept), = periodic._block([[w.encode() for w in words]], 6, 4)
        assert runs == [run] and kept.decode().split() == words[:run[2]]


def test_periodic_rows(make_extra):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a " * 6, "a " * 5, "é\xa0é x " * 9 + "\x0b y", "one two", "b\tb\nb\x0bb\x0cb\rb"] + [" ".join(noisy(rng, 2)) for _ in range(60)] + ["w v " * 40_000]
    rows = [*enumerate(texts), (None, "a " * 9), (3, "a " * 6), (3, "a " * 6)]
    for block in (periodic.BLOCK_WORDS, 50):
        got = periodic.periodic_runs(make_extra(rows).coalesce(2), block_words=block).collect()
        assert sorted(str(r.id) for r in got) == sorted(str(d) for d, _ in rows)
        for r in got:
            text = "a " * 9 if r.id is None else texts[r.id] or ""
            runs, kept = plain.periodic_runs([w.decode() for w in text.encode().split()])
            assert [tuple(x) for x in r.runs] == runs and r.n_runs == len(runs) and r.collapsed == " ".join(kept) and r.collapsed_sha256 == sha(kept)
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
            best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
            assert (r.start, r.length, r.period) == best and r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
    assert periodic.periodic_runs(make_extra([])).collect() == []


def test_the_query_rewrites_a_tenth(spark, make_extra, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 60)))) for i in range(-60, 240)] + [(None, "q " * 8), (500, None)]
    make_extra(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for d, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(d).encode()), len(words)
        if d is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs, kept = plain.periodic_runs(words)
        assert got[d].n_runs == len(runs) and got[d].collapsed_sha256 == sha(kept), d
    assert changed > 10


def test_targets_stop_and_are_shared_anew(spark):
    rng = random.Random(4)
    cases = [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000}, {None: 5, "z": 7, "é": 0, "Z": 300}, {"only": 0}, {}]
    cases += [{rng.choice([None, *map(chr, range(97, 123))]): rng.choice([0, 1, 5, 50, 5000, 10 ** 12]) for _ in range(rng.randrange(1, 12))} for _ in range(6)]
    for sizes in cases:
        d = spark.createDataFrame([*sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(d).collect()}
        assert got == {s: pytest.approx(float(t), rel=1e-12) for s, t in plain.shared_targets(sizes).items()}


def test_mix(spark, make_docs, make_extra):
    rng = random.Random(5)
    sources = ["a", "b", "c", None, "hot", "hot", "hot", "hot"]
    rows = [(i, " ".join(rng.choices(["x", "yy", "é"], k=rng.randrange(0, 40))), "en", rng.choice(sources)) for i in range(1200)]
    rows += [(3000, None, None, "a"), (3001, "", None, "a"), (None, "one two", None, "b"), (None, "one two", None, "b"), (3002, "w " * 30_000, "en", "hot")]
    got = mixing.mixed(make_docs(rows)).collect()
    assert sorted((str(r.id), r.size, str(r.source)) for r in got) == sorted((str(d), len((t or "").encode().split()), str(s)) for d, t, _, s in rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    goal = {s: float(t) for s, t in plain.shared_targets(sizes).items()}
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) for r in own)
        assert all(np.floor(r.rate) <= r.copies <= np.ceil(r.rate) and r.taken == r.size * r.copies <= 2 * r.size for r in own)
        slack = 30_000 if s == "hot" else .02 * goal[s]
        assert abs(sum(r.taken for r in own) - goal[s]) <= slack
    # the documents emitted are those counted, whatever the order of the rows
    rng.shuffle(rows)
    again = mixing.mixed(make_docs(rows).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.emitted(make_docs(rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert out.groupBy("doc_id").count().filter("doc_id IS NOT NULL").count() == len({r.id for r in got if r.copies and r.id is not None})
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mixed(make_extra([])).collect() == [] and mixing.emitted(make_extra([])).collect() == []
    extra = mixing.mixed(make_extra([(1, "a b"), (1, "a b"), (None, None), (2, "c")])).collect()
    assert len(extra) == 4 and all(r.target == pytest.approx(7.5) for r in extra)


def test_draws_are_uniform_and_independent(spark):
    d = spark.range(4000).select(mixing.draws(17, mixing.F.col("id"), mixing.F.lit("text")).alias("d")).collect()
    x = np.array([r.d for r in d]) / 16.0 ** mixing.DIGITS
    assert x.shape == (4000, mixing.DRAWS) and abs(x.mean(0) - .5).max() < .02 and abs(np.corrcoef(x.T) - np.eye(mixing.DRAWS)).max() < .08


def phrases(rng, lang, n):
    fixed = [["new", "york", "city"], ["of", "course"], ["ad", "hoc", "red", "tape", "worm"], ["x1", "x2"]]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(1, 12)):
            words += rng.choice(fixed) if rng.random() < .25 else [rng.choice("the a of to in and on new city".split()) + ("" if rng.random() < .8 else rng.choice("qrs"))]
            if rng.random() < .1:
                words.append(rng.choice([",", ". ", "!?", "\n", "\t"]))
        out.append((" ".join(w.upper() if rng.random() < .05 else w for w in words), lang))
    return out


@pytest.mark.parametrize("least,top,shares", [(5, 2000, (1 / 4, 1.0)), (3, 6, (1 / 64, 1 / 8, 1.0))])
def test_collocations_equal_brute_force(make_docs, monkeypatch, least, top, shares):
    monkeypatch.setattr(collocations, "SHARES", shares)
    rng = random.Random(least * 100 + top)
    rows = phrases(rng, "en", 250) + phrases(rng, "de", 60) + phrases(rng, None, 40) + [("new york", "und")] * 30 + [("dup dup dup dup dup dup", "en")] * 9
    rows += [(None, "en"), ("", "de"), (" ,;.", "en"), ("É É é\xa0é É É", "fr"), ("long word " * 5000, "long")]
    rng.shuffle(rows)
    docs = make_docs([(i, t, v) for i, (t, v) in enumerate(rows)])
    got = collocations.collocations(docs, least=least, top=top, block_bytes=3000, bits=18).collect()
    assert sorted(map(tuple, got)) == plain.collocations(rows, least, 5, top)


def test_early_settling_skips_common_words(make_docs, monkeypatch):
    """Where rare words already give the first phrases, common words are never expanded, and the result is the same."""
    rows = [(f"rare{i % 7} pair{i % 7}. " + "and the of " * 20, "en") for i in range(140)]
    seen = []
    grown = collocations._grown
    monkeypatch.setattr(collocations, "_grown", lambda *a: seen.append(a[1]) or grown(*a))
    got = collocations.collocations(make_docs([(i, *r) for i, r in enumerate(rows)]), least=10, top=3, bits=18).collect()
    assert sorted(map(tuple, got)) == plain.collocations(rows, 10, 5, 3)
    assert len(seen) <= 8  # less than the rounds it takes to expand everything


def test_collocations_of_edge_tables(make_extra, monkeypatch):
    monkeypatch.setattr(collocations, "SHARES", (1.0,))
    for rows in ([], [(None, None)], [(1, "a b"), (1, "a b"), (None, "a b.")]):
        got = collocations.collocations(make_extra(rows), least=3, bits=18).collect()
        assert [tuple(r) for r in got] == ([("und", 1, "a b", 3, 3, 3, 6, 2000)] if len(rows) == 3 else [])
    assert collocations.tokens("A-b\tC,d") == [b"a-b", b"c", b".", b"d", b".", b""]
