import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.plain import near_components, without_repeated_lines
from tests.llm.test_text import LANGS, talk
from tripflow.llm import bpe, langid, queries

pytest.importorskip("public_tokenizers")


def corpus(rng):
    rows = []
    for i in range(150):
        lang = rng.choice([*LANGS])
        rows.append((i, "\n".join(talk(rng, lang, 9) + f" w{rng.random()}" for _ in range(rng.randrange(1, 9))), lang))
    passage = "\n".join(talk(rng, "en", 12) + f" p{k}" for k in range(4))
    rows += [(200 + k, talk(rng, "en", 10) + f" a{k}\n{passage}\n" + talk(rng, "en", 10) + f" z{k}", "en") for k in range(5)]
    rows += [(300 + k, re.sub("w0", "v", rows[k][1], count=1), rows[k][2]) for k in range(40)]
    rows += [(400 + k, rows[k][1], rows[k][2]) for k in range(20)]
    long = [talk(rng, "de", 80) for _ in range(10)]
    rows += [(600 + 3 * k + j, x + f" ende{j}", "de") for k, x in enumerate(long) for j in range(3)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 ! 34", "de"), (503, talk(rng, "fr", 9), None)]
    rng.shuffle(rows)
    return [(d, t, v, rng.choice(["hot", "b", None]), len(t or "")) for d, t, v in rows]


def test_stages_against_plain_python(spark, make_docs, tmp_path):
    rows = corpus(random.Random(11))
    docs = make_docs(rows)
    for name, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        got = made.collect()
        if name == "language_id":
            assert {r.doc_id for r in got} == {d for d, t, *_ in rows if re.search(r"[^\W\d_]", t or "")}
            assert all(tuple(r) == tuple(given[r.doc_id]) for r in got)
        elif name == "line_dedup":
            want = without_repeated_lines([(d, r.text) for d, r in given.items()])
            want = {d: t for d, (t, n) in want.items() if not n or t.strip()}
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
            assert sum("p3" in r.text for r in got) == 1
        elif name == "near_duplicates":
            roots = near_components([(d, r.text) for d, r in given.items()])
            assert sorted(r.doc_id for r in got) == sorted(d for d, (_, c) in roots.items() if c == d) and len(got) < len(given)
        else:
            tokens = {}
            for r in got:
                tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
            assert tokens == {d: len(bpe.load().encode(r.text)) // 4 + 1 for d, r in given.items()}
        docs = made
    docs = make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r)[:5] for r in queries.QUERIES["pipeline"](spark, str(tmp_path)).collect()) == sorted(tuple(r)[:5] for r in got)


def test_stages_on_edge_tables(spark, make_extra, tmp_path):
    for rows in ([], [(None, None)], [(1, "word word", None), (1, "word word", None), (None, "some text", "en")]):
        docs = make_extra(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()


def test_language_id_drops_only_what_has_no_language(spark, make_docs, monkeypatch):
    def machine(bias):
        return np.array([0.0] * langid.FEATURES + [bias], np.float32)

    circle = langid.Model.__new__(langid.Model)
    circle.families, circle.names, circle.rest = {"germanic": ["de", "en", "nl"]}, ["germanic"], []
    circle.pairs = {("de", "en"): machine(1.0), ("de", "nl"): machine(-1.0), ("en", "nl"): machine(1.0)}
    assert circle.predict(np.zeros(langid.FEATURES, np.float32))[1] < .5
    monkeypatch.setattr(langid, "learn", lambda docs: circle)
    docs = make_docs([(1, "clean text", "en"), (2, "12 !", "en"), (3, None, "en"), (4, "", "en")])
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


def test_near_duplicates_go_by_id_and_text(spark, make_docs):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1)), (7, text(1) + " more"), (7, text(2)), (7, text(2)), (8, text(3)), (8, text(3) + " end"), (9, text(3)), (None, text(1)), (None, text(4)), (2, "")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, make_docs(rows), "").collect()]
    eights = [r for r in got if r[0] == 8]
    assert len(eights) == 1 and eights[0] in rows
    assert sorted(map(str, set(got) - {*eights})) == sorted(map(str, [(1, text(1)), (7, text(2)), (None, text(1)), (None, text(4)), (2, "")]))
    assert len(got) == 7


def test_every_operator_has_one_query():
    names = [*queries.QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert set(queries.SQL) <= set(names)
