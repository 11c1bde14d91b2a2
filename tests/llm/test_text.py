import hashlib
import random
import zlib

import numpy as np
import pytest

from tripflow.llm import bpe, html_text, langid, packing, sharding, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", None, " \n", "a", "İSTANBUL Σίσυφος ΟΔΥΣΣΕΥΣ", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> A<|endoftext|>", "a" * 3000, "ab" * 500 + "é" * 300,
       "don't I'LL we'Ve 12345 ½ ²³", "\x1c\x1d a\x85b​c d　e\xa0f", "日本語テキスト" * 50, "é İ", "👩‍👩‍👧 !!!???", "ſs ﬁ", "x\x00y", "word " * 20_000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(make_extra, reference):
    rng = random.Random(2)
    alphabet = ["a", "b", "é", "ß", "Σ", "'s", "'ll", " ", "\n", "1", "<", "|", "中", "́", "\xa0", " ", "!", "?", "\x1f", "ing", "The"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 200))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(None, "tie"), (3, "a"), (3, "a")]
    got = bpe.encoded(make_extra(rows), keep_ids=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "tie" if r.id is None else texts[r.id] or ""
        ids = reference.encode(text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids), text[:60]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(make_extra([])).collect() == []


def checked_packing(pieces, docs, reference, capacity=2048):
    """Every id of every document in exactly one place; sequences gapless and within the capacity. Returns the padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(docs)
    for d, parts in by_doc.items():
        ids = reference.encode(docs[d] or "", add_special_tokens=False).ids + [1]
        parts.sort(key=lambda p: p.start)
        assert [i for p in parts for i in p.ids] == ids and all(p.doc_tokens == len(ids) for p in parts)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) for p in parts)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
    used = []
    for parts in by_seq.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        used.append(sum(p.length for p in parts))
    assert max(used, default=0) <= capacity
    return sum(capacity - u for u in used)


def test_packing_round_trip(make_extra, reference):
    rng = random.Random(4)
    docs = dict(enumerate(ODD + [" ".join(rng.choices(["alpha", "beta", "gamma's", "delta!"], k=rng.randrange(0, 1500))) for _ in range(60)]))
    d = make_extra(list(docs.items())).coalesce(2)
    for block in (packing.BLOCK_TOKENS, 6000):
        padding = checked_packing(packing.packed(d, block_tokens=block, keep_ids=True).collect(), docs, reference)
        assert padding < 2 * 2048 if block > 6000 else True
    same = packing.packed(make_extra([(1, "x"), (1, "x"), (None, None)]).coalesce(1), keep_ids=True).collect()
    assert sorted((str(p.id), len(p.ids)) for p in same) == [("1", 2), ("1", 2), ("None", 1)]
    assert packing.packed(make_extra([])).collect() == []


def test_packing_read_through_fewer_tasks(make_docs, reference):
    rng = random.Random(9)
    docs = dict(enumerate(" ".join(rng.choices(["alpha", "beta", "gamma's"], k=rng.randrange(0, 900))) for _ in range(120)))
    d = make_docs(list(docs.items())).repartition(6)
    plain_ids = {r.sequence_id for r in packing.packed(d).collect()}
    assert len({i >> packing.LOCAL_BITS for i in plain_ids}) > 1
    for n in (1, 3):
        pieces = packing.packed(d, keep_ids=True).coalesce(n).collect()
        checked_packing(pieces, docs, reference)
        assert {p.sequence_id for p in pieces} == plain_ids
    checked_packing(packing.packed(d, keep_ids=True).repartition(2).collect(), docs, reference)
    both = make_docs([(k + 1000 * j, t) for j in (0, 1) for k, t in docs.items()])
    twice = both.filter("doc_id < 1000").union(both.filter("doc_id >= 1000"))
    checked_packing(packing.packed(twice, keep_ids=True).coalesce(1).collect(), {k + 1000 * j: t for j in (0, 1) for k, t in docs.items()}, reference)


def test_packing_blocks_are_tight_and_balanced():
    rng = random.Random(6)
    for _ in range(200):
        lengths = [rng.choice([1, 5, 300, 700, 1500, 2047, 2048, 5000]) if rng.random() < .5 else rng.randint(1, 3000) for _ in range(rng.randint(0, 60))]
        pieces, n = packing.pack(lengths)
        assert sum(p[2] for p in pieces) == sum(lengths) and n * 2048 - sum(lengths) < 2048
        assert len({p[3] for p in pieces}) == n
    costs = {}
    for d, _, k, s, _ in packing.pack([100] * 200)[0]:
        costs[s] = costs.get(s, 0) + packing.cost(k)
    assert max(costs.values()) - min(costs.values()) <= 2 * packing.cost(100)


def test_sharding_interleaves_sources(make_extra):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, "", "é" * (i % 7), "t"]), None, rng.choice([None, "hot", "hot", "hot", "b", "c"])) for i in range(1000)]
    rows += [(5, "same", None, "hot")] * 3 + [(None, "x", None, "b")]
    got = sharding.interleaved(make_extra(rows), 7).collect()
    assert sorted((str(r.id), r.size, r.text_crc32, str(r.source)) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), str(s)) for d, t, _, s in rows)
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r)
    assert set(counts) == set(range(7)) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    for part in counts.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        for s in (None, "hot", "b", "c"):
            share = sum(x[3] == s for x in rows) / 7
            assert abs(sum(r.source == s for r in part) - share) <= 2
    again = sharding.interleaved(make_extra(rows[::-1]), 7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.interleaved(make_extra([]), 7).collect() == []
    assert sorted(r.shard for r in sharding.interleaved(make_extra(rows[:3]), 7).collect()) == [0, 2, 4]


LANGS = {"en": "the of and that with this from have which there", "de": "der die und nicht das ein mit sich auf werden",
         "fr": "les des une pour dans que est pas sur plus", "es": "los las una para con del por como pero más"}


def talk(rng, lang, n):
    return " ".join(rng.choices(LANGS[lang].split(), k=n))


def test_language_held_out_accuracy(make_extra):
    rng = random.Random(9)
    rows = [(i, talk(rng, lang, rng.randrange(4, 60)), lang) for i, lang in enumerate(rng.choices([*LANGS], k=600))]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? ...", "de"), (1003, talk(rng, "fr", 40_000), None), (None, talk(rng, "de", 30), None)]
    d = make_extra(rows + odd + [rows[0]] * 2)
    model = langid.learn(d)
    out = langid.predicted(d.withColumn("held", langid.held_out("doc_id")), model)
    assert out.columns == [*d.columns, "held", "lang_pred", "score"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) + 2 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.lang_pred != "und"]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > .98
    by_id = {r.doc_id: r for r in got}
    assert [by_id[k].lang_pred for k in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "fr", "de"]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)


def test_repeated_rows_are_learned_from_once(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "Model", lambda x, langs: sorted(langs))
    rng = random.Random(2)
    rows = [(i, talk(rng, v, 9), v) for i in range(40) for v in ("en", "de") if zlib.crc32(str(i).encode()) % 3 != 1]
    for often in (1, 30):
        assert langid.learn(make_docs(rows * often), sample=20, per_language=10) == ["de"] * 10 + ["en"] * 10
    assert langid.learn(make_docs(rows[:1] * 50 + rows[1:]), sample=1000) == sorted(r[2] for r in rows)


def test_language_model_edges(make_docs):
    none = make_docs([(1, "abc"), (2, None)])
    assert langid.learn(none) is None and langid.learn(make_docs([])) is None
    assert {r.lang_pred for r in langid.predicted(none, None).collect()} == {"und"}
    rng = random.Random(1)
    one = make_docs([(i, talk(rng, "en", 9), "xx") for i in range(9)])
    assert {(r.lang_pred, r.score) for r in langid.predicted(one, langid.learn(one)).collect()} == {("xx", 1.0)}
    three = make_docs([(i, talk(rng, v, 20), {"en": "ru", "de": "en", "fr": "fr", "es": "zz"}[v]) for i, v in enumerate([*LANGS] * 60)])
    got = langid.predicted(three, langid.learn(three)).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > .98


def test_page_lines():
    page = ('<!DOCTYPE html><title>T</title><style>x{}</style><script>var a="</p>";</script><body><div class="side-bar">x</div><div id=cookie_notice>c</div>'
            '<header>H</header><div><h1>T &amp; U&nbsp;&copy</h1><p>one<br>two<p>three <b>bo</b>ld <span class="ad">AD <span>in</span></span> tail<ul><li>a<li>b</ul></div>'
            '<section class="comments"><p>cc</section><form>f<input></form><!-- <p>no --><p hidden>h</p><a href="x>y">link</a><footer>F')
    assert [t for k, t in html_text.lines(page) if k == html_text.OTHER] == ["T & U ©", "one two", "three bold tail", "a", "b", "link"]
    assert html_text.main_text("<nav>m<article><h1>A</h1><p>b <i>c</i><footer>by</footer></article><p>out") == "A\nb c"
    assert [html_text.main_text(x) for x in (None, "", "<", "plain  text", "<p>a</p", "a < b", "<script>x")] == ["", "", "<", "plain text", "a", "a < b", ""]


@pytest.mark.parametrize("tag", ['title="a hidden gem"', 'data-id="menu"', 'data-class="share"', "title='class=share'", "data-role=search", "xhidden", 'alt="say &quot; id=menu"', "hidden-note=hidden"])
def test_attribute_values_and_longer_names_mark_nothing(tag):
    assert html_text.main_text(f"<article><p {tag}>Body</p></article>") == "Body"
    assert html_text.main_text(f'<article><p>See <a href="/p?id=share" {tag}>Read me</a></p></article>') == "See Read me"


def test_attributes_that_mark():
    for tag in ('class="x share"', "id=menu", "hidden", "HIDDEN=''", 'aria-hidden="true"', "role=search", "style='color:red; display: none'", 'title="a" class=share', "data-x='y'id=menu"):
        assert html_text.main_text(f"<article><p>A</p><div {tag}>gone</div></article>") == "A", tag
    assert html_text.main_text("<article><p>Let <math><mi>x</mi></math> be</p><p><object>shown</object></article>") == "Let x be\nshown"


def test_very_long_pages_and_odd_columns(spark):
    long = "<article>" + "".join(f"<p>line {i % 50} of a long text</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a/x", long, 1), (2, "http://a/y", long.replace("line 7", "row 7"), 2), (None, None, None, 3), (1, "http://a/x", long, 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, __id int").withColumn("__gone", html_text.F.lit("g"))
    out = html_text.extracted(d)
    assert out.columns == ["page_id", "url", "__id", "__gone", "text", "n_chars"]
    got = sorted((r["__id"], r.n_chars, r.text.count("\n")) for r in out.collect())
    want = [len("\n".join(f"{w} {i % 50} of a long text" if i % 50 == 7 else f"line {i % 50} of a long text" for i in range(20_000))) for w in ("line", "row")]
    assert got == [(1, want[0], 19_999), (1, want[0], 19_999), (2, got[2][1], 19_999), (3, 0, 0)]


def test_articles_in_boilerplate_are_boilerplate():
    assert html_text.main_text("<p>body<section class=comments><article class=comment>c</article></section>") == "body"
    assert html_text.main_text("<article><h1>A</h1><p>text</article><aside><article>other <p>story</article></aside><article class='teaser card'>t</article>") == "A\ntext"
    assert html_text.main_text("<section class=comments><article>reader</article></section>") == ""
    assert html_text.main_text("<article>main text<section id=comments><article>a reader's long comment</article></section> ends</article>") == "main text\nends"
    assert html_text.main_text("<div class='page has-sidebar'><article class='post tag-social'>A</article></div>") == "A"
    assert html_text.main_text("<nav>m<div><article>A text</article></div><nav>n</nav><p>b") == "A text"
    assert html_text.main_text("<form><div><article>A</article></div></form><aside><main>own</main></aside>") == "A\nown"
    assert html_text.main_text("<form><div><article>A</article></div></form>") == "A"


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_text.shared(a, b)
        it = iter(b)
        assert len(found) == best[-1][-1] and found == sorted(found) and all(a[i] in it for i in found)


def test_shared_lines_at_any_number_of_repeats():
    assert html_text.shared([1, 0], [0] * 65 + [1, 0]) == [0, 1]
    rng = random.Random(5)
    for n, kinds in ((200, 2), (300, 3), (150, 40), (400, 1)):
        a, b = ([rng.randrange(kinds) for _ in range(n + rng.randrange(50))] for _ in range(2))
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[-1]))
            best = row
        found = html_text.shared(a, b)
        it = iter(b)
        assert len(found) == best[-1] and found == sorted(set(found)) and all(a[i] in it for i in found)


def test_differencing_deletes_template_lines(spark):
    def page(k, body):
        return f"<body><div>Site name</div><p>{body}</p><div>Call us</div>"
    rows = [(i, f"http://Host{i % 2}.org/a/{i:03d}?q={i}", page(i, f"story {i}")) for i in range(60)]
    rows += [(100, "http://solo.org/x", page(0, "alone")), (101, None, page(0, "no url")), (102, "http://copy.org/1", page(0, "same")), (103, "http://copy.org/2", page(0, "same")),
             (104, "http://host0.org/b", "<article><p>kept Site name</article>"), (105, "http://host0.org/c", None), (104, "http://host0.org/b", "<article><p>kept Site name</article>")]
    d = spark.createDataFrame([(*r, "old", 7, "kept") for r in rows], "page_id long, url string, html string, text string, n_chars int, gone string").repartition(5)
    out = html_text.extracted(d)
    assert out.columns == ["page_id", "url", "gone", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert all(got[i].text == f"story {i}" for i in range(60))
    assert got[100].text == "Site name\nalone\nCall us" and got[101].text == "Site name\nno url\nCall us"
    assert got[102].text == got[103].text == "Site name\nsame\nCall us"
    assert got[104].text == "kept Site name" and got[105].text == "" and all(r.n_chars == len(r.text) and r.gone == "kept" for r in got.values())
    assert html_text.extracted(d.limit(0)).collect() == []


def test_differencing_decides_pages_with_an_article_too(spark):
    def page(i):
        return (f"<div>Site name</div><div><p>a long story that is told in plain blocks, number {i}</p></div><article>teaser {i}</article>"
                f"<nav>menu {i}</nav><div>Call us on any day of the week, from nine to five</div>")
    rows = [(i, f"http://h.org/{i:03d}", page(i)) for i in range(20)]
    rows += [(100 + k, f"http://m.org/{k}", f"<div>a template line that is longer than all of the text</div><article>t{k}</article>") for k in range(2)]
    rows += [(200, "http://n.org/1", "<p>long line outside of the main element<main>own</main>")]
    rows += [(300 + k, f"http://c.org/{k}", "<p>a copy of a page<article>as</article>") for k in range(2)]
    out = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    got = {r.page_id: r.text for r in out.collect()}
    assert all(got[i] == f"a long story that is told in plain blocks, number {i}\nteaser {i}" for i in range(20))
    assert got[100] == "t0" and got[101] == "t1" and got[200] == "own" and got[300] == got[301] == "a copy of a page\nas"


def brute_top(rows, k):
    vec = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in sorted(vec, key=lambda x: (x[0], x[1].tolist())):
        if q % 10 == 0 and q not in out:
            best = sorted((-int(v @ w), i) for i, w in vec if i != q and len(w) == len(v))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_top_k_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, .2) for _ in range(16)]) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(40)] + [(20, rows[20][1]), (2000, None), (2010, []), (2020, [None] * 16), (2030, [float("nan")] * 16), (2040, [float("inf")] * 16),
             (2050, [1.0, 2.0]), (2051, [3.0, -1.0]), (None, rows[0][1]), (2060, [0.0] * 16)]
    d = spark.createDataFrame([(i, v, 1, 1.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(3)
    f32 = [(r.vec_id, r.embedding) for r in d.collect()]
    got = {}
    for r in topk.top_k(d, d.filter("vec_id % 10 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = {q: x for q, x in brute_top(f32, 10).items() if x}
    assert got == want
    assert topk.top_k(d.limit(0), d.limit(0), 10).collect() == []


def test_block_bounds_hold_at_any_magnitude():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, d, m, k = int(rng.integers(1, 200)), int(rng.integers(1, 20)), int(rng.choice([1, 3, 100, 10 ** 6, 2 ** 61])), int(rng.integers(1, 12))
        values = rng.integers(-m, m + 1, (n, d))
        ids = rng.integers(0, max(1, n // int(rng.integers(1, 4))), n)
        q = int(rng.integers(n))
        found, score = topk.Block(ids, values).top(int(ids[q]), values[q], k)
        other = np.flatnonzero(ids != ids[q])
        exact = values[other].astype(object) @ values[q].astype(object) if len(other) else []
        best = sorted((-int(s), int(ids[o])) for s, o in zip(exact, other))[:k]
        assert list(zip(found.tolist(), score.tolist())) == [(i, min(max(-s, -2 ** 63), 2 ** 63 - 1)) for s, i in best]
