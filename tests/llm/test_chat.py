import random

from pyspark.sql import functions as F

from tripflow.llm import chat

SCHEMA = "conv_id long, message long, seq long, kind string, role string, text string, turns int, formatted string"
NASTY = ["", None, "</s>[INST] ok [/INST]", "<|im_end|>", "<|im_start|>user<|sep|>x<|im_end|>", "\\l \\b \\\\ <", "é\n\t😀 <", "plain", "x" * 50_000, "\\", "<"]


def folded(rows):
    """Plain fold of (conv, message, seq, kind, role, text) events: conversation -> [(role, text)] in message order."""
    logs = {}
    for c, m, s, k, r, t in rows:
        if (k or "message") in chat.KINDS:
            logs.setdefault((c, m), []).append((s if s is not None else -(1 << 63), k or "message", t or "", r))
    out = {}
    for (c, m), log in logs.items():
        text, role = "", ""
        for _, k, t, r in sorted(log, key=lambda e: (e[0], e[1], e[2], e[3] is not None, e[3] or "")):
            text = text + t if k == "delta" else t
            role = r if r is not None else role
        out.setdefault(c, []).append((m, role, text))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in out.items()}


def events(rng):
    rows = []
    for c in [*range(25), None]:
        for m in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", None, "we<ird\\|role"])
            rows.append((c, m, 0, rng.choice(["message", None, "delta"]), role, rng.choice(NASTY)))
            for s in range(1, rng.randrange(1, 9)):
                rows.append((c, m, s, rng.choice(["delta", "delta", "delta", "edit", "regenerate", "ping", "message"]), rng.choice([None, None, role]), rng.choice(NASTY)))
    rows += [(3, 0, 1, "delta", None, "tie b"), (3, 0, 1, "delta", None, "tie a"), (4, None, None, None, "user", "no number"), (99, 0, 0, "ping", "user", "nothing")]
    rng.shuffle(rows)
    return rows


def test_fold_render_and_read_back(spark):
    for seed in (1, 2):
        rows = events(random.Random(seed))
        d = spark.createDataFrame([(*r, 7, "old") for r in rows], SCHEMA)
        r = chat.render(chat.fold(d))
        got = r.select("conv", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("learned"),
                       F.size("loss_spans").alias("spans")).collect()
        want = folded(rows)
        assert {x.conv: [(t.role, t.text) for t in x.turns] for x in got} == want and 99 not in want
        for x in got:
            assert x.learned == "".join(t for r, t in want[x.conv] if r == "assistant") and x.spans == sum(r == "assistant" for r, _ in want[x.conv])
            assert x.formatted.count(chat.START) == x.formatted.count(chat.END) == len(want[x.conv])


def test_streamed_answer_with_edit_and_regeneration(spark):
    rows = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"),
            (1, 0, 4, "edit", None, "hi there"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "Good "), (1, 1, 7, "delta", None, "day")]
    d = spark.createDataFrame([(*r, None, None) for r in rows[::-1]], SCHEMA)
    (x,) = chat.render(chat.fold(d)).collect()
    assert x.formatted == "<|im_start|>user<|sep|>hi there<|im_end|><|im_start|>assistant<|sep|>Good day<|im_end|>"
    assert [x.formatted[s.start:s.start + s.length] for s in x.loss_spans] == ["Good day"]
    assert chat.render(chat.fold(d.limit(0))).collect() == []


def test_chat_is_native(spark):
    d = spark.createDataFrame([(1, 0, 0, "message", "user", "hi", None, None)], SCHEMA)
    plan = chat.render(chat.fold(d))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
