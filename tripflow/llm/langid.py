"""Language identification in two levels: the language family first, then the language within it.

Texts become hashed counts of 1- to 3-letter runs over lower-cased letters (everything else is one blank), of unit length.
A linear support vector machine per family (one against the rest) picks the family; within it, one machine per pair of
languages votes. Machines are fitted by dual coordinate descent on a bounded sample: at most ``SAMPLE`` rows, the same
number per language, chosen by hash. Prediction reads whole texts in Arrow batches; the model is a few arrays of
``FEATURES`` numbers.

The score is the least certain decision on the path, as a probability (logistic of the margin), from 0 to 1.

Defined results: a text that is null or has no letter is ``und`` with score 0. Without any labelled row every text is
``und``. With a single language or family the decision it would take is certain (1). Languages that are in no family
below share the family ``other``. Rows with a null id are predicted too and may be learned from. Extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.memory import release, released

FEATURES, SAMPLE, PER_LANGUAGE, ROUNDS, PENALTY, SLOPE = 1 << 12, 4000, 1000, 12, 10.0, 3.0
UNKNOWN = "und"

# ISO 639-1 codes by language family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr sl bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indo-iranian": "hi ur bn pa gu mr ne fa ps ku tg".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue".split(),
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().replace("_", "-").split("-")[0] in codes), "other")


def held_out(id_col: str) -> Column:
    """The third of the rows, by checksum of the id, that is never learned from."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


class Profiles:
    """Hashed letter-run counts of texts."""

    def __init__(self, features: int = FEATURES):
        self.features = features
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def counts(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text, or None where it has no letter."""
        if not text:
            return None
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(self.letter[codes], codes, 32)
        gap = codes == 32
        if gap.all():
            return None
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        c = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
        mask = np.uint32(self.features - 1)
        found = np.zeros(self.features, np.float32)
        for run in (c, two, three):
            h = run * np.uint32(0xC2B2AE3D)
            found += np.bincount(((h ^ (h >> np.uint32(15))) & mask).astype(np.int64), minlength=self.features)
        return found / np.linalg.norm(found)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine, hinge loss, by dual coordinate descent."""
    n, d = x.shape
    w, alpha = np.zeros(d + 1, np.float32), np.zeros(n, np.float32)
    norm = (x * x).sum(1) + 1
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(n):
            slack = y[i] * (x[i] @ w[:d] + w[d]) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), penalty)
            if step := (new - alpha[i]) * y[i]:
                w[:d] += step * x[i]
                w[d] += step
                alpha[i] = new
    return w


class Model:
    """Families, their languages, and the machines that tell them apart."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.names = sorted(self.families)
        of = np.array([family_of(v) for v in langs])
        lang = np.array(langs)
        asked = self.names if len(self.names) > 2 else self.names[:1] * (len(self.names) > 1)
        self.rest = [fit_svm(x, np.where(of == f, 1.0, -1.0).astype(np.float32)) for f in asked]
        self.pairs = {}
        for f, members in self.families.items():
            for a, b in combinations(members, 2):
                rows = (lang == a) | (lang == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0).astype(np.float32))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        margins = [float(v @ w[:-1] + w[-1]) for w in self.rest]
        if not self.rest:
            family, least = self.names[0], np.inf
        elif len(self.rest) == 1:
            family, least = self.names[0 if margins[0] >= 0 else 1], abs(margins[0])
        else:
            best, second = np.argsort(margins)[::-1][:2]
            family, least = self.names[best], (margins[best] - margins[second]) / 2
        members = self.families[family]
        votes = {m: [0, 0.0] for m in members}
        duels = {}
        for a, b in combinations(members, 2):
            w = self.pairs[a, b]
            duels[a, b] = m = float(v @ w[:-1] + w[-1])
            won = votes[a if m >= 0 else b]
            won[0] += 1
            won[1] += abs(m)
        lang = max(members, key=lambda m: votes[m])
        own = [m if a == lang else -m for (a, b), m in duels.items() if lang in (a, b)]
        least = min([least, *own])
        return lang, float(1 / (1 + np.exp(-SLOPE * min(least, 50.0))))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
          per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on at most ``sample`` labelled rows that are not held out; None where there is none."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), key.alias("key"))
    # a row that repeats id and text is drawn once at most, however often it stands
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("rows")).orderBy("lang").limit(sample)
    each = max(1, min(per_language, sample // max(1, sizes.count())))
    # rows far beyond the lowest hashes never reach the ranking, so a large language is not ranked in one task
    reach = F.least(F.lit(1.0), F.lit(4.0 * each + 100) / F.col("rows"))
    near = rows.join(F.broadcast(sizes), "lang").filter((F.col("key").cast("double") + 2.0 ** 63) / 2.0 ** 64 < reach)
    near = near.select("lang", "id", "key").distinct()
    best = Window.partitionBy("lang").orderBy("key", "id")
    chosen = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= each).select("lang", "id", "key").limit(sample)
    texts = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text"))
    on = F.col("t.id").eqNullSafe(F.col("c.id")) & (F.col("t.key") == F.col("c.key")) & (F.col("t.lang") == F.col("c.lang"))
    drawn = texts.alias("t").join(F.broadcast(chosen).alias("c"), on, "left_semi")
    drawn = drawn.dropDuplicates(["lang", "id", "key"])  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles()
        for batch in batches:
            found = [(lang.as_py(), v) for lang, text in zip(batch.column(0), batch.column(1)) if (v := profiles.counts(text.as_py())) is not None]
            vectors = pa.array([v.tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in found], pa.string()), vectors], names=["lang", "v"])

    fitted = drawn.select("lang", "text").mapInArrow(released(run), "lang string, v binary").toArrow()
    if not fitted.num_rows:
        return None
    pairs = sorted(zip(fitted.column(0).to_pylist(), fitted.column(1).to_pylist()))
    return Model(np.stack([np.frombuffer(v, np.float32) for _, v in pairs]), [lang for lang, _ in pairs])


def predicted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (in place of columns of these names)."""
    docs = docs.drop("lang_pred", "score")

    # only the text goes to Python and only the prediction comes back; Spark holds the rows meanwhile
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def said(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiles = Profiles()
        try:
            for texts in batches:
                out = []
                for text in texts:
                    v = profiles.counts(text.as_py()) if model else None
                    out.append((UNKNOWN, 0.0) if v is None else model.predict(v))
                yield pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=["lang_pred", "score"])
        finally:
            release()

    own = [F.col("row")[c].alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*docs.columns).alias("row"), said.asNondeterministic()(F.col(text_col)).alias("said"))
    return rows.select(*own, F.col("said.lang_pred"), F.col("said.score"))
