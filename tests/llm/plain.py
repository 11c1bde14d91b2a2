"""Plain Python versions of the operators, for tables of a few hundred rows."""

import re
from collections import Counter
from fractions import Fraction

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def near_components(rows):
    """doc_id -> (set size, least id reachable); rows of (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def without_repeated_lines(rows, width=3):
    """doc_id -> (text, lines removed) for rows of (doc_id, text) with distinct ids."""
    seen, gone = set(), {}
    for d, text in sorted(rows):
        lines = [(i, x.strip(" \t\r")) for i, x in enumerate((text or "").split("\n"))]
        lines = [(i, x) for i, x in lines if x]
        spans = [lines[k:k + width] for k in range(len(lines) - width + 1)] if len(lines) >= width else [lines] if lines else []
        for span in spans:
            key = tuple(x for _, x in span)
            if key in seen:
                gone.setdefault(d, set()).update(i for i, _ in span)
            seen.add(key)
    out = {}
    for d, text in rows:
        g = gone.get(d, set())
        out[d] = ("\n".join(x for i, x in enumerate(text.split("\n")) if i not in g) if g else text, len(g))
    return out


def periodic_runs(words, least=6, times=4):
    """All runs (start, length, period) of a list of words, and the words outside of repetitions."""
    n, out, gone = len(words), [], set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            w = words[s:i + q]
            if len(w) >= max(least, times * q) and not any(w[p:] == w[:-p] for p in range(1, q)):
                out.append((s, len(w), q))
                gone |= {*range(s + q, i + q)}
    return sorted(out, key=lambda r: (r[0], r[2])), [w for i, w in enumerate(words) if i not in gone]


def shared_targets(sizes, weights=(5, 2, 1)):
    """source -> target, the excess of stopped sources shared again and again; sizes by source, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, todo = {}, Fraction(3 * sum(sizes.values()), 2)
    while names:
        level = todo / sum(weight[s] for s in names)
        above = [s for s in names if level * weight[s] > 2 * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in names}
        for s in above:
            target[s] = Fraction(2 * sizes[s])
            todo -= target[s]
            names.remove(s)
    return target


def collocations(rows, least=100, most_words=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) for rows of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most_words + 1):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for lang in n:
        own = {p[1:]: a for p, a in often.items() if p[0] == lang}
        rows = []
        for p, a in own.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)
