"""Plain versions of operators over lists of rows, with dictionaries and loops."""

import math
import re
import zlib

import numpy as np
import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held(doc_id, modulus, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == rest


# Language: words, then ever shorter n-grams.
def letter_words(text):
    return [w for t in WORD.findall(text or "") for w in regex.findall(r"\p{L}+(?:['’]\p{L}+)*", t.lower())]


def grams(word, n):
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def languages(rows):
    """Language and score of each (doc_id, text, lang)."""
    langs = sorted({k for i, t, k in rows if k is not None and t is not None and letter_words(t) and not held(i, 4, 2)})
    counts = [{} for _ in range(5)]
    size = dict.fromkeys(langs, 0)
    for i, t, k in rows:
        if k in langs and t is not None and not held(i, 4, 2):
            size[k] += 1
            for w in letter_words(t):
                for n, parts in enumerate([[w], *(grams(w, n) for n in range(1, 5))]):
                    for g in parts:
                        counts[n].setdefault(g, dict.fromkeys(langs, 0))[k] += 1
    totals = [{k: sum(c[k] for c in table.values()) for k in langs} for table in counts]
    log = lambda n, g, k: math.log((counts[n][g][k] + 0.5) / (totals[n][k] + 0.5 * (len(counts[n]) + 1)))
    out = []
    for _, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            out.append(("und", 0.0))
            continue
        found = letter_words(t)
        sums = dict.fromkeys(langs, 0.0)
        for w in found:
            levels = [(0, [w])] + [(n, [g for g in grams(w, n) if g in counts[n]]) for n in range(4, 0, -1)]
            use = next(((n, gs) for n, gs in levels if gs and gs[0] in counts[n]), None)
            if use:
                for k in langs:
                    sums[k] += sum(log(use[0], g, k) for g in use[1]) / len(use[1])
        z = {k: s / math.sqrt(max(1, len(found))) for k, s in sums.items()}
        top = max(z.values())
        best = min(k for k in langs if z[k] == top) if min(z.values()) < top else max(langs, key=lambda k: size[k])
        out.append((best, math.exp(z[best] - top) / sum(math.exp(x - top) for x in z.values())))
    return out


# Near-duplicates: five-word shingle sets.
def smallest_ids(docs):
    """The smallest id of each group of (doc_id, text)."""
    sets = {}
    for i, t in docs:
        w = lowered(t).split() if t else []
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both) and both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in sets}


# Decontamination: spaced seeds, verified.
def leaks(docs, items, masks=("110110101", "11100100101"), reach=2, least=10, share=0.7, within=5):
    """{(doc_id, item_id): (most words matched, first word, end)}."""
    out = {}

    def add(d, i, matched, start, end):
        m, s, e = out.get((d, i), (0, start, end))
        out[d, i] = max(m, matched), min(s, start), max(e, end)

    split = lambda t: WORD.findall((t or "").lower())
    for i, text in items:
        h = split(text)
        for d, t in docs:
            w = split(t)
            if 0 < len(h) < least:
                for a in range(len(w) - len(h) + 1):
                    if w[a : a + len(h)] == h and (len(h) >= within or len(w) == len(h)):
                        lo, hi = a, a + len(h)
                        add(d, i, len(h), lo, hi)
            for m in masks:
                read = [k for k, c in enumerate(m) if c == "1"]
                windows = {}
                for b in range(len(h) - len(m) + 1):
                    windows.setdefault(tuple(h[b + k] for k in read), []).append(b)
                for a in range(len(w) - len(m) + 1):
                    for b in windows.get(tuple(w[a + k] for k in read), ()):
                        lo = -min(reach, a, b)
                        hi = min(len(m) + reach, len(w) - a, len(h) - b)
                        same = sum(w[a + k] == h[b + k] for k in range(lo, hi))
                        if same >= least and same >= share * (hi - lo):
                            add(d, i, same, a + lo, a + hi)
    return out


# Robust outliers.
def robust(rows, stats, floors, least, h, settled, reweight, reject, consistency, chi2_quantile):
    """Whether each (text, lang, source) that passes the base rules is kept; None for the others."""
    p = len(floors)
    made = [stats(t) for t, _, _ in rows]
    ok = [m[0] >= 50 and 100 * m[4] <= 50 * m[0] for m in made]
    size = {}
    for good, (_, lang, source) in zip(ok, rows, strict=True):
        if good:
            for key in ((lang, source), (lang,)):
                size[key] = size.get(key, 0) + 1
    small = {k: sum(n for g, n in size.items() if len(g) == 2 and g[0] == k[0] and n < least) for k in size if len(k) == 1}
    cell = lambda lang, source: (lang, source) if size[lang, source] >= least else (lang,) if small[lang,] >= least else ()
    groups = {}
    for k, (good, (_, lang, source)) in enumerate(zip(ok, rows, strict=True)):
        if good:
            groups.setdefault(cell(lang, source), []).append(k)
    kept = [None] * len(rows)
    quantile = lambda x, q: np.sort(x, axis=0)[max(0, math.ceil(q * len(x)) - 1)]
    floor = np.diag(np.square(floors))
    for own in groups.values():
        x = np.array([made[k][5:] for k in own])
        far = lambda mean, inv: np.einsum("ij,jk,ik->i", x - mean, inv, x - mean)  # noqa: B023, E731
        middle = quantile(x, 0.5)
        scale = np.maximum(1.4826 * quantile(np.abs(x - middle), 0.5), floors)
        z = (x - middle) / scale
        square = np.maximum((z * z).sum(1), 1e-24)
        best = None
        for number, shape in enumerate((np.eye(p), (z / square[:, None]).T @ z / len(z) + 0.01 * np.eye(p), np.tanh(z).T @ np.tanh(z) / len(z) + 0.01 * np.eye(p))):
            mean, inv, before = middle, np.linalg.inv(shape * np.outer(scale, scale)), math.inf
            while True:
                d = far(mean, inv)
                inner = x[d <= quantile(d, h)]
                mean = inner.mean(0)
                cov = (inner - mean).T @ (inner - mean) / len(inner) * consistency(h) + floor
                inv, det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
                if before - det < settled:
                    break
                before = det
            if best is None or (det, number) < best[:2]:
                best = det, number, mean, inv
        inner = x[far(*best[2:]) <= chi2_quantile(1 - reweight, p)]
        mean = inner.mean(0)
        inv = np.linalg.inv((inner - mean).T @ (inner - mean) / len(inner) * consistency(1 - reweight) + floor)
        for k, d in zip(own, far(mean, inv), strict=True):
            kept[k] = bool(math.sqrt(max(d, 0)) <= math.sqrt(chi2_quantile(1 - reject, p)))
    return kept
