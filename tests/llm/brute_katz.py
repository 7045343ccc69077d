"""The same model with dictionaries, for small tables."""

import math
import zlib
from collections import Counter, defaultdict


def good_turing(n, cut):
    """Katz's factors of counts up to ``cut`` from the counts of counts; (r - 1/2) / r where they aren't defined."""
    factors = {}
    for r in range(1, cut + 1):
        factors[r] = 1 - 0.5 / r
        if n[1] and n[r]:
            common = (cut + 1) * n[cut + 1] / n[1]
            if common < 1:
                star = (r + 1) * n[r + 1] / n[r]
                x = (star / r - common) / (1 - common)
                if 0 < x <= 1:
                    factors[r] = x
    return factors


def katz(rows, cut=5):
    toks = {k: [*(t or "").encode().lower().split(), b"\n"] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    c = Counter(w for k, t in toks.items() if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    d0 = n + 0.5 * (v + 1)
    p = lambda w: (c[w] + 0.5) / d0
    pair = Counter()
    for k, t in toks.items():
        if not held[k]:
            pair.update(zip(["start", *t[:-1]], t))  # noqa: B905
    d = good_turing(Counter(pair.values()), cut)
    after = defaultdict(dict)
    for (a, b), x in pair.items():
        after[a][b] = x
    model = {}
    for a, s in after.items():
        total = sum(s.values())
        mass = sum(d.get(x, 1) * x for x in s.values()) / total
        opened = 1 - sum(p(b) for b in s)
        scale = 1 / mass if opened < 1e-9 else total / (total + 0.5) if 1 - mass < 1e-9 else 1.0
        model[a] = (total, scale, 0 if opened < 1e-9 else (1 - mass * scale) / opened)

    def prob(a, b):
        total, scale, alpha = model.get(a, (0, 1, 1))
        x = pair.get((a, b), 0)
        return d.get(x, 1) * x / total * scale if x else alpha * p(b)

    out = []
    for k, t in toks.items():
        s = sum(math.log10(prob(a, b)) for a, b in zip(["start", *t[:-1]], t))  # noqa: B905
        out.append((rows[k][0], held[k], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), s))
    sums = [sum(prob(a, b) for b in [*c, "a word never seen"]) for a in [*list(model)[:30], "nowhere"]]
    return out, sums
