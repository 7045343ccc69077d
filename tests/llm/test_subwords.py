"""The features of many tokens are hashed at once and equal those of one token after the other."""

import numpy as np
import pytest
from xxhash import xxh32_intdigest

from nimbusframe.llm import subwords


def plain(tokens, buckets, low, high, strip):
    rows = []
    for token in tokens:
        w = token.decode("utf-8", "replace").lower()
        w = w.strip(".,;:!?\"'()[]{}|#*$%&<>=-_+/\\") if strip else w
        form = f"<{w}>" if w else ""
        grams = [(form[i : i + n], n) for n in range(low, min(high, len(form) - 1) + 1) for i in range(len(form) - n + 1)]
        rows.append([xxh32_intdigest(g, seed) % buckets for g, seed in [(w, 7), *grams]])
    return rows


@pytest.mark.parametrize(("low", "high", "strip"), [(4, 6, True), (3, 4, False), (1, 9, False)])
def test_features_of_many_tokens(monkeypatch, low, high, strip):
    rng = np.random.default_rng(4)
    letters = list("abXYZéÉßİ日本語\U0001f600<>.,-'0")
    tokens = ["".join(rng.choice(letters, rng.integers(0, 14))).encode() for _ in range(600)] + [b"", b"...", b"a", b"\xff\x80ab", b"x" * 3000, "\U0001f600".encode() * 40]
    want = plain(tokens, 1 << 16, low, high, strip)
    calls, one = [], subwords.xxh32_intdigest
    monkeypatch.setattr(subwords, "xxh32_intdigest", lambda *a: calls.append(a) or one(*a))
    for chunk in (1, 100, 1 << 20):
        monkeypatch.setattr(subwords, "CHUNK", chunk, raising=False)
        calls.clear()
        flat, counts = subwords.feature_rows(tokens, 1 << 16, low, high, strip)
        assert counts.tolist() == [len(r) for r in want] and flat.tolist() == [f for r in want for f in r]
        assert len(calls) <= len(tokens)  # no call for each n-gram
    assert [a.tolist() for a in subwords.feature_rows([], 1 << 16, low, high, strip)] == [[], []]
