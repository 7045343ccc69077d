"""Hashed features of tokens, and the token lists they are made from."""

from __future__ import annotations

import numpy as np
from xxhash import xxh32_intdigest


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8, as written; the normal form is taken once a distinct word."""
    return text.encode().split() if text else []


#: About so many bytes of forms are hashed at a time.
CHUNK = 200_000
#: The constants of XXH32.
P1, P2, P3, P4, P5 = (np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393))


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint32(bits)) | (x >> np.uint32(32 - bits))


def xxh32_spans(at: np.ndarray, word: np.ndarray, starts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH32 of spans of equal size, from the bytes and the little-endian words that begin at each byte."""
    done = 0
    if size >= 16:
        lanes = [np.full(len(starts), (seed + add) % (1 << 32), dtype=np.uint32) for add in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        while done + 16 <= size:
            for k in range(4):
                lanes[k] = rotated(lanes[k] + word[starts + (done + 4 * k)] * P2, 13) * P1
            done += 16
        h = rotated(lanes[0], 1) + rotated(lanes[1], 7) + rotated(lanes[2], 12) + rotated(lanes[3], 18)
    else:
        h = np.full(len(starts), (seed + int(P5)) % (1 << 32), dtype=np.uint32)
    h += np.uint32(size)
    while done + 4 <= size:
        h = rotated(h + word[starts + done] * P3, 17) * P4
        done += 4
    while done < size:
        h = rotated(h + at[starts + done] * P5, 11) * P1
        done += 1
    h = (h ^ (h >> np.uint32(15))) * P2
    h = (h ^ (h >> np.uint32(13))) * P3
    return h ^ (h >> np.uint32(16))


def feature_rows(tokens: list[bytes], buckets: int, low: int, high: int, strip: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the features of each token, flat, and how many each has.

    A token's features are its whole form and the character n-grams of length low to
    high of ``<form>``. Forms are lower-cased; ``strip`` also drops punctuation at the
    ends, and a token of nothing else then has the one feature of the empty form.
    The n-grams of many tokens are hashed at once.
    """
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    forms: list[str] = []
    held = 0
    for token in tokens:
        w = token.decode("utf-8", "replace").lower()
        if strip:
            w = w.strip(".,;:!?\"'()[]{}|#*$%&<>=-_+/\\")
        forms.append(w)
        held += len(token) + 2
        if held >= CHUNK:
            parts.append(form_rows(forms, buckets, low, high))
            forms, held = [], 0
    parts.append(form_rows(forms, buckets, low, high))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def form_rows(forms: list[str], buckets: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``feature_rows`` gives, of a bounded number of forms."""
    whole = np.array([xxh32_intdigest(w, 7) for w in forms], dtype=np.int64) % buckets
    size = np.array([len(w) + 2 if w else 0 for w in forms], dtype=np.int64)  # of <form>, in characters; the empty form has no n-grams
    raw = "".join([f"<{w}>" for w in forms if w]).encode()
    at = np.frombuffer(raw + bytes(3), dtype=np.uint8).astype(np.uint32)
    word = at[:-3] | (at[1:-2] << np.uint32(8)) | (at[2:-1] << np.uint32(16)) | (at[3:] << np.uint32(24))
    char = np.append(np.flatnonzero((at[:-3] & np.uint32(0xC0)) != 0x80), len(raw))  # the byte at which each character begins
    first = np.cumsum(size) - size
    grams = [np.where(size > n, size - n + 1, 0) for n in range(low, high + 1)]
    counts = 1 + sum(grams, np.zeros(len(forms), dtype=np.int64))
    place = np.cumsum(counts) - counts
    flat = np.empty(counts.sum(), dtype=np.int64)
    flat[place] = whole
    place = place + 1
    for n, many in zip(range(low, high + 1), grams, strict=True):
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = np.repeat(first, many) + within
        starts = char[begin]
        length = char[begin + n] - starts
        values = np.empty(len(starts), dtype=np.uint32)
        for k in np.flatnonzero(np.bincount(length)):
            own = length == k
            values[own] = xxh32_spans(at, word, starts[own], int(k), n)
        flat[np.repeat(place, many) + within] = values % np.uint32(buckets)
        place = place + many
    return flat, counts
