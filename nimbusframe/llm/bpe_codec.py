"""Operator 5: byte-level BPE by speculation and verification.

Greedy longest match proposes the tokens of each pre-token. A sequence of tokens is
the tokenizer's own exactly if each token is canonical and each adjacent pair is: no
merge across the border would have come before the merges that made the two. That
check runs over arrays of pairs at once; only pre-tokens with a failing pair are
merged exactly, pair by pair in rank order.

Defined cases: a null text counts as empty (no tokens, hash of nothing). Special
tokens written out in a text are matched as the library does, before anything else.
Repeated rows are encoded each. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from nimbusframe.llm.common import map_arrow, merged, table

#: White space of the byte-level pre-tokenizer, and code points that the regex module's
#: Unicode tables class as letters, numbers or assigned and those of the tokenizers library do not.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 "
    "18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_CLASS = "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER.split())


def split_pattern(newer: bool) -> str:
    """The split pattern; ``newer`` adds the exclusion of NEWER from letters and numbers."""
    but = f"--[{NEWER_CLASS}]" if newer else ""
    letter, number = rf"[\p{{L}}{but}]", rf"[\p{{N}}{but}]"
    other = rf"[^{SPACE}\p{{L}}\p{{N}}]" if not newer else rf"(?:[{NEWER_CLASS}]|[^{SPACE}\p{{L}}\p{{N}}])"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Codec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, most: int = 100_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        # Ranks: 0-255 for bytes, then the merges in order. ``parts`` splits a rank, ``ids`` names it in the file.
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.left, self.right = [*range(256)], [*range(256)]
        for m in spec["model"]["merges"]:
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            if a + b not in self.rank:
                self.rank[a + b] = len(self.left)
                self.left.append(self.rank[a])
                self.right.append(self.rank[b])
        n = len(self.left)
        self.id_of = np.array([vocab[w] for w in sorted(self.rank, key=self.rank.get)], dtype=np.uint32)
        self.left_np, self.right_np = np.array(self.left, dtype=np.int64), np.array(self.right, dtype=np.int64)
        keys = self.left_np[256:] * n + self.right_np[256:]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], (order + 256).astype(np.int64)
        self.merge_of = {(self.left[r], self.right[r]): r for r in range(256, n)}
        self.n = n
        self.longest = max(map(len, self.rank))
        # A merged token is canonical if its parts are and nothing across their border comes before its own merge.
        ok = np.ones(n, dtype=bool)
        border = self.compatible(self.left_np[256:], self.right_np[256:], np.arange(256, n))
        for r in range(256, n):
            ok[r] = ok[self.left[r]] and ok[self.right[r]] and border[r - 256]
        self.canonical = ok
        self.usual = regex.compile(split_pattern(False)).findall
        self.careful = regex.compile(split_pattern(True), regex.V1).findall
        self.has_newer = regex.compile(f"[{NEWER_CLASS}]").search
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self.known_pairs, self.known_ok = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        # Two generations of words: when the younger is full it becomes the older, so common words stay and memory is bounded.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most
        self.exact_words = self.seen_words = 0
        # Decoder tables: the bytes of each id, end to end.
        names: list[bytes] = [b""] * self.size
        for w, i in vocab.items():
            names[i] = w
        for s, i in self.specials.items():
            names[i] = b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in s)
        self.names = names

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        try:
            text.encode("latin-1")
            return self.usual(text)
        except UnicodeEncodeError:
            return self.careful(text) if self.has_newer(text) else self.usual(text)

    def merged_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging each pair, or n where there is no such merge."""
        keys = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], self.n)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether tokens a and b, side by side, stay as they are; ``limit``: merges from this rank on don't count.

        Walks back through the merges that made a's right and b's left edge, latest
        first; a border merge that ranks before the later of the two fails the pair.
        """
        n = self.n
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), n, dtype=np.int64) if limit is None else limit.astype(np.int64).copy()
        good, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            bad = self.merged_rank(x, y) < top
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # Undo whichever token was made later; a border merge must then rank before it.
            # On a tie the left token was merged first, so the right one is undone first.
            back_left = x > y
            top = np.where(back_left, x, y + (y >= 256))
            stuck = np.where(back_left, x, y) < 256
            a[live], b[live] = np.where(back_left, self.right_np[x], x), np.where(back_left, y, self.left_np[y])
            limit[live] = top
            live = live[~stuck]
        return good

    def greedy(self, word: bytes) -> list[int]:
        rank, out, i, n = self.rank, [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                r = rank.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first; beyond a few bytes with a heap over a linked list, n log n for long words."""
        if len(word) <= 24:
            get, none, part = self.merge_of.get, self.n, list(word)
            ranks = [get(p, none) for p in zip(part, part[1:])]  # noqa: B905
            while ranks and (r := min(ranks)) < none:
                i = ranks.index(r)
                part[i : i + 2] = [r]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((part[i - 1], r), none)
                if i < len(ranks):
                    ranks[i] = get((r, part[i + 1]), none)
            return part
        part = list(word)
        size = len(part)
        after, before = [*range(1, size + 1)], [*range(-1, size - 1)]
        alive, merge = [True] * size, self.merge_of
        heap = [(r, i, part[i], part[i + 1]) for i in range(size - 1) if (r := merge.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or part[i] != x or j >= size or part[j] != y:
                continue
            part[i], alive[j], after[i] = r, False, after[j]
            if after[j] < size:
                before[after[j]] = i
                if (q := merge.get((r, part[after[j]]))) is not None:
                    heapq.heappush(heap, (q, i, r, part[after[j]]))
            if before[i] >= 0 and (q := merge.get((part[before[i]], r))) is not None:
                heapq.heappush(heap, (q, before[i], part[before[i]], r))
        return [p for p, a in zip(part, alive, strict=True) if a]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each distinct pre-token."""
        raw = [w.encode() for w in words]
        guess = [self.greedy(w) for w in raw]
        lengths = np.array([len(g) for g in guess], dtype=np.int64)
        flat = np.array([r for g in guess for r in g], dtype=np.int64)
        owner = np.repeat(np.arange(len(guess)), lengths)
        fails = np.zeros(len(guess), dtype=bool)
        fails[owner[~self.canonical[flat]]] = True
        inner = owner[1:] == owner[:-1]
        keys, back = np.unique((flat[:-1] * self.n + flat[1:])[inner], return_inverse=True)
        at = np.minimum(np.searchsorted(self.known_pairs, keys), max(len(self.known_pairs) - 1, 0))
        seen = self.known_pairs[at] == keys if len(self.known_pairs) else np.zeros(len(keys), dtype=bool)
        good = self.known_ok[at] & seen if len(self.known_pairs) else seen.copy()
        new = np.flatnonzero(~seen)
        if len(new):
            good[new] = self.compatible(keys[new] // self.n, keys[new] % self.n)
            if len(self.known_pairs) > 8 * self.most:
                self.known_pairs, self.known_ok = self.known_pairs[:0], self.known_ok[:0]
            every = np.concatenate([self.known_pairs, keys[new]])
            order = np.argsort(every, kind="stable")
            self.known_pairs, self.known_ok = every[order], np.concatenate([self.known_ok, good[new]])[order]
        fails[owner[:-1][inner][~good[back]]] = True
        self.seen_words += len(words)
        self.exact_words += int(fails.sum())
        for i in np.flatnonzero(fails):
            guess[i] = self.exact(raw[i])
        ids = self.id_of.astype("<u4")
        return [ids[g].tobytes() for g in guess]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        jobs: list[list] = []
        for t in texts:
            parts: list = []
            if t:
                if self.special_split and any(s in t for s in self.specials):
                    for k, piece in enumerate(self.special_split(t)):
                        if k % 2:
                            parts.append(self.specials[piece])
                        elif piece:
                            parts.append(self.split(piece))
                else:
                    parts.append(self.split(t))
            jobs.append(parts)
        if len(self.words) > self.most:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        new = {w for parts in jobs for p in parts if not isinstance(p, int) for w in p if w not in words}
        fresh = []
        for w in new:
            if (ids := older.get(w)) is not None:
                words[w] = ids
            else:
                fresh.append(w)
        if fresh:
            words.update(zip(fresh, self.encode_words(fresh), strict=True))
        get = words.__getitem__
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(get, p)) for p in parts) for parts in jobs]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; broken sequences become replacement characters."""
        raw = b"".join(map(self.names.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, decoded text and, on request, the ids of every document.

    The ids are the binary little-endian sequence; hashes of both are included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path or default_path())
        for doc_ids, texts in merged(batches, 1_000_000):
            ids = c.encode_many(texts)
            out = {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids]),
            }
            if keep_ids:
                out |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([c.decode(x).decode() for x in ids])}
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
