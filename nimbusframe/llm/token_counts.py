"""Operator 6: token counts by a Viterbi search that carries counts only.

The vocabulary (pieces and scores) is read from a SentencePiece file and segmented as a
unigram model. An Aho-Corasick automaton enumerates every piece in a word; the search
keeps, for each place, the best score and the number of tokens on the way there, and no
path. The rules are those of the tokenizers library's Unigram model: a character that is no piece itself costs the
least score less ten and becomes one token per UTF-8 byte; a way is replaced only by a strictly better
one, starts taken from the left, so that of equal ways the one with the longest last piece stays. Words
begin at each blank, which belongs to the word after it; each distinct word is searched once.

Defined cases: null and empty texts have no tokens. Repeated rows and null ids are all returned;
other columns are ignored. Very long words are searched like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nimbusframe.llm.common import TokenTable, map_arrow, merged, segment, table

BLANK, PENALTY = "▁", 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]], unknown: str = "<unk>") -> None:
        self.search = ahocorasick.Automaton()
        scores = dict(vocab)
        for piece, score in scores.items():
            self.search.add_word(piece, (len(piece), score))
        self.search.make_automaton()
        self.pieces = scores
        self.unknown = unknown
        self.unknown_score = min(scores.values()) - PENALTY

    def count(self, word: str) -> tuple[int, float]:
        """Tokens and score of a word, which begins with its blank."""
        n = len(word)
        best, tokens = [0.0] * (n + 1), [0] * (n + 1)
        pieces, unknown = self.pieces, self.unknown_score
        ends: list[list] = [[] for _ in range(n)]
        for end, item in self.search.iter(word):
            ends[end].append(item)
        traced = self.unknown in word
        start = [0] * (n + 1) if traced else []
        for end in range(n):
            s = t = None
            for length, score in ends[end]:  # longest first: earliest start first
                x = best[end + 1 - length] + score
                if s is None or x > s:
                    s, t = x, tokens[end + 1 - length] + 1
                    if traced:
                        start[end + 1] = end + 1 - length
            if word[end] not in pieces:
                x = best[end] + unknown
                if s is None or x > s:
                    s, t = x, tokens[end] + len(word[end].encode())
                    if traced:
                        start[end + 1] = end
            best[end + 1], tokens[end + 1] = s, t
        return (self.traced(word, start) if traced else tokens[n]), best[n]

    def traced(self, word: str, start: list[int]) -> int:
        """Tokens on the best way, given by where each of its pieces starts, in a word that spells the unknown piece out: that runs together with unknown characters."""
        total, end = 0, len(word)
        run = end  # where the run of unknown pieces that ends at `stop` starts
        stop = end
        while end > 0:
            piece = word[start[end] : end]
            if piece == self.unknown or piece not in self.pieces:
                run = start[end]
            else:
                total += self.width(word[run:stop]) + 1
                run = stop = start[end]
            end = start[end]
        return total + self.width(word[run:stop])

    def width(self, run: str) -> int:
        return 0 if not run else 1 if run in self.pieces else len(run.encode())

    def rows(self, words: list[str]) -> np.ndarray:
        return np.array([self.count(BLANK + w) for w in words], dtype=np.float64)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    marked = text.replace(" ", BLANK)
    return (marked[1:] if marked[0] == BLANK else marked).split(BLANK)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the score of the best segmentation of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path or default_path())
        known = TokenTable(c.rows, most=800_000)
        for ids, texts in merged(batches):
            at, lengths = known.lookup([words_of(t) for t in texts])
            total = segment(np.add, known.matrix[at], lengths) if len(at) else np.zeros((len(ids), 2))
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(total[:, 0].astype(np.int64)), "path_score": pa.array(total[:, 1])})

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, path_score double")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
