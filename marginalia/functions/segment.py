"""Unigram segmentation: the best-scoring pieces of each word, by a piece vocabulary.

Text is composed (NFKC), ASCII punctuation stands apart, white space parts words, and
each word starts with a mark. Of all ways to cut a word into pieces of the vocabulary
or unknown characters, the one of the greatest sum of scores is taken (on equal sums,
a character stays unknown, and else the longest last piece wins); adjacent unknown
characters of a word are one.

The vocabulary is sorted 64-bit hashes with ids and scores, counted and bounded before
it is broadcast. An Arrow batch's distinct words are segmented together: numpy hashes
all their substrings of a length at once, looks them up, and the words' best sums
advance side by side, a character at a time. No word is segmented alone and no
substring is a Python object.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The mark before a word, characters of the longest piece, what an unknown character costs below the least score.
MARK, LONGEST, PENALTY = "▁", 24, 10.0
_PUNCTUATION = re.compile(r"([!-/:-@\[-`{-~])")
#: Pieces that a broadcast vocabulary holds at most (20 bytes each).
MOST_PIECES = 4_000_000
#: Characters of distinct words that are segmented together.
CHARS_AT_ONCE = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each starts (and the last ends)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.cumsum([0, *map(len, words)])


def piece_hash(pieces: list[str]) -> np.ndarray:
    """64-bit hashes of pieces; internal to a vocabulary, so any good hash serves."""
    flat, at = _codes(pieces)
    size, h = np.diff(at), np.zeros(len(pieces), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > k)
        h[own] = (h[own] + flat[at[own] + k] + np.uint64(1)) * _MULT
    return _mixed(h)


class Vocabulary:
    """Pieces as sorted hashes with their ids and scores."""

    def __init__(self, pieces: list[str], scores: list[float], unknown: int):
        if not 0 <= unknown < len(pieces):
            raise ValueError("the unknown piece is not in the vocabulary")
        scores = np.asarray(scores, np.float64)
        if not np.isfinite(scores).all():
            raise ValueError("scores must be finite numbers")
        keys = piece_hash(pieces)
        self.ids = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.ids]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces are equal, or share a hash")
        self.scores = scores.astype(np.float32).astype(np.float64)
        self.unknown, self.unknown_score = unknown, float(self.scores.min()) - PENALTY
        # A piece of more characters than LONGEST is never tried.
        self.longest = min(LONGEST, max(map(len, pieces)))

    def _found(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 where no piece has it."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.ids[at], -1)

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word's pieces."""
        if not words:
            return []
        flat, at = _codes(words)
        size = np.diff(at)
        left = np.repeat(at[1:], size) - np.arange(len(flat))  # characters from here to the word's end
        ids = np.full((self.longest, len(flat)), -1, np.int32)
        h = np.zeros(len(flat), np.uint64)
        for m in range(1, self.longest + 1):
            own = np.flatnonzero(left >= m)
            if not len(own):
                break
            h[own] = (h[own] + flat[own + m - 1] + np.uint64(1)) * _MULT
            ids[m - 1, own] = self._found(_mixed(h[own]))
        # best[at[w] + w + j]: the greatest sum for the first j characters of word w.
        base, order = at[:-1] + np.arange(len(words)), np.argsort(-size, kind="stable")
        best, back = np.zeros(len(flat) + len(words)), np.zeros(len(flat) + len(words), np.int8)
        longer = np.searchsorted(-size[order], -np.arange(int(size.max()) + 1), "right")  # words of at least j characters
        for j in range(1, int(size.max()) + 1):
            own = order[: longer[j]]
            now = best[base[own] + j - 1] + self.unknown_score
            how = np.zeros(len(own), np.int8)
            for m in range(min(j, self.longest), 0, -1):
                piece = ids[m - 1, at[own] + j - m]
                sums = np.where(piece >= 0, best[base[own] + j - m] + self.scores[piece], -np.inf)
                better = sums > now
                now, how = np.where(better, sums, now), np.where(better, np.int8(m), how)
            best[base[own] + j], back[base[own] + j] = now, how
        return self._walk(words, at, base, size, ids, back)

    def _walk(self, words, at, base, size, ids, back) -> list[np.ndarray]:
        """Pieces from the last to the first, of all words side by side."""
        place, live = size.copy(), np.flatnonzero(size)
        steps, before = [], np.full(len(words), -1, np.int32)
        while len(live):
            m = back[base[live] + place[live]].astype(np.int64)
            place[live] -= np.maximum(m, 1)
            piece = np.where(m > 0, ids[np.maximum(m, 1) - 1, at[live] + place[live]], self.unknown).astype(np.int32)
            kept = ~((piece == self.unknown) & (before[live] == self.unknown))
            before[live] = piece
            steps.append((live[kept], piece[kept]))
            live = live[place[live] > 0]
        word, piece = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(word, kind="stable")[::-1]  # later steps are earlier pieces
        word, piece = word[order], piece[order]
        ends = np.searchsorted(-word, -np.arange(len(words)), "left"), np.searchsorted(-word, -np.arange(len(words)), "right")
        return [piece[i:j] for i, j in zip(*(x.tolist() for x in ends), strict=True)]

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text's pieces; each distinct word is segmented once."""
        words = [[MARK + w for w in _PUNCTUATION.sub(r" \1 ", unicodedata.normalize("NFKC", t or "")).split()] for t in texts]
        distinct, known, at = sorted({w for own in words for w in own}), {}, 0
        while at < len(distinct):
            end, size = at, 0
            while end < len(distinct) and (end == at or size < CHARS_AT_ONCE):
                size += len(distinct[end])
                end += 1
            known.update(zip(distinct[at:end], self.segment(distinct[at:end]), strict=True))
            at = end
        none = np.zeros(0, np.int32)
        return [np.concatenate([none, *map(known.__getitem__, own)]) for own in words]


def load_vocabulary(path: str) -> Vocabulary:
    """A vocabulary file: JSON with a ``model`` of type Unigram, its ``vocab`` ([piece, score]) and ``unk_id``."""
    with open(path, encoding="utf-8") as file:
        raw = json.load(file)
    spec = raw.get("model") if isinstance(raw, dict) else None
    if not isinstance(spec, dict) or spec.get("type") != "Unigram":
        raise ValueError(f"{path}: not a Unigram model")
    rows, unknown = spec.get("vocab"), spec.get("unk_id")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if not isinstance(unknown, int) or not isinstance(rows, list) or not rows:
        raise ValueError(f"{path}: vocab or unk_id is missing")
    if not all(isinstance(r, list) and len(r) == 2 and isinstance(r[0], str) and number(r[1]) for r in rows):
        raise ValueError(f"{path}: a vocabulary entry is no [piece, score]")
    return Vocabulary([r[0] for r in rows], [r[1] for r in rows], unknown)


def vocabulary(pieces: DataFrame, unknown: str = "<unk>") -> Vocabulary:
    """A vocabulary from a table (piece, score); ids follow (score desc, piece) after the unknown piece's 0.

    A table of more than ``MOST_PIECES`` rows is an error: a vocabulary is bounded by design.
    """
    n = pieces.count()
    if n > MOST_PIECES:
        raise ValueError(f"{n} pieces are more than {MOST_PIECES}")
    rows = sorted(((r["piece"], float(r["score"])) for r in pieces.select("piece", "score").collect()), key=lambda r: (-r[1], r[0]))
    least = min((s for _, s in rows), default=0.0)
    return Vocabulary([unknown, *(p for p, _ in rows)], [least, *(s for _, s in rows)], 0)


#: Texts whose words a task holds at once.
TEXTS_AT_ONCE = 256


def segments(spark: SparkSession, text: Column, vocab: Vocabulary) -> Column:
    """array<int> of a text's piece ids; null text has none."""
    shared = spark.sparkContext.broadcast(vocab)  # bounded by MOST_PIECES

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for start in range(0, len(texts), TEXTS_AT_ONCE):  # words are held for so many texts, not for a batch
                out += shared.value.texts([t if isinstance(t, str) else None for t in texts.iloc[start : start + TEXTS_AT_ONCE]])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<int>")(text)
