"""Benchmark decontamination by q-gram lemma filtering.

A passage of ``m`` characters that a text holds with at most ``k`` edits shares
at least ``m - q + 1 - k*q`` of its q-grams with the text, all on diagonals
(text position less passage position) within ``k`` of each other.

1. Windows of the text with too few q-grams of any passage are passed over.
2. In the others, shared q-grams are counted in overlapping diagonal bands for
   each passage; bands below the passage's bound go.
3. What is left is verified by banded alignment (edit distance).

Texts are compared lower-cased with white space collapsed; reported positions
are in that normalised text. The whole text is searched, in overlapping chunks.

Items of fewer than ``q`` characters have no q-gram, and no edit is within their
budget: an automaton of them finds every place where one stands and is no part of a
longer word (a letter or number beside it that could go on with its own; scripts
written without blanks have no such edges).

The index of the benchmark is built on the driver, a block of ``BLOCK_CHARS``
characters at a time, and broadcast; all blocks together take about 60 bytes a
character of the benchmark there.

Defined cases: null or empty texts and items match nothing; repeated rows are reported each;
a null doc_id or item_id is reported as null; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 8
#: Edits allowed, as a share of the passage's characters.
EDIT_RATE = 0.08
#: Characters of benchmark text in one broadcast index; a larger benchmark is searched block by block.
BLOCK_CHARS = 4_000_000
CHUNK = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Thai, Lao, Burmese, Khmer, kana, Han and its extensions.
_BLANKLESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of each q-gram, built from grams of powers of two."""
    n = len(a) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, done, out = a.astype(np.uint64) + np.uint64(1), 1, 0, None
    mult = int(_MULT)
    while done < q:
        if q & size:
            part = power[done : done + n]
            out = part if out is None else out * np.uint64(pow(mult, size, 1 << 64)) + part
            done += size
        if done < q:
            power = power[:-size] * np.uint64(pow(mult, size, 1 << 64)) + power[size:]
            size *= 2
    return out ^ (out >> np.uint64(31))


def _automaton(items):
    """An automaton over the items, or None without any."""
    if not items:
        return None
    import ahocorasick

    out = ahocorasick.Automaton()
    for item in items:
        out.add_word(item, item)
    out.make_automaton()
    return out


def _one_word(a: str, b: str) -> bool:
    """Whether adjacent characters belong to one word: letters or numbers of scripts that part words by blanks."""
    return all(c.isalnum() and not _BLANKLESS.match(c) for c in (a, b))


@dataclass
class Hit:
    item: int
    start: int
    length: int
    edits: int


class PassageIndex:
    """Sorted q-grams of the passages with their postings."""

    def __init__(self, items: list[tuple[int | None, str | None]], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        texts = [(i, normal(t)) for i, t in items]
        self.short: dict[str, list[int | None]] = {}
        for i, t in texts:
            if 0 < len(t) < q:
                self.short.setdefault(t, []).append(i)
        self.automaton = _automaton(self.short)
        texts = [(i, t) for i, t in texts if len(t) >= q]
        self.ids, self.texts = [i for i, _ in texts], [t for _, t in texts]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        # At least one shared q-gram must be asked for.
        self.budget = np.minimum((self.length * rate).astype(np.int64), np.maximum(0, (self.length - q) // q))
        self.bound = self.length - q + 1 - self.budget * q
        grams = [gram_hashes(codes(t), q) for t in self.texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams]).astype(np.int64)
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.gram, self.first = np.unique(flat[order], return_index=True)
        self.count = np.diff([*self.first, len(flat)]).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
        # A bitmap over 22 hash bits answers most look-ups.
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.gram >> np.uint64(42)).astype(np.int64)] = True
        # Length classes: (window in q-grams, least count) for the first filter.
        self.windows = []
        left = np.argsort(self.length, kind="stable")
        while len(left):
            own = left[self.length[left] <= self.length[left[0]] * 1.25 + 1]
            self.windows.append((int((self.length[own] + self.budget[own]).max()) - q + 1, int(self.bound[own].min())))
            left = left[len(own) :]
        self.reach = int((self.length + 3 * self.budget + 4).max()) if len(self.length) else 0

    def found(self, text: str | None) -> list[Hit]:
        """Passages of the index in ``text``."""
        t = normal(text)
        hits = self._short(t) if self.short else []
        if not len(self.gram) or len(t) < self.q:
            return hits
        best: dict[int, list[Hit]] = {}
        for at in range(0, max(1, len(t) - self.reach), CHUNK):
            for h in self._chunk(t[at : at + CHUNK + 2 * self.reach]):
                h.start += at
                known = best.setdefault(h.item, [])
                k, reach = len(known) - 1, h.length // 2 + 1
                # Hits of an item come in order but for those of a chunk's overlap, so only the last ones can be near.
                while k >= 0 and abs(known[k].start - h.start) >= reach and known[k].start > h.start - 2 * self.reach:
                    k -= 1
                if k < 0 or abs(known[k].start - h.start) >= reach:
                    known.append(h)
                elif h.edits < known[k].edits:
                    known[k] = h
        return hits + [Hit(self.ids[h.item], h.start, h.length, h.edits) for own in best.values() for h in own]

    def _short(self, t: str) -> list[Hit]:
        """Items without a q-gram, in every place where they are no part of a longer word."""
        out = []
        for last, item in self.automaton.iter(t) if self.short else ():
            start, end = last + 1 - len(item), last + 1
            if (start == 0 or not _one_word(t[start - 1], t[start])) and (end == len(t) or not _one_word(t[last], t[end])):
                out += [Hit(i, start, len(item), 0) for i in self.short[item]]
        return out

    def _chunk(self, t: str) -> list[Hit]:
        a = codes(t)
        h = gram_hashes(a, self.q)
        likely = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        where = np.searchsorted(self.gram, h[likely])
        same = self.gram[np.minimum(where, len(self.gram) - 1)] == h[likely]
        at, gram = likely[same], where[same]
        if len(at) < min(b for _, b in self.windows):
            return []
        inside = np.zeros(len(at), bool)
        for width, least in self.windows:
            # Windows that start at a shared q-gram suffice.
            good = np.flatnonzero(at[least - 1 :] - at[: max(0, len(at) - least + 1)] < width)
            if len(good):
                upto = np.searchsorted(at, at[good] + width)
                edge = np.bincount(good, minlength=len(at) + 1) - np.bincount(upto, minlength=len(at) + 1)
                inside |= np.cumsum(edge[:-1]) > 0
        if not inside.any():
            return []
        at, gram = at[inside], gram[inside]
        n = self.count[gram]
        slot = np.repeat(self.first[gram] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, diagonal = self.item[slot], np.repeat(at, n) - self.pos[slot]
        width = 2 * self.budget[item] + 1
        band = diagonal // width
        # Bands overlap by half: a q-gram counts in its own and the one before.
        key = (item << 32) + band + (1 << 30)
        key, counts = np.unique(np.concatenate((key, key - 1)), return_counts=True)
        enough = counts >= self.bound[key >> 32]
        out, last = [], None
        for one in key[enough].tolist():
            i, b = one >> 32, (one & 0xFFFFFFFF) - (1 << 30)
            w = int(2 * self.budget[i] + 1)
            lo, hi = b * w, (b + 2) * w - 1
            if last and last[0] == i and lo <= last[2] + 1:
                last[2] = hi
            else:
                last = [i, lo, hi]
                out.append(last)
        return [h for i, lo, hi in out if (h := self._verify(t, a, i, lo, hi))]

    def _verify(self, t: str, a: np.ndarray, i: int, lo: int, hi: int) -> Hit | None:
        k, own = int(self.budget[i]), self.texts[i]
        start, end = max(0, lo - k), min(len(t), hi + len(own) + 2 * k + 1)
        exact = t.find(own, start, end)
        if exact >= 0:
            return Hit(i, exact, len(own), 0)
        if not k:
            return None
        item, part = codes(own), a[start:end]
        edits, stop = banded(item, part, lo - start - k, hi - start + k)
        if edits > k:
            return None
        _, size = banded(item[::-1], part[:stop][::-1], 0, 2 * k, anchored=True)
        return Hit(i, start + stop - size, size, edits)


def banded(item: np.ndarray, part: np.ndarray, lo: int, hi: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits of ``item`` against a stretch of ``part``, and where the stretch ends.

    Cells are kept for diagonals ``lo`` to ``hi`` (column less row). The stretch
    may start anywhere, or at 0 if ``anchored`` (diagonals -hi to hi then).
    """
    if anchored:
        lo = -hi
    steps, far = np.arange(hi - lo + 1), 1 << 20
    column = steps + lo
    row = np.where((column >= 0) & (column <= len(part)), np.maximum(column, 0) if anchored else 0, far)
    for r in range(len(item)):
        column = column + 1  # of this row's cells
        inside = (column >= 1) & (column <= len(part))
        cost = np.full(len(steps), 1)
        cost[inside] = part[column[inside] - 1] != item[r]
        new = np.where(inside, row + cost, far)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((column >= 0) & (column <= len(part)), new, far)
        row = np.minimum.accumulate(new - steps) + steps
        row = np.where((column >= 0) & (column <= len(part)), row, far)
    best = int(row.argmin())
    return int(row[best]), int(column[best])


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, q: int, rate: float, block_chars: int):
    """A broadcast index for each block of the benchmark; one block while it is small."""
    chosen = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = chosen.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    sc = benchmark.sparkSession.sparkContext
    for b in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        yield sc.broadcast(PassageIndex(sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")), q, rate))


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, length, edits): benchmark passages in documents."""
    out = None
    for index in _indexes(benchmark, "item_id", "text", q, rate, block_chars):

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, h.item, h.start, h.length, h.edits) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for h in index.value.found(t)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                names = ("doc_id", "item_id", "start", "length", "edits")
                yield pd.DataFrame({n: pd.array(list(c), "Int64") for n, c in zip(names, cols, strict=True)})

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, item_id long, start long, length long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; columns unchanged."""
    at = docs.columns.index("text")
    for index in _indexes(benchmark, "item_id", "text", q, rate, block_chars):

        def run(batches, index=index):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([not index.value.found(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
