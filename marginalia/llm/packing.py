"""Best-fit packing by a configuration linear program over piece lengths.

1. Executors turn texts into pieces of at most ``capacity`` tokens.
2. The histogram of piece lengths (``capacity`` entries at most, whatever the
   corpus) goes to the driver, where multiplicative weights price the lengths,
   an unbounded knapsack dynamic program finds the best configuration around
   each length, and the fractional counts are rounded to whole sequences.
3. Each piece has its rank among the pieces of its length that its task cut, and
   the counts of earlier tasks before it; that rank picks the sequence and the
   offset from the rounded plan. Counts travel, no piece is sorted to be ranked.

Every round of the linear program gives a lower bound on the sequences (its
prices, scaled so that no configuration is worth more than 1, are feasible for
the dual). Rounds end once the rounded plan is within ``GAP`` of the best bound.

Defined cases: a null text is empty (one closing token); null or repeated
doc_ids are packed row by row; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, settle

CAPACITY, END_ID = 4096, 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Parts that a worker keeps the ids of, and slots of their hash table (a power of two).
KNOWN_PARTS, SLOT_BITS, KNOWN_IDS = 450_000, 20, 1 << 23
CHARS_AT_ONCE = 400_000
#: Rounds of the linear program at most, how fast prices move, and the gap to the bound that ends it.
ROUNDS, RATE, GAP = 256, 0.1, 0.002
#: A configuration worth less than the best one by this share counts e times less in a round.
SOFT = 0.01
_WORDS = re.compile("[^ \t\n\r\x0b\x0c]+")
#: Python's split() takes these for white space, the pre-tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_BYTES, SHORT, _MIX = 8, 23, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def _classes() -> np.ndarray:
    """The pre-tokenizer's class of each lower-cased Latin-1 character."""
    out = np.full(256, _OTHER, np.uint8)
    for c in range(256):
        kind = unicodedata.category(chr(c))[0]
        if chr(c) in "\t\n\x0b\x0c\r \x85\xa0":
            out[c] = _SPACE
        elif kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
    return out


_CLASS = _classes()


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of lower-cased Latin-1 bytes.

    Runs of letters, single numbers, runs of anything else, and contractions
    ('s 't 'm 'd 're 've 'll) where such a run starts with their apostrophe.
    """
    kind = _CLASS[raw]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    start = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
    at = np.flatnonzero((raw == 39) & start)
    if len(at):
        one, two = (raw[np.minimum(at + i, len(raw) - 1)] * (at + i < len(raw)) for i in (1, 2))
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = one.astype(np.uint16) * 256 + two
        long = np.isin(pair, [256 * x[0] + x[1] for x in (b"re", b"ve", b"ll")])
        for found, size in ((short, 2), (long, 3)):
            p = at[found]
            start[p + 1] = False
            rest = p[p + size < len(raw)] + size
            start[rest[kind[rest] == _LETTER]] = True
    edge = np.flatnonzero(start | ((kind == _SPACE) & (before != _SPACE)))
    ends = np.append(edge[1:], len(raw))
    own = start[edge]
    return edge[own], ends[own]


class IdTable:
    """An exact hash table from parts to their ids, in numpy.

    Parts of at most 23 bytes are three words, with the length in the last byte;
    longer ones, which are few, are in a dictionary.
    """

    def __init__(self):
        size = 1 << SLOT_BITS
        self.keys, self.entry = np.zeros((3, size), np.uint64), np.full(size, -1, np.int32)
        self.first, self.size, self.ids = np.zeros(KNOWN_PARTS, np.int64), np.zeros(KNOWN_PARTS, np.int64), np.zeros(1 << 20, "<u4")
        self.long: dict[bytes, int] = {}
        self.n = self.used = 0

    def slots(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0] * np.uint64(_MIX[0])
        for k, m in ((keys[1], _MIX[1]), (keys[2], _MIX[2])):
            h = (h ^ (h >> np.uint64(32))) + k * np.uint64(m)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[3])
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The entry of each key, -1 where it has none."""
        out, todo, slot = np.full(len(keys[0]), -1, np.int64), np.arange(len(keys[0])), self.slots(keys)
        while len(todo):
            got = self.entry[slot]
            same = got >= 0
            for mine, own in zip(self.keys, keys, strict=True):
                same &= mine[slot] == own[todo]
            out[todo[same]] = got[same]
            on = (got >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def add(self, parts: list[bytes], ids: list[bytes]) -> None:
        """Enter new parts with their ids."""
        entries = np.arange(self.n, self.n + len(parts))
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.array([len(x) // 4 for x in ids], np.int64)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), "<u4")))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[entries], self.first[entries] = size, self.used + np.cumsum(size) - size
        self.n, self.used = self.n + len(parts), self.used + len(flat)
        short = [i for i, p in enumerate(parts) if len(p) <= SHORT]
        self.long.update((p, int(e)) for p, e in zip(parts, entries, strict=True) if len(p) > SHORT)
        own = np.frombuffer(b"".join(parts[i].ljust(SHORT, b"\0") + bytes([len(parts[i])]) for i in short), "<u8").reshape(-1, 3).T
        keys, entries = [np.ascontiguousarray(k) for k in own], entries[short]
        slot, todo = self.slots(keys), np.arange(len(short))
        while len(todo):
            free = todo[self.entry[slot[todo]] < 0]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.entry[slot[put]] = entries[put]
            for mine, k in zip(self.keys, keys, strict=True):
                mine[slot[put]] = k[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)


class WordIds:
    """Ids of texts as little-endian bytes, each distinct part tokenized once.

    The ids of a text are those of its pre-tokens in order. In Latin-1 texts,
    where the normaliser only lower-cases, numpy finds the pre-tokens of many
    texts at a time and looks their ids up; in others white space, which no
    token crosses, parts the words.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.table = Tokenizer.from_file(path), IdTable()
        self.words: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def plain(self, words: list[str]) -> list[bytes]:
        """Ids of each of ``words`` by the tokenizer itself."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def runs(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: encoded together, cut where a word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4") if words else np.zeros(0, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1) * 4
        if len(ends) != len(words):
            return self.plain(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, parts: list[bytes]) -> None:
        letters = [p for p in parts if _CLASS[p[0]] == _LETTER]
        rest = [p for p in parts if _CLASS[p[0]] != _LETTER]
        for i in range(0, len(letters), 2000):
            own = letters[i : i + 2000]
            self.table.add(own, self.runs([p.decode("latin-1") for p in own]))
        self.table.add(rest, self.plain([p.decode("latin-1") for p in rest]))

    def _entries(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entry of each part of ``raw``, learned where it is new."""
        size = ends - starts
        eights = np.ndarray((len(raw) + 3 * _BYTES,), "<u8", raw + b"\0" * 4 * _BYTES, 0, (1,))
        keys = [eights[starts + _BYTES * i] & _MASKS[np.clip(size - _BYTES * i, 0, _BYTES)] for i in range(3)]
        keys[2] = (keys[2] & _MASKS[_BYTES - 1]) | (np.minimum(size, SHORT + 1).astype(np.uint64) << np.uint64(56))
        out = self.table.find(keys)
        far = np.flatnonzero(size > SHORT)
        for i in far.tolist():
            out[i] = self.table.long.get(raw[starts[i] : ends[i]], -1)
        new = np.flatnonzero(out < 0)
        if len(new):
            parts = [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            distinct = sorted(set(parts))
            if self.table.n + len(distinct) > KNOWN_PARTS or self.table.used > KNOWN_IDS:
                self.table = IdTable()
                if len(distinct) < len(size):  # what was known is gone, too
                    return self._entries(raw, starts, ends)
            known = {p: self.table.n + i for i, p in enumerate([p for p in distinct if _CLASS[p[0]] == _LETTER] + [p for p in distinct if _CLASS[p[0]] != _LETTER])}
            self.learn(distinct)
            out[new] = [known[p] for p in parts]
        return out

    def _latin(self, texts: list[str]) -> list[bytes]:
        """Ids of Latin-1 texts; at most ``KNOWN_PARTS`` characters go at a time."""
        raw = "\n".join(texts).lower().encode("latin-1")
        starts, ends = spans(np.frombuffer(raw, np.uint8))
        pieces, step = [np.zeros(0, "<u4")], KNOWN_PARTS // 2
        count = np.zeros(len(starts) + 1, np.int64)
        for i in range(0, len(starts), step):
            entry = self._entries(raw, starts[i : i + step], ends[i : i + step])
            size, first = self.table.size[entry], self.table.first[entry]
            upto = np.cumsum(size)
            count[i + 1 : i + 1 + len(size)] = count[i] + upto
            pieces.append(self.table.ids[np.repeat(first - upto + size, size) + np.arange(int(upto[-1]))])
        ids = np.concatenate(pieces)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at = count[np.searchsorted(starts, bounds)]
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _any(self, text: str) -> bytes:
        words = _WORDS.findall(text) if _ODD.search(text) else text.split()
        new = sorted(set(words) - self.words.keys())
        if len(self.words) + len(new) > KNOWN_PARTS:
            self.words, new = {}, sorted(set(words))
        self.words.update(zip(new, self.plain(new), strict=True))
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        latin = []
        for i, t in enumerate(texts):
            if "<|" not in t and (t.isascii() or _is_latin(t)):
                latin.append(i)
            else:
                out[i] = self._any(t)
        for i, ids in zip(latin, self._latin([texts[i] for i in latin]), strict=True):
            out[i] = ids
        return out


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own :class:`WordIds`, kept from task to task."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids_crc32, part, rank).

    ``part`` is the task that cut the piece and ``rank`` counts the pieces of this
    length that it had cut before. They hold once the rows are written.
    """
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = word_ids(tokenizer), np.array([END_ID], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for pdf in batches:
            out = []
            texts = [t or "" for t in pdf["text"]]
            run = np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE
            for i in np.unique(run):
                at = np.flatnonzero(run == i)
                for doc, ids in zip(pdf["doc_id"].iloc[at], words.encode(texts[at[0] : at[-1] + 1]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        out.append((doc, k, at // 4, n, zlib.crc32(own), seen[n]))
                        seen[n] += 1
            cols = list(zip(*out, strict=True)) or [()] * len(columns)
            made = pd.DataFrame({n: list(c) for n, c in zip(columns, cols, strict=True)}).assign(part=part)
            yield made.astype({"doc_id": "Int64", "piece": "int32", **dict.fromkeys((*columns[2:], "part"), "int64")})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, f"{PIECES}, rank long, part long")


def best_values(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each room, and the length taken first there."""
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for room in range(1, capacity + 1):
        n = np.searchsorted(lengths, room, "right")
        best[room] = best[room - 1]
        first[room] = -2  # one token of room unused
        if n:
            value = best[room - lengths[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], first[room] = value[k], k
    return best, first


def fillings(lengths: np.ndarray, first: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, item, times): around each length the best filling of the rest, by seed and item."""
    rooms = np.arange(capacity + 1)
    used = np.maximum.accumulate(np.where(first == -2, 0, rooms))  # where a room's unused tokens end
    used[first[used] < 0] = 0
    seed = np.arange(len(lengths))
    room, found = used[capacity - lengths], [seed * len(lengths) + seed]
    while len(seed):
        seed, room = seed[room > 0], room[room > 0]
        found.append(seed * len(lengths) + first[room])
        room = used[room - lengths[first[room]]]
    key, times = np.unique(np.concatenate(found), return_counts=True)
    return key // len(lengths), key % len(lengths), times


def rounded(share: dict[tuple, float], lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole sequences from fractional ones: their whole parts, full ones as often as they go, the rest by best fit."""
    left, plan = counts.astype(np.int64).copy(), []

    def take(own: dict[int, int], most: int) -> None:
        n = min([most, *(int(left[i]) // a for i, a in own.items())])
        if n > 0:
            for i, a in own.items():
                left[i] -= n * a
            plan.append((own, n))

    for key in sorted(share, key=lambda key: (-share[key], key)):
        take(dict(key), int(share[key]))
    full = {key: sum(a * int(lengths[i]) for i, a in key) for key in share}
    for key in sorted(share, key=lambda key: (-key[0][0], -full[key], key)):
        if full[key] >= capacity - capacity // 512:
            take(dict(key), int(left.max()))
    while left.any():
        top, room, own = int(np.flatnonzero(left)[-1]), capacity, {}
        used = np.zeros(len(lengths), np.int64)
        k = top
        while k >= 0:
            own[k] = own.get(k, 0) + 1
            used[k] += 1
            room -= int(lengths[k])
            fits = np.flatnonzero((left - used > 0) & (lengths <= room))
            k = int(fits[-1]) if len(fits) else -1
        take(own, int(left[top]))
    return plan


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE, gap: float = GAP) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations ({length index: times}, sequences) that use up ``counts`` exactly, and a lower bound.

    ``lengths`` ascend. Each round prices every room by the dynamic program and
    takes the best filling around each length, weighted by how little its worth
    is below the best one. Prices of lengths that these cover more than once are
    multiplied down, others up. Any prices over the worth of the best filling are
    feasible for the dual and give a lower bound. After 1, 2, 4, ... rounds the
    mean of the rounds since the last time is rounded; the best plan so far is
    final once it is within ``gap`` of the bound.
    """
    m, n = len(lengths), counts.astype(float)
    prices, share, since = lengths / capacity, {}, 0
    least, plan, size = 1, [], None
    for done in range(1, rounds + 1):
        best, first = best_values(lengths, prices, capacity)
        worth = best[capacity]
        least = max(least, int(np.ceil(float(n @ prices) / worth - 1e-6)))
        seed, item, times = fillings(lengths, first, capacity)
        value = np.bincount(seed, times * prices[item], m) / worth
        weight = np.exp(-np.minimum((1 - value) / SOFT, 50)) * n / times[seed == item]
        weight *= least / weight.sum()
        cover = np.bincount(item, times * weight[seed], m) / n
        prices = prices * np.exp(rate * (1 - np.minimum(cover, 3)) / (1 + done / 16))
        edges = np.searchsorted(seed, np.arange(m + 1))
        for k in np.flatnonzero(weight > 1e-6).tolist():
            own = slice(edges[k], edges[k + 1])
            key = tuple(zip(item[own][::-1].tolist(), times[own][::-1].tolist(), strict=True))
            share[key] = share.get(key, 0.0) + float(weight[k])
        if done & (done - 1) == 0 or done == rounds:
            made = rounded({key: x / (done - since) for key, x in share.items()}, lengths, counts, capacity)
            share, since = {}, done
            now = sum(x for _, x in made)
            if size is None or now < size:
                plan, size = made, now
            if size <= least * (1 + gap):
                break
    return plan, least


def segments(lengths: np.ndarray, plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces a sequence, first offset) in rank order."""
    ranks, out, base = np.zeros(len(lengths), np.int64), {}, 0
    for own, n in plan:
        offset = 0
        for i in sorted(own, reverse=True):
            out.setdefault(int(lengths[i]), []).append((int(ranks[i]), base, own[i], offset))
            ranks[i] += n * own[i]
            offset += own[i] * int(lengths[i])
        base += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of ``docs`` with their sequence_id and gapless offset."""
    spark = docs.sparkSession
    with batches_of(spark, 1000):
        cut = settle(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # A row a task: a length that a third of all pieces share has no more.
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = sizes.select("length", "part", earlier.alias("before"))
    rows = sizes.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # one row a length, capacity at most
    lengths, counts = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    # Rows for each length in each configuration of the plan, whatever the corpus.
    shared = spark.sparkContext.broadcast(segments(lengths, solve(lengths, counts, capacity)[0] if len(rows) else [], capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table, seq, off = shared.value, np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        own_length, own_rank = length.to_numpy(), rank.to_numpy()
        for one in np.unique(own_length):
            at, rows = own_length == one, table[int(one)]
            r = own_rank[at]
            s = rows[np.searchsorted(rows[:, 0], r, "right") - 1]
            seq[at] = s[:, 1] + (r - s[:, 0]) // s[:, 2]
            off[at] = s[:, 3] + (r - s[:, 0]) % s[:, 2] * one
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = cut.join(before, ["length", "part"]).withColumn("place", place("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
