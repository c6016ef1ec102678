"""Alignment of two tokenizers' tokens, with counts of the id pairs over all documents.

A is a byte-level BPE (``tokenizers`` file), B a piece model (``sentencepiece``
file). Byte offsets where tokens of both end cut a text into groups; all pairs of
an A and a B token of one group are links; the count of an id pair is the number of
documents that hold it linked.

1. A text is parted before blanks that follow another character: no token of A or
   B crosses such a place (checked on the files, else a text is one part), so both
   tokenize each part alone and a part's tokens, groups and links are worked out once
   a worker.
2. Pairs are packed in an int64 (A id, B id). Tasks sum ``np.unique`` counts of the
   distinct pairs of their documents and give them on in runs of bounded size.
3. A global sort by range puts all partial counts of a pair next to each other; each
   range sums its runs and writes a shard of sorted keys and counts to the shared
   folder, in blocks as they come.
4. Tasks map the shards into memory and look up a batch's pairs by ``searchsorted``.
   Only the list of shards and the best count of each A id, one number a vocabulary
   entry, go through the driver.

The shared folder is ``spark.checkpoint.dir``; shards are written and read through
``pyarrow.fs`` (mapped where it is a mounted folder, read a shard at a time where it
isn't). A lost executor loses nothing: written shards stay, others are made again
under names of their own.

Defined cases: null and empty texts, and those whose joined tokens of A or B differ
from blank + text (also bytes that are no UTF-8), have no tokens: zeros and no
groups; null or repeated doc_ids are rows of their own, each row counts as a document;
an empty table gives an empty table; other columns are not read. A task holds the
distinct pairs of one document at a time; a group of many tokens (text without a
common token end) is linked by its distinct ids with their numbers, not place by place.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, work_dir, write_table

#: Parts, distinct pairs of parts and bytes of their groups beyond which a worker forgets the rare ones.
KNOWN_PARTS, KNOWN_PAIRS, KNOWN_BYTES = 400_000, 4_000_000, 1 << 26
#: Text bytes, pairs of parts and packed pairs that are worked on at a time.
BYTES_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 19
#: Characters of parts that are tokenized as one text.
CHARS_AT_ONCE = 1 << 14
#: Distinct pairs with counts that a task holds before it gives them on.
HELD = 1 << 20
#: Links of one group beyond which they are made from its distinct ids.
WIDE_GROUP = 1 << 12
B_BITS = 32
_SPACE = "▁"
#: Fixed value: how byte-level tokenizers part a text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NOT_LATIN = re.compile("[^\x00-\u024f]")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: themselves where printable, else from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places first[i] .. first[i] + size[i] - 1, one run after the other."""
    upto = np.cumsum(size)
    return np.repeat(first - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)


class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocab = _byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        b_pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(b_pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        names = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits, self.name_size = np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names], np.int64)
        self.name_first = np.cumsum(self.name_size) - self.name_size
        with open(a_path, encoding="utf-8") as file:
            made = json.load(file)
        split = made.get("pre_tokenizer") or {}
        bytewise = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not made.get("normalizer")
        self.quick = self._ranked(made) if bytewise else None
        self.parted = bytewise and not any(_SPACE in p.lstrip(_SPACE) for p in b_pieces)

    def _ranked(self, made: dict):
        """The same encoder by ranks, where ids are the order of the merges, or None."""
        import tiktoken

        merges = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        special = {x["id"] for x in made.get("added_tokens", [])}
        ids = {x: i for x, i in made["model"]["vocab"].items() if i not in special}
        first = len(ids) - len(merges)
        if first != 256 or any(ids.get(a + b) != first + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _a(self, texts: list[str]) -> list[list[int]]:
        """Ids by A. Latin text goes by ranks; of newer letters the two libraries might hold other classes."""
        other = [i for i, t in enumerate(texts) if not self.quick or _NOT_LATIN.search(t)]
        out = dict(zip(other, (e.ids for e in self.a.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)), strict=True))
        return [out[i] if i in out else self.quick.encode_ordinary(t) for i, t in enumerate(texts)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of blank + text by A, and of text by B, which adds the blank."""
        return [np.array(x, np.int64) for x in self._a([" " + t for t in texts])], [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]

    def whole(self, a: np.ndarray, b: np.ndarray, raw: bytes) -> bool:
        """Whether the bytes of both sides' tokens are the text's; those of a byte-level A without a normalizer always are."""
        same = b"".join(map(self.b_bytes.__getitem__, b.tolist())) == raw
        return same and (self.quick is not None or b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw)


def links(a: np.ndarray, b: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, packed pair, number) of the links of groups: ids of both sides, ordered by their groups ``a_of`` and ``b_of``."""
    groups = int(a_of[-1]) + 1 if len(a_of) else 0
    na, nb = np.bincount(a_of, minlength=groups), np.bincount(b_of, minlength=groups)
    a_first, b_first = np.cumsum(na) - na, np.cumsum(nb) - nb
    wide = np.flatnonzero(na * nb > WIDE_GROUP)
    own = np.ones(groups, bool)
    own[wide] = False
    tokens = np.flatnonzero(own[a_of])
    g = a_of[tokens]
    key = (np.repeat(a[tokens], nb[g]) << B_BITS) | b[expand(b_first[g], nb[g])]
    out = [(np.repeat(g, nb[g]), key, np.ones(len(key), np.int64))]
    for w in wide.tolist():
        x, xn = np.unique(a[a_first[w] : a_first[w] + na[w]], return_counts=True)
        y, yn = np.unique(b[b_first[w] : b_first[w] + nb[w]], return_counts=True)
        out.append((np.full(len(x) * len(y), w), ((x << B_BITS)[:, None] | y).ravel(), (xn[:, None] * yn).ravel()))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Codes(dict):
    """Numbers of parts; one that is asked for the first time gets the next number and is kept in ``new``."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(known or {})
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        self[part] = code = len(self)
        return code


class Parts:
    """What a worker knows of the parts of texts, as growing arrays.

    Of part i: ``n[i]`` is (A tokens, B tokens, groups, links), ``good[i]`` whether
    both tokenizers keep its bytes, ``open[i]`` whether no text may be parted after
    it, ``text[i]`` its groups in decimal ids (each with its ``;``), and its distinct pairs with their
    numbers are at ``first[i]`` .. ``first[i] + size[i]`` of ``pair`` and ``times``.
    """

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.code = Codes()
        self.text: list[bytes] = []
        self.n, self.good, self.open = np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(0, bool)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.bytes = np.zeros(0, np.int64), 0

    def full(self) -> bool:
        return len(self.text) > KNOWN_PARTS or len(self.pair) > KNOWN_PAIRS or self.bytes > KNOWN_BYTES

    def forget(self) -> None:
        """Keep what texts have held more than once, the most used half at most."""
        most = min(KNOWN_PARTS, len(self.text)) // 2
        kept = np.flatnonzero(self.used > 1)
        kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[:most]])
        room = (np.cumsum(self.size[kept]) <= KNOWN_PAIRS // 2) & (np.cumsum([len(self.text[i]) for i in kept.tolist()]) <= KNOWN_BYTES // 2)
        kept = kept[room]
        names, at = list(self.code), expand(self.first[kept], self.size[kept])
        self.code = Codes({names[i]: k for k, i in enumerate(kept.tolist())})
        self.text = [self.text[i] for i in kept.tolist()]
        self.n, self.good, self.open, self.size = self.n[kept], self.good[kept], self.open[kept], self.size[kept]
        self.pair, self.times, self.first = self.pair[at], self.times[at], np.cumsum(self.size) - self.size
        self.used, self.bytes = np.zeros(len(kept), np.int64), sum(map(len, self.text))

    def _tokens(self, parts: list[str], opens: list[bool]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[bool]]]:
        """(A ids, B ids, bytes, good) of runs of parts, the bytes of bad ones counted as none.

        Parts are tokenized joined, which no token crosses; a run whose tokens do,
        or lose bytes, is tokenized part by part.
        """
        t, at = self.tokenizers, 0
        runs = []
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size < CHARS_AT_ONCE and t.parted and not opens[end - 1]):
                size += len(parts[end]) + 1
                end += 1
            runs.append(parts[at:end])
            at = end
        for run, a, b in zip(runs, *t.encode([" ".join(run) for run in runs]), strict=True):
            raw = [(" " + p).encode("utf-8", "replace") for p in run]
            size = [len(r) for r in raw]
            ends = np.cumsum(size)
            if t.whole(a, b, b"".join(raw)) and all(np.isin(ends, np.cumsum(n[x]), assume_unique=True).all() for n, x in ((t.a_size, a), (t.b_size, b))):
                yield a, b, size, [True] * len(run)
                continue
            one = list(zip(*t.encode(run), strict=True))
            good = [t.whole(x, y, r) for (x, y), r in zip(one, raw, strict=True)]
            none = [np.zeros(0, np.int64)]
            a, b = (np.concatenate(none + [x[k] for x, g in zip(one, good, strict=True) if g]) for k in (0, 1))
            yield a, b, [n if g else 0 for n, g in zip(size, good, strict=True)], good

    def coded(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The numbers of lists of parts; new ones are learned."""
        get = self.code.__getitem__
        out = [np.fromiter(map(get, own), np.int64, len(own)) for own in lists]
        if self.code.new:
            self._learn(self.code.new)
            self.code.new = []
        return out

    def _learn(self, parts: list[str]) -> None:
        """Tokenize and align new parts, all at a time, in the order of their numbers."""
        t = self.tokenizers
        opens = [not p or p[-1].isspace() for p in parts]
        a, b, size, good = zip(*self._tokens(parts, opens), strict=True)
        a, b, good = np.concatenate(a), np.concatenate(b), np.array([g for own in good for g in own])
        base = np.cumsum([0, *(n for own in size for n in own)])
        a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        # Bytes of good parts follow each other, so ends of tokens are places in all of them together.
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        a_of, b_of = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        part = np.searchsorted(base, both) - 1  # of each group
        group, pair, times = links(a, b, a_of, b_of)
        own = part[group]
        order = np.lexsort((pair, own))
        own, pair, times = own[order], pair[order], times[order]
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (pair[1:] != pair[:-1]))) if len(own) else np.zeros(0, np.int64)
        times = np.add.reduceat(times, new) if len(new) else times
        own, pair = own[new], pair[new]
        n = len(parts)
        counts = [np.bincount(x, minlength=n) for x in (part[a_of], part[b_of], part)]
        size, total = np.bincount(own, minlength=n), np.bincount(own, times, n).astype(np.int64)
        self.first = np.concatenate((self.first, len(self.pair) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.pair, self.times = np.concatenate((self.pair, pair)), np.concatenate((self.times, times))
        self.n = np.concatenate((self.n, np.stack((*counts, total), 1)))
        self.good = np.concatenate((self.good, good))
        self.open = np.concatenate((self.open, np.array(opens)))
        self.used = np.concatenate((self.used, np.zeros(n, np.int64)))
        self.text += self._texts(n, part, a, b, a_of, b_of)
        self.bytes += sum(map(len, self.text[-n:]))

    def _texts(self, n: int, part: np.ndarray, a, b, a_of, b_of) -> list[bytes]:
        """The groups of each part, in decimal ids, each with its ``;``."""
        t, groups = self.tokenizers, np.arange(len(part) + 1)
        a_at, b_at = np.searchsorted(a_of, groups), np.searchsorted(b_of, groups)
        # Every id is followed by one mark: A's by the last of its group's |, B's by ;.
        a_place, b_place = np.arange(len(a)) + b_at[a_of], np.arange(len(b)) + a_at[b_of + 1]
        name, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        name[a_place], name[b_place] = a, b
        mark[a_place[a_at[1:] - 1]], mark[b_place[b_at[1:] - 1]] = ord("|"), ord(";")
        size = t.name_size[name]
        end = np.cumsum(size + 1)
        out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
        out[expand(end - size - 1, size)] = t.digits[expand(t.name_first[name], size)]
        out[end - 1] = mark
        upto = np.append(0, end)[(a_at + b_at)[np.searchsorted(part, np.arange(n + 1))]].tolist()
        raw = out.tobytes()
        return [raw[i:j] for i, j in zip(upto, upto[1:], strict=False)]


def _words(text: str) -> list[str]:
    """Parts of blank + text, each without its first blank, which follows a character that is no white space."""
    out, now = [], None
    for word in text.split(" "):
        if now is None:
            now = word
        elif not now or now[-1].isspace():
            now += " " + word
        else:
            out.append(now)
            now = word
    if not now and out:  # a single blank at the end is no part: B would not see it
        out[-1] += " "
    else:
        out.append(now)
    return out


@dataclass
class Batch:
    """The parts of some texts: ``code`` of all in order, ``doc`` the row of each."""

    rows: int
    code: np.ndarray
    doc: np.ndarray


def batches(texts: list[bytes | None], parts: Parts) -> Iterator[tuple[int, Batch]]:
    """(first row, parts) of texts, some at a time; rows without tokens have no parts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= BYTES_AT_ONCE):
            size += len(texts[end] or b"")
            end += 1
        yield at, _batch(texts[at:end], parts)
        at = end


def _batch(texts: list[bytes | None], parts: Parts) -> Batch:
    own: list[list[str]] = []
    for raw in texts:
        try:
            text = (raw or b"").decode()
        except UnicodeDecodeError:
            text = ""
        own.append([] if not text else text.split(" ") if parts.tokenizers.parted else [text])
    if parts.full():
        parts.forget()

    codes = parts.coded(own)
    again = [i for i, c in enumerate(codes) if parts.tokenizers.parted and parts.open[c].any()]
    for i, c in zip(again, parts.coded([_words(texts[i].decode()) for i in again]), strict=True):
        codes[i] = c
    codes = [c if parts.good[c].all() else c[:0] for c in codes]
    doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    parts.used += np.bincount(code, minlength=len(parts.used))
    return Batch(len(codes), code, doc)


def weighted(batch: Batch, parts: Parts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, packed pair, links) of a batch, whole rows at a time; a pair comes again with each distinct part that holds it."""
    rows, n = np.unique((batch.doc << 32) | batch.code, return_counts=True)
    doc, code = rows >> 32, rows & 0xFFFFFFFF
    size = parts.size[code]
    run = np.cumsum(np.bincount(doc, size, batch.rows))[doc] // PAIRS_AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
    for i, j in zip(edges, edges[1:], strict=False):
        if i < j:
            at = expand(parts.first[code[i:j]], size[i:j])
            yield np.repeat(doc[i:j], size[i:j]), parts.pair[at], parts.times[at] * np.repeat(n[i:j], size[i:j])


_loaded: dict[tuple[str, str], Parts] = {}


def known(a_path: str, b_path: str) -> Parts:
    """The worker's own :class:`Parts`, kept from task to task."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Parts(Tokenizers(a_path, b_path))
    return _loaded[a_path, b_path]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def partial_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): documents of a task that hold a packed pair; one to a few rows a task and pair."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, size = known(a_path, b_path), [], 0

        def out(keys, counts):
            for i in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(counts[i : i + (1 << 16)])], names=["pair", "n"])

        for batch in given:
            for _, own in batches(batch.column(0).to_pylist(), parts):
                for doc, pair, _ in weighted(own, parts):
                    keys, at = np.unique(pair, return_inverse=True)
                    both = np.unique(doc * len(keys) + at) % max(1, len(keys))  # a document counts once
                    held.append((keys, np.bincount(both, minlength=len(keys))))
                    size += len(keys)
                    if size > HELD:
                        held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield from out(*held[0])
                            held, size = [], 0
        if held:
            yield from out(*summed(*map(np.concatenate, zip(*held, strict=True))))

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "pair long, n long")


def _runs(given: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and the sums of their runs, of sorted (pair, n) batches; a run may go on in the next batch."""
    last: tuple[np.ndarray, np.ndarray] | None = None
    for batch in given:
        keys, counts = (np.asarray(batch.column(i)) for i in (0, 1))
        if last is not None:
            keys, counts = np.concatenate((last[0], keys)), np.concatenate((last[1], counts))
        keys, counts = summed(keys, counts)
        if len(keys):
            last = keys[-1:], counts[-1:]
            yield keys[:-1], counts[:-1]
    if last is not None:
        yield last


def _sorted(partial: DataFrame) -> DataFrame:
    """Partial counts dealt by ranges of the pair and sorted: a global sort.

    ``partial`` is read twice, for the bounds of the ranges and for its rows: give a written table.
    """
    ranges = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partial.repartitionByRange(ranges, "pair").sortWithinPartitions("pair")


def sorted_counts(partial: DataFrame) -> DataFrame:
    """(pair, n) of the whole corpus, sorted by pair over all partitions: the sums of runs of partial counts."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _runs(given):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "n"])

    return _sorted(partial).mapInArrow(run, "pair long, n long")


def vocabulary(a_path: str) -> int:
    """One more than the largest id of A."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(a_path).get_vocab().values()) + 1


def unpacked(counts: DataFrame) -> DataFrame:
    """(a, b, n): the ids of packed pairs."""
    return counts.select(F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b"), "n")


@dataclass
class Shards:
    """Where the sorted counts are, the first key of each, and the best count of every A id."""

    files: list[tuple[str, str, int]]
    firsts: np.ndarray
    best: np.ndarray
    _open: dict[int, tuple[np.ndarray, np.ndarray]] | None = None

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        self._open = self._open or {}
        if i not in self._open:
            keys, counts, n = self.files[i]
            store, path = fs.FileSystem.from_uri(keys)
            if isinstance(store, fs.LocalFileSystem):
                paths = [path, fs.FileSystem.from_uri(counts)[1]]
                return self._open.setdefault(i, tuple(np.memmap(p, np.int64, "r", shape=(n,)) for p in paths))
            self._open = {i: tuple(np.frombuffer(_read(uri), np.int64) for uri in (keys, counts))}
        return self._open[i]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted distinct keys, 0 for those that no document holds."""
        out = np.zeros(len(keys), np.int64)
        shard = np.searchsorted(self.firsts, keys, "right") - 1
        for i in np.unique(shard[shard >= 0]).tolist():
            at = slice(*np.searchsorted(shard, [i, i + 1]))
            own, counts = self._shard(i)
            place = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
            out[at] = np.where(own[place] == keys[at], counts[place], 0)
        return out


def _read(uri: str) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as file:
        return file.read()


def write_shards(partial: DataFrame, a_ids: int) -> Shards:
    """Sort and sum partial counts, and write each range as a shard of raw int64 in the shared folder; an A id is below ``a_ids``."""
    spark = partial.sparkSession
    folder = f"{work_dir(spark)}/marginalia/pair-shards-{uuid.uuid4().hex}"

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        name = uuid.uuid4().hex  # a repeated attempt writes files of its own
        n, first, best = 0, None, np.zeros(a_ids, np.int64)
        with store.open_output_stream(f"{path}/{name}.keys") as keys_to, store.open_output_stream(f"{path}/{name}.counts") as counts_to:
            for keys, own in _runs(given):
                if not len(keys):
                    continue
                first = int(keys[0]) if first is None else first
                keys_to.write(keys.tobytes())
                counts_to.write(own.tobytes())
                np.maximum.at(best, keys >> B_BITS, own)
                n += len(keys)
        if n:
            used = np.flatnonzero(best)
            row = {"keys": [f"{folder}/{name}.keys"], "counts": [f"{folder}/{name}.counts"], "n": [n], "first": [first], "a": [used.tobytes()], "best": [best[used].tobytes()]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("keys", pa.string()), ("counts", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("a", pa.binary()), ("best", pa.binary())]))

    # One row a range; the A ids of all ranges together are the vocabulary and one more a range.
    made = sorted(_sorted(partial).mapInArrow(run, "keys string, counts string, n long, first long, a binary, best binary").collect(), key=lambda r: r["first"])
    best = np.zeros(a_ids, np.int64)
    for r in made:
        np.maximum.at(best, np.frombuffer(r["a"], np.int64), np.frombuffer(r["best"], np.int64))
    return Shards([(r["keys"], r["counts"], r["n"]) for r in made], np.array([r["first"] for r in made], np.int64), best)


def score(docs: DataFrame, shards: Shards, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(shards)  # paths, and a number a vocabulary entry
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shards = known(a_path, b_path), shared.value
        for batch in given:
            for at, own in batches(batch.column(1).to_pylist(), parts):
                sums = np.zeros((own.rows, 6), np.int64)
                if len(own.code):
                    starts = np.flatnonzero(np.append(True, own.doc[1:] != own.doc[:-1]))
                    sums[own.doc[starts], :4] = np.add.reduceat(parts.n[own.code], starts)
                for doc, pair, times in weighted(own, parts):
                    keys, back = np.unique(pair, return_inverse=True)
                    count = shards.find(keys)
                    top = count == shards.best[keys >> B_BITS]
                    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    sums[doc[starts], 4] += np.add.reduceat(times * top[back], starts)
                    sums[doc[starts], 5] += np.add.reduceat(times * count[back], starts)
                bounds = np.searchsorted(own.doc, np.arange(own.rows + 1)).tolist()
                code, text = own.code.tolist(), parts.text
                groups = [b"".join([text[c] for c in code[i:j]])[:-1].decode() for i, j in zip(bounds, bounds[1:], strict=False)]
                columns = [batch.column(0).slice(at, own.rows), *(pa.array(sums[:, k]) for k in range(6)), pa.array(groups, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "groups"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{n} long' for n in names)}, groups string")


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(a, b, n): the documents that hold each pair of ids linked."""
    path = write_table(partial_counts(docs, a_path, b_path), "pair-counts")
    return unpacked(sorted_counts(docs.sparkSession.read.parquet(path)))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment, links and their corpus counts of each document; see :func:`score`."""
    spark = docs.sparkSession
    path = write_table(partial_counts(docs, a_path, b_path), "pair-counts")
    shards = write_shards(spark.read.parquet(path), vocabulary(a_path))
    drop_table(spark, path)
    return score(docs, shards, a_path, b_path)
