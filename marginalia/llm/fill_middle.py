"""Fill-in-the-middle: documents cut in three, reordered around sentinels.

A numpy kernel works on the UTF-8 buffer of a whole Arrow batch. A lookup gives
each byte its class, the classes of adjacent bytes tell where a unit starts
(``char``: a code point; ``word``: a run of other characters with the white space
after it; ``line``: up to and with a line feed; white space is ASCII), every
document starts one, cumulative sums number the units, and searches in the sums
find both cuts of all documents together. A window of ``WINDOW`` bytes goes
through it at a time, with the sum so far carried on, so one very long text
takes no more than many short ones.

Two hashes of the seed and doc_id pick the cuts, a third whether the document
stays plain, a fourth its order. Texts that hold a sentinel stay plain, so that
:func:`restored` gives every text back.

Defined cases: null text is empty; an empty text is plain with no units; a null
doc_id hashes as the empty string; rows that share a doc_id are cut by the same
hashes, each in its own text; bytes that are no UTF-8 count as units unless they
continue one and are kept in the output (:func:`restored` gives U+FFFD for them,
as Spark's string functions do); an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Percent of the documents that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
WINDOW = 1 << 22
#: Bytes of text that are reordered before their rows are given on.
BYTES_AT_ONCE = 1 << 24
_CONTINUES, _SPACE, _LINE, _OTHER = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[0x80:0xC0] = _CONTINUES
    out[[9, 11, 12, 13, 32]] = _SPACE
    out[10] = _LINE
    return out


def _starts(rule) -> np.ndarray:
    return np.array([rule(a, b) for a in range(4) for b in range(4)])


_CLASS = _classes()
#: For each kind of unit, whether one starts at a byte: by 4 * (class of the byte before) + (its own class).
UNITS = {
    "char": _starts(lambda a, b: b != _CONTINUES),
    "word": _starts(lambda a, b: a in (_SPACE, _LINE) and b == _OTHER),
    "line": _starts(lambda a, b: a == _LINE),
}


def _sums(raw: np.ndarray, offsets: np.ndarray, unit: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, units that started before it, running counts of starts) of each window."""
    before, table = 0, UNITS[unit]
    for at in range(0, len(raw), WINDOW):
        kind = _CLASS[raw[at : at + WINDOW]]
        prior = np.empty_like(kind)
        prior[0], prior[1:] = (_CLASS[raw[at - 1]] if at else _OTHER), kind[:-1]
        mask = table[(prior << 2) | kind]
        mask[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + len(kind))] - at] = True
        sums = np.cumsum(mask, dtype=np.int32)
        yield at, before, sums
        before += int(sums[-1])


def count_units(raw: np.ndarray, offsets: np.ndarray, unit: str = "char") -> np.ndarray:
    """Units that start before each offset; a document has the difference of its two."""
    out = np.zeros(len(offsets), np.int64)
    for at, before, sums in _sums(raw, offsets, unit):
        own = slice(np.searchsorted(offsets, at, "right"), np.searchsorted(offsets, at + len(sums), "right"))
        out[own] = before + sums[offsets[own] - at - 1]
    return out


def find_units(raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, unit: str = "char") -> np.ndarray:
    """The byte where each wanted unit (counted over all documents) starts; the end for those beyond the last."""
    order = np.argsort(wanted, kind="stable")
    sought, out = wanted[order], np.full(len(wanted), len(raw), np.int64)
    for at, before, sums in _sums(raw, offsets, unit):
        own = slice(*np.searchsorted(sought, [before, before + int(sums[-1])]))
        out[order[own]] = at + np.searchsorted(sums, sought[own] - before + 1)
    return out


def cuts(raw: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "char") -> tuple[np.ndarray, ...]:
    """(units, prefix units, middle units, first cut, second cut) of every document; cuts are bytes of ``raw``."""
    first = count_units(raw, offsets, unit)
    n = np.diff(first)
    one, two = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    at = find_units(raw, offsets, np.concatenate((first[:-1] + low, first[:-1] + high)), unit)
    # A cut after the last unit is the end of the document, not the start of the next one that has any.
    at = np.minimum(at, np.tile(offsets[1:], 2))
    return n, low, high - low, at[: len(n)], at[len(n) :]


def _group(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def _column(values, kind: pa.DataType, hidden: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, kind, mask=hidden)


def _reorder(batch: pa.RecordBatch, unit: str, plain: int, suffix_first: int) -> pa.RecordBatch:
    doc, text, has, *h = (batch.column(i) for i in range(7))
    buffers = text.buffers()
    bounds = np.frombuffer(buffers[1], np.int64 if pa.types.is_large_binary(text.type) else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = memoryview(buffers[2] or b"")[bounds[0] : bounds[-1]]
    offsets = bounds - bounds[0]
    h1, h2, h3, h4 = (np.asarray(x) for x in h)
    n, low, middle, a, b = cuts(np.frombuffer(data, np.uint8), offsets, h1, h2, unit)
    form = np.where((n == 0) | np.asarray(has) | (h3 % 100 >= 100 - plain), 0, np.where(h4 % 100 < suffix_first, 2, 1))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for kind, start, x, y, end in zip(form.tolist(), offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True):
        if kind == 0:
            out.append(data[start:end])
        elif kind == 1:
            out.append(b"".join((p, data[start:x], s, data[y:end], m, data[x:y])))
        else:
            out.append(b"".join((s, data[y:end], p, data[start:x], m, data[x:y])))
    sizes = np.cumsum([0, *map(len, out)])
    made = pa.Array.from_buffers(pa.large_binary(), len(out), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(b"".join(out))])
    names = pa.array(["plain", "psm", "spm"]).take(pa.array(form))
    columns = [doc, _column(n, pa.int64()), names, _column(low, pa.int64(), form == 0), _column(middle, pa.int64(), form == 0), made.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])


def transform(docs: DataFrame, unit: str = "char", seed: str = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of each document.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle); the counts are null for plain ones.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}, not {unit!r}")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), holds.alias("holds"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", "holds", *(_group(F.col("digest"), i).alias(f"h{i + 1}") for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(np.asarray(pc.binary_length(batch.column(1))), dtype=np.int64) // BYTES_AT_ONCE
            ends = [*(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
            for at, end in zip([0, *ends[:-1]], ends, strict=True):
                yield _reorder(batch.slice(at, end - at), unit, plain, suffix_first)

    made = rows.mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that a form's output was made of.

    No sentinel overlaps itself and none is in a text that was reordered, so the
    first place where each one is found is its own.
    """
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    a, after = F.split_part(rest, second, F.lit(1)), F.split_part(rest, second, F.lit(2))
    b, middle = (F.split_part(after, F.lit(MIDDLE), F.lit(i)) for i in (1, 2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))


#: The rows of the query in DuckDB.
OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), h AS (
  SELECT doc_id, t, length(t)::BIGINT AS n,
         ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2,
         ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
