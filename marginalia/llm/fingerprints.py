"""Document fingerprints: invertible Bloom lookup sketches, DataFrame functions only.

A text's fingerprint holds its distinct paragraphs as 64-bit digests in
``CELLS`` cells. A paragraph is a line, or a piece of a longer one: from LEAST
characters on it ends after a word of a certain last character, at MOST anyway. A digest goes to one cell of each of three subtables; a cell
keeps a count, the exclusive-or of its digests and that of their check words.
Cells of two versions subtract; peeling then recovers the digests that only one
side holds: a cell of count 1 or -1 whose check word fits names a digest, which
is taken out of its other cells, and so on. Where cells remain, that pair is
tried again with larger sketches: the digests are dealt by hash over blocks of
some BLOCK digests, each block a sketch of three times ``THIRD`` cells, and
``GROWTH`` times more each time that fails, until none does.
The likeness is the Jaccard index of the two digest sets, from their sizes and
the recovered differences.

Fingerprints of ``CELLS`` cells subtract and peel within their row. The cells of
larger sketches are rows, of which only those that hold something exist, until
each block's are put together and peeled: memory is bounded however long a text
is.

Defined cases: null text is empty (one empty paragraph); the order of documents
is doc_id ascending (nulls first), then a hash of the text; repeated rows are
documents of their own; a single document is its own next; an empty table gives
an empty table; other columns are not read. Peeling that still fails after
``LEVELS`` retries (two digests in the same three cells each time) is an error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

CELLS, BLOCK, THIRD, GROWTH, LEVELS = 12, 4, 32, 4, 10
#: Rounds of peeling; what is left then counts as failed.
PEELS = 6
#: Percentile bounds of doc_id on the driver, and finest cuts between two.
BOUNDS, ROWS_A_RANGE = 256, 200_000
#: Digests in a partition of larger sketches.
DIGESTS_A_PART = 100_000
CHECK = 99
#: Characters of a piece of a long line, and where it ends.
LEAST, MOST = 96, 384
PIECE = rf"(?s).{{{LEAST},{MOST - 2}}}?[.,;:!?edst]\s|.{{1,{MOST}}}"


def digests(text):
    """Distinct 64-bit digests of the paragraphs of a text."""
    pieces = lambda p: F.when(F.char_length(p) <= LEAST, F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)))
    return F.array_distinct(F.transform(F.flatten(F.transform(F.split(text, "\n", -1), pieces)), lambda p: F.xxhash64(p)))


def cell_of(key, table: int, third, level):
    """The key's cell in one of the three subtables of ``third`` cells."""
    return (F.pmod(F.xxhash64(key, F.lit(table), level), third) + third * table).cast("long")


def sketch(keys):
    """The ``CELLS`` cells (n, k, c) of a digest array."""
    third = CELLS // 3
    at = lambda k, t: cell_of(k, t, F.lit(third), F.lit(0)).alias(f"p{t}")
    placed = F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k, F.lit(CHECK)).alias("c"), *[at(k, t) for t in range(3)]))

    def cell(own, j: int):
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
        add = lambda a, s: F.struct((a["n"] + 1).alias("n"), a["k"].bitwiseXOR(s["k"]).alias("k"), a["c"].bitwiseXOR(s["c"]).alias("c"))
        return F.aggregate(F.filter(own, lambda s: s[f"p{j // third}"] == j), start, add)

    # Placed once for all cells.
    return F.transform(F.array(placed), lambda own: F.array(*[cell(own, j) for j in range(CELLS)]))[0]


def fingerprint(keys):
    """The sketch of a digest array as text: count, then the cells in order.

    A cell is its count, in four hex digits or as many as it takes, and 32 digits of sums.
    """
    count = lambda n: F.lpad(F.hex(n), F.greatest(F.lit(4), F.length(F.hex(n))), F.lit("0"))  # noqa: E731  (lpad cuts what is longer)
    shown = F.transform(sketch(keys), lambda a: F.concat(count(a["n"]), F.lpad(F.hex(a["k"]), 16, "0"), F.lpad(F.hex(a["c"]), 16, "0")))
    return F.lower(F.concat_ws(".", F.hex(F.size(keys)), shown))


def peeled(cells, third, level):
    """(ok, only_a, only_b): subtracted ``cells`` (at, n, k, c) peeled within the row."""
    cell = lambda x, p: F.struct(x["at"].alias("at"), (x["n"] - p["n"]).alias("n"), x["k"].bitwiseXOR(p["k"]).alias("k"), x["c"].bitwiseXOR(p["c"]).alias("c"))
    state = lambda cells, only_a, only_b: F.struct(cells.alias("cells"), only_a.alias("only_a"), only_b.alias("only_b"))
    sided = lambda own, n: F.size(F.filter(own, lambda p: p["n"] == n)).cast("long")

    def step(now, _):
        pure = F.filter(now["cells"], lambda x: (F.abs(x["n"]) == 1) & (F.xxhash64(x["k"], F.lit(CHECK)) == x["c"]))
        # A digest named by several of its cells counts once.
        named = F.array_distinct(F.transform(pure, lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["c"].alias("c"), F.array(*[cell_of(x["k"], t, third, level) for t in range(3)]).alias("of"))))
        without = lambda own: F.filter(
            F.transform(now["cells"], lambda x: F.aggregate(own, x, lambda y, p: F.when(F.array_contains(p["of"], y["at"]), cell(y, p)).otherwise(y))),
            lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0),
        )
        bound = F.transform(F.array(named), lambda own: state(without(own), now["only_a"] + sided(own, 1), now["only_b"] + sided(own, -1)))
        return F.when(F.size(now["cells"]) == 0, now).otherwise(bound[0])

    zero = F.lit(0).cast("long")
    done = lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["only_a"].alias("only_a"), s["only_b"].alias("only_b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), state(cells, zero, zero), step, done)


def subtracted(a, b):
    """The cells (at, n, k, c) of sketch ``a`` less those of ``b`` that are not empty."""
    cells = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z, j: F.struct(j.cast("long").alias("at"), (z["a"]["n"] - z["b"]["n"]).alias("n"), z["a"]["k"].bitwiseXOR(z["b"]["k"]).alias("k"), z["a"]["c"].bitwiseXOR(z["b"]["c"]).alias("c")))
    return F.filter(cells, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0))


# -- the next document --------------------------------------------------------


def _search(col, bounds: list[int], at: int = 0):
    """Index of the last bound not above ``col``, as a tree of comparisons."""
    if len(bounds) <= 1:
        return F.lit(at)
    mid = len(bounds) // 2
    return F.when(col < bounds[mid], _search(col, bounds[:mid], at)).otherwise(_search(col, bounds[mid:], at + mid))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, a: its digests) with next_text and next_a, those of the next document.

    Contiguous ranges of ids go to one task each, with a copy of the row that
    follows; texts are exchanged once.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("h", F.xxhash64("text"))
    ids = keyed.select("doc_id", "h")
    n, named, bounds = ids.agg(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", [i / BOUNDS for i in range(BOUNDS + 1)], 10_000)).first()
    bounds = sorted(set(bounds or [0]))
    fine = max(1, -(-n // (ROWS_A_RANGE * BOUNDS)))
    coarse = _search(F.col("doc_id"), bounds)
    low, high = F.element_at(F.array(*map(F.lit, bounds)), coarse + 1), F.element_at(F.array(*map(F.lit, [*bounds[1:], bounds[-1] + 1])), coarse + 1)
    share = (F.col("doc_id").cast("double") - low) / F.greatest(F.lit(1.0), high.cast("double") - low) * fine
    cut = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor(share))).cast("int") if fine > 1 else F.lit(0)
    # Rows without an id come first, in ranges of their hash.
    blank = -(-(n - named) // ROWS_A_RANGE)
    by_hash = F.greatest(F.lit(0), F.least(F.lit(blank - 1), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * blank))).cast("int") - blank
    pid = F.when(F.col("doc_id").isNull(), by_hash).otherwise(coarse * fine + cut)
    # One row a range: BOUNDS * fine at most.
    firsts = ids.groupBy(pid.alias("pid")).agg(F.min(F.struct("doc_id", "h")).alias("k")).orderBy("pid").collect()
    back = [(firsts[i - 1]["pid"], r["k"]["doc_id"], r["k"]["h"]) for i, r in enumerate(firsts)]
    columns = [pa.array([r[i] for r in back], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
    copies = F.broadcast(spark.createDataFrame(pa.table(columns, ["before", "first_id", "first_h"])))
    at = keyed.join(copies, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left")
    own, copy = F.struct(pid.alias("pid"), F.lit(0).alias("copy")), F.struct(F.col("before").alias("pid"), F.lit(1).alias("copy"))
    dealt = at.select("doc_id", "h", "text", "a", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"))
    dealt = dealt.select("doc_id", "h", "text", "a", "to.pid", "to.copy")
    following = Window.partitionBy("pid").orderBy("copy", "doc_id", "h")
    both = dealt.withColumns({"next_text": F.lead("text").over(following), "next_a": F.lead("a").over(following)})
    return both.where("copy = 0").select("doc_id", "text", "a", "next_text", "next_a")


# -- larger sketches -------------------------------------------------------------


def differences(pairs: DataFrame, level: int, parts: int) -> DataFrame:
    """(uid, kind, ok, only_a, only_b): digests that peeling recovers on each side.

    ``pairs``: (uid, a, others: array of (kind, b)). ok is false where cells
    remain; a pair without any difference has no row.
    """
    third, salt = F.lit(THIRD * GROWTH ** (level - 1)), F.lit(level)
    blocks = F.ceil((F.size("a") + F.size("b")) / BLOCK)
    signed = lambda x, s: F.transform(x, lambda d: F.struct(F.lit(s).cast("long").alias("s"), d.alias("d")))
    sides = F.concat(signed("a", 1), signed("b", -1))
    own = pairs.repartition(parts, "uid").select("uid", "a", F.explode("others").alias("o")).select("uid", "o.kind", "a", "o.b")
    dealt = own.select("uid", "kind", blocks.alias("blocks"), F.explode(sides).alias("e"))
    digest = F.col("e.d")
    dealt = dealt.select("uid", "kind", F.pmod(F.xxhash64(digest, F.lit("block"), salt), "blocks").alias("block"), "e.s", "e.d", F.explode(F.array(*[cell_of(digest, t, third, salt) for t in range(3)])).alias("at"))
    cells = dealt.groupBy("uid", "kind", "block", "at").agg(F.sum("s").alias("n"), F.bit_xor("d").alias("k"), F.bit_xor(F.xxhash64("d", F.lit(CHECK))).alias("c"))
    cells = cells.where("n <> 0 or k <> 0 or c <> 0")
    own = cells.groupBy("uid", "kind", "block").agg(F.collect_list(F.struct("at", "n", "k", "c")).alias("cells"))
    done = own.select("uid", "kind", peeled(F.col("cells"), third, salt).alias("d"))
    return done.groupBy("uid", "kind").agg(F.min("d.ok").alias("ok"), F.sum("d.only_a").alias("only_a"), F.sum("d.only_b").alias("only_b"))


def retried(pairs: DataFrame) -> DataFrame:
    """(uid, kind, only_a, only_b) of (uid, a, others), by sketches as large as each needs; none for equal sides."""
    spark, out, left = pairs.sparkSession, None, pairs
    for level in range(1, LEVELS + 1):
        size = F.aggregate("others", F.lit(0), lambda n, o: n + F.size("a") + F.size(o["b"]))
        total = left.agg(F.sum(size)).first()[0] or 0
        parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // DIGESTS_A_PART))
        done = settle(differences(left, level, parts), f"differences-{level}", total // 2)
        good = done.where("ok").select("uid", "kind", "only_a", "only_b")
        out = good if out is None else out.unionByName(good)
        failed = done.where("not ok").groupBy("uid").agg(F.collect_set("kind").alias("again"))
        if not failed.limit(1).count():
            return out
        left = left.join(failed, "uid").select("uid", "a", F.filter("others", lambda o: F.array_contains("again", o["kind"])).alias("others"))
    raise RuntimeError(f"peeling still failed after {LEVELS} retries")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text against its edited form and the next document's text.

    The edited text has its last floor(n_chars / 2) code points replaced by as
    many (or all) from the start of the next document, doc_id ascending, the
    first after the last. Returns (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, half = F.char_length("text").cast("long"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = with_next(texts.withColumn("a", digests(F.col("text")))).select("doc_id", n.alias("n_chars"), "a", F.col("next_a").alias("b"), edited.alias("edited"))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("e"), "b")
    cells = both.select("*", sketch(F.col("a")).alias("sa"), sketch(F.col("e")).alias("se"), sketch(F.col("b")).alias("sb"))
    failed = F.struct(F.lit(False).alias("ok"), F.lit(0).cast("long").alias("only_a"), F.lit(0).cast("long").alias("only_b"))
    # More digests on one side than cells can name never peel.
    first = lambda x: F.when(F.abs(F.size("a") - F.size(x)) > CELLS, failed).otherwise(peeled(subtracted(F.col("sa"), F.col(f"s{x}")), F.lit(CELLS // 3), F.lit(0)))
    made = cells.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "n_chars", "edited_sha256", "a", "e", "b", first("e").alias("d_e"), first("b").alias("d_b"))
    made = settle(made, "digests")  # fixes uid
    kinds = [F.struct(F.lit(x).alias("kind"), F.col(x).alias("b")) for x in ("e", "b")]
    left = F.filter(F.array(*kinds), lambda p: F.when(p["kind"] == "e", ~F.col("d_e.ok")).otherwise(~F.col("d_b.ok")))
    found = retried(made.select("uid", "a", left.alias("others")).where(F.size("others") > 0))
    only = lambda x, side: F.max(F.when(F.col("kind") == x, F.col(f"only_{side}"))).alias(f"{x}_only_{side}")
    joined = made.join(found.groupBy("uid").agg(*[only(x, side) for x in ("e", "b") for side in ("a", "b")]), "uid", "left")

    def like(x: str):
        of = lambda side: F.when(F.col(f"d_{x}.ok"), F.col(f"d_{x}.only_{side}")).otherwise(F.coalesce(F.col(f"{x}_only_{side}"), F.lit(0)))
        return (F.size("a") - of("a")) / (F.size("a") + of("b"))

    return joined.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), like("e").alias("near_edited"), like("b").alias("near_next"))
