"""SimHash near-duplicates by tiled exact comparison.

Each document gets a fingerprint of ``64 * words`` bits. Equal fingerprints are
grouped first, so a group of copies is one row from then on. Distinct
fingerprints are cut into tiles by population counts, or by shingle counts where
a similarity is wanted; pairs of tiles that can't hold a link are skipped, every
other pair is compared exactly with numpy exclusive-or and bit counts, 256 by
256 rows at a time and with the same skips. A pair of tiles reports a spanning
forest of what it links, never all pairs; :func:`common.components` joins the
forests. A task holds one pair of tiles at a time, whatever the table.

The comparison is exact and so grows with the square of the distinct
fingerprints, less what the skips save.

With a wanted similarity, links within the radius are candidates only, and rows
are grouped by their shingle sets (count and sum of hashes) besides. Groups of
candidates are cut into blocks, and pairs of blocks compared by the exact
Jaccard index of the shingle sets; only what that confirms is joined. A group's
rows are read once a block of it.

Defined cases: null or wordless texts have the fingerprint zero, linked like any
other; a row without doc_id is returned without a component (null) and links
nothing; repeated rows stay repeated; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, components, settle

SEED = 42
#: Fixed odd multipliers that spread one 64-bit hash over further words.
SPREAD = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: Fingerprints in a tile: at most, and at least while there are fewer.
TILE, LEAST_TILE = 131_072, 4096
#: Pairs of tiles that a partition gets, about, and partitions at most.
PAIRS_A_PART, MOST_PARTS = 4, 100_000
#: Rows and shingles of a block of a candidate group, about; groups of one block go some together.
BLOCK_ROWS, BLOCK_SHINGLES, TOGETHER = 4096, 1_000_000, 2_000_000
#: Sets of fewer shingles than this need the radius ``short``.
SHORT = 5
SUB = 256
#: Length classes for the ratio skip: class k holds counts from GROWTH**k.
GROWTH = 1.05


@dataclass(frozen=True)
class Method:
    """How fingerprints are made and linked.

    shingle: words in a shingle. words: 64-bit words in a fingerprint. radius:
    most differing bits of a link. distinct: whether a repeated shingle counts
    once. ratio: least Jaccard index of the shingle sets, which bounds the ratio
    of their counts (0: the radius alone decides). short: radius where a set has
    fewer than SHORT shingles.
    """

    shingle: int = 5
    words: int = 4
    radius: int = 72
    distinct: bool = True
    ratio: float = 0.8
    short: int = 80


#: The query's contract: 4-word shingles with repeats, 64 bits, radius 4.
CONTRACT = Method(shingle=4, words=1, radius=4, distinct=False, ratio=0.0, short=4)
#: Five words; a similarity of 0.8 differs in at most 41 of 256 bits on average, 48 for 4 against 5 shingles; both radii are 5 deviations above.
NEAR = Method()


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined k-word shingles, in order."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    out = h[:, None] * SPREAD[:words]
    if words > 1:
        out[:, 1:] ^= out[:, 1:] >> np.uint64(29)
        out[:, 1:] *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, 1:] ^= out[:, 1:] >> np.uint64(32)
    return out


def fingerprint(text: str | None, method: Method) -> tuple[np.ndarray, int]:
    """The fingerprint's words and the number of shingles behind it."""
    h = shingle_hashes(text or "", method.shingle)
    if method.distinct:
        h = np.unique(h)
    return majority(h, method), len(h)


def majority(h: np.ndarray, method: Method) -> np.ndarray:
    """The words whose bits are set in over half the hashes."""
    on = np.zeros(64 * method.words, np.int64)
    for i in range(0, len(h), 65_536):  # bounded memory for very long texts
        on += np.unpackbits(_mixed(h[i : i + 65_536], method.words).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((on * 2 > len(h)), bitorder="little").view(np.uint64)


def _sum(h: np.ndarray) -> int:
    return int(h.sum(dtype=np.uint64).view(np.int64)) if len(h) else 0


def fingerprints(docs: DataFrame, method: Method = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, w0 .. w{words-1}: the fingerprint's words as bigint, n: shingles, s: sum of their hashes).

    With a ``ratio`` also h, the text's hash, which tells texts under one doc_id apart.
    """
    names, extra = [f"w{i}" for i in range(method.words)], _extra(method)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                h = shingle_hashes(t or "", method.shingle)
                h = np.unique(h) if method.distinct else h
                rows.append((majority(h, method), len(h), _sum(h)))
            words = np.array([r[0] for r in rows], np.uint64).reshape(-1, method.words).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **{n: words[:, i] for i, n in enumerate(names)}, "n": [r[1] for r in rows], "s": [r[2] for r in rows], **{c: pdf[c] for c in extra}})

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", n long, s long" + "".join(f", {c} long" for c in extra)
    hashes = [F.xxhash64(text_col).alias(c) for c in extra]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *hashes).mapInPandas(run, schema)


def _extra(method: Method) -> list[str]:
    return ["h"] if method.ratio else []


# -- tiles -------------------------------------------------------------------


def _class_column(method: Method):
    """A small integer that decides which tiles can be skipped."""
    if method.ratio:
        return F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.log(F.lit(GROWTH))).cast("int")
    half = F.lit(0xFFFFFFFF)
    return (F.bit_count(F.shiftrightunsigned("w0", 32)) * 33 + F.bit_count(F.col("w0").bitwiseAND(half))).cast("int")


def _reach(method: Method, c: int) -> int:
    """The greatest class whose rows can link to rows of class ``c``."""
    if method.ratio:
        return c + 2 + int(np.log(1 / method.ratio) / np.log(GROWTH))
    return (c // 33 + method.radius) * 33 + 32


def plan_tiles(sizes: dict[int, int], method: Method, tile: int) -> list[tuple[int, int, int, int, int]]:
    """(class, first tile, tiles, lowest and highest tile to compare with) of each class.

    Classes of at most ``tile`` rows share tiles, larger ones are cut. Tiles
    follow the classes, so what one compares with is a range. The driver holds
    a row a class: 1,089, or a few hundred.
    """
    spans, first, rows = [], {}, 0  # of each tile: least and greatest class
    for c in sorted(sizes):
        n = -(-sizes[c] // tile)
        if n > 1 or not spans or rows + sizes[c] > tile:
            first[c] = (len(spans), n)
            spans += [(c, c)] * n
            rows = sizes[c] if n == 1 else tile
        else:
            first[c] = (len(spans) - 1, 1)
            spans[-1] = (spans[-1][0], c)
            rows += sizes[c]
    least, most = np.array([x[0] for x in spans]), np.array([_reach(method, x[1]) for x in spans])
    highest = np.searchsorted(least, most, "right") - 1
    lowest = np.searchsorted(highest, np.arange(len(spans)))
    return [(c, t, n, int(lowest[t]), int(highest[t])) for c, (t, n) in first.items()]


class Forest:
    """Union-find over array positions, kept flat after each batch of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            on = ra != rb
            if not on.any():
                return
            a, b, ra, rb = a[on], b[on], ra[on], rb[on]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                flat = self.root[self.root]
                if np.array_equal(flat, self.root):
                    break
                self.root = flat


def _order(fps: np.ndarray, n: np.ndarray, node: np.ndarray, method: Method) -> np.ndarray:
    """Rows that skip alike next to each other."""
    halves = np.bitwise_count(fps[:, 0].copy().view(np.uint16).reshape(-1, 4))
    return np.lexsort((node, *halves.T, n) if method.ratio else (node, *halves.T))


def _runs(at: np.ndarray, fps: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends in ``at`` of runs of SUB rows, with the ranges of their byte population counts and shingle counts."""
    starts = np.arange(0, len(at), SUB)
    counts = np.bitwise_count(fps[at, 0].copy().view(np.uint8).reshape(-1, 8)).astype(np.int64)
    least, most = (np.array([f(counts[s : s + SUB], 0) for s in starts]) for f in (np.min, np.max))
    low, high = (np.array([f(n[at[s : s + SUB]]) for s in starts]) for f in (np.min, np.max))
    return starts, np.minimum(starts + SUB, len(at)), least, most, low, high


def link_tiles(fps: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, method: Method) -> Forest:
    """Compare rows ``left`` with rows ``right``, the same or others, each in :func:`_order`."""
    forest, same = Forest(len(fps)), left is right
    if not len(left) or not len(right):
        return forest
    starts, ends, least, most, low, high = _runs(left, fps, n)
    starts2, ends2, least2, most2, low2, high2 = (starts, ends, least, most, low, high) if same else _runs(right, fps, n)
    for k in range(len(starts)):
        radius = np.where(np.minimum(low[k], low2) < SHORT, method.short, method.radius)
        if method.words == 1:
            on = np.maximum(0, np.maximum(least2 - most[k], least[k] - most2)).sum(1) <= radius
        else:
            on = np.ones(len(starts2), bool)
        if method.ratio:
            on &= (low[k] * method.ratio <= high2 + 1e-9) & (low2 * method.ratio <= high[k] + 1e-9)
        if same:
            on[:k] = False
        rows = left[starts[k] : ends[k]]
        own = fps[rows]
        for m in np.flatnonzero(on).tolist():
            others = right[starts2[m] : ends2[m]]
            other = fps[others]
            bits = np.bitwise_count(own[:, None, 0] ^ other[None, :, 0])
            for w in range(1, method.words):
                bits = bits + np.bitwise_count(own[:, None, w] ^ other[None, :, w]).astype(np.uint16)
            hit = bits <= radius[m]
            if same and m == k:
                if hit.sum() == len(own):  # each row meets itself only
                    continue
            elif not hit.any():
                continue
            a, b = np.nonzero(hit)
            forest.link(rows[a], others[b])
    return forest


def links(distinct: DataFrame, method: Method, parts: int | None = None, tile: int | None = None) -> DataFrame:
    """Spanning forests (a, b) over ``distinct`` (node, n, w0 ..), one row a fingerprint."""
    spark, names = distinct.sparkSession, [f"w{i}" for i in range(method.words)]
    classed = distinct.withColumn("class", _class_column(method))
    sizes = {r[0]: r[1] for r in classed.groupBy("class").count().collect()}  # some hundred classes
    parts = parts or int(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Tiles small enough that each partition has pairs of them to do, while there are few rows.
    tile = tile or int(min(TILE, max(LEAST_TILE, sum(sizes.values()) / np.sqrt(2 * PAIRS_A_PART * parts))))
    plan = plan_tiles(sizes, method, tile)
    pairs = sum(n * (high - low + 1) for _, _, n, low, high in plan) // 2
    parts = min(MOST_PARTS, max(parts, pairs // PAIRS_A_PART))
    rows = pa.table([pa.array([r[i] for r in plan], pa.int32()) for i in range(5)], ["class", "first", "tiles", "lowest", "highest"])
    own = F.col("first") + F.pmod(F.xxhash64(*names), F.col("tiles").cast("long")).cast("int")
    placed = (
        classed.join(F.broadcast(spark.createDataFrame(rows)), "class")  # at most 1,089 rows
        .select(own.alias("tile"), F.explode(F.sequence("lowest", "highest")).alias("other"), "node", "n", *names)
        .select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "n", *names)
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.ascontiguousarray(pdf[names].to_numpy(np.int64).view(np.uint64).reshape(-1, method.words))
        n, node, tile_of = (pdf[c].to_numpy() for c in ("n", "node", "tile"))
        order = _order(fps, n, node, method)
        left, right = (order[tile_of[order] == t] for t in key)
        root = link_tiles(fps, n, left, left if key[0] == key[1] else right, method).root
        on = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": node[on], "b": node[root[on]]})

    return placed.repartition(parts, "i", "j").groupBy("i", "j").applyInPandas(run, "a long, b long")


# -- exact similarity ----------------------------------------------------------


def link_similar(fps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, method: Method) -> Forest:
    """Link rows of ``left`` and ``right`` whose sets are similar; pairs of one tree are not tested again."""
    forest, n = Forest(len(fps)), np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts, own = np.cumsum(n) - n, np.zeros(len(ids), bool)
    reach = max(method.radius, method.short)
    for p in left.tolist():
        others = right[forest.root[right] != forest.root[p]]
        bits = np.bitwise_count(fps[others] ^ fps[p]).sum(1, dtype=np.int64)
        near = others[(bits <= reach) & (np.minimum(n[others], n[p]) >= method.ratio * np.maximum(n[others], n[p]) - 1e-9)]
        if not len(near):
            continue
        ends = np.cumsum(n[near])
        at = np.arange(ends[-1]) + np.repeat(starts[near] - ends + n[near], n[near])
        mine = ids[starts[p] : starts[p] + n[p]]
        own[mine] = True
        common = np.add.reduceat(own[ids[at]], ends - n[near], dtype=np.int64)
        own[mine] = False
        good = near[common >= method.ratio * (n[p] + n[near] - common) - 1e-9]
        if len(good):
            forest.link(np.full(len(good), p), good)
    return forest


def verified(docs: DataFrame, distinct: DataFrame, groups: DataFrame, method: Method, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spanning forests (a, b) of the exact links within ``groups`` (node, component) of candidates."""
    spark, names = docs.sparkSession, [f"w{i}" for i in range(method.words)]
    members = distinct.join(groups, "node")
    cells = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES))
    cut = settle(members.groupBy("component").agg(cells.cast("int").alias("blocks"), F.sum("n").alias("shingles")), "simhash-groups")
    whole = cut.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0
    lots = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole // TOGETHER))
    rows = members.join(cut.drop("shingles"), "component").select("node", "component", "blocks", "n", "s", *names)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(rows, "node")

    def shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(t or "", method.shingle)) for t in pdf["text"]]
            # Another text under the same doc_id is not this row's.
            own = [(len(x), _sum(x)) == (n, s) for x, n, s in zip(sets, pdf["n"], pdf["s"], strict=True)]
            yield pdf.drop(columns=["text", "n", "s"]).assign(shingles=[x.tobytes() for x in sets])[own]

    schema = "node long, component long, blocks int, " + ", ".join(f"{n} long" for n in names) + ", shingles binary"
    # Each pair of a group's blocks is a unit of two blocks of rows, however large the group;
    # a group of one block is small, and lots of these are a unit.
    block, other = F.pmod(F.xxhash64("node", *names), F.col("blocks").cast("long")).cast("int"), F.col("other")
    dealt = (
        texts.mapInPandas(shingled, schema)
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lot", F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(lots))).otherwise(F.col("component")))
        .withColumn("blocks_one", F.col("blocks") == 1)
        .select("node", "component", "lot", "blocks_one", "block", F.least("block", other).alias("i"), F.greatest("block", other).alias("j"), *names, "shingles")
    )

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": []}, dtype=np.int64)]
        for _, own in unit.groupby("component"):
            own = own.sort_values(["node", *names])
            fps = own[names].to_numpy(np.int64).view(np.uint64).reshape(-1, method.words)
            sets = [np.frombuffer(x, np.uint64) for x in own["shingles"]]
            block, node = own["block"].to_numpy(), own["node"].to_numpy()
            root = link_similar(np.ascontiguousarray(fps), sets, np.flatnonzero(block == own["i"].iat[0]), np.flatnonzero(block == own["j"].iat[0]), method).root
            on = np.flatnonzero(root != np.arange(len(root)))
            out.append(pd.DataFrame({"a": node[on], "b": node[root[on]]}))
        return pd.concat(out, ignore_index=True)

    # Components are doc_ids; lots are told from them by whether the unit's group is one block.
    return dealt.groupBy("lot", F.col("blocks_one").alias("one"), "i", "j").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, method: Method = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, w0 .., n, component_id): each document with the smallest doc_id it reaches."""
    names = [f"w{i}" for i in range(method.words)]
    with batches_of(docs.sparkSession, 1000):
        prints = settle(fingerprints(docs, method, id_col, text_col), "simhash")
    named = prints.where("doc_id is not null")
    if method.ratio:
        keys = [*names, "n", "s"]
        distinct = settle(named.groupBy(*keys).agg(F.min("doc_id").alias("node")), "simhash-distinct")
        # Sets too small to reach the similarity unless equal link nothing.
        groups = components(links(distinct.where((F.col("n") + 1) * method.ratio <= F.col("n") + 1e-9), method))
        with batches_of(docs.sparkSession, 1000):
            found = components(verified(docs, distinct, groups, method, id_col, text_col))
    else:
        keys = names
        distinct = settle(named.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.max("n").alias("n")), "simhash-distinct")
        found = components(links(distinct, method))
    rooted = distinct.join(found, "node", "left").select(*keys, F.coalesce("component", "node").alias("component"))
    # Rows without doc_id are in no class and meet in no join.
    shown = ["doc_id", *names, "n", *_extra(method)]
    out = named.join(rooted, keys).select(*shown, F.col("component").alias("component_id"))
    return out.unionByName(prints.where("doc_id is null").select(*shown, F.lit(None).cast("long").alias("component_id")))


def keep_representatives(docs: DataFrame, method: Method = NEAR) -> DataFrame:
    """``docs`` with one document of each class: that of its smallest doc_id.

    Rows without doc_id pass. Repeated rows of one doc_id become one row. Of different
    texts under the smallest doc_id that of the least text hash stays, and none of the
    others comes back with it: rows are joined by id and text hash.
    """
    found = classes(docs, method).where("doc_id = component_id").groupBy("doc_id").agg(F.min("h").alias("kept_hash"), F.count("*").alias("rows"))
    kept = settle(found.withColumnRenamed("doc_id", "kept_id"), "simhash-kept")
    # The kept ids grow with the table: one plan at every size, never a broadcast; a sort-merge join can spill.
    at = F.xxhash64(docs["text"])
    joined = lambda rows: docs.join(rows.hint("merge"), (docs["doc_id"] == rows["kept_id"]) & (at == rows["kept_hash"]), "left_semi")
    out = joined(kept).unionByName(docs.where("doc_id is null"))
    if kept.where("rows > 1").limit(1).count():  # repeated rows, or two texts under one id
        out = joined(kept.where("rows = 1")).unionByName(joined(kept.where("rows > 1")).dropDuplicates(["doc_id"])).unionByName(docs.where("doc_id is null"))
    return out
