"""Near-duplicate frames: pairs of fingerprints within a distance, their components, dense group ids.

Pairs within a small distance come from multi-index hashing (Norouzi, Punjani and Fleet,
CVPR 2012): bits are cut into bands, and a pair within the distance agrees in some band
up to distance // bands bits. Each side is filed under all keys of that radius split
between both (left probes floor(r/2) flips, right the rest), so the join is an equi-join
on band and key and no pair is missed. How many bands follows from the number of
fingerprints: few and wide ones file more keys, many and narrow ones meet more strangers.
Within a wide distance of longs nearly all meet; where that costs more than comparing
each with each, fingerprints are dealt into blocks, and a task compares two of them.
Fingerprints are made distinct first, so copies never meet each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharpsieve.functions import bits
from sharpsieve.functions.tiles import distance_of_arrays
from sharpsieve.operators.components import components
from sharpsieve.operators.scratch import Scratch
from sharpsieve.session import ship

#: Keys that one fingerprint is filed under in a band, at most.
KEYS = 20_000
#: Comparisons in a block that take as long as a row that is filed or met.
ROW = 200
#: Fingerprints of a block, while there are fewer blocks than that (each fingerprint is sent to as many tasks as there are blocks).
BLOCK, BLOCKS = 4096, 32
#: Pairs of a batch that a task gives back.
GIVEN = 100_000


def _flips(bits: int, most: int) -> list[int]:
    """All masks of at most `most` of `bits` bits."""
    return [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def _band_cost(n: int, most: int, n_bits: int, bands: int) -> float:
    """Rows that n fingerprints file in so many bands, and expect to meet."""

    def ball(width: int, radius: int) -> int:
        return sum(math.comb(width, k) for k in range(radius + 1))

    width, reach = -(-n_bits // bands), most // bands
    left, right = ball(width, reach // 2), ball(width, reach - reach // 2)
    if right > KEYS:
        return math.inf
    return bands * n * (left + right) + bands * float(n) * n * left * right / 2.0**width


def best_bands(n: int, most: int, n_bits: int = 64) -> int:
    """The number of bands for which n fingerprints file the fewest keys and expect to meet the fewest others."""
    return min(range(1, min(n_bits, most + 1) + 1), key=lambda bands: _band_cost(n, most, n_bits, bands))


def in_blocks(n: int, most: int, n_bits: int = 64) -> bool:
    """Whether comparing each of n fingerprints with each takes less than bands do."""
    return float(n) * n / 2 <= ROW * _band_cost(n, most, n_bits, best_bands(n, most, n_bits))


def hamming_pairs(frames: DataFrame, most: int, *, id_col: str = "file_idx", hash_col: str = "fingerprint", n_bits: int = 64, bands: int | None = None) -> DataFrame:
    """a, b, distance: pairs of rows (a < b) whose fingerprints (longs) differ in at most `most` bits; null fingerprints take no part.

    All pairs are its result, those of equal fingerprints too; groups need fewer (group_by_similarity).
    """
    rows = Scratch(frames.sparkSession).write(frames.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")), "rows")
    close = fingerprint_pairs(rows.select("h").distinct(), most, n_bits=n_bits, bands=bands)
    for side in "12":
        close = close.join(rows.select(F.col("id").alias(f"id{side}"), F.col("h").alias(f"h{side}")), f"h{side}")
    linked = close.where("id1 != id2").select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "distance")
    same = rows.select(F.col("id").alias("a"), "h").join(rows.select(F.col("id").alias("b"), "h"), "h").where("a < b").select("a", "b", F.lit(0).cast("int").alias("distance"))
    return linked.union(same)


def fingerprint_pairs(distinct: DataFrame, most: int, *, n_bits: int = 64, bands: int | None = None) -> DataFrame:
    """h1, h2, distance: pairs (h1 < h2) of the distinct column h within the distance, each once."""
    if bands is None:
        n = max(distinct.count(), 1)
        if in_blocks(n, most, n_bits):
            return _compared(distinct, n, _close_pairs(most), "h1 bigint, h2 bigint, distance int")
        bands = best_bands(n, most, n_bits)
    cuts = [k * n_bits // bands for k in range(bands + 1)]
    reach = most // bands
    near, far = reach // 2, reach - reach // 2

    def filed(rows: DataFrame, name: str, flips: int) -> DataFrame:
        keys = []
        for band, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = F.shiftrightunsigned(F.col("h"), low).bitwiseAND(F.lit((1 << (high - low)) - 1 if high - low < 64 else -1))
            masks = F.split(F.lit(",".join(map(str, _flips(high - low, flips)))), ",").cast("array<bigint>")  # one constant, not a tree of them
            keys.append(F.transform(masks, _filed_under(band, part)))
        return rows.select(F.col("h").alias(name), F.explode(F.concat(*keys)).alias("k")).select(name, "k.band", "k.key")

    left, right = filed(distinct, "h1", near), filed(distinct, "h2", far)
    gap = F.bit_count(F.col("h1").bitwiseXOR(F.col("h2")))
    met = left.join(right, ["band", "key"]).where((F.col("h1") < F.col("h2")) & (gap <= most))
    return met.select("h1", "h2", gap.alias("distance")).distinct()


def fingerprint_links(distinct: DataFrame, most: int, *, n_bits: int = 64) -> DataFrame:
    """h1, h2: pairs of the distinct column h whose components are those of all pairs within the distance; each two blocks give a tree of theirs instead of all pairs."""
    n = max(distinct.count(), 1)
    if in_blocks(n, most, n_bits):
        return _compared(distinct, n, _trees(most), "h1 bigint, h2 bigint")
    return fingerprint_pairs(distinct, most, n_bits=n_bits, bands=best_bands(n, most, n_bits)).select("h1", "h2")


def _filed_under(band: int, part: Column):
    return lambda m: F.struct(F.lit(band).alias("band"), part.bitwiseXOR(m).alias("key"))


def _compared(distinct: DataFrame, n: int, run, schema: str) -> DataFrame:
    """What run makes of each two blocks of the column h, and of each block with itself: rows i, j (blocks, i <= j), a, b (their fingerprints)."""
    ship(distinct.sparkSession)
    blocks = max(1, min(BLOCKS, -(-n // BLOCK)))
    packed = distinct.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("h").alias("hs"))
    sent = packed.select("block", "hs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    sent = sent.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "hs")
    side = lambda c: F.any_value(F.when(F.col("block") == F.col(c), F.col("hs")), F.lit(True))
    both = sent.repartition(blocks * (blocks + 1) // 2, "i", "j").groupBy("i", "j").agg(side("i").alias("a"), side("j").alias("b"))
    return both.where("a is not null and b is not null").mapInArrow(run, schema)


def _two_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The fingerprints of each row's blocks; the second is None where both are one."""
    for batch in batches:
        for r in range(batch.num_rows):
            a, b = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in "ab")
            yield a, None if batch.column("i")[r].as_py() == batch.column("j")[r].as_py() else b


def _close_pairs(most: int):
    """For _compared: h1, h2, distance of all close pairs."""

    def given(found: list[tuple]) -> pa.RecordBatch:
        one, two, gap = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(gap)], ["h1", "h2", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _two_blocks(batches):
            found, n = [], 0
            for x, y, gap in bits.close(a, b, most):
                found.append((a[x], (a if b is None else b)[y], gap))
                n += len(x)
                if n >= GIVEN:
                    yield given(found)
                    found, n = [], 0
            if found:
                yield given(found)

    return run


def _trees(most: int):
    """For _compared: h1, h2, the smallest fingerprint of a component of two blocks and each other one of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _two_blocks(batches):
            nodes = np.sort(a if b is None else np.concatenate((a, b)))
            places = [np.searchsorted(nodes, x) for x in (a, a if b is None else b)]
            forest, found, n = bits.Forest(len(nodes)), [], 0
            for x, y, _ in bits.close(a, b, most):
                found.append((places[0][x], places[1][y]))
                n += len(x)
                if n >= GIVEN:
                    forest.join(*map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
            if found:
                forest.join(*map(np.concatenate, zip(*found, strict=True)))
            below = np.flatnonzero(forest.root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[forest.root[below]]), pa.array(nodes[below])], ["h1", "h2"])

    return run


def wide_pairs(distinct: DataFrame, most: int, n_bits: int) -> DataFrame:
    """fingerprint_pairs for arrays of longs, n_bits in all: a pair within the distance is equal in one of most + 1 bands.

    This prunes as long as there are far more bits than differences.
    """
    cuts = [k * n_bits // (most + 1) for k in range(most + 2)]
    keys = []
    for band, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        words = []
        for word in range(low // 64, -(-high // 64)):
            mask = sum(1 << b - 64 * word for b in range(max(low, 64 * word), min(high, 64 * word + 64)))
            words.append(F.get("h", F.lit(word)).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        keys.append(F.struct(F.lit(band).alias("band"), F.xxhash64(*words).alias("key")))
    filed = distinct.select("h", F.explode(F.array(*keys)).alias("k")).select("h", "k.band", "k.key")
    other = filed.select(F.col("h").alias("h2"), "band", "key")
    gap = distance_of_arrays(F.col("h"), F.col("h2"))
    met = filed.join(other, ["band", "key"]).where((F.col("h") < F.col("h2")) & (gap <= most))
    return met.select(F.col("h").alias("h1"), "h2", gap.alias("distance")).distinct()


def within_gap(a: Column, b: Column, seconds: float) -> Column:
    """False only if a gap is asked for, both times are known, and they are farther apart."""
    return F.lit(True) if seconds <= 0 else ~F.coalesce(F.abs(a - b) > seconds, F.lit(False))


def group_by_similarity(
    frames: DataFrame, *, max_distance: int = 10, max_gap: float = 0.0, id_col: str = "file_idx", hash_col: str = "fingerprint", time_col: str | None = None, n_bits: int = 64
) -> DataFrame:
    """id_col, group_id: for each row with a fingerprint the dense id (from 0, by first member) of its component of close pairs.

    Fingerprints are longs, or arrays of longs that hold n_bits. Rows of one fingerprint
    that lie in one span of `max_gap` seconds are one node, as each two of them are
    linked; rows without a time are a node that is linked to all nodes of its own and of
    close fingerprints. Nodes meet those of their own and the next span, by equality, so
    copies cost no pairs and no window holds them.
    """
    scratch = Scratch(frames.sparkSession)
    timed = max_gap > 0 and time_col is not None
    time = F.col(time_col).cast("double") if timed else F.lit(None).cast("double")
    cell = F.floor(time / max_gap) if timed else F.lit(0).cast("long")
    rows = scratch.write(frames.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), time.alias("t"), cell.alias("cell")), "rows")  # fingerprints are computed once
    nodes = scratch.write(rows.groupBy("h", "cell").agg(F.min("id").alias("node"), F.min("t").alias("first"), F.max("t").alias("last")), "nodes")
    distinct = nodes.select("h").distinct()
    wide = rows.schema["h"].dataType.simpleString().startswith("array")
    pairs = wide_pairs if wide else fingerprint_pairs if timed else fingerprint_links  # a link that a time gap breaks can't stand for others
    close = scratch.write(pairs(distinct, max_distance, n_bits=n_bits).select("h1", "h2"), "close")
    if timed:
        close = close.union(distinct.select(F.col("h").alias("h1"), F.col("h").alias("h2")))  # a fingerprint's own spans
    one, two = (nodes.select(*(F.col(x).alias(f"{x}{n}") for x in ("h", "cell", "node", "first", "last"))) for n in (1, 2))
    if timed:
        steps = F.explode(F.array(*(F.col("cell1") + k for k in (-1, 0, 1))))
        with_one = close.join(one, "h1")
        near = with_one.where("cell1 is not null").withColumn("cell2", steps).join(two.where("cell2 is not null"), ["h2", "cell2"])
        near = near.where((F.col("first2") - F.col("last1") <= max_gap) & (F.col("first1") - F.col("last2") <= max_gap)).select("node1", "node2")
        untimed = with_one.where("cell1 is null").join(two, "h2").select("node1", "node2")
        other = close.join(two.where("cell2 is null"), "h2").join(one, "h1").select("node1", "node2")
        edges = near.union(untimed).union(other).select(F.col("node1").alias("a"), F.col("node2").alias("b"))
        roots = components(edges, scratch).withColumnRenamed("node", "_node")
        named = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("h", "cell", F.coalesce("root", "node").alias("root"))
    else:  # a node is a fingerprint
        roots = components(close.select(F.col("h1").alias("a"), F.col("h2").alias("b")), scratch).select(F.col("node").alias("_h"), F.col("root").alias("_root"))
        linked = scratch.write(nodes.join(roots, F.col("h") == F.col("_h"), "left").select("h", "cell", "node", F.coalesce("_root", "h").alias("_root")), "linked")
        named = linked.join(linked.groupBy("_root").agg(F.min("node").alias("root")), "_root").select("h", "cell", "root")
    named = scratch.write(named, "named")
    ids = dense_ids(named.select("root").distinct())
    of = named.join(ids, "root").select(F.col("h").alias("_h"), F.col("cell").alias("_cell"), "group_id")
    return rows.join(of, (F.col("h") == F.col("_h")) & F.col("cell").eqNullSafe(F.col("_cell"))).select(F.col("id").alias(id_col), "group_id")


def dense_ids(roots: DataFrame, column: str = "root", out: str = "group_id") -> DataFrame:
    """0, 1, ... in the order of column: ranges are numbered apart, and shifted by the counts before them, so no task sees all rows."""
    scratch = Scratch(roots.sparkSession)
    once = scratch.write(roots.select(column), "roots")  # dealing out by range reads its input twice
    spread = scratch.write(once.repartitionByRange(column).select(column, F.spark_partition_id().alias("_part")), "ranges")
    counts = spread.groupBy("_part").count().collect()  # as many rows as there are ranges
    shift, total = {}, 0
    for r in sorted(counts, key=lambda r: r._part):
        shift[r._part], total = total, total + r["count"]
    starts = roots.sparkSession.createDataFrame([(k, v) for k, v in shift.items()], "_part int, _start long")
    own = F.row_number().over(W.partitionBy("_part").orderBy(column)) - 1
    return spread.join(F.broadcast(starts), "_part").select(column, (own + F.col("_start")).cast("int").alias(out))
