"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: the contract of op7 (lower-cased words, shingles with repeats,
XXH64 with seed 42, a bit is 1 if set in over half the hashes).

Covering masks (Pagh, SODA 2016): bit i gets a vector m(i) of radius + 1 bits; for
each of the 2^(radius+1) - 1 non-zero vectors v, mask v holds the bits whose m(i)
has an odd number of ones in common with v. The vectors of at most `radius`
differing bits span a proper subspace, so some v is orthogonal to all of them and
mask v holds none of the differing bits: every pair within the radius agrees on
all that some mask holds, and meets in that mask's table.

Equal fingerprints are one fingerprint from the start. Of a bucket of two, the pair
is compared at once. Buckets of up to `bucket` fingerprints are compared in blocks
inside one task, which gives back a spanning forest. A larger bucket is covered
anew on the bits that its mask leaves free, as often as needed: the bits that may
still differ halve each time, so this ends, with no pair lost. A mask of what a bucket
leaves free has to hold a bit at least, so buckets of up to 2^(2^radius - 1) fingerprints
are compared in a task whatever `bucket` says, and the radius is 4 at most.

Defined results: a null text counts as empty; without words the fingerprint is 0,
linked like any other; rows that repeat an id give a row each; a null id belongs
to its fingerprint's component but is never its smallest id (a component of null
ids only has a null component_id); other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharpsieve.llm.common import Scratch, encoded, free_name
from sharpsieve.operators.components import components

SEED, BITS, RADIUS, SHINGLE, BUCKET = 42, 64, 3, 3, 2048
ALL = (1 << BITS) - 1
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined + b" ", np.uint8) == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    last = min(shingle, len(words)) - 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + last : to + last].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, th (hash of the text), fp (as a signed long): a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in encoded(batches):
            fps = np.array([fingerprint(x, shingle) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["id", "th", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"id {kind}, th bigint, fp bigint")


def masks(radius: int = RADIUS, free: int = ALL) -> list[int]:
    """The covering masks of the bits set in free; the vectors are dealt out in turn, so each mask holds about half of them."""
    n = 1 << (radius + 1)
    spots = [i for i in range(BITS) if free >> i & 1]
    vectors = {i: 1 + k % (n - 1) for k, i in enumerate(spots)}
    return [sum(1 << i for i in spots if (vectors[i] & v).bit_count() % 2) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _covered(rows: DataFrame, helds: list[int], radius: int) -> DataFrame:
    """rows (fp, held: the bits in which its bucket agrees) once for each covering mask of the other bits."""
    kinds: Column = F.lit(None)
    for held in helds:
        more = sorted({_signed(held & ALL | m) for m in masks(radius, ~held & ALL)})
        kinds = F.when(F.col("held") == held, F.array(*map(F.lit, more))).otherwise(kinds)
    return rows.select("fp", F.explode(kinds).alias("held")).select("fp", "held", F.col("fp").bitwiseAND(F.col("held")).alias("key"))


def stars(distinct: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """a, b: in each bucket of each covering mask, the smallest fingerprint with the others that are within the radius.

    Every pair within the radius shares a bucket, but is given only where one of both is its smallest; links gives all that connects.
    """
    spread = _covered(distinct.select("fp", F.lit(0).cast("long").alias("held")), [0], radius)
    least = spread.groupBy("held", "key").agg(F.min("fp").alias("a"))
    met = spread.join(least, ["held", "key"]).where("fp != a").select("a", F.col("fp").alias("b"))
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join all fingerprints linked by pairs within the radius, fewer than there are fingerprints."""
    bits, left, out = fps.view(np.uint64), np.arange(len(fps)), []
    reached = np.zeros(len(fps), bool)
    while len(left):
        front = [int(left[0])]
        reached[front[0]] = True
        left = left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= radius
            new = left[near]
            out += [(int(fps[at]), int(fps[i])) for i in new]
            reached[new] = True
            front += new.tolist()
            left = left[~near]
    return out


def links(distinct: DataFrame, scratch: Scratch, *, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """distinct: column fp without repeats. Edges a, b (within the radius) that connect what pairs within the radius connect."""

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(np.unique(pdf["fp"].to_numpy(np.int64)), radius), columns=["a", "b"], dtype="int64")

    if not 0 <= radius <= 4:
        raise ValueError("radius has to be 0 to 4")
    bucket = max(bucket, 1 << (1 << radius) - 1)
    rows, level, helds, found = distinct.select("fp", F.lit(0).cast("long").alias("held")), 0, [0], []
    while helds:
        spread = _covered(rows, helds, radius)
        if level:
            spread = spread.distinct()
        sizes = spread.groupBy("held", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        sizes = scratch.write(sizes, f"sizes-{level}")
        found.append(sizes.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        some = sizes.where(f"n between 3 and {bucket}").select("held", "key")
        found.append(spread.join(some, ["held", "key"]).groupBy("held", "key").applyInPandas(joined, "a bigint, b bigint"))
        large = sizes.where(f"n > {bucket}").select("held", "key")
        helds = sorted(r.held for r in large.select("held").distinct().collect())  # masks, as many as the parameters allow
        if helds:
            level += 1
            rows = scratch.write(spread.join(large, ["held", "key"]).select("fp", "held"), f"rows-{level}")
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """id, th, fp (signed long), component_id, first_th: a row for each document; component_id and first_th name the component's first row."""
    scratch = Scratch(docs.sparkSession)
    marked = scratch.write(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fps")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    least = scratch.write(marked.groupBy("fp").agg(F.min(place).alias("least")), "least")
    roots = components(links(least.select("fp"), scratch, radius=radius, bucket=bucket), scratch)
    scratch.drop(*(f"{name}-{k}" for name in ("sizes", "rows") for k in range(BITS)))  # what links has written
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = scratch.write(named, "named")
    scratch.drop("least")
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    of = scratch.write(named.join(first, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.th").alias("first_th")), "of")
    scratch.drop("named")
    return marked.join(of, "fp").select("id", "th", "fp", "component_id", "first_th")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, unchanged: the first by id (nulls last), then by the text's hash, then by the other columns."""
    return keep_named(docs, near_duplicates(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options), id_col, text_col)


def keep_named(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that found (id, th, component_id, first_th) names first in their component, once each."""
    first = found.where(F.col("id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th"))).select(F.col("id").alias("_first_id"), F.col("th").alias("_first_th")).distinct()
    none, value, text = free_name(docs, "none"), free_name(docs, "value"), free_name(docs, "th")
    keyed = docs.withColumns({none: F.col(id_col).isNull(), value: F.xxhash64(id_col), text: F.xxhash64(text_col)})
    keys = first.select(F.col("_first_id").isNull().alias("_none"), F.xxhash64("_first_id").alias("_value"), F.col("_first_th").alias("_text"))
    kept = keyed.join(keys, (keyed[none] == keys["_none"]) & (keyed[value] == keys["_value"]) & (keyed[text] == keys["_text"]), "left_semi")
    others = [c for c, kind in docs.dtypes if c not in (id_col, text_col) and not kind.startswith(("map", "variant"))]
    number = free_name(docs, "number")
    once = kept.withColumn(number, F.row_number().over(W.partitionBy(none, value, text).orderBy(id_col, *others))).where(F.col(number) == 1)
    return once.select(*docs.columns)
