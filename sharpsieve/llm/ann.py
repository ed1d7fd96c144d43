"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree grows with the table. It is fitted on a bounded sample first (`most` vectors in
expectation, drawn by hash): each node splits its vectors into `branch` clusters until a
leaf has about `leaf` rows of the table. Every vector is put into its leaf; a leaf that
then holds more than `LARGE * leaf` rows is split again in a task of its own, on a sample
of at most `SPLIT` of its rows in expectation, and so on until none is larger, can't be
split (equal vectors), or the tree has MAX_LEAVES leaves; beyond them leaves get larger.
A query walks the tree best bin first: a priority queue holds the branches not taken, by
distance, and gives the leaves in the order in which they are visited. How many leaves
are visited is calibrated: a bounded set of queries is searched exactly, in blocks over
all rows, and visits are widened until the share of their true neighbours that lie in
visited leaves reaches `recall`. A query goes on beyond that until its leaves hold more
than k rows, so it gets k neighbours whenever there are as many.

A leaf's rows, and the queries that visit it, are dealt out in chunks of a bounded
number, so a leaf that holds a third of all rows is many groups. Each pair of chunks
of a leaf gives the k best for each query; these are merged. Cosines are computed in double precision from
the original vectors; equal cosines go by smaller vec_id.

Defined results: vectors that are null, zero, or hold null or non-finite components,
or are of another length than the most frequent (the larger of equally frequent
ones), take no part, nor do null ids; equal rows count once, and of rows that share an
id the one with the smallest vector; rows of the query's own id are never its neighbours; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sharpsieve.llm.common import Scratch

K, BRANCH, LEAF, MOST, CALIBRATE, RECALL, CHUNK, ROUNDS = 5, 16, 256, 32768, 256, 0.94, 8192, 10
LARGE, SPLIT, MAX_LEAVES = 4, 4096, 1 << 17


@dataclass
class Tree:
    """centres[n]: of node n's children; children[n]: their node numbers, negative for leaf -1 - number."""

    centres: list[np.ndarray]
    children: list[list[int]]
    n_leaves: int

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit row."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
            elif len(own):
                best = np.argmax(rows[own] @ self.centres[node].T, axis=1)
                todo += [(child, own[best == j]) for j, child in enumerate(self.children[node])]
        return out

    def visits(self, row: np.ndarray, most: int, sizes: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """The first `most` leaves, best bin first, and more until they hold `rows` rows; leaves without rows aren't counted. sizes: rows of each leaf."""
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < rows):
            _, node = heapq.heappop(queue)
            while node >= 0:
                far = np.sqrt(np.maximum(2 - 2 * (self.centres[node] @ row), 0))
                best = int(np.argmin(far))
                for j, child in enumerate(self.children[node]):
                    if j != best:
                        heapq.heappush(queue, (float(far[j]), child))
                node = self.children[node][best]
            if sizes is None:
                out.append(-1 - node)
            elif sizes[-1 - node]:
                out.append(-1 - node)
                held += int(sizes[-1 - node])
        return out

    def split(self, leaf: int, centres: np.ndarray, parents: dict[int, tuple[int, int]]) -> None:
        """A leaf becomes a node with a leaf for each centre."""
        at = len(self.centres)
        self.centres.append(centres)
        self.children.append([-(self.n_leaves + j + 1) for j in range(len(centres))])
        self.n_leaves += len(centres)
        node, j = parents.pop(leaf)
        self.children[node][j] = at
        parents |= {-1 - x: (at, j) for j, x in enumerate(self.children[at])}

    def parents(self) -> dict[int, tuple[int, int]]:
        """The node of each leaf, and its place there."""
        return {-1 - x: (node, j) for node, own in enumerate(self.children) for j, x in enumerate(own) if x < 0}


def _means(rows: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = rows[np.sort(rng.choice(len(rows), min(k, len(rows)), replace=False))]
    own = np.zeros(len(rows), np.int64)
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres, np.argmax(rows @ centres.T, axis=1)


def grow(rows: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 0) -> Tree:
    """A tree over unit rows without repeats."""
    rng, tree = np.random.default_rng(seed), Tree([], [], 0)

    def node(own: np.ndarray) -> int:
        centres, member = _means(own, branch, rng) if len(own) > leaf else (own[:1], np.zeros(len(own), np.int64))
        used = np.unique(member)
        if len(used) < 2 and tree.centres:
            tree.n_leaves += 1
            return -tree.n_leaves
        at = len(tree.centres)
        tree.centres.append(centres[used])
        tree.children.append([])
        for j in used:
            part = own[member == j]
            if len(used) < 2:
                tree.n_leaves += 1
                tree.children[at].append(-tree.n_leaves)
            else:
                tree.children[at].append(node(part))
        return at

    node(rows)
    return tree


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    peak = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(peak > 0, peak, 1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of one vector with each row, in double precision; equal rows get equal results wherever they stand."""
    q, r = query.astype(np.float64), rows.astype(np.float64)
    return np.clip((r * q).sum(axis=1) / (np.sqrt((r * r).sum(axis=1)) * np.sqrt((q * q).sum())), -1, 1)


def _best(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query id, id, cosine) of the k best rows for each query."""
    out, unit = [], _unit(rows)
    for at in range(0, len(queries), 256):
        near = _unit(queries[at : at + 256]) @ unit.T
        for j, q in enumerate(q_ids[at : at + 256]):
            own = near[j]
            own[ids == q] = -np.inf
            live = np.flatnonzero(own >= (np.partition(own, -k)[-k] if len(own) > k else -2) - 1e-9)
            exact = cosines(queries[at + j], rows[live])
            first = np.lexsort((ids[live], -exact))[:k]
            out += [(int(q), int(ids[live[i]]), float(exact[i])) for i in first]
    return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (floats as they are, else doubles): the rows that take part."""
    v = F.col(vector_col)
    if rows.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col(id_col).isNotNull() & fit).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _filled(usable: DataFrame, tree: Tree, scratch: Scratch, drawn, branch: int, leaf: int) -> tuple[DataFrame, np.ndarray]:
    """The rows with their leaves, and how many each leaf has; leaves that hold too many are split, which changes tree."""
    kind, spark = usable.schema["v"].dataType.simpleString(), usable.sparkSession

    def halves(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(_unit(_stack(pdf["v"])), axis=0)
        centres, member = _means(own, branch, np.random.default_rng(0))
        used = np.unique(member)
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[0], "j": used, "centre": list(centres[used])})

    index, level, whole = None, 0, set()
    while True:
        sent = spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf[["id", "v"]].assign(leaf=sent.value.leaf(_unit(_stack(pdf["v"]))))

        last, index = index, scratch.write(usable.mapInPandas(place, f"id long, v {kind}, leaf long"), f"index-{level}")
        if last is not None:
            scratch.drop(f"index-{level - 1}")
        held = np.zeros(tree.n_leaves, np.int64)
        for r in index.groupBy("leaf").count().collect():  # as many rows as the tree has leaves
            held[r.leaf] = r["count"]
        large = [int(x) for x in np.flatnonzero(held > LARGE * leaf) if x not in whole]
        large = large[: max(0, (MAX_LEAVES - tree.n_leaves) // branch)]
        if not large:
            return index, held
        shares = spark.createDataFrame([(x, min(1.0, SPLIT / int(held[x]))) for x in large], "leaf long, share double")
        own = index.join(F.broadcast(shares), "leaf").where(drawn(F.col("share")))
        found = own.select("leaf", "v").groupBy("leaf").applyInPandas(halves, "leaf long, j long, centre array<double>").orderBy("leaf", "j").toPandas()
        parents = tree.parents()
        for x, part in found.groupby("leaf"):
            if len(part) > 1:
                tree.split(int(x), _stack(part["centre"]), parents)
        split = set(found.loc[found.duplicated("leaf"), "leaf"].astype(int))
        whole |= set(large) - split
        if not split:
            return index, held
        level += 1


def search(
    rows: DataFrame,
    is_query: Column,
    *,
    k: int = K,
    branch: int = BRANCH,
    leaf: int = LEAF,
    most: int = MOST,
    calibrate: int = CALIBRATE,
    recall: float = RECALL,
    chunk: int = CHUNK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score. is_query says which ids (column id) are queries. report gets leaves, visits and calibrated recall."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    usable = _usable(rows, id_col, vector_col)
    sizes = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    usable = scratch.write(usable.where(F.size("v") == sizes[0].d).groupBy("id").agg(F.min("v").alias("v")), "usable")
    total = usable.count()

    def drawn(share: Column) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.lit(1 << 40)) / float(1 << 40) < share

    sample = usable.where(drawn(F.lit(min(1.0, most / total)))).select("v").toPandas()
    sample = np.unique(_stack(sample["v"]), axis=0) if len(sample) else np.ones((1, sizes[0].d))
    tree = grow(_unit(sample), branch, max(1, round(leaf * len(sample) / total)))
    index, held = _filled(usable, tree, scratch, drawn, branch, leaf)
    scratch.drop("usable")  # the index has its rows
    sent = spark.sparkContext.broadcast((tree, held))
    queries = index.where(is_query)

    # calibration: exact neighbours of some queries, and the leaves in which they lie
    few = queries.orderBy(F.xxhash64("id"), "id").limit(calibrate).toPandas()
    if not len(few):
        return spark.createDataFrame([], schema)
    q_ids, q_rows = few["id"].to_numpy(), _stack(few["v"])
    test = spark.sparkContext.broadcast((q_ids, q_rows))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ids = pdf["id"].to_numpy()
                own = pd.DataFrame(_best(*test.value, ids, _stack(pdf["v"]), k), columns=["query_id", "id", "score"])
                yield own.merge(pdf[["id", "leaf"]].drop_duplicates("id"), on="id")

    partial = index.mapInPandas(exact, "query_id long, id long, score double, leaf long")
    truth = _merged(partial.select("query_id", "id", "score", "leaf"), k).toPandas()
    order = {int(q): {x: i + 1 for i, x in enumerate(tree.visits(r, tree.n_leaves, held))} for q, r in zip(q_ids, _unit(q_rows), strict=True)}
    needed = np.sort([order[q][x] for q, x in zip(truth["query_id"], truth["leaf"], strict=True)])
    n_visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1
    if report is not None:
        report |= {"leaves": int((held > 0).sum()), "largest": int(held.max()), "visits": n_visits, "recall": float((needed <= n_visits).mean()) if len(needed) else 1.0}

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q, v, unit in zip(pdf["id"], pdf["v"], _unit(_stack(pdf["v"])) if len(pdf) else [], strict=True):
                leaves = sent.value[0].visits(unit, n_visits, sent.value[1], k + 1)
                yield pd.DataFrame({"leaf": leaves, "query_id": q, "q": [v] * len(leaves)})

    asked = scratch.write(queries.select("id", "v").mapInPandas(visit, f"leaf long, query_id long, q {index.schema['v'].dataType.simpleString()}"), "asked")
    parts = [x.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(n)) for x, n in ((index, "n_rows"), (asked, "n_asked"))]
    parts = F.broadcast(parts[0].join(parts[1], "leaf"))  # as many rows as the tree has leaves
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = index.join(parts, "leaf").select("leaf", F.pmod(F.xxhash64("id"), "n_rows").cast("int").alias("a"), spread("n_asked").alias("b"), "id", "v")
    asked = asked.join(parts, "leaf").select("leaf", spread("n_rows").alias("a"), F.pmod(F.xxhash64("query_id"), "n_asked").cast("int").alias("b"), "query_id", "q")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = _best(right["query_id"].to_numpy(), _stack(right["q"]), left["id"].to_numpy(), _stack(left["v"]), k) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "id", "score"])

    met = dealt.groupBy("leaf", "a", "b").cogroup(asked.groupBy("leaf", "a", "b")).applyInPandas(meet, "query_id long, id long, score double")
    return _merged(met, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with their rank; each task keeps k a query before they meet."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
