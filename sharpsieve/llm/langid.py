"""Language identification by nearest centroid.

A text's vector: hashed byte n-grams (1 to 4) of its lower-cased letters, each
log(1 + count) times the feature's inverse document frequency, at unit length.
Document frequencies are counted over all learned documents. Each language gets up
to `centroids` centroids by spherical k-means on a bounded sample of its documents
(`per_lang` in expectation, drawn by a hash of id and text; rows that are drawn alike
count once, and each language has its first row by that hash in any case), in a task for
each language. All language values are learned; their centroids are scored in blocks of
`BLOCK_LANGS` languages. A text gets the language of the centroid of largest cosine
(ties: the first language in order), and is `rejected` if it is farther than nearly all
of that centroid's own members. A letter is what Unicode calls one (categories L*).

Defined results: null texts and texts without a letter get `und`, score 0 and
rejected; without any learned language every text does; null languages aren't
learned; rows that repeat an id are scored each; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharpsieve.llm.common import Scratch, decoded
from sharpsieve.llm.ngrams import byte_grams, pieces

DIM_BITS, CENTROIDS, PER_LANG, BLOCK_LANGS, ROUNDS, SLACK = 13, 4, 400, 128, 8, 0.05
DIM = 1 << DIM_BITS
UNKNOWN = "und"
_SHIFT = np.uint64(64 - DIM_BITS)
_ascii_letter = re.compile(r"[A-Za-z]")
#: ASCII that isn't a letter becomes a space.
_CLEAN = bytes(x if x > 127 or chr(x).isalpha() else 32 for x in range(256))


def has_letter(text: str) -> bool:
    return bool(_ascii_letter.search(text)) or any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each feature occurs."""
    out = np.zeros(DIM, np.int64)
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN) + b" "
    for n in (1, 2, 3, 4):
        for part in pieces(data, n - 1):
            out += np.bincount((byte_grams(part, n) >> _SHIFT).astype(np.int64), minlength=DIM)
    return out


@dataclass
class Block:
    """The centroids of some languages, one column each."""

    langs: list[str]
    centres: np.ndarray
    least: np.ndarray


@dataclass
class Model:
    idf: np.ndarray
    blocks: list[Block] = field(default_factory=list)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The features of a text and their values, at unit length."""
        n = counts(text)
        ids = np.flatnonzero(n)
        values = (np.log1p(n[ids]) * self.idf[ids]).astype(np.float32)
        norm = float(np.sqrt(np.dot(values, values)))
        return ids, values / norm if norm > 0 else values

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, whether it is rejected."""
        if not self.blocks or not text or not has_letter(text):
            return UNKNOWN, 0.0, True
        ids, values = self.vector(text)
        found = (UNKNOWN, -1.0, True)
        for block in self.blocks:
            cosines = values @ block.centres[ids]
            best = int(np.argmax(cosines))
            if cosines[best] > found[1]:
                found = block.langs[best], float(cosines[best]), bool(cosines[best] < block.least[best])
        return found[0], min(max(found[1], 0.0), 1.0), found[2]


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows, from far-apart starts: centroids, and each row's."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        gap = np.maximum(1 - nearest, 0) ** 2
        if gap.sum() <= 1e-9:
            break
        chosen.append(int(rng.choice(len(rows), p=gap / gap.sum())))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, np.argmax(rows @ centres.T, axis=1)


def _frequencies(learned: DataFrame) -> tuple[np.ndarray, int]:
    """In how many learned texts each feature occurs, and how many there are. Each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIM, np.int64), 0
        for _, found in decoded(batches):
            for x in found:
                seen += counts(x) > 0
            n += len(found)
        ids = np.flatnonzero(seen)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*ids, -1], pa.int32()), pa.array([*seen[ids], n], pa.int64())], names=["feature", "n"])

    rows = learned.select("_text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    got = {r.feature: r.n for r in rows}
    return np.array([got.get(i, 0) for i in range(DIM)], float), got.get(-1, 0)


def train(
    docs: DataFrame, *, learn: Column | None = None, centroids: int = CENTROIDS, per_lang: int = PER_LANG, block_langs: int = BLOCK_LANGS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id"
) -> Model:
    """learn: which rows of docs may be learned (default: all)."""
    learned = (docs if learn is None else docs.where(learn)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    learned = learned.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    draw = F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 40)) / float(1 << 40)
    learned = learned.select("_text", "_lang", draw.alias("_draw"))
    seen, n = _frequencies(learned)
    model = Model(np.log((1 + n) / (1 + seen)) + 1)
    if not n:
        return model
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rates = learned.groupBy("_lang").agg(F.greatest(F.min("_draw"), F.lit(float(per_lang)) / F.count(F.lit(1))).alias("_rate"))
    rates = scratch.write(rates, "rates")  # a table of known size: it is broadcast if that is small
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in decoded(batches):
            pairs = [sent.value.vector(x) for x in found]
            cols = [batch.column("_lang"), pa.array([i.astype(np.uint16).tobytes() for i, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "ids", "vals"])

    def centre(own: pd.DataFrame) -> pd.DataFrame:
        """A language's centroids, and how near nearly all of their members are."""
        rows = sorted(zip(own["ids"], own["vals"], strict=True))
        dense = np.zeros((len(rows), DIM), np.float32)
        for k, (ids, values) in enumerate(rows):
            dense[k, np.frombuffer(ids, np.uint16)] = np.frombuffer(values, np.float32)
        centres, member = cluster(dense, centroids)
        used = [(c, dense[member == j] @ c) for j, c in enumerate(centres) if (member == j).any()]
        return pd.DataFrame([(own["lang"].iloc[0], j, c.astype(np.float32).tobytes(), float(np.quantile(near, 0.01)) - SLACK) for j, (c, near) in enumerate(used)], columns=["lang", "k", "centre", "least"])

    drawn = learned.join(rates, "_lang").where(F.col("_draw") <= F.col("_rate")).groupBy("_lang", "_draw").agg(F.min("_text").alias("_text"))
    vectors = drawn.select("_text", "_lang").mapInArrow(run, "lang string, ids binary, vals binary")
    got = vectors.groupBy("lang").applyInPandas(centre, "lang string, k int, centre binary, least double")
    got = scratch.write(got, "centroids").orderBy("lang", "k")
    part: list = []
    for r in got.toLocalIterator():
        if part and r.lang != part[-1].lang and len({x.lang for x in part}) == block_langs:
            model.blocks.append(_block(part))
            part = []
        part.append(r)
    if part:
        model.blocks.append(_block(part))
    return model


def _block(rows: list) -> Block:
    centres = np.ascontiguousarray(np.stack([np.frombuffer(r.centre, np.float32) for r in rows], axis=1))
    return Block([r.lang for r in rows], centres, np.array([r.least for r in rows]))


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected: a row for each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in decoded(batches):
            got = [sent.value.predict(x) for x in found]
            cols = [batch.column(0), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return chosen.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean")
