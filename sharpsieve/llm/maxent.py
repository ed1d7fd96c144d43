"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(slot | class, history) * P(word | slot).
Words fall into classes by spelling: centroids of byte n-grams, clustered over the most
frequent words; the end of a text is a class of its own. In its class a word has a slot:
each of the class's most frequent words has one to itself, so that its probability
given class and history is the softmax's alone; the others share `REST` slots by their
last letters, and in a slot go by unigrams (c + 0.5 for a word, 0.5 for what the slot
hasn't seen). Both softmaxes have hashed n-grams and skips of the history as features
(TABLES; those of the slots are crossed with the class), and one training fits both.

Texts are cut into blocks of tokens with a vocabulary each, written once; the words of
these vocabularies meet in one shuffle, get their corpus counts, classes and hashes,
and go back to their blocks as numbers, so a word is sent once a block and not once an
occurrence. Vocabularies are kept in pieces that tasks unpack one at a time, and numbers go
back many to a row, so the JVM never holds or sorts a block's words as rows. The words that classes are made from are the most frequent ones by their
counts in blocks that have them among their own first. Training takes all learned texts once, in `rounds` rounds: every task
runs Adagrad over its blocks from the same weights, and the updates are averaged by
how often each feature was seen, in a tree of bounded fan-in. Weights, class tables
and their updates have a fixed size (`ROW_BITS`, CLASSES, SLOTS); the vocabulary and
its counts, which grow with the corpus, stay distributed.

Defined results: a null text counts as empty, which is one token, the end; rows that
repeat an id are scored each (and counted each); a null id is scored like any other;
with nothing to learn from, N and V are 0; other columns aren't read. A text has to
fit into memory once, a table of any number of texts doesn't.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sharpsieve.llm.common import Scratch, encoded, release
from sharpsieve.llm.langid import cluster
from sharpsieve.llm.ngrams import byte_grams

#: Tokens in a block, bits of a feature table's rows, classes and slots in each, slots that words share, words that the classes are made from, a block's own first words, rounds.
BLOCK, ROW_BITS, CLASSES, SLOTS, REST, TOP, OWN_TOP, ROUNDS = 2_000_000, 13, 32, 32, 8, 8192, 2000, 2
#: The features of a history for classes: words, pairs of words, skips, and classes before; and for slots, each with the class.
TABLES = ("always", "word 1 before", "word 2 before", "words 1 and 2 before", "classes 1 to 3 before")
SLOT_TABLES = ("class", "class, word 1 before", "class, word 2 before")
#: START: what a row's squared gradients start from, so that rows seen seldom move little.
SPELL_BITS, BATCH, RATE, START, FAN, RUN = 10, 4096, 0.3, 10.0, 64, 1 << 18
ROWS = 1 << ROW_BITS
END = b"\n"
_M = np.uint32(0x9E3779B1)
#: Bits of a word's code: class, slot, hash, and whether it is counted in this block.
_CLASS, _SLOT, _HASH = 26, 21, 1
#: What goes back to a block for each of its words; bytes of a piece of a vocabulary, of which a word takes some besides its own.
KNOWN = np.dtype([("place", "<i4"), ("code", "<i4"), ("c", "<i8")])
PIECE, BESIDES = 1 << 19, 64


# --- blocks -----------------------------------------------------------------


def pack(tokens: np.ndarray) -> bytes:
    """Places as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=3).compress(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel()


def pieces(words: list[bytes], counts: np.ndarray) -> list[bytes]:
    """Words and their counts as compressed pieces: the first word's place and the number of words, lengths, counts, bytes."""
    lengths, out = np.array([len(w) for w in words], np.int64), []
    for a, b, _, _ in _runs(lengths + BESIDES, PIECE):
        head = np.concatenate(([a, b - a], lengths[a:b], counts[a:b])).astype("<i8")
        out.append(zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(words[a:b])))
    return out


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, piece): block, place, word, n, a batch for each piece."""
    for batch in batches:
        for block, piece in zip(batch.column("block").to_pylist(), batch.column("piece"), strict=True):
            raw = zstandard.ZstdDecompressor().decompress(piece.as_py())
            first, n = np.frombuffer(raw, "<i8", 2).tolist()
            lengths, counts = np.frombuffer(raw, "<i8", 2 * n, offset=16).reshape(2, n)
            ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw).slice(16 * (n + 1))])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(first, first + n, dtype=np.int32)), words, pa.array(counts)], names=["block", "place", "word", "n"])


def gathered(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = RUN) -> Iterator[pa.RecordBatch]:
    """Arrays of blocks and of KNOWN: at (the block), known (the bytes of all that goes to it), a row for each block of about `most` words."""

    def flush():
        at = np.concatenate([x for x, _ in held])
        order = np.argsort(at, kind="stable")
        at, rows = at[order], np.concatenate([x for _, x in held])[order]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = (np.append(starts, len(at)) * KNOWN.itemsize).astype(np.int32)
        known = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(at[starts]), known], names=["at", "known"])

    held, n = [], 0
    for at, rows in found:
        held.append((at, rows))
        n += len(at)
        if n >= most:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _blocks(docs: DataFrame, learn: Column, id_col: str, text_col: str, block: int) -> DataFrame:
    """block, ids, learned, lengths, tokens (places in words), words with counts in learned texts (in pieces), and its most frequent words."""
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 24) - 1

        def flush():
            own = np.concatenate(tokens)
            counts = np.bincount(own[np.repeat(flags, lengths)], minlength=len(places))
            found = list(places)
            first = np.argsort(-counts, kind="stable")[:OWN_TOP]
            first = first[counts[first] > 0]
            row = [[number], [flags], [lengths], [pack(own)], [pieces(found, counts)], [[found[i] for i in first]], [counts[first]]]
            kinds = [pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            cols = [pa.array(r, t) for r, t in zip(row, kinds, strict=True)]
            every = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays([cols[0], every.cast(pa.list_(arrow)), *cols[1:]], names=["block", "ids", "learned", "lengths", "tokens", "words", "top", "top_counts"])

        def fresh():
            found = defaultdict()
            found.default_factory = found.__len__
            found[END]
            return found, [], [], [], [], 0

        places, ids, flags, lengths, tokens, n = fresh()
        for batch, texts in encoded(batches):
            learned = batch.column("learned").to_pylist()
            for i, text in enumerate(texts):
                words = text.lower().split()
                own = np.zeros(len(words) + 1, np.int32)
                own[:-1] = list(map(places.__getitem__, words))
                ids.append(batch.column(0).slice(i, 1))
                flags.append(bool(learned[i]))
                lengths.append(len(own))
                tokens.append(own)
                n += len(own)
                if n >= block:
                    number += 1
                    yield flush()
                    places, ids, flags, lengths, tokens, n = fresh()
        if n:
            number += 1
            yield flush()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), learn.alias("learned"))
    return rows.mapInArrow(run, f"block long, ids array<{kind.simpleString()}>, learned array<boolean>, lengths array<long>, tokens binary, words array<binary>, top array<binary>, top_counts array<long>")


# --- classes ----------------------------------------------------------------


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams (1 to 3) of words, one word after the other, and each one's word."""
    data = b"\n" + b"\n\n".join(words) + b"\n"  # a feed at both ends of each word
    raw = np.frombuffer(data, np.uint8)
    feeds = np.flatnonzero(raw == 10)
    starts, ends = feeds[::2], feeds[1::2]
    owner = np.repeat(np.arange(len(words)), ends - starts + 1)
    grams, owners = [], []
    for n in (1, 2, 3):
        g = (byte_grams(data, n) >> np.uint64(64 - SPELL_BITS)).astype(np.int32)
        inside = owner[: len(g)] == owner[n - 1 : n - 1 + len(g)]
        grams.append(g[inside])
        owners.append(owner[: len(g)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(grams)[order], owners[order]


@dataclass
class Classes:
    """Centroids of spelling, and the slots of frequent words."""

    centres: np.ndarray
    slots: dict[bytes, int]

    @property
    def n(self) -> int:
        return self.centres.shape[1] + 1

    def of(self, words: list[bytes]) -> np.ndarray:
        """The class of each word; the end has the last."""
        out = np.zeros(len(words), np.int32)
        wide = np.pad(self.centres, ((0, 0), (0, self.centres.shape[1] % 2)))
        for at in range(0, len(words), 4096):
            part = [b"" if w == END else w for w in words[at : at + 4096]]
            grams, owners = spelling(part)
            sums = _run_sums(wide.take(grams, axis=0), np.searchsorted(owners, np.arange(len(part))))
            out[at : at + len(part)] = np.argmax(sums[:, : self.n - 1], axis=1)
        out[[i for i, w in enumerate(words) if w == END]] = self.centres.shape[1]
        return out

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Class, slot and hash of each word in one number."""
        rest = SLOTS - REST
        slots = np.array([s if (s := self.slots.get(w)) is not None else rest + zlib.crc32(w[-2:]) % REST for w in words], np.int32)
        hashes = np.array([zlib.crc32(w) & 0xFFFFF for w in words], np.int32)
        return self.of(words) << _CLASS | slots << _SLOT | hashes << _HASH


def make_classes(words: list[bytes], classes: int = CLASSES) -> Classes:
    """words: the most frequent first."""
    words = [w for w in words if w != END]
    if not words:
        return Classes(np.zeros((1 << SPELL_BITS, 1), np.float32), {})
    grams, owners = spelling(words)
    dense = np.zeros((len(words), 1 << SPELL_BITS), np.float32)
    np.add.at(dense, (owners, grams), 1)
    dense = np.log1p(dense)
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    made = Classes(np.ascontiguousarray(cluster(dense, classes - 1)[0].T, np.float32), {})
    held = defaultdict(int)
    for w, k in zip(words, made.of(words).tolist(), strict=True):
        if held[k] < SLOTS - REST:
            made.slots[w] = held[k]
            held[k] += 1
    return made


# --- the two softmaxes --------------------------------------------------------


def features(tokens: np.ndarray, hashes: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
    """The rows of both softmaxes' tables for each token of a block; texts end with token 0, which also stands before each."""

    def before(x: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], x[:-1])).astype(x.dtype)

    def row(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint32(32 - ROW_BITS)).astype(np.uint16)

    one = before(tokens)
    two = np.where(one == 0, 0, before(one))
    three = np.where(two == 0, 0, before(two))
    h1, h2 = hashes[one], hashes[two]
    k1, k2, k3, own = (classes[x].astype(np.uint32) for x in (one, two, three, tokens))
    pair = (h1 * np.uint32(31) + h2) * _M
    past = (k3 * np.uint32(256) + k2) * np.uint32(256) + k1
    of_class = (np.zeros(len(tokens), np.uint16), row(h1), row(h2), row((pair ^ pair >> np.uint32(15)) * _M), row((past + np.uint32(1)) * _M))
    crossed = [((h ^ h >> np.uint32(15)) + own * np.uint32(0x85EBCA6B)) * _M for h in (h1, h2)]
    return [np.stack(of_class), np.stack((own.astype(np.uint16), *(row(x ^ x >> np.uint32(13)) for x in crossed)))]


def _exps(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The unnormalised probabilities; sums of weights stay far below what a float holds, and are bounded here in any case."""
    out = weights[0].take(rows[0], axis=0)
    for weight, own in zip(weights[1:], rows[1:], strict=True):
        out += weight.take(own, axis=0)
    np.minimum(out, 80, out=out)
    return np.exp(out, out=out)


def log_softmax(weights: np.ndarray, rows: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The log probability (natural) of each goal."""
    out, ones = np.empty(len(goal)), np.ones(weights.shape[2], np.float32)
    for at in range(0, len(goal), BATCH):
        z = _exps(weights, rows[:, at : at + BATCH])
        own = z[np.arange(len(z)), goal[at : at + BATCH]]
        out[at : at + BATCH] = np.log(np.maximum(own, 1e-37)) - np.log(z @ ones)
    return out


def _run_sums(z: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; two floats are added at a time, as a complex number, where the width allows it."""
    if z.shape[1] % 2:
        return np.add.reduceat(z, starts, axis=0)
    return np.add.reduceat(z.view(np.complex64), starts, axis=0).view(np.float32)


def learn_batch(weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, rows: np.ndarray, goal: np.ndarray, rate: float) -> None:
    """One Adagrad step on the summed gradient of each row that a batch holds."""
    z = _exps(weights, rows)
    ones = np.ones(len(z), np.float32)
    z /= (z @ ones[: z.shape[1]])[:, None] if len(z) >= z.shape[1] else z.sum(axis=1, keepdims=True)
    z.ravel()[np.arange(len(z)) * z.shape[1] + goal] -= 1
    for own, weight, square, sight in zip(rows, weights, squares, seen, strict=True):
        if not own.any():  # all of one row
            used, sums, n = np.zeros(1, np.int64), (ones @ z)[None], len(z)
        else:
            order = np.argsort(own, kind="stable")
            own = own[order]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            used, sums, n = own[starts].astype(np.int64), _run_sums(z.take(order, axis=0), starts), np.diff(starts, append=len(own))
        sight[used] += n
        total = square.take(used, axis=0)
        total += sums * sums
        square[used] = total
        sums *= rate
        sums /= np.sqrt(total, out=total)
        weight[used] -= sums


def numbers(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, classes, slots and hashes of a block's words: all counts (64 bits each), then all codes (32)."""
    n = len(data) // 12
    codes = np.frombuffer(data, "<i4", offset=8 * n)
    return np.frombuffer(data, "<i8", n), codes >> _CLASS, codes >> _SLOT & 31, (codes >> _HASH & 0xFFFFF).astype(np.uint32) * _M


def _runs(lengths: list[int], most: int = RUN) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last, first token, last) of runs of whole texts of about `most` tokens, so that a block's features are never held all at once."""
    ends = np.cumsum(lengths)
    a = 0
    while a < len(ends):
        start = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, start + most, "right")))
        yield a, b, start, int(ends[b - 1])
        a = b


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """A row at a time, with its record."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row, row.to_pylist()[0]


def _row(record: dict, key: str, kind: type) -> np.ndarray:
    return np.frombuffer(record[key], kind)


def _updates(ready: DataFrame, weights: list[np.ndarray], part: int, rounds: int, rate: float) -> list[np.ndarray]:
    """For each softmax the mean updates of its tables' rows after a round, weighted by sights; its texts are every rounds-th of a block, from `part`."""
    sent = ready.sparkSession.sparkContext.broadcast(weights)
    step = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, squares = [w.copy() for w in sent.value], [np.full_like(w, START) for w in sent.value]
        seen = [np.zeros(w.shape[:2], np.int64) for w in now]
        for _, record in _rows(batches):
            tokens, (_, classes, slots, hashes) = unpack(record["tokens"]), numbers(record["words"])
            flags = np.array(record["learned"], bool) & (np.arange(len(record["learned"])) % rounds == part)
            lengths = np.array(record["lengths"], np.int64)
            mine, lengths = tokens[np.repeat(flags, lengths)], lengths[flags]
            for _, _, i, j in _runs(lengths):
                own = mine[i:j]
                for k, (rows, goal) in enumerate(zip(features(own, hashes, classes), (classes[own], slots[own]), strict=True)):
                    for at in range(0, len(goal), BATCH):
                        learn_batch(now[k], squares[k], seen[k], rows[:, at : at + BATCH], goal[at : at + BATCH], rate)
        task = TaskContext.get().partitionId()
        for k, start in enumerate(sent.value):
            for t in range(start.shape[0]):
                for at in range(0, ROWS, step):
                    n = seen[k][t, at : at + step]
                    if n.any():
                        delta = np.clip((now[k][t, at : at + step] - start[t, at : at + step]) * 1024, -60000, 60000).astype(np.float16)
                        place = (k * len(TABLES) + t) * ROWS + at
                        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([task], pa.int64()), pa.array([pack_halves(delta)], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=names)

    names = ["place", "task", "delta", "n"]

    def add(key, got):
        """The mean update of a run of rows, weighted by sights, and their sum."""
        delta, n = 0.0, 0
        for record in got.to_pylist():
            own = _row(record, "n", np.int64)
            delta, n = delta + halves(record["delta"], len(own)).astype(np.float64) * own[:, None], n + own
        mean = (delta / np.maximum(n, 1)[:, None]).astype(np.float16)
        row = [[key[0].as_py()], [key[1].as_py()], [pack_halves(mean)], [n.tobytes()]]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=names)

    schema = "place int, task long, delta binary, n binary"
    found, width = ready.mapInArrow(run, schema), ready.rdd.getNumPartitions()
    while width > 1:
        found = found.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("place", "task").applyInArrow(add, schema)
        width = -(-width // FAN)
    deltas = [np.zeros_like(w) for w in weights]
    for r in found.toLocalIterator():
        n = np.frombuffer(r.n, np.int64)
        t, at = divmod(r.place, ROWS)
        k, t = divmod(t, len(TABLES))
        deltas[k][t, at : at + len(n)] = halves(r.delta, len(n)).astype(np.float32) / 1024
    return deltas


def pack_halves(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 2).T.tobytes())


def halves(data: bytes, rows: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(2, -1).T).view(np.float16).reshape(rows, -1)


def start_weights(counts: np.ndarray) -> list[np.ndarray]:
    """Weights of both softmaxes that give the unigrams of classes, and of slots in them. counts: training tokens by class and slot."""
    n_classes, slots = counts.shape
    out = [np.zeros((len(TABLES), ROWS, n_classes), np.float32), np.zeros((len(SLOT_TABLES), ROWS, slots), np.float32)]
    out[0][0, 0] = np.log((counts.sum(axis=1) + 0.5) / (counts + 0.5 / slots).sum())
    out[1][0, :n_classes] = np.log((counts + 0.5 / slots) / (counts + 0.5 / slots).sum(axis=1, keepdims=True))
    return out


# --- the whole ----------------------------------------------------------------


def score(
    docs: DataFrame, *, learn: Column, classes: int = CLASSES, rounds: int = ROUNDS, rate: float = RATE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", report: dict | None = None
) -> DataFrame:
    """id, learned, n_tokens, n_known, train_tokens, base_score, score (both log10): a row for each document; learn says which are learned from. report gets the model."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType
    blocks = scratch.write(_blocks(docs, learn, id_col, text_col, block), "blocks")
    first = blocks.select(F.explode(F.arrays_zip("top", "top_counts")).alias("w")).groupBy(F.col("w.top").alias("word")).agg(F.sum("w.top_counts").alias("c"))
    named = make_classes([bytes(r.word) for r in first.orderBy(F.desc("c"), "word").limit(TOP).collect()], classes)
    n_classes, cells = named.n, named.n * SLOTS
    sent = spark.sparkContext.broadcast(named)

    words = blocks.select("block", F.explode("words").alias("piece")).mapInArrow(spread, "block long, place int, word binary, n long")
    same = W.partitionBy("word").orderBy("block")
    counted = words.select("block", "place", "word", F.sum("n").over(W.partitionBy("word")).alias("c"), (F.row_number().over(same) == 1).alias("here"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            coded = batch.column("word").dictionary_encode()  # equal words are neighbours
            found, spots = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            rows = np.empty(batch.num_rows, KNOWN)
            rows["place"], rows["c"] = batch.column("place").to_numpy(), batch.column("c").to_numpy()
            rows["code"] = sent.value.codes(found)[spots] | batch.column("here").to_numpy(zero_copy_only=False)
            yield batch.column("block").to_numpy().copy(), rows

    known = counted.mapInArrow(lambda batches: gathered(classify(batches)), "at long, known binary")
    schema = f"ids array<{kind.simpleString()}>, learned array<boolean>, lengths array<long>, tokens binary, words binary, cell_n array<long>, cell_v array<long>"
    kinds = {"ids": pa.list_(to_arrow_type(kind)), "learned": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "tokens": pa.binary(), "words": pa.binary(), "cell_n": pa.list_(pa.int64()), "cell_v": pa.list_(pa.int64())}

    def ready_block(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        rows = np.frombuffer(b"".join(right.column("known").to_pylist()), KNOWN)
        rows = rows[np.argsort(rows["place"], kind="stable")]
        c, codes = rows["c"], rows["code"]
        mine = (codes & 1 > 0) & (c > 0)
        cell = (codes >> _CLASS)[mine] * SLOTS + (codes >> _SLOT & 31)[mine]
        totals = [np.bincount(cell, weights=w, minlength=cells).astype(np.int64) for w in (c[mine], None)]
        packed = c.astype("<i8").tobytes() + codes.astype("<i4").tobytes()
        cols = [*(left.column(x).cast(kinds[x]) for x in ("ids", "learned", "lengths", "tokens")), pa.array([packed], pa.binary()), *(pa.array([x], pa.list_(pa.int64())) for x in totals)]
        return pa.Table.from_arrays(cols, names=list(kinds))

    own = blocks.select("block", "ids", "learned", "lengths", "tokens")
    ready = scratch.write(own.groupBy("block").cogroup(known.groupBy("at")).applyInArrow(ready_block, schema), "ready")
    scratch.drop("blocks")
    by_cell = ready.select(F.posexplode(F.arrays_zip("cell_n", "cell_v")).alias("k", "t")).groupBy("k").agg(F.sum("t.cell_n").alias("n"), F.sum("t.cell_v").alias("v")).collect()
    cell_n, cell_v = np.zeros(cells), np.zeros(cells)
    for r in by_cell:
        cell_n[r.k], cell_v[r.k] = r.n, r.v
    del blocks, words, counted, known, own, first
    release(spark)

    weights = start_weights(cell_n.reshape(n_classes, SLOTS))
    for part in range(rounds):
        weights = [w + d for w, d in zip(weights, _updates(ready, weights, part, rounds, rate), strict=True)]
    model = spark.sparkContext.broadcast(weights)
    big_n = int(cell_n.sum())
    all_n = float(np.log10(big_n + 0.5 * (cell_v.sum() + 1)))
    cell_log = np.log10(cell_n + 0.5 * (cell_v + 1))
    if report is not None:
        report |= {"weights": weights, "classes": named, "cell_n": cell_n, "cell_v": cell_v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, record in _rows(batches):
            tokens, (c, classes, slots, hashes) = unpack(record["tokens"]), numbers(record["words"])
            word, lengths = np.log10(c + 0.5), record["lengths"]
            inside = word - cell_log[classes * SLOTS + slots]
            sums = []
            for a, b, i, j in _runs(lengths):
                own = tokens[i:j]
                starts = np.concatenate(([0], np.cumsum(lengths[a:b])[:-1])).astype(np.int64)
                chosen = sum(log_softmax(w, rows, goal[own]) for w, rows, goal in zip(model.value, features(own, hashes, classes), (classes, slots), strict=True))
                values = (c > 0).astype(np.int64)[own], (word - all_n)[own], inside[own] + chosen / np.log(10)
                sums.append([np.add.reduceat(x, starts) for x in values])
            n_known, base, score_ = (np.concatenate(x) for x in zip(*sums, strict=True))
            ids = row.column("ids").flatten()
            cols = [ids, pa.array(record["learned"], pa.bool_()), pa.array(lengths, pa.int64()), pa.array(n_known), pa.array(np.full(len(ids), big_n, np.int64)), pa.array(base), pa.array(score_)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "learned", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(run, f"id {kind.simpleString()}, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
