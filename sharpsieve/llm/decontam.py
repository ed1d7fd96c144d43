r"""Benchmark decontamination by template windows.

Tokens are runs of letters, and numbers. A token's canonical form is ``<num>`` for a
number, ``<unit>`` for a unit of measure after a number, ``<name>`` for a capitalised
word (Xxxx) that isn't one of OPENERS, else the lower-cased word; where a token stands
in its sentence doesn't matter. Each run of `window` tokens of an item (all its tokens
if it has fewer) is a window with two keys: its lower-cased words as they are, and, if it
has at least `literals` words that are no slots, its canonical forms. So a copy always
meets its item, and a re-parameterised item does where enough of its words stayed.

Slots are checked over a document's whole meeting with an item: every window that is
hit proposes what the item's slot values have become; each value is bound to the
document value that most windows propose (ties: the first in the text). A canonical hit
counts if its slots agree with that one map from item to document; two item values may
become one. Hits of the words as they are always count. The coverage is the share of
the item's windows with a hit that counts: of those with a canonical key, or of all
windows by words alone, whichever is larger. `coverage` of it makes a report.

Both sides are tables of windows, joined by key. Before, a bit table of bounded size
(at most 2^BITS bits) of the benchmark's windows drops the windows of documents that
can't meet any. First only rare windows are joined: a document that covers an item hits
one of its n - ceil(coverage * n) + 1 rarest windows, so a phrase that a million items
share doesn't pair them all with every document that has it. Pairs found that way then
look up all windows. Nothing of the benchmark but the bit table is on the driver.

Defined results: null texts count as empty; an item of fewer than `least` tokens
takes no part; items that repeat an item_id with another text are items of their
own, equal rows one item; a row that repeats a document is reported again; null
ids are passed on; other columns are ignored; empty tables give no rows. A text and an
item have to fit into a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sharpsieve.llm.common import Scratch, decoded

WINDOW, LITERALS, LEAST, COVERAGE = 8, 4, 4, 0.6
#: Bits of the largest bit table; smaller benchmarks get at least SPARE bits a window.
BITS, SPARE = 27, 1024
#: Units of measure that count after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec min h hr second seconds minute minutes hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars cent cents euro euros percent degrees kb mb gb tb hz khz mhz ghz w kw v a j kj cal kcal mph kph".split()
)
#: Words that a capital doesn't make names.
OPENERS = frozenset(
    "a about after all also an and any are as at be because before both but by can could did do does each every find first for from given had has have he her here his how i if in into is it its "
    "let many may more most much my no not now of on one or our out over she should so some such than that the their then there these they this those to two under until was we were what when "
    "where which while who whom whose why will with would you your".split()
)
SLOTS = ("<num>", "<unit>", "<name>")
_tokens = re.compile(r"[^\W\d_]+|\d+(?:[.,:]\d+)*")
_BASE, _NUMBER, _UNIT, _NAME = np.uint64(0x9E3779B97F4A7C15), 1, 2, 4


def canonical(text: str) -> list[tuple[str, str]]:
    """(canonical form, lower-cased word) of each token; the plain statement of the rule, for items and hits."""
    out, number = [], False
    for word in _tokens.findall(text):
        low = word.lower()
        after, number = number, word[0].isdigit()
        name = len(word) > 1 and word[0].isupper() and word[1:].islower() and low not in OPENERS
        out.append(("<num>" if number else "<unit>" if after and low in UNITS else "<name>" if name else low, low))
    return out


class Codes(dict):
    """The number of each word, and by these numbers its hash and what it can be a slot of."""

    MOST = 1 << 20

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint8)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.kinds):
            self.hashes, self.kinds = (np.concatenate((x, np.zeros_like(x))) for x in (self.hashes, self.kinds))
        low = word.lower()
        name = len(word) > 1 and word[0].isupper() and word[1:].islower() and low not in OPENERS
        self.hashes[n] = xxhash.xxh64_intdigest(low)
        self.kinds[n] = _NUMBER if word[0].isdigit() else (_UNIT if low in UNITS else 0) | (_NAME if name else 0)
        self[word] = n
        return n

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words as they are, and of their canonical forms."""
        if len(self) > self.MOST:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        plain, kinds = self.hashes[numbers], self.kinds[numbers]
        number = kinds & _NUMBER > 0
        forms = np.where(kinds & _NAME > 0, np.uint64(3), plain)
        forms[1:][number[:-1] & (kinds[1:] & _UNIT > 0)] = 2
        forms[number] = 1
        return plain, forms


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` ids."""
    n = len(ids) - size + 1
    out, mixed = np.full(max(n, 0), size, np.uint64), (ids + np.uint64(1)) * _BASE
    mixed ^= mixed >> np.uint64(29)
    for k in range(size):
        out = (out ^ mixed[k : k + n]) * np.uint64(0x100000001B3) + (out >> np.uint64(47))
    return out * _BASE


def _join(parts) -> str:
    return " ".join(parts)


def _item_windows(benchmark: DataFrame, window: int, literals: int, least: int) -> DataFrame:
    """item (a number), item_id, i, key, kind (0: words, 1: forms), words, h, n_all, n_forms: the windows of the distinct items."""
    kind = benchmark.schema["item_id"].dataType
    names = ["item", "item_id", "i", "key", "kind", "words", "h", "n_all", "n_forms"]
    types = [pa.int64(), to_arrow_type(kind), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch, texts in decoded(batches):
            at, rows = [], []
            for k, text in enumerate(texts):
                tokens = canonical(text)
                if len(tokens) < least:
                    continue
                size = min(window, len(tokens))
                plain, forms = (rolling(x, size).view(np.int64).tolist() for x in codes.of(_tokens.findall(text)))
                spans = [tokens[i : i + size] for i in range(len(plain))]
                rich = [sum(f not in SLOTS for f, _ in s) >= min(literals, size) for s in spans]
                rich = rich if any(rich) else [True] * len(spans)
                for i, s in enumerate(spans):
                    said = _join(w for _, w in s)
                    rows.append((i, said, 0, said, plain[i], len(spans), sum(rich)))
                    if rich[i]:
                        rows.append((i, _join(f for f, _ in s), 1, said, forms[i], len(spans), sum(rich)))
                at += [k] * (len(rows) - len(at))
            spots = pa.array(at, pa.int64())
            cols = [batch.column(0).take(spots), batch.column(1).take(spots), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types[2:]))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("_text")).distinct()
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "_text")
    return numbered.mapInArrow(run, f"item long, item_id {kind.simpleString()}, i int, key string, kind int, words string, h long, n_all int, n_forms int")


def _bit_table(windows: DataFrame) -> np.ndarray:
    """The bits of the windows' hashes, as 64-bit words; its size follows the number of windows up to 2^BITS bits."""
    n = windows.count()
    bits = min(BITS, max(10, math.ceil(math.log2(max(n, 1) * SPARE))))
    spot = F.shiftrightunsigned("h", 64 - bits)
    got = windows.groupBy(F.shiftright(spot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, %d) & 63 as int))" % (64 - bits))).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out


def _in(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes >> np.uint64(64 - 6 - (len(table) - 1).bit_length())
    return table[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1) > 0


def _text_windows(docs: DataFrame, table: np.ndarray, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """doc (a number), id, t1, t2 (hashes of the text), at, key, words: the windows of documents that may meet an item's."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    names = ["doc", "id", "t1", "t2", "at", "key", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch, texts in decoded(batches):
            spots, rows = [], []
            for k, text in enumerate(texts):
                tokens = _tokens.findall(text)
                plain, forms = codes.of(tokens)
                for size in sizes:
                    if len(tokens) < size:
                        continue
                    as_is, as_form = rolling(plain, size), rolling(forms, size)
                    hit = [_in(sent.value, x) for x in (as_is, as_form)]
                    hit[1] &= as_is != as_form
                    for kind, found in enumerate(hit):
                        for i in np.flatnonzero(found).tolist():
                            own = canonical(" ".join(tokens[max(0, i - 1) : i + size]))[-size:]
                            said = _join(w for _, w in own)
                            rows.append((i, _join(f for f, _ in own) if kind else said, said))
                spots += [k] * (len(rows) - len(spots))
            taken = pa.array(spots, pa.int64())
            cols = [*(batch.column(x).take(taken) for x in range(4)), *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int32(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("_text"))
    return rows.mapInArrow(run, f"doc long, id {kind}, t1 long, t2 long, at int, key string, words string")


def judged(hits: list[tuple[int, int, int, str, str, str]], n_all: int, n_forms: int, rich: set[int]) -> tuple[int, float, int, int]:
    """(windows that count, coverage, first token, slot values changed) of one document's meeting with one item.

    hits: (window of the item, place in the text, kind, canonical forms, the item's words, the document's).
    """
    votes: dict[str, Counter] = defaultdict(Counter)
    first: dict[tuple[str, str], int] = {}
    holds = []
    for i, at, kind, forms, own, said in hits:
        pairs = {(a, b) for f, a, b in zip(forms.split(" "), own.split(" "), said.split(" "), strict=True) if f in SLOTS}
        holds.append(pairs)
        for a, b in pairs:
            votes[a][b] += 1
            first[a, b] = min(first.get((a, b), at), at)
    bound = {a: min(own, key=lambda b, a=a, own=own: (-own[b], first[a, b], b)) for a, own in votes.items()}
    counted, plain, start = set(), set(), None
    used: set[str] = set()
    for (i, at, kind, *_), pairs in zip(hits, holds, strict=True):
        if kind == 0 or all(bound[a] == b for a, b in pairs):
            counted.add(i)
            plain |= {i} if kind == 0 else set()
            start = at - i if start is None else min(start, at - i)
            used |= {a for a, b in pairs if kind and a != b}
    return len(counted), max(len(plain) / n_all, len(counted & rich) / n_forms), max(start or 0, 0), len(used)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, literals: int, least: int, coverage: float, id_col: str, text_col: str) -> DataFrame:
    """id, t1, t2, item_id, n_windows, coverage, first_token, slots_changed: a row for each document and item found in it."""
    scratch = Scratch(docs.sparkSession)
    kinds = docs.schema[id_col].dataType, benchmark.schema["item_id"].dataType
    theirs = scratch.write(_item_windows(benchmark, window, literals, least), "items")
    sizes = sorted(r.n for r in theirs.select(F.size(F.split("words", " ")).alias("n")).distinct().collect())  # from least to window
    ours = scratch.write(_text_windows(docs, _bit_table(theirs), sizes, id_col, text_col), "texts")

    # rare windows: each item's positions by how many windows share their key
    shared = theirs.join(theirs.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    size = F.when(F.col("kind") == 1, F.col("n_forms")).otherwise(F.col("n_all"))
    rank = F.row_number().over(W.partitionBy("item", "kind").orderBy("n", "i"))
    ranked = shared.withColumn("rare", rank <= size - F.ceil(size * coverage - 1e-9) + 1)
    rare = ranked.select("item", "key", F.max("rare").over(W.partitionBy("item", "i")).alias("rare")).where("rare").drop("rare")  # by either key of a position
    met = ours.select("doc", "key").distinct().join(rare, "key").select("doc", "item").distinct()

    keys = met.join(theirs, "item").select("doc", "item", "item_id", "i", "key", "kind", F.col("words").alias("own"), "n_all", "n_forms")
    hits = keys.join(ours, ["doc", "key"])
    grouped = hits.groupBy("doc", "item").agg(
        *(F.any_value(x).alias(x) for x in ("id", "t1", "t2", "item_id", "n_all", "n_forms")), F.collect_list(F.struct("i", "at", "kind", "key", "own", "words")).alias("hits")
    )
    rich = theirs.where("kind = 1").groupBy("item").agg(F.collect_list("i").alias("rich"))
    names = ["id", "t1", "t2", "item_id", "n_windows", "coverage", "first_token", "slots_changed"]
    types = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keep = [], []
            for k, r in enumerate(batch.select(["n_all", "n_forms", "hits", "rich"]).to_pylist()):
                hits = [(h["i"], h["at"], h["kind"], h["key"], h["own"], h["words"]) for h in r["hits"]]
                n, share, first, changed = judged(hits, r["n_all"], r["n_forms"], set(r["rich"]))
                if share >= coverage - 1e-9:
                    keep.append(k)
                    rows.append((n, share, first, changed))
            spots = pa.array(keep, pa.int64())
            cols = [batch.column(x).take(spots) for x in names[:4]] + [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"id {kinds[0].simpleString()}, t1 long, t2 long, item_id {kinds[1].simpleString()}, n_windows long, coverage double, first_token long, slots_changed long"
    return grouped.join(rich, "item").mapInArrow(run, schema)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, literals: int = LITERALS, least: int = LEAST, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, item_id, n_windows, coverage, first_token, slots_changed: a row for each document and item found in it."""
    return _found(docs, benchmark, window, literals, least, coverage, id_col, text_col).drop("t1", "t2")


def remove_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    literals: int = LITERALS,
    least: int = LEAST,
    coverage: float = COVERAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs without those in which an item was found: rows whose text (by two 64-bit hashes) has a leak."""
    leaky = _found(docs, benchmark, window, literals, least, coverage, id_col, text_col).select("t1", "t2").distinct()
    return docs.join(leaky, (F.xxhash64(docs[text_col]) == leaky["t1"]) & (F.xxhash64(F.lit(1), docs[text_col]) == leaky["t2"]), "left_anti")
