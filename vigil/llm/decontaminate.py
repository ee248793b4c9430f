"""Benchmark decontamination: item-sized windows, SimHash with multi-index Hamming blocks, exact verification.

Texts and items are lower-cased and cut into runs of letters and digits, so case and punctuation don't hide a leak; a
shingle is five words (a shorter item is one shingle). For an item of n words, windows of n words get a 64-bit SimHash
over their shingles, repeats weighing as often as they occur. Fingerprints are cut into ``BLOCKS`` blocks of 16 bits, and
a table has the items by the value of each of their blocks: of two fingerprints within the radius some block differs in
no more than ``RADIUS`` // ``BLOCKS`` bits, so the items under all values that near to a window's blocks hold every item
within it. (Values near to one are looked up, or, where a table has fewer values than that, picked from them.) That is
where candidates come from. They are verified by the weighted Jaccard similarity of the shingles (sum of
lesser over sum of greater counts), which must be ``SIMILARITY`` or more. The radius is three deviations beyond the mean
distance at that similarity.

One filter keeps this off the mass of text: a window in which too few shingles are any item's to reach the similarity
with one is not fingerprinted. It knows no items apart and loses nothing.

Defined results: null and empty texts and items match nothing; an item without an id is searched like any other; a
document or item in two rows gives a match for each document id and item id once; a document of fewer words than an item
is compared as a whole; extra columns don't matter to ``leaks`` and stay in ``without_leaks``.

Scale: the items are the stated query set. They are sent to all tasks in blocks of at most ``BLOCK_BYTES`` of text and
``BLOCK_ITEMS`` items, one after another, each being one narrow pass over the documents whose finds are written before
the next; documents are never shuffled in ``leaks``. A worker keeps the index of one block, which grows with the items'
text alone, and uses it for all its tasks.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vigil.llm import hashing
from vigil.plans import scratch
from vigil.plans.shipping import ship

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 19
BLOCKS = 4
BLOCK_BYTES, BLOCK_ITEMS = 8_000_000, 20_000
#: Values of a block compared at a time.
VALUES = 1024
#: Shingles whose bits are summed at a time, which bounds memory in long documents.
CHUNK = 8192
_NOT_WORD = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_CLEAN = bytes(32 if _NOT_WORD.match(bytes([i])) else i for i in range(256))
_FILTER_BITS = 20


def _word_bytes(text: str | None) -> bytes:
    """The text in lower case, all but letters, digits and characters outside ASCII being spaces."""
    return (text or "").lower().encode().translate(_CLEAN)


def _word_hashes(data: bytes) -> np.ndarray:
    return hashing.word_hashes(data, *hashing.words(data))


def _shingles(data: bytes) -> tuple[np.ndarray, int]:
    """Hashes of the shingles in order, and the number of words."""
    own = _word_hashes(data)
    return hashing.Stretches(own).every(min(SHINGLE, len(own))) if len(own) else own, len(own)


def _simhashes(bits: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of windows of ``width`` shingles from running sums of the shingles' bits."""
    ones = bits[starts + width] - bits[starts]
    return np.packbits(2 * ones > width, axis=1, bitorder="little").view(np.uint64).ravel()


def _running_bits(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=out[1:])
    return out


def _fingerprint(hashes: np.ndarray) -> np.uint64:
    """The fingerprint of one window, however long."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def _blocks_of(fps: np.ndarray) -> np.ndarray:
    """(n, BLOCKS): the blocks of fingerprints."""
    return fps.view(np.uint16).reshape(-1, BLOCKS)


#: Differences of up to RADIUS // BLOCKS bits within a block.
_NEAR = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(64 // BLOCKS), k)], np.uint16)


class _Item:
    def __init__(self, item_id: object, text: str):
        self.id = item_id
        own = _word_hashes(_word_bytes(text))
        self.words, self.unit = len(own), min(SHINGLE, len(own))
        self.hashes = hashing.Stretches(own).every(self.unit) if len(own) else own

    @cached_property
    def counts(self) -> Counter:
        """For items that are candidates only."""
        return Counter(self.hashes.tolist())


class _Table:
    """Items of one number of shingles by the values of each block of their fingerprints."""

    def __init__(self, items: list[_Item]):
        self.items = items
        self.fps = np.array([_fingerprint(x.hashes) for x in items], np.uint64)
        self.order, self.values = [], []
        for own in _blocks_of(self.fps).T:
            order = np.argsort(own, kind="stable").astype(np.int32)
            value, first, size = np.unique(own[order], return_index=True, return_counts=True)
            self.order.append(order)
            self.values.append((value, first, size))

    def _near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which some block differs in few enough bits. Of many items those under the near values are looked up,
        and a pair may come more than once; of fewer items than there are such values the blocks are compared."""
        blocks = _blocks_of(fps)
        if len(self.items) <= len(_NEAR):
            return np.nonzero((np.bitwise_count(blocks[:, None] ^ _blocks_of(self.fps)[None]) <= RADIUS // BLOCKS).any(axis=2))
        windows, items = [], []
        for own, order, (value, first, size) in zip(blocks.T, self.order, self.values, strict=True):
            wanted = own[:, None] ^ _NEAR[None, :]
            at = np.minimum(np.searchsorted(value, wanted), len(value) - 1)
            window, k = np.nonzero(value[at] == wanted)
            at = at[window, k]
            n = size[at]
            items.append(order[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            windows.append(np.repeat(window, n))
        return np.concatenate(windows), np.concatenate(items)

    def within(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the number of a fingerprint and of an item that are within the radius, each once."""
        found = []
        for k in range(0, len(fps), VALUES):
            window, item = self._near(fps[k : k + VALUES])
            near = np.bitwise_count(fps[window + k] ^ self.fps[item]) <= RADIUS
            found.append((window[near] + k) * len(self.items) + item[near])
        found = np.unique(np.concatenate(found))
        return found // len(self.items), found % len(self.items)


class Index:
    """A block of items: tables by shingle size and number of shingles, and all their shingles."""

    def __init__(self, items: list[tuple[object, str]]):
        made = [x for x in (_Item(*i) for i in items) if x.words]
        by: dict[int, dict[int, list[_Item]]] = defaultdict(lambda: defaultdict(list))
        for x in made:
            by[x.unit][len(x.hashes)].append(x)
        self.tables = {unit: {n: _Table(own) for n, own in sorted(of.items())} for unit, of in by.items()}
        self.known = {unit: np.unique(np.concatenate([x.hashes for x in made if x.unit == unit])) for unit in by}
        self.filter = {unit: np.zeros(1 << _FILTER_BITS, bool) for unit in by}
        for unit, own in self.known.items():
            self.filter[unit][own & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def _hits(self, unit: int, hashes: np.ndarray) -> np.ndarray:
        """The places of shingles that are some item's."""
        maybe = np.flatnonzero(self.filter[unit][hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        known = self.known[unit]
        at = np.searchsorted(known, hashes[maybe])
        return maybe[known[np.minimum(at, len(known) - 1)] == hashes[maybe]]

    def search(self, text: str | None) -> list[tuple[object, float, int, int]]:
        """For each item found, its id, the best similarity, and the first such window's start and length in words."""
        own, out = _word_hashes(_word_bytes(text)), []
        for unit, tables in self.tables.items():
            if len(own) < unit:
                continue
            hashes = hashing.Stretches(own).every(unit)
            hits = self._hits(unit, hashes)
            if not len(hits):
                continue
            sums = np.zeros(len(hashes) + 1, np.int32)
            sums[hits + 1] = 1
            sums = np.cumsum(sums)
            for n, table in tables.items():
                width = min(n, len(hashes))  # a shorter document is one window
                if 9 * len(hits) < 4 * (width + n):
                    continue
                # shared / (width + n - shared) >= 4 / 5
                starts = np.flatnonzero(9 * (sums[width:] - sums[: len(sums) - width]) >= 4 * (width + n))
                if len(starts):
                    out += [(x.id, best[0], best[1], width + unit - 1) for x, best in self._best(table, hashes, starts, width)]
        return out

    def _best(self, table: _Table, hashes: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple[_Item, tuple[float, int]]]:
        windows: dict[int, list[int]] = defaultdict(list)
        edge = np.flatnonzero(np.diff(starts) > max(1, min(width, CHUNK)))
        for run in np.split(starts, edge + 1):
            for k in range(0, len(run), CHUNK):
                own = run[k : k + CHUNK]
                base = int(own[0])
                if width > CHUNK:  # sums of one window at a time
                    fps = np.array([_fingerprint(hashes[s : s + width]) for s in own.tolist()], np.uint64)
                else:
                    fps = _simhashes(_running_bits(hashes[base : int(own[-1]) + width]), own - base, width)
                for w, i in zip(*(x.tolist() for x in table.within(fps)), strict=True):
                    windows[i].append(int(own[w]))
        for i, at in windows.items():
            best = max(_similarities(table.items[i], hashes, at, width), key=lambda x: (x[0], -x[1]))
            if best[0] >= SIMILARITY:
                yield table.items[i], best


#: The index that a worker has made last.
_index: dict[str, Index] = {}


def _index_of(name: str, sent: Broadcast) -> Index:
    """The index of a block of items, made once by each worker and not by each task."""
    if name not in _index:
        _index.clear()
        _index[name] = Index(sent.value)
    return _index[name]


def _similarities(item: _Item, hashes: np.ndarray, starts: list[int], width: int) -> Iterator[tuple[float, int]]:
    """The similarity of the windows that begin at ``starts``, in order; counts move along with the window."""
    left, shared, before = Counter(), 0, None
    for s in starts:
        if before is None or s - before >= width:
            left, shared, gone, new = Counter(item.counts), 0, (), hashes[s : s + width].tolist()
        else:
            gone, new = hashes[before:s].tolist(), hashes[before + width : s + width].tolist()
        for h in gone:
            if h in item.counts:
                left[h] += 1
                shared -= left[h] > 0
        for h in new:
            if h in item.counts:
                shared += left[h] > 0
                left[h] -= 1
        before = s
        yield shared / (width + len(item.hashes) - shared), s


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, each read by the driver in turn."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).filter("t is not null").distinct()
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"].encode()) + 64
        if size >= BLOCK_BYTES or len(block) >= BLOCK_ITEMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item id, similarity, word_start, n_words): each item found in each document and where it is most alike;
    word_start counts the document's runs of letters and digits from 0."""
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__vg_text"))
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([ids.schema[0], T.StructField(item_col, item_type), T.StructField("similarity", T.DoubleType()), T.StructField("word_start", T.LongType()), T.StructField("n_words", T.LongType())])
    kind, out = to_arrow_type(item_type), spark.createDataFrame([], schema)
    for block in _item_blocks(benchmark, item_col, item_text_col):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = _index_of(name, sent)
            for batch in batches:
                rows = []
                for i, t in enumerate(batch.column(1)):
                    rows += [(i, *x) for x in index.search(t.as_py())]
                at = pa.array([r[0] for r in rows], pa.int64())
                cols = [batch.column(0).take(at), pa.array([r[1] for r in rows], kind), *[pa.array([r[k] for r in rows], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

        out = out.unionByName(scratch.table(ids.mapInArrow(run, schema)))
        sent.destroy()
    best = F.max(F.struct("similarity", (-F.col("word_start")).alias("s"), "n_words")).alias("b")
    return out.groupBy(id_col, item_col).agg(best).select(id_col, item_col, F.round("b.similarity", 6).alias("similarity"), (-F.col("b.s")).alias("word_start"), "b.n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    # the row itself is decided on, known by its id and a hash of its text: ids may repeat or be null
    th = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = docs.select(F.struct(F.col(f"`{id_col}`").alias("i"), th.alias("h")).alias("__vg_row"), F.col(f"`{text_col}`").alias("__vg_t"))
    found = leaks(keyed, benchmark, "__vg_row", "__vg_t").select("__vg_row.*").toDF("__vg_id", "__vg_h").distinct()
    return docs.join(scratch.table(found), F.col(f"`{id_col}`").eqNullSafe(F.col("__vg_id")) & (th == F.col("__vg_h")), "left_anti")
