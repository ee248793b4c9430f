"""Spelling variants: words that one edit turns into a far more common word.

Words are counted over the whole corpus. Two are near if exactly one inserted, deleted or replaced code point turns one
into the other. A word's form is its most frequent near word, if that occurs ``RATIO`` times as often or more; forms of
forms lead to a root.

Near pairs meet by deletion keys. A word without its i-th code point is a prefix and a suffix; the hashes of both follow
from running polynomial sums, so NumPy makes the keys of all places of many words at once, as 64-bit integers. There are
two kinds: a *gap* (the place and what is left), which two words share exactly if they differ in that place alone, and
what is left by itself, which a word *drops* and another word may simply be. Of a run of equal code points only the
first is dropped, since all give the same string. Spark deals the keys out by their leading bits (radix) and sorts each
partition by key; a task then walks through runs of equal keys and verifies them on the strings.

No run is paired up: of a gap's words each is near all others, so counts and the best two are enough; of a drop's words
only the word that they drop to is near each. Distinct pairs meet once: the place of a replacement is unique, and equal
drops of a word are one key. So n_near is a sum. A key has at most as many words as the alphabet has letters (90) times,
for drops, the places of a word; nothing grows with the corpus but the vocabulary itself.

Defined results: a null text has no words; a null id reads as an empty one; rows that repeat count each; ties between
near words go to the smallest in code-point order; an empty table gives an empty table. Long texts are cut between runs
for counting, so a task holds one piece at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import hashing
from vigil.plans import scratch
from vigil.plans.shipping import ship

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run in 199 loses a code point (see ``altered``).
EVERY = 199
#: Different words held before they are sent on; code points of text and of vocabulary handled at a time.
HELD, PIECE, BLOCK = 200_000, 1 << 20, 1 << 16
#: Leading bits of a key by which rows are dealt out.
RADIX = 16

_RUN = re.compile("[a-zÀ-ÿ]+")
_OTHER = re.compile("[^a-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between runs."""
    at = 0
    while len(text) - at > PIECE:
        cut = _OTHER.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def altered(doc_id: int | None, text: bytes | None, every: int | None) -> Iterator[Counter]:
    """How often each lower-cased run occurs in a text. With ``every``, a run whose CRC-32 after ``<id>:`` is divisible
    by it loses the code point at that number modulo its length: errors spread evenly over a corpus, for tests."""
    start = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    start = zlib.crc32(b":", start)
    for piece in _pieces((text or b"").lower().decode("utf-8", "replace")):  # bytes: A-Z only
        found = Counter(_RUN.findall(piece))
        if every:
            for run in list(found):
                h = zlib.crc32(run.encode(), start)
                if h % every == 0:
                    k = h % len(run)
                    n = found.pop(run)
                    yield Counter({run[:k] + run[k + 1 :]: n})
        yield found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """(word, n) of the words of ``LEAST_LENGTH`` code points or more that occur ``LEAST_COUNT`` times or more."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for found in altered(doc, text.as_py(), every):
                    held.update(found)
                    if len(held) >= HELD:
                        yield _counts(held)
                        held = Counter()
        yield _counts(held)

    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counts(held: Counter) -> pa.RecordBatch:
    words = [w for w in held if len(w) >= LEAST_LENGTH]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, key) of some words. Place -1 is the word itself; a place i >= 0 stands for the gap at i, with
    bit 30 set for what dropping it leaves. A word and what drops to it have equal keys, and so have equal gaps."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(size)
    begin = ends - size
    values = hashing.mix(codes.astype(np.uint64) + np.uint64(1))
    n, base = int(size.max(initial=0)), np.uint64(0x9E3779B97F4A7C15 | 5)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, base, np.uint64), out=power[1:])
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - begin[owner]
    # each code point times a power by its place: sums of the part before a place, and of the part after it moved up by one
    here = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[place])))
    moved = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[np.maximum(place - 1, 0)])))
    at = np.arange(len(codes))
    left = (here[at] - here[begin[owner]]) + (moved[ends[owner]] - moved[at + 1])
    whole = here[ends] - here[begin]
    of = lambda h, length, gap: hashing.mix(hashing.mix(h + length.astype(np.uint64)) + gap.astype(np.uint64))
    new = np.concatenate(([True], codes[1:] != codes[:-1])) | (place == 0) if len(codes) else np.zeros(0, bool)
    row = np.concatenate((np.arange(len(words)), owner[new], owner))
    where = np.concatenate((np.full(len(words), -1), place[new] | 1 << 30, place))
    key = np.concatenate((of(whole, size, np.zeros(len(words), int)), of(left[new], size[owner[new]] - 1, np.zeros(int(new.sum()), int)), of(left, size[owner] - 1, place + 1)))
    return row, where, key.view(np.int64)


def _blocks(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Some words at a time, and the first one's number."""
    first, have, size = 0, [], 0
    for i, w in enumerate(words):
        have.append(w)
        size += len(w)
        if size >= BLOCK:
            yield first, have
            first, have, size = i + 1, [], 0
    if have:
        yield first, have


def keyed(words: DataFrame) -> DataFrame:
    """(radix, key, place, word, n): each word by each of its keys."""
    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, some in _blocks(b.column(0).to_pylist()):
                row, place, key = deletion_keys(some)
                at = pa.array(row + first)
                radix = (key.view(np.uint64) >> np.uint64(64 - RADIX)).astype(np.int32)
                cols = [pa.array(radix), pa.array(key), pa.array(place.astype(np.int32)), b.column(0).take(at), b.column(1).take(at)]
                for k in range(0, len(row), BLOCK):
                    yield pa.RecordBatch.from_arrays([c.slice(k, BLOCK) for c in cols], ["radix", "key", "place", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "radix int, key long, place int, word string, n long")


def _string(place: int, word: str) -> tuple[int, str]:
    """What a row's key stands for."""
    if place < 0:
        return -1, word
    if place >> 30:
        k = place ^ 1 << 30
        return -1, word[:k] + word[k + 1 :]
    return place, word[:place] + word[place + 1 :]


def _near(rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, the best of them, its n) from the rows (place, word, n) of one key."""
    groups: dict[tuple[int, str], list[tuple[int, str, bool]]] = {}
    for place, word, n in rows:
        groups.setdefault(_string(place, word), []).append((-n, word, place < 0))
    for (gap, _), own in groups.items():
        if len(own) == 1:
            continue
        if gap < 0:
            whole = [x for x in own if x[2]]
            longer = [x for x in own if not x[2]]
            if whole and longer:
                best = min(longer)
                yield whole[0][1], len(longer), best[1], -best[0]
                for x in longer:
                    yield x[1], 1, whole[0][1], -whole[0][0]
        else:
            best, second = sorted(own)[:2]
            for x in own:
                other = second if x is best else best
                yield x[1], len(own) - 1, other[1], -other[0]


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): how many words are near each word of ``keyed`` rows, and the best of them. Words
    without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last key's rows may go on in the next batch
        for b in batches:
            whole = pa.Table.from_batches([b] if before is None else [before, b]).combine_chunks().to_batches()[0]
            key = whole.column(0).to_numpy()
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            cut = int(edge[-1]) if len(edge) else 0
            before = whole.slice(cut)
            yield _found(whole.slice(0, cut))
        if before is not None:
            yield _found(before)

    sorted_ = rows.repartition("radix").sortWithinPartitions("key").select("key", "place", "word", "n")
    found = sorted_.mapInArrow(run, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def _found(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The near words of whole runs of equal keys."""
    key = rows.column(0).to_numpy()
    edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, int)
    many = np.flatnonzero(np.diff(edge) > 1)
    # only rows of keys that several rows have are made Python objects
    at = np.concatenate([np.arange(edge[k], edge[k + 1]) for k in many]) if len(many) else np.zeros(0, int)
    own = rows.take(pa.array(at))
    made = list(zip(*[own.column(i).to_pylist() for i in (1, 2, 3)], strict=True))
    out, start = [], 0
    for size in np.diff(edge)[many].tolist():
        out += _near(made[start : start + size])
        start += size
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*out, strict=True)) if out else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["word", "n_near", "form", "form_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): where following forms ends. Each round goes twice as far; a form occurs
    ``RATIO`` times as often as its word, so that no path is longer than the logarithm of the largest count."""
    to = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = scratch.table(to.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done = step.filter("moved").isEmpty()
        scratch.drop(to)
        to = step
        if done:
            return step.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """One row per word: word, n, n_near, form and form_n (null if it has none) and root (itself if it has none)."""
    words = scratch.table(vocabulary(docs, id_col, text_col, every))
    out = words.join(near_words(keyed(words)), "word", "left")
    own = F.col("form_n") >= RATIO * F.col("n")
    out = scratch.table(
        out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(own, F.col("form")).alias("form"), F.when(own, F.col("form_n")).alias("form_n"))
    )
    scratch.drop(words)
    ends = roots(out.filter("form is not null"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")
