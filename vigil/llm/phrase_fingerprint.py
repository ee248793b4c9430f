"""Lempel-Ziv phrase fingerprints of whole documents.

A text is parsed as by a dictionary compressor: from where the last phrase ended, the shortest sequence of symbols that is
no phrase yet becomes one. Texts that would compress well together have many phrases in common, so the Jaccard
similarity of their phrase sets is a likeness close to that of compression. A fingerprint is a minimum-hash signature
of the set: ``SLOTS`` permutations of 64-bit phrase hashes, one byte of each least value, in hex. Two fingerprints'
likeness is the share of equal slots, less what agrees by chance, so it is 1 for equal texts.

A symbol is a word with the white space after it, at most ``LONGEST`` bytes of it at a time; a code point from U+3000 on
(scripts without spaces) is one by itself. Single characters as symbols cost six times as much and separate less well.

An edited text that keeps a document's beginning has the same phrases up to the edit, so only the rest is parsed anew.
``beside_next`` needs each document's successor: rows are dealt by ranges of (id, hash of the text) whose ends are
rows of a bounded sample, sorted within and read as a stream, so that the successor is the next row; the first row of
each range is sent to the range before it as well. Texts are shuffled once, compressed, with about one extra copy a
range. Documents are in order of descending id, null last, equal ids by the hash of the text; rows that repeat both
are neighbours, and so are in one range, which costs time in its task and no memory.

Defined results: a null text is empty; an empty text has no phrases, and is like another empty one only; an empty table
gives an empty table. A task holds two texts and the phrases of one (some ten times a text's size).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import hashing
from vigil.plans.shipping import ship

SLOTS, LONGEST = 128, 24
#: Sampled rows for each range, and the most ranges; with both, at most so many rows of two numbers meet on the driver.
SAMPLED, RANGES = 16, 16_384
#: Bytes of text hashed at a time, phrases permuted at a time, and bytes of compressed text in a batch.
STRETCH, BLOCK, BATCH = 1 << 18, 2048, 4 << 20

_SYMBOL = re.compile(rb"[\xE3-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}|[^\s\xE3-\xF4]{1,%d}\s*|[\s\S]" % LONGEST)
_rng = np.random.default_rng(13)
_TIMES, _PLUS = (_rng.integers(2**63, size=SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_NONE = np.iinfo(np.uint64).max


def _parsed(text: bytes, start: int, seen: set[bytes]) -> list[int]:
    """Where the phrases from ``start`` on end; they are added to ``seen``. What is left at the end is none."""
    ends, add, end = [], seen.add, 0
    for m in _SYMBOL.finditer(text, start):
        end = m.end()
        phrase = text[start:end]
        if phrase not in seen:
            add(phrase)
            ends.append(end)
            start = end
    return ends


def _least(text: bytes, start: int, ends: list[int]) -> np.ndarray:
    """For each permutation the least value of the phrases that end there, the first one beginning at ``start``."""
    out = np.full(SLOTS, _NONE, np.uint64)
    end = np.array(ends, np.int64)
    begin = np.concatenate(([start], end[:-1]))[: len(end)]
    k = 0
    while k < len(end):
        stop = max(k + 1, int(np.searchsorted(end, begin[k] + STRETCH)))
        part = hashing.Stretches(np.frombuffer(text, np.uint8, int(end[stop - 1] - begin[k]), int(begin[k])))
        h = part.hash(begin[k:stop] - begin[k], end[k:stop] - begin[k])
        for i in range(0, len(h), BLOCK):
            np.minimum(out, (h[i : i + BLOCK, None] * _TIMES + _PLUS).min(axis=0), out=out)
        k = stop
    return out


def _hex(least: np.ndarray) -> str:
    return (hashing.mix(least) & np.uint64(255)).astype(np.uint8).tobytes().hex()


def fingerprint(text: bytes) -> str:
    return _hex(_least(text, 0, _parsed(text, 0, set())))


def alike(a: str, b: str) -> float:
    """The likeness of two fingerprints: equal slots, less the 1 in 256 that agree by chance."""
    same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b), strict=True)) / SLOTS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def likeness(a: Column, b: Column) -> Column:
    """As ``alike``, for columns of fingerprints."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(SLOTS - 1)), F.lit(0), lambda n, i: n + (F.substr(a, 2 * i + 1, F.lit(2)) == F.substr(b, 2 * i + 1, F.lit(2))).cast("int"))
    return F.greatest(F.lit(0.0), (same / SLOTS - 1 / 256) / (1 - 1 / 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of each document, without a shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n_chars"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.array([fingerprint(x.as_py() or b"") for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own], [*b.schema.names[:2], "fingerprint"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:2], T.StructField("fingerprint", T.StringType())]))


class _Document:
    """A document that waits for its successor."""

    def __init__(self, doc: int | None, text: bytes):
        self.doc, self.text, self.chars = doc, text, text.decode("utf-8", "replace")
        self.moved = len(self.chars) // 3  # code points that the edit replaces
        kept = len(self.chars) - self.moved
        self.cut = len(self.chars[:kept].encode())
        self.seen: set[bytes] = set()
        ends = _parsed(text, 0, self.seen)
        # phrases before the cut are the edited text's too: what follows them is the same up to their next symbol
        k = int(np.searchsorted(ends, self.cut)) if ends else 0
        begin = ends[k - 1] if k else 0
        self.resume, self.head = begin, _least(text, 0, ends[:k])
        self.print = _hex(np.minimum(self.head, _least(text, begin, ends[k:])))
        for a, b in zip([begin, *ends[k:]], ends[k:], strict=False):
            self.seen.discard(text[a:b])

    def row(self, following: _Document) -> tuple:
        edited = self.text[: self.cut] + following.chars[: self.moved].encode()
        least = _least(edited, self.resume, _parsed(edited, self.resume, self.seen))
        of_edited = _hex(np.minimum(self.head, least))
        sha = hashlib.sha256(edited).hexdigest()
        return (self.doc, len(self.chars), sha, self.print, of_edited, alike(self.print, of_edited), alike(self.print, following.print))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _KINDS, strict=True)], [c.split()[0] for c in _SCHEMA.split(", ")])


def _place(doc: int | None, th: int) -> tuple:
    """What orders documents."""
    return (doc is None, 0 if doc is None else -doc, th)


def _splitters(rows: DataFrame) -> list[tuple]:
    """The places of rows at which ranges begin: evenly spaced ones of a sample, by a hash that is the same on a rerun."""
    spark, n = rows.sparkSession, rows.count()
    ranges = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = SAMPLED * ranges
    order = F.shiftrightunsigned(F.xxhash64("th", "doc", F.lit(3)), 1)
    own = rows.select("doc", "th", order.alias("o"))
    if n > 4 * most:
        own = own.filter(F.col("o") < int(2 * most / n * 2**63))
    places = sorted(_place(r["doc"], r["th"]) for r in own.distinct().orderBy("o").limit(most).collect())
    return places[:: max(1, len(places) // ranges)]


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its fingerprint, that of its edited text (the last third of its code points replaced by the
    beginning of the next document) and its likeness to both the edited text and the next document."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    splitters = _splitters(rows.select("doc", "th"))
    known = spark.sparkContext.broadcast(splitters)  # at most twice RANGES rows, whatever the input
    names = ["range", "kind", "doc", "th", "text"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, zip_ = known.value, len(known.value) - 1, zstandard.ZstdCompressor(1)
        for b in batches:
            out, size = [], 0
            for doc, th, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                place, packed = _place(doc, th), zip_.compress(body.as_py())
                k = bisect_right(at, place) - 1
                # the last range goes on with the rows before the first splitter, as the last document's next is the first
                out.append((k, 0, doc, th, packed) if k >= 0 else (last, 1, doc, th, packed))
                if k >= 0 and at[k] == place:
                    out.append(((k - 1) % len(at), 2, doc, th, packed))
                size += len(packed)
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, where, unzip = None, None, zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for range_, kind, doc, body in zip(*(b.column(i) for i in (0, 1, 2, 4)), strict=True):
                if range_.as_py() != where:
                    before, where = None, range_.as_py()
                if kind.as_py() == 2 and before is None:
                    continue  # another copy of the row that begins the next range
                own = _Document(doc.as_py(), unzip.decompress(body.as_py()))
                if before is not None:
                    out.append(before.row(own))
                before = own if kind.as_py() < 2 else None
            yield _batch(out)

    order = ["range", "kind", F.desc_nulls_last("doc"), F.asc("th")]
    sorted_ = rows.mapInArrow(dealt, "range int, kind int, doc long, th long, text binary").repartition("range").sortWithinPartitions(*order)
    return sorted_.mapInArrow(matched, _SCHEMA).withColumnRenamed("doc_id", id_col)
