"""Substring dedup on words by level-wise doubling.

Windows of 5 words that occur once cannot lie in a longer repeated window. So windows repeated at one length alone are
extended to twice that length, and again, until the full window or until none survives.

At the shortest length each full window is represented by its anchor, the least-hashed five words in it, and windows
with the same anchor are one cell (see ``repeats``). Cells of equal text are settled at once: all but the first are
repeats throughout. Cells whose five words another one has too are extended: all windows of a cell that begin five words
or more before the anchor hold the ten words around it, all others the ten words from it on. These halves meet by their
ten words, and those that share them with another half are extended once more, to their windows of 20 words.

A word is removed if some window that covers it has the same words as one that starts earlier: in a document with a
smaller id, or earlier in the same one. Windows are judged on the input.

Defined results: a null text has no words; fewer words than a window: nothing is removed; a null id comes after all
others; rows with the same id and text are one document, with the same result; of rows with the same id and other
texts the order is that of the texts' hashes; extra columns are left out; an empty table gives an empty result.

Scale: what is shuffled is a row for each cell (about one for eight words), one for each half that goes on, one for each
window that goes on after that, and the documents, once beside their cells and once beside their spans. At each length,
what meets within a part of a batch is dealt with there, so a common line, passage or document sends one row a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import hashing, repeats
from vigil.plans import scratch
from vigil.plans.shipping import ship

WINDOW, GRAM = 20, 5
DOUBLE = 2 * GRAM


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A text, a long one in pieces of whole words that overlap by a window; with the number of its first word."""
    if len(text) <= repeats.LIMIT:
        yield 0, text
        return
    start, end = hashing.words(text)
    for c in range(0, len(start) - WINDOW + 1, repeats.CHUNK):
        yield c, text[start[c] : end[min(len(start), c + repeats.CHUNK + WINDOW - 1) - 1]]


class _Words:
    """The words of several texts: hashes of stretches in two ways, and for each word whose it is and its number there."""

    def __init__(self, texts: list[bytes]):
        line = b" ".join(texts)
        start, end = hashing.words(line)
        begin = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        self.owner = np.searchsorted(begin, start, "right") - 1
        self.first = np.searchsorted(start, begin)
        self.one, self.two = (hashing.Stretches(hashing.word_hashes(line, start, end, seed), seed) for seed in (1, 2))


def _cells(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    words = _Words(texts)
    grams = words.one.every(GRAM)
    lo, n, anchor = repeats.cells_of(grams, words.owner, WINDOW, GRAM)
    owner = words.owner[lo]
    return owner, lo - words.first[owner], n, anchor - lo, grams[anchor].view(np.int64), words.two.hash(lo, lo + n + WINDOW - 1).view(np.int64)


def _windows(texts: list[bytes], cells: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(text, start, hash of the half's ten words, hash of the window, number of the half) of all windows of cells."""
    words = _Words(texts)
    owner = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    lo, n, off = repeats.unpacked(np.concatenate(cells))
    lo = lo + words.first[owner]
    anchor = np.repeat(lo + off, n)
    start = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    left = start <= anchor - GRAM
    ten = np.where(left, anchor - GRAM, anchor)
    owner = np.repeat(owner, n)
    half = 2 * np.repeat(np.arange(len(n)), n) + ~left
    return owner, start - words.first[owner], words.one.hash(ten, ten + DOUBLE).view(np.int64), words.two.hash(start, start + WINDOW).view(np.int64), half


def _runs(key: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of each run of rows with one key and neighbouring places, at most 4,000 of them."""
    breaks = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 1)) + 1
    first = np.concatenate(([0], breaks))
    n = np.diff(np.append(first, len(p)))
    more = np.repeat(first, -(-n // 4000)) + 4000 * (np.arange((-(-n // 4000)).sum()) - np.repeat(np.cumsum(-(-n // 4000)) - -(-n // 4000), -(-n // 4000)))
    return more, np.diff(np.append(more, len(p)))


def _halves(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, th, at, key, ws): the halves of contested cells by their ten words, with the hashes of their windows; null
    stands for a window that begins earlier in the same part too. Of such windows the spans come out as settled rows."""
    ship(docs.sparkSession)
    fields = [T.StructField("at", T.LongType()), T.StructField("key", T.LongType()), T.StructField("ws", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema["doc"], docs.schema["th"], *fields])
    rows = repeats.beside_text(docs, scratch.table(repeats.per_document(cells, "at")))

    def made(batch: pa.RecordBatch, rank: np.ndarray, have: list[tuple]) -> pa.RecordBatch:
        # halves get numbers of their own over the part's texts
        up = np.cumsum([0, *[x[4].max() + 1 for x in have[:-1]]])
        row, p, ten, w, half = (np.concatenate(c) for c in zip(*[(*x[:4], x[4] + u) for x, u in zip(have, up, strict=True)], strict=True))
        order, head, again = repeats.heads(rank[row], p, ten, w)
        first = head == np.arange(len(order))
        later = order[~first & ~again]
        later = later[np.lexsort((p[later], row[later]))]
        out_row, out_at, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(later):
            a, n = _runs(row[later], p[later])
            out_row.append(row[later][a])
            out_at.append(repeats.packed(p[later][a], n, 0 * n, 0))
            out_key.append(repeats.scattered(out_row[-1], out_at[-1]))
        mine = np.sort(order[first])  # by half, then by place
        cut = np.concatenate(([0], np.flatnonzero(np.diff(half[mine])) + 1))
        a, z = mine[cut], mine[np.append(cut[1:], len(mine)) - 1]
        n = p[z] - p[a] + 1
        hard, marks = repeats.crowded(ten[a], half[a])
        # each half's windows from its first to its last, those in between that are settled being null
        to = np.cumsum(n) - n
        ws, known = np.zeros(n.sum(), np.int64), np.zeros(n.sum(), bool)
        at = np.repeat(to, np.diff(np.append(cut, len(mine)))) + p[mine] - np.repeat(p[a], np.diff(np.append(cut, len(mine))))
        ws[at], known[at] = w[mine], True
        lists = pa.ListArray.from_arrays(pa.array(np.append(to, len(ws)), pa.int32()), pa.array(ws, mask=~known))
        settled = sum(map(len, out_row))
        out_row += [row[a], row[a[marks]]]
        out_at += [repeats.packed(p[a], n, 0 * n, np.where(hard, repeats.HARD, repeats.OPEN)), repeats.packed(p[a[marks]], n[marks], 0 * n[marks], repeats.OPEN | repeats.MARK)]
        out_key += [ten[a], ten[a[marks]]]
        none = lambda k: pa.nulls(k, lists.type)
        rows = pa.array(np.concatenate(out_row))
        every = pa.concat_arrays([none(settled), lists, none(len(marks))])
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(out_at)), pa.array(np.concatenate(out_key)), every], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, have, size = repeats.ranks(batch), [], 0
            parts = batch.column(3)
            of, ends = parts.flatten().to_numpy(), np.cumsum(parts.value_lengths().to_numpy())
            mine = lambda i: of[ends[i - 1] if i else 0 : ends[i]]
            for rows, base, texts in repeats.blocks(((i, t.as_py()) for i, t in enumerate(batch.column(2))), _pieces):
                cells = []
                for k, i in enumerate(rows.tolist()):
                    own = mine(i)
                    lo = own >> 28
                    # a piece has the cells that begin in it and not in the next one, which it holds to their end
                    far = base[k + 1] if k + 1 < len(rows) and rows[k + 1] == i else base[k] + repeats.CHUNK
                    own = own[(lo >= base[k]) & (lo < far)] if len(texts[k]) > repeats.LIMIT // 2 or base[k] else own
                    cells.append(own - (base[k] << 28))
                if sum(map(len, cells)):
                    text, p, *more = _windows(texts, cells)
                    have.append((rows[text], p + base[text], *more))
                    size += len(p)
                if size >= repeats.PART:
                    yield made(batch, rank, have)
                    have, size = [], 0
            if have:
                yield made(batch, rank, have)

    return rows.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, lo, n) of ``repeats.keyed`` documents: windows lo to lo + n - 1 start earlier too."""
    cells = scratch.table(repeats.met(docs, _pieces, _cells, ordered=True))
    halves = scratch.table(_halves(cells.filter("further"), docs))
    spans = [x.select("doc", "th", repeats.lo_of("at").alias("lo"), repeats.n_of("at").alias("n")) for x in (cells.filter("final"), halves.filter(~repeats.is_("at", repeats.OPEN | repeats.HARD)))]
    # ten words that no other half has end here; a key has no more rows than there are parts
    met = halves.filter(repeats.is_("at", repeats.OPEN)).withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").drop("n")
    on = met.filter(~repeats.is_("at", repeats.MARK)).unionByName(halves.filter(repeats.is_("at", repeats.HARD)))
    windows = on.select("doc", "th", "key", repeats.lo_of("at").alias("lo"), F.posexplode("ws").alias("k", "w")).filter("w is not null")
    windows = windows.select("doc", "th", "key", "w", (F.col("lo") + F.col("k")).alias("lo"))
    in_order = Window.partitionBy("key", "w").orderBy(repeats.place("lo")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = windows.withColumn("later", F.first(repeats.place("lo")).over(in_order) < repeats.place("lo")).filter("later")
    return spans[0].unionByName(spans[1]).unionByName(later.select("doc", "th", "lo", F.lit(1).cast("long").alias("n")))


def removed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256 and kept (the words left, joined by single spaces)."""
    ship(docs.sparkSession)
    own = repeats.keyed(docs, id_col, text_col)
    spans = scratch.table(repeats.per_document(repeated_spans(own).select("doc", "th", F.shiftleft("lo", 16).bitwiseOR(F.col("n")).alias("x")), "x"))
    rows = repeats.beside_text(own, spans, "left")
    schema = T.StructType([T.StructField(id_col, rows.schema["doc"].dataType), *T._parse_datatype_string("n_words long, n_removed long, kept_sha256 string, kept string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(t.as_py(), p.values.to_numpy() if p.is_valid else None) for t, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())],
                schema.names,
            )

    return rows.mapInArrow(run, schema)


def _kept(text: bytes, parts: np.ndarray | None) -> tuple[int, int, bytes]:
    """Words, words removed, and the others joined by spaces."""
    words, kept, at = text.split(), [], 0
    for a, b in repeats.union_of(parts >> 16, (parts >> 16) + (parts & 0xFFFF) + WINDOW - 1) if parts is not None else ():
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)
