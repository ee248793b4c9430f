"""What the two repeated-text operators share: anchored cells, where cells meet, and spans beside their documents.

A window (so many bytes, or so many words) is known by its anchor: the place of the least-hashed short gram inside it,
the first of equal ones. Equal windows have their anchor at the same place, so windows can only be equal where grams at
anchors are. Neighbouring windows with the same anchor make a cell; a cell and all text its windows cover is one row.
A corpus thus has one row for about half a window, not one for each position, and loses no window.

Cells meet by their gram, in one shuffle. Cells of equal text (by two 64-bit hashes, of the gram and of the whole) are
settled there: one stays as their representative. Only a representative whose gram another text has too (it is
contested) can hold windows of which part of the cell is repeated; those go on to the operator's own refinement.

What meets within a part of a batch is dealt with before the shuffle, so that a gram or a text, however common, sends
one row a part: copies of a cell in the part are settled; a gram with several texts in the part is contested already,
and its cells go on at once, leaving one mark for the other parts.

A document is known by its id and a hash of its text, so ids that repeat or are null do no harm. Rows that repeat both
count as one document wherever one document's own order matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import hashing
from vigil.plans.shipping import ship

#: Text handled at a time, in bytes, and windows of one long document.
LIMIT, CHUNK = 1 << 20, 1 << 17
#: Rows of a part.
PART = 300_000
#: What is known of a row: it is settled (0), contested, open, a copy that still stands for its text, a mark.
HARD, OPEN, DONE, MARK = 1, 2, 4, 8


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, text): text as bytes, null as empty; th its hash."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def packed(lo: np.ndarray, n: np.ndarray, off: np.ndarray, state: np.ndarray | int) -> np.ndarray:
    """A cell's first window, number of windows, and distance from there to the anchor, with its state, in one number."""
    return lo.astype(np.int64) << 28 | n << 16 | off << 4 | state


def lo_of(at: Column | str) -> Column:
    return F.shiftright(at, 28)


def n_of(at: Column | str) -> Column:
    return F.shiftright(at, 16).bitwiseAND(F.lit(0xFFF))


def is_(at: Column | str, bit: int) -> Column:
    return (F.col(at) if isinstance(at, str) else at).bitwiseAND(F.lit(bit)) != 0


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 28, at >> 16 & 0xFFF, at >> 4 & 0xFFF


def cells_of(grams: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of each cell, from the hashes of all grams of several texts in a row;
    ``owner`` says whose each item is. Windows across two texts are none."""
    place = hashing.window_least(grams, window - gram + 1)
    own = np.flatnonzero(owner[: len(place)] == owner[window - 1 :]) if len(place) else place
    if not len(own):
        return own, own, own
    first = np.concatenate(([0], np.flatnonzero((np.diff(place[own]) != 0) | (np.diff(own) != 1)) + 1))
    return own[first], np.diff(np.append(first, len(own))), place[own[first]]


def ranks(batch: pa.RecordBatch) -> np.ndarray:
    """Each row's rank in the order of ``place``; rows with the same id and text share one."""
    keys = [(d is None, 0 if d is None else d, th) for d, th in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
    rank = {k: i for i, k in enumerate(sorted(set(keys)))}
    return np.array([rank[k] for k in keys], np.int64)


def heads(rank: np.ndarray, lo: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by key and place, and for each place in it where its key begins and whether it repeats the place
    before it."""
    order = np.lexsort((lo, rank, *key[::-1]))
    differs = lambda *columns: np.concatenate(([True], np.any([np.diff(c[order]) != 0 for c in columns], axis=0)))
    new, moved = differs(*key), differs(*key, rank, lo)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)), ~moved


def crowded(key: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a key that several different parts have, and one row for each such key."""
    order = np.lexsort((part, key))
    k, p = key[order], part[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    more = np.concatenate(([False], (k[1:] == k[:-1]) & (p[1:] != p[:-1])))
    group = np.cumsum(new) - 1
    many = np.zeros(group[-1] + 1, bool)
    many[group[more]] = True
    out = np.zeros(len(key), bool)
    out[order] = many[group]
    return out, order[new & many[group]]


def scattered(*of: np.ndarray) -> np.ndarray:
    """Numbers that spread rows which need to meet nothing over the cluster; 32 bits are half the bytes to shuffle."""
    h = np.zeros(len(of[0]), np.uint64)
    for x in of:
        h = hashing.mix(h + x.view(np.uint64))
    return (h >> np.uint64(32)).view(np.int64)


def _settled(rank: np.ndarray, cells: tuple[np.ndarray, ...], ordered: bool) -> tuple[np.ndarray, ...]:
    """(row, at, key, u, gram) of a part's rows: see the module's text."""
    row, lo, n, off, gram, u = cells
    order, head, again = heads(rank[row], lo, gram, u)
    first = head == np.arange(len(order))
    state = np.zeros(len(order), np.int64)
    state[first] = OPEN
    if not ordered:  # both ends of a repeat go, a repeated row being a text of its own
        copied = np.zeros(len(order), bool)
        copied[head[~first]] = True
        state[first & copied] |= DONE
    keep = ~(again & ~first)
    order, state, first = order[keep], state[keep], first[keep]
    row, lo, n, off, gram, u = (c[order] for c in (row, lo, n, off, gram, u))
    mine = np.flatnonzero(first)
    hard, marks = crowded(gram[mine], u[mine])
    state[mine[hard]] += HARD - OPEN
    marks = mine[marks]
    free = state & OPEN == 0
    key = np.where(free, scattered(row, lo, gram), gram)
    cat = lambda a, b: np.concatenate((a, b))
    return (
        cat(row, row[marks]),
        cat(packed(lo, n, off, state), packed(lo[marks], n[marks], off[marks], OPEN | MARK)),
        cat(key, gram[marks]),
        cat(np.where(state == 0, 0, u), u[marks]),
        cat(np.where(state & HARD != 0, gram, 0), np.zeros(len(marks), np.int64)),
    )


Pieces = Callable[[bytes], Iterator[tuple[int, bytes]]]
Cells = Callable[[list[bytes]], tuple[np.ndarray, ...]]


def blocks(texts: Iterator[tuple[int, bytes]], pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(row, place of the first item, bytes) of texts and of pieces of long ones, ``LIMIT`` bytes at a time."""
    rows, base, own, size = [], [], [], 0
    for i, text in texts:
        for at, piece in pieces(text):
            rows.append(i)
            base.append(at)
            own.append(piece)
            size += len(piece)
            if size >= LIMIT:
                yield np.array(rows), np.array(base), own
                rows, base, own, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(base), own


def met(docs: DataFrame, pieces: Pieces, cells: Cells, ordered: bool) -> DataFrame:
    """(doc, th, at, gram, u, final, further) of ``keyed`` documents' cells that repeat, wholly (final) or perhaps in part
    (further). ``cells`` makes (piece, first window, windows, distance to the anchor, gram, hash of all) from a list of
    pieces. ``ordered``: the first of equal cells is no repeat; else all are."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema["doc"], docs.schema["th"], *[T.StructField(c, T.LongType()) for c in ("at", "key", "u", "gram")]])

    def part_rows(batch: pa.RecordBatch, rank: np.ndarray, have: list[tuple]) -> pa.RecordBatch:
        row, *own = _settled(rank, tuple(np.concatenate(c) for c in zip(*have, strict=True)), ordered)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, own)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, have, size = ranks(batch), [], 0
            for rows, base, texts in blocks(((i, t.as_py()) for i, t in enumerate(batch.column(2))), pieces):
                piece, lo, *more = cells(texts)
                if len(piece):
                    have.append((rows[piece], lo + base[piece], *more))
                    size += len(piece)
                if size >= PART:
                    yield part_rows(batch, rank, have)
                    have, size = [], 0
            if have:
                yield part_rows(batch, rank, have)

    made = docs.select("doc", "th", "text").mapInArrow(run, schema)
    # a key has no more rows than there are parts
    all_ = Window.partitionBy("key")
    same = Window.partitionBy("key", "u").orderBy(F.col("is_mark"), place(lo_of("at")))
    rows = made.withColumns({"is_open": is_("at", OPEN), "is_mark": is_("at", MARK)})
    rows = rows.withColumns({"n": F.row_number().over(same), "contested": (F.min("u").over(all_) != F.max("u").over(all_)) | F.max("is_mark").over(all_)})
    if ordered:
        later = F.first(place(lo_of("at"))).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)) < place(lo_of("at"))
        head = ~later
        final = ~is_("at", HARD) & (~F.col("is_open") | later)
    else:
        head = F.col("n") == 1
        final = is_("at", DONE) | F.when(F.col("is_open"), F.count_if(~F.col("is_mark")).over(Window.partitionBy("key", "u")) > 1).otherwise(~is_("at", HARD))
    further = is_("at", HARD) | (F.col("is_open") & head & F.col("contested"))
    rows = rows.withColumns({"final": final, "further": further}).filter("not is_mark and (final or further)")
    return rows.select("doc", "th", "at", F.when(F.col("is_open"), F.col("key")).otherwise(F.col("gram")).alias("gram"), "u", "final", "further")


def place(*more: Column | str) -> Column:
    """What orders places in the corpus: id (null last), then text and position."""
    return F.struct(F.col("doc").isNull().alias("n"), F.col("doc"), F.col("th"), *more)


def same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def per_document(rows: DataFrame, column: str) -> DataFrame:
    """(doc, th, parts): the numbers of each document's rows as an array, bounded by its own length."""
    return rows.groupBy("doc", "th").agg(F.collect_list(column).alias("parts"))


def beside_text(docs: DataFrame, parts: DataFrame, how: str = "inner") -> DataFrame:
    """(doc, th, text, parts). ``parts`` should be a written table: a join below which its aggregation shares the
    shuffle can't split a skewed key."""
    return docs.alias("d").join(parts.alias("p"), same_document("d", "p"), how).select("d.doc", "d.th", "d.text", "p.parts")


def union_of(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Spans [lo, hi) merged where they touch or overlap."""
    if not len(lo):
        return []
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order])
    first = np.concatenate(([True], lo[1:] > end[:-1]))
    return list(zip(lo[first].tolist(), end[np.append(np.flatnonzero(first)[1:] - 1, len(lo) - 1)].tolist(), strict=True))
