"""Suffix-array dedup by bucket-pointer refinement: bytes of strings that occur twice go.

Every string of ``WINDOW`` bytes is known by its anchor, a q-gram inside it (see ``repeats``), and the initial buckets
are those of equal anchor q-grams; a bucket of one holds no repeat. Cells of equal text are settled before. Within a
bucket, all suffixes of its members start with a bucket pointer, that of their first ``STEP`` bytes. Each refinement
sorts them on the pairs of their own pointer and the pointer ``STEP`` bytes further on, which gives pointers for twice
the length; these are used again in the next one, up to the window. A suffix that is alone in its bucket leaves, and
with it all that point to it.

A bucket of more than ``BUCKET`` members is first refined across the cluster in the same way: the range of places that
the anchor has in the windows is halved, which makes the text that all windows of a half share longer on either side,
and the bucket's identifier together with the added text is the identifier for the next round. After nine rounds a half
is a single place and the shared text the whole window, so equal identifiers are equal windows and are only counted: no
bucket of any size is ever gathered.

A byte is removed if a window that covers it also starts anywhere else, the same document included. Windows are judged
on the input.

Defined results: a null text is empty; a text shorter than a window keeps all; rows that repeat are documents of their
own, so both lose what they share; null ids do no harm; a cut may leave a UTF-8 character in part, which ``kept`` leaves
out; extra columns are left out; an empty table gives an empty result.

Scale: a cell is a row of some 45 bytes for about 185 bytes of text, shuffled once; only contested cells carry text. What
meets within a part of a batch is dealt with before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vigil.llm import hashing, repeats
from vigil.plans import scratch
from vigil.plans.shipping import ship

WINDOW, GRAM, STEP = 400, 32, 16
#: Members gathered in a task at most: some 1.5 MB of text.
BUCKET = 2048
ROUNDS = 9  # 2^9 places are more than an anchor can have in a window


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    for c in range(0, len(text) - WINDOW + 1, repeats.LIMIT):
        yield c, text[c : c + repeats.LIMIT + WINDOW - 1]


def _cells(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum([0, *map(len, texts[:-1])])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    grams = hashing.Stretches(data).every(GRAM)
    lo, n, anchor = repeats.cells_of(grams, owner, WINDOW, GRAM)
    owner = owner[lo]
    return owner, lo - first[owner], n, anchor - lo, grams[anchor].view(np.int64), hashing.Stretches(data, 2).hash(lo, lo + n + WINDOW - 1).view(np.int64)


def repeated_starts(members: list[bytes]) -> list[np.ndarray]:
    """For each member the places where a window starts that another one starts too, by bucket-pointer refinement."""
    size = np.array([len(m) for m in members])
    text = np.frombuffer(b"".join(members), np.uint8)
    end = np.repeat(np.cumsum(size), size)
    n = len(text)
    left = end - np.arange(n)  # bytes of the member from each place on

    def pointers(active: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Bucket pointers of the active suffixes; -1 for those alone in their bucket and for all others."""
        out = np.full(n, -1, np.int64)
        if len(active):
            _, bucket, count = np.unique(key, return_inverse=True, return_counts=True)
            many = count[bucket] > 1
            out[active[many]] = bucket[many]
        return out

    active = np.flatnonzero(left >= STEP)
    bucket, length = pointers(active, hashing.Stretches(text).every(STEP)[active]), STEP
    while length < WINDOW:
        further = min(length, WINDOW - length)
        active = np.flatnonzero((bucket >= 0) & (left >= length + further))
        active = active[bucket[active + further] >= 0]
        bucket = pointers(active, bucket[active] * n + bucket[active + further])
        length += further
    begin = np.cumsum(size) - size
    return [np.flatnonzero(bucket[b : b + s] >= 0) for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


NODE = "lo long, at long, n_places long, b1 long, b2 long, block long, text binary, n long"


def _nodes(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Contested cells with their text: lo (first window), at (place of the anchor in the text), n_places (windows),
    b1, b2 (bucket), block (range of the anchor's places), n (members of the bucket)."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema["doc"], docs.schema["th"], *T._parse_datatype_string(NODE).fields])
    sizes = scratch.table(cells.groupBy("gram").agg(F.count("*").alias("members")))
    cells = cells.join(sizes, "gram").select("doc", "th", F.struct("at", "gram", "members").alias("x"))
    rows = repeats.beside_text(docs, scratch.table(repeats.per_document(cells, "x")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                for p in batch.column(3)[i].as_py():
                    lo, n, off = repeats.unpacked(p["at"])
                    at.append(i)
                    out.append((lo, off, n, p["gram"], 0, 0, text[lo : lo + n + WINDOW - 1], p["members"]))
                if len(out) >= 20_000 or i == batch.num_rows - 1:
                    yield _node_batch([c.take(pa.array(at, pa.int64())) for c in batch.columns[:2]], out, schema)
                    at, out = [], []

    return scratch.table(rows.mapInArrow(run, schema))


def _node_batch(head: list, rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([*head, *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], schema.names)


def _halves(nodes: DataFrame, level: int) -> DataFrame:
    """Each node's windows by the half of the range in which the anchor's place lies, with the text that all windows of
    that half share added to the bucket's identifier."""
    ship(nodes.sparkSession)
    schema, size = nodes.schema, 1 << (ROUNDS - level)

    def shared(at: int, first: int) -> tuple[int, int]:
        """Where the text that all windows with the anchor at places first to first + size - 1 share begins and ends."""
        return at - first, at + max(GRAM, WINDOW - (first + size - 1))

    def children(row: dict) -> Iterator[tuple]:
        for block in (2 * row["block"], 2 * row["block"] + 1):
            first, last = block * size, block * size + size - 1
            # windows start at 0 ... n_places - 1, and there the anchor's place in the window is at - start
            a, b = max(0, row["at"] - last), min(row["n_places"] - 1, row["at"] - first)
            if a > b:
                continue
            x, y = shared(row["at"], first)
            bucket = hashing.digest128(b"%d %d %d " % (row["b1"], row["b2"], block) + row["text"][x:y])
            yield (row["lo"] + a, row["at"] - a, b - a + 1, *bucket, block, row["text"][a : b + WINDOW], 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            names = batch.schema.names[2:]
            for i, row in enumerate(zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True)):
                for child in children(dict(zip(names, row, strict=True))):
                    at.append(i)
                    out.append(child)
            yield _node_batch([c.take(pa.array(at, pa.int64())) for c in batch.columns[:2]], out, schema)

    return nodes.mapInArrow(run, schema).drop("n")


def _refined(nodes: DataFrame) -> DataFrame:
    """(doc, th, lo, hi): spans of repeated windows in buckets that are gathered, none above ``BUCKET``."""
    ship(nodes.sparkSession)
    schema = T.StructType([nodes.schema["doc"], nodes.schema["th"], *T._parse_datatype_string("lo long, hi long").fields])
    buckets = nodes.groupBy("b1", "b2").agg(F.collect_list(F.struct("doc", "th", "lo", "text")).alias("m")).select("m")
    arrow_doc = to_arrow_type(nodes.schema["doc"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column(0):
                members = m.as_py()
                for x, starts in zip(members, repeated_starts([x["text"] for x in members]), strict=True):
                    if len(starts):
                        cut = np.flatnonzero(np.diff(starts) > 1) + 1
                        out += [(x["doc"], x["th"], x["lo"] + int(p[0]), x["lo"] + int(p[-1]) + WINDOW) for p in np.split(starts, cut)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (arrow_doc, pa.int64(), pa.int64(), pa.int64()), strict=True)], schema.names)

    return buckets.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, lo, hi) of ``repeats.keyed`` documents: byte spans [lo, hi) of windows that start elsewhere too."""
    cells = scratch.table(repeats.met(docs, _pieces, _cells, ordered=False))
    # contested cells of one text that met in no part: a text has no more of them than there are parts
    same = Window.partitionBy("gram", "u")
    further = cells.filter("further").withColumns({"copies": F.count("*").over(same), "number": F.row_number().over(same.orderBy(repeats.place("at")))})
    further = scratch.table(further)
    lo = repeats.lo_of("at")
    found = [x.select("doc", "th", lo.alias("lo"), (lo + repeats.n_of("at") + (WINDOW - 1)).alias("hi")) for x in (cells.filter("final"), further.filter("copies > 1 and not final"))]
    nodes = _nodes(further.filter("number = 1"), docs)
    for level in range(1, ROUNDS + 1):
        found.append(_refined(nodes.filter(F.col("n") <= BUCKET)))
        large = nodes.filter(F.col("n") > BUCKET)
        if large.isEmpty():
            break
        halves = scratch.table(_halves(large, level))
        sizes = scratch.table(halves.groupBy("b1", "b2").agg(F.count("*").alias("n")).filter("n > 1"))
        nodes = scratch.table(halves.join(sizes, ["b1", "b2"]).select(*nodes.columns))
        if level == ROUNDS:  # the shared text is the window itself: all that is left is repeated
            found.append(nodes.select("doc", "th", "lo", (F.col("lo") + WINDOW).alias("hi")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def removed_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left, as text)."""
    ship(docs.sparkSession)
    own = repeats.keyed(docs, id_col, text_col)
    spans = scratch.table(repeats.per_document(repeated_spans(own).withColumn("x", F.struct("lo", "hi")), "x"))
    rows = repeats.beside_text(own, spans, "left")
    fields = T._parse_datatype_string("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string").fields
    schema = T.StructType([T.StructField(id_col, rows.schema["doc"].dataType), *fields])

    def cut(text: bytes, parts: pa.ListScalar) -> tuple[int, int, int, str, str]:
        merged = repeats.union_of(*[parts.values.field(k).to_numpy() for k in ("lo", "hi")]) if parts.is_valid else []
        kept, at = [], 0
        for a, b in merged:
            kept.append(text[at:a])
            at = b
        rest = b"".join([*kept, text[at:]])
        return len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cut(t.as_py(), p) for t, p in zip(batch.column(2), batch.column(3), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], schema.names)

    return rows.mapInArrow(run, schema)
