"""Near-duplicate groups by SimHash and covering locality-sensitive hashing.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its three-word shingles. Two
fingerprints link at ``RADIUS`` = 3 or fewer differing bits, and a group is what links connect.

Covering masks: each bit position gets a vector of RADIUS + 1 bits; for each of the 15 vectors v other than zero, table v
keeps the positions whose vector has an odd product with v. Any three positions leave a v that is orthogonal to all of
their vectors, so a pair within the radius agrees on all that some table keeps: every link collides, none by chance
only. A bucket with more than ``BUCKET`` fingerprints is dealt out again by the same masks over the bits that its key
does not hold yet (about half of the rest each time); after three rounds about 8 bits are free, so no bucket can hold
over 2^9 different fingerprints, whatever the input.

Within a bucket all pairs are compared, but only a spanning forest of the links leaves the task: never more rows than
members. Large-star and small-star rounds over these edges give the groups.

Defined results: a null or empty text has fingerprint zero, linked like any other; ``component_id`` is the smallest
doc_id of the group, nulls aside (null if it has none); repeated rows are in the same group; an empty table gives an
empty result. Exact copies share a fingerprint and are one row from the start, so a group of copies costs nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.plans import scratch
from vigil.plans.shipping import ship

RADIUS, SHINGLE, SEED = 3, 3, 42
TABLES = 2 ** (RADIUS + 1) - 1
BUCKET, ROUNDS = 512, 3


def _fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[: max(0, len(words) - SHINGLE)])).tolist()
    last = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "__vg_fp", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint as one more column."""
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__vg_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps, pa.int64())], [*batch.schema.names[:-1], name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField(name, T.LongType())]))


def covering_masks(free: int) -> list[int]:
    """Subsets of the bits ``free``: any RADIUS of these bits are missing together from at least one subset."""
    places = [i for i in range(64) if free >> i & 1]
    vector = {i: k % TABLES + 1 for k, i in enumerate(places)}
    return [sum(1 << i for i in places if (vector[i] & v).bit_count() & 1) for v in range(1, TABLES + 1)]


def _masks(rounds: int) -> list[list[int]]:
    """For each round the bits that a bucket's key holds, by the bucket's path (a number in base 15)."""
    level, out = [0], []
    for _ in range(rounds):
        level = [held | new for held in level for new in covering_masks(~held & (2**64 - 1))]
        out.append(level)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the smallest member for each group of linked fingerprints in a bucket."""
    u, n = fps.view(np.uint64), len(fps)
    label = np.arange(n)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= RADIUS
    while True:  # each takes the least label among its links
        least = np.where(near, label[None, :], n).min(axis=1)
        if (least == label).all():
            return [(int(fps[i]), int(fps[label[i]])) for i in range(n) if label[i] != i]
        label = least


def _bucket_edges(buckets: DataFrame) -> DataFrame:
    ship(buckets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = set()
            for x in batch.column(0):
                edges.update(_forest(np.array(sorted(x.as_py()), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect the linked ones of the different fingerprints in column ``fp``."""
    found, rows = [], fps.select("fp", F.lit(0).alias("path"))
    for k, masks in enumerate(_masks(ROUNDS)):
        by_path = F.array(*[F.lit(_signed(m)) for m in masks])
        rows = rows.select("fp", F.explode(F.sequence(F.col("path") * TABLES, F.col("path") * TABLES + TABLES - 1)).alias("path"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.element_at(by_path, F.col("path") + 1)))
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1")
        rows = rows.join(sizes, ["path", "key"])
        rows = scratch.table(rows)
        last = k == ROUNDS - 1
        small = (rows if last else rows.filter(F.col("n") <= BUCKET)).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(_bucket_edges(small))
        rows = rows.filter(F.col("n") > BUCKET).select("fp", "path")
        if last or rows.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for every node a that is not the least of its component, b being the least. Rounds of large-star (each
    node hands its larger neighbours to its least one) and small-star (the same for its smaller ones) until stable."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        # written: a join that shares its shuffle with the aggregation below it could not deal a hub to several tasks
        least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        made.append(least)
        moved = both.join(least, "a")
        if large:
            return moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        rest = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    made: list[DataFrame] = []
    e, before = scratch.table(edges), None
    while True:
        done = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if done == before:
            return e
        before = done
        large = scratch.table(star(e, True))
        old, e = e, scratch.table(star(large, False))
        scratch.drop(old, large, *made)
        made.clear()


def grouped(fps: DataFrame) -> DataFrame:
    """For rows (fp, least) with ``least`` the smallest doc_id of a fingerprint: fp and the smallest of its group."""
    own = components(links(fps)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    whole = fps.join(own, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = scratch.table(whole.groupBy("root").agg(F.min("least").alias("component_id")))
    return whole.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its fingerprint in hex and the smallest id of its group."""
    rows = scratch.table(with_fingerprints(docs, text_col, keep=[id_col]).toDF(id_col, "fp"))
    fps = scratch.table(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    return rows.join(grouped(fps), "fp").select(F.col(id_col), hexed(F.col("fp")).alias("fingerprint"), "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
