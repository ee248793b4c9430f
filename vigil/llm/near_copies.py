"""Near copies: SimHash and covering masks, an exact check by Jaccard similarity, and prefixes for what is farther apart.

Two texts link where the sets of their five-word shingles have a similarity of 0.8 or more, and a group is what links
connect. Sets get 64-bit SimHash fingerprints. One mask family for all that a similarity of 0.8 allows (19 bits, see
``decontaminate``) would take 2^20 tables, so a fingerprint is cut into ``PARTS`` halves: of two within ``RADIUS`` = 11
bits some half differs in five or fewer, and for these each half has 63 covering masks. A bit has a vector of six bits
(32 and its place), a mask keeps the bits whose vectors have an odd product with its number; five vectors leave a number
that is orthogonal to all, so every pair within the radius meets in a table. Sets that meet there within the radius are
decided on the whole sets.

Links beyond the radius (the mean distance at 0.8 is 10 bits) are found exactly in what is then still apart: with the
shingles of all texts in one order, a set of n can only reach 0.8 with another if the first n - ceil(0.8 n) + 1 of both
share one. Each set also has a sketch of 512 bits, the parity of its shingles by nine bits of their hash: two sketches
differ in at most as many bits as the sets in shingles, so candidates whose sketches or sizes rule 0.8 out go; the others
are decided on the whole sets. The order is that of the hashes, shingles held by more than ``HEAVY`` texts last; any order
finds every pair, this one makes few others.

A large group of different near copies is not compared pair by pair: by ``FEW`` of the masks of each half, and then by
prefixes, the sets of a bucket are first compared to one of them only, another one for each bucket and each turn, and each
set goes on with the likest one. What links so is one component; turns go on while they join much. The passes over all
masks and prefixes after that only join sets of different components. A mask's buckets are lists of at most ``BUCKET``
sets, compared within a task, which only pairs leave that fingerprints, sizes and half a sketch allow; links of fuller
buckets are found by prefixes, which are complete by themselves.

Defined results: words are as in ``simhash_dedup``; a text of fewer than five words is one shingle; null and empty texts
are copies of each other; of a group the row with the smallest (id, hash of the text) stays, null ids last; rows that
repeat both are one; ids that repeat or are null do no harm; an empty table gives an empty table. Texts with equal sets
are one node from the start.

Scale: 126 keys of a set are shuffled, half of them at a time, about a fifth of the shingles as numbers, sets only for
candidates, the texts once at the end. Keys of more than ``BUCKET`` sets are not gathered, prefixes are joined on the key,
which adaptive execution splits where it is skewed. A key holds 16 bits of a fingerprint, so beside the near copies a
bucket has a set in 65,536: fingerprints compared in tasks (a few ns each) grow with the square of the sets, rows do not.
Beyond some 33 million different sets most buckets are too full, and prefixes find what the first comparisons have not.
Sets that nearly link but are of different components all meet in the last round: its tests (not its rows) grow with the
square of a group of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm import decontaminate, simhash_dedup
from vigil.plans import scratch
from vigil.plans.shipping import ship

#: A shingle in more prefixes than this goes to the end of the order, the ``MOST`` commonest of them.
HEAVY, MOST, ROUNDS = 32, 100_000, 2
#: A fingerprint's parts, the differences that masks cover in one, and so those within which all pairs meet.
PARTS, COVERED = 2, 5
RADIUS = PARTS * (COVERED + 1) - 1
PRINT = ["fp"]
#: Tables in which a bucket's sets are compared to one of them, before all tables.
FEW = 8
#: Comparing each set to a few goes on while a round adds more than one in STARS to what is joined.
STARS = 20
#: Sets of a bucket whose pairs are all compared, and pairs compared at a time.
BUCKET, COMPARED = 512, 100_000
#: Texts of which a task holds the sets at a time.
PIECE = 1000
#: The sketch of a set, as columns of 64 bits.
SKETCH = [f"s{i}" for i in range(8)]
#: The filter of texts whose sets are needed has 2^FILTER bits (8 MB).
FILTER = 26


def _shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(decontaminate._shingles((text or b"").lower())[0])


def _among(own: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of ``own`` are in ``of``, which is sorted: nothing is sorted anew for each text."""
    if not len(of):
        return np.zeros(len(own), bool)
    return of[np.minimum(np.searchsorted(of, own), len(of) - 1)] == own


def _sign(own: np.ndarray) -> int:
    """The number that stands for a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def _sketch(own: np.ndarray) -> np.ndarray:
    """For each value of nine bits whether an odd number of the set's shingles has it."""
    bits = 64 * len(SKETCH)
    odd = np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, PIECE):
            yield b.slice(k, PIECE)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, th, sig, n, fp, sketch) of every row: its id, the hash of its text, the number of its set, its size, its
    fingerprint and its sketch."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    names = ["doc", "th", "sig", "n", *PRINT, *SKETCH]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            own = np.zeros((b.num_rows, len(names) - 2), np.int64)
            for row, x in zip(own, b.column(2), strict=True):
                found = _shingle_set(x.as_py())
                row[:3] = _sign(found), len(found), decontaminate._fingerprint(found).view(np.int64)
                row[3:] = _sketch(found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in own.T)], names)

    return df.mapInArrow(run, df.select("doc", "th", *[F.lit(0).cast("long").alias(c) for c in names[2:]]).schema)


def covering_masks(part: int) -> list[int]:
    """The bits that each table of a part keeps: 16, or all 32 in one."""
    bits = 64 // PARTS
    return [sum(1 << bits * part + i for i in range(bits) if ((bits + i) & v).bit_count() & 1) for v in range(1, 2 ** (COVERED + 1))]


def _masked(nodes: DataFrame, masks: list[int], *more: Column) -> DataFrame:
    """(key, ...): the nodes under the bits that each mask keeps of their fingerprints."""
    known = F.array(*[F.lit(simhash_dedup._signed(m)) for m in masks])
    rows = nodes.select("sig", "n", "comp", *PRINT, *more, F.explode(known).alias("mask"))
    return rows.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), *[c for c in rows.columns if c != "mask"])


def _prefixes(texts: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(key, sig, at): the shingles of each set's prefix and their places in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "sig", "at"]
        for b in _pieces(batches):
            cols = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int32)]
            for x in b.column(0):
                own = _shingle_set(x.as_py())
                n = len(own)
                late = _among(own, heavy)
                first = np.concatenate((own[~late], own[late]))[: n - -(-4 * n // 5) + 1] if n else own
                for c, v in zip(cols, (first.view(np.int64), np.full(len(first), _sign(own)), np.arange(len(first)))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(c[0].dtype)) for c in cols], names)

    return texts.mapInArrow(run, "key long, sig long, at int")


def _sets(docs: DataFrame, text_col: str, ends: DataFrame) -> DataFrame:
    """(sig, own): the sets of ``ends`` (sig, th) as arrays. The texts to take are found by a filter of fixed size, one
    bit for each value of ``FILTER`` bits of a text's hash, and then exactly by the join."""
    place = F.col("th").bitwiseAND(2**FILTER - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = ends.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = np.zeros(2 ** (FILTER - 6), np.uint64)
    for batch in words.toArrow().to_batches():  # at most 2^(FILTER - 6) rows, whatever the input
        held[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    known = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            at = b.column(0).to_numpy() & (2**FILTER - 1)
            take = np.flatnonzero(known.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1))
            own = [_shingle_set(b.column(1)[int(i)].as_py()) for i in take]
            sets = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(map(_sign, own), pa.int64()), sets], ["sig", "own"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(F.xxhash64(text).alias("th"), text.cast("binary").alias("text")).mapInArrow(run, "sig long, own array<long>")
    return found.join(ends.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def _differ(marks: list[str]) -> Column:
    """In how many bits the fingerprints or sketches of ``x`` and ``y`` differ."""
    return sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in marks), F.lit(0))


def _may_link(marks: list[str]) -> Column:
    """Whether sizes and sketches of ``x`` and ``y`` allow 0.8 (at most a ninth of their shingles differ); for
    fingerprints, whether they are within the radius."""
    both = F.col("x.n") + F.col("y.n")
    near = _differ(marks) <= RADIUS if marks == PRINT else 9 * _differ(marks) <= both
    return (9 * F.least("x.n", "y.n") >= 4 * both) & near


def _decided(pairs: DataFrame, docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """Those pairs whose whole sets have the similarity."""
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    own = _sets(docs, text_col, nodes.select("sig", "th").join(ends, "sig", "left_semi"))
    both = pairs.join(own.toDF("a", "own_a"), "a").join(own.toDF("b", "own_b"), "b")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return both.filter(9 * shared >= 4 * (F.size("own_a") + F.size("own_b"))).select("a", "b")


def _star(rows: DataFrame, marks: list[str], turn: int = 0) -> DataFrame:
    """(a, b), a > b: each set with the likest of another component, of those chosen one for each shared key, another
    one in each turn."""
    one = F.min(F.struct(F.xxhash64("key", "sig", F.lit(turn)).alias("order"), "sig", "n", "comp", *marks)).alias("one")
    y = rows.groupBy("key").agg(one).select("key", "one.*").alias("y")
    pairs = rows.alias("x").join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & _may_link(marks))
    best = pairs.groupBy(F.col("x.sig").alias("x")).agg(F.min(F.struct(_differ(marks).alias("differ"), F.col("y.sig").alias("y"))).alias("best"))
    return best.select(F.greatest("x", "best.y").alias("a"), F.least("x", "best.y").alias("b")).distinct()


def _close(sizes: np.ndarray, sig: np.ndarray, n: np.ndarray, comp: np.ndarray, *marks: np.ndarray) -> Iterator[list[np.ndarray]]:
    """(a, b), a > b, for the pairs of each bucket that may link, of different components; ``sizes`` tells how many of the
    sets in a row each bucket has."""
    at, (fp, *sketch) = np.arange(len(sig)), [c.view(np.uint64) for c in marks]  # of signed numbers numpy counts other bits
    after = np.repeat(np.cumsum(sizes), sizes) - at - 1  # of the same bucket
    upto = np.cumsum(after)
    first = 0
    while first < len(sig):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + COMPARED, "right")))
        k = after[first:last]
        x = np.repeat(at[first:last], k)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= RADIUS) & (comp[x] != comp[y])
        x, y = x[near], y[near]
        both = n[x] + n[y]
        apart = sum((np.bitwise_count(c[x] ^ c[y]) for c in sketch), np.zeros(len(x), np.int64))
        near = (9 * np.minimum(n[x], n[y]) >= 4 * both) & (9 * apart <= both)
        x, y = sig[x[near]], sig[y[near]]
        yield [np.maximum(x, y), np.minimum(x, y)]
        first = last


def _met(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(a, b), a > b, as a table: all pairs of different components that meet under a mask, in buckets of up to
    ``BUCKET`` sets, and may link. Half as many bits of a sketch, pairs of them added, are a sketch as well."""
    half = len(SKETCH) // 2
    short = [F.col(c).bitwiseXOR(F.col(d)).alias(c) for c, d in zip(SKETCH[:half], SKETCH[half:], strict=True)]
    rows = _masked(nodes, masks, *short)
    crowded = scratch.table(_masked(nodes, masks).groupBy("key").count().filter(F.col("count") > BUCKET).select("key"))
    of = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.collect_list(F.struct("sig", "n", "comp", *PRINT, *SKETCH[:half])).alias("sets")]
    buckets = rows.join(crowded, "key", "left_anti").groupBy("key").agg(*of).filter("lo < hi").select("sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for found in _close(b.column(0).value_lengths().to_numpy(), *(c.to_numpy() for c in b.column(0).flatten().flatten())):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b"])

    out = scratch.table(buckets.mapInArrow(run, "a long, b long"))
    scratch.drop(crowded)
    return out


def _rest(rows: DataFrame) -> DataFrame:
    """(a, b), a > b: all pairs of different components that share a key and may link. One of the two is not of the
    bucket's largest component, so that one's members are not compared with each other."""
    open_ = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("weight").alias("main")).filter("lo < hi").select("key", "main")
    rows = rows.join(open_, "key")
    # the first shared shingle leaves enough after it; later ones needn't be tested
    left = 9 * F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= 4 * (F.col("x.n") + F.col("y.n"))
    once = (F.col("x.weight") == F.col("x.main")) | (F.col("x.sig") > F.col("y.sig"))
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & once
    pairs = rows.alias("x").join(rows.filter("weight <> main").alias("y"), on & left & _may_link(SKETCH))
    return pairs.select(F.greatest("x.sig", "y.sig").alias("a"), F.least("x.sig", "y.sig").alias("b")).distinct()


def _heavy(text: DataFrame) -> np.ndarray:
    """The common shingles, sorted; ``MOST`` at most."""
    heavy = np.zeros(0, np.uint64)
    for _ in range(ROUNDS):
        often = _prefixes(text, heavy).groupBy("key").count().filter(F.col("count") > HEAVY).orderBy(F.desc("count"), "key")
        with scratch.cleaned(text.sparkSession):
            found = np.array([r["key"] for r in often.limit(MOST - len(heavy)).collect()], np.int64).view(np.uint64)
        new = np.setdiff1d(found, heavy)
        if not len(new):
            break
        heavy = np.union1d(heavy, new)
    return heavy


def _placed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """The nodes with their component and its weight: its number of sets above 40 bits of its number, which tell
    components of one size apart."""
    sizes = scratch.table(found.groupBy(F.col("b").alias("comp")).agg((F.count("*") + 1).alias("size")))
    own = nodes.drop("head", "th").join(found.toDF("sig", "comp"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    size = F.least(F.coalesce("size", F.lit(1)), F.lit(2**22)).cast("long")
    weight = F.shiftleft(size, 40).bitwiseOR(F.col("comp").bitwiseAND(2**40 - 1))
    out = scratch.table(own.join(sizes, "comp", "left").withColumn("weight", weight).drop("size"))
    scratch.drop(sizes)
    return out


def grouped(docs: DataFrame, nodes: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b) for every set a that is not the least of its group, b being the least (by number). ``nodes`` has each set's
    number, size, fingerprint, sketch and the hash of a text with it."""
    found, joined = scratch.table(docs.sparkSession.createDataFrame([], "a long, b long")), 0

    def go_on(*candidates: Callable[[DataFrame], DataFrame]) -> bool:
        """A round: the candidates, of which those are links that the whole sets bear out, join components. Whether
        that was worth while."""
        nonlocal found, joined
        now = _placed(nodes, found)
        parts = [c(now) for c in candidates]
        pairs = parts[0]
        for p in parts[1:]:
            pairs = pairs.unionByName(p)
        before = joined
        if not pairs.isEmpty():
            new = scratch.table(_decided(pairs.distinct(), docs, text_col, nodes))
            comps = now.select("sig", "comp")
            ends = new.join(comps.toDF("a", "x"), "a").join(comps.toDF("b", "y"), "b")
            merged = simhash_dedup.components(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
            roots = comps.join(merged.toDF("comp", "root"), "comp", "left").select(F.col("sig").alias("a"), F.coalesce("root", "comp").alias("b"))
            old, found = found, scratch.table(roots.filter("a <> b"))
            joined = found.count()
            scratch.drop(new, old, merged)
        scratch.drop(now, *parts)
        return STARS * (joined - before) > joined

    go_on(*[lambda now, p=p: scratch.table(_star(_masked(now, covering_masks(p)[:FEW]), PRINT)) for p in range(PARTS)])
    text = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    every = scratch.table(_prefixes(text, _heavy(text)))
    shared = every.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo < hi").select("key")
    rows = scratch.table(every.join(shared, "key", "left_semi").distinct())  # exact copies are one
    scratch.drop(every)
    turn = 0
    while go_on(*[lambda now, t=t: scratch.table(_star(rows.join(now, "sig"), SKETCH, t)) for t in (turn, turn + 1)]):
        turn += 2
    go_on(*[lambda now, p=p: _met(now, covering_masks(p)) for p in range(PARTS)])
    go_on(lambda now: scratch.table(_rest(rows.join(now, "sig"))))
    scratch.drop(rows)
    return found


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each group, with all its columns; one row of repeated rows."""
    order = F.struct(F.isnull("doc").alias("none"), "doc", "th")
    same = [F.min(c).alias(c) for c in ("n", *PRINT, *SKETCH)]  # the same for all of a set
    nodes = scratch.table(signed(docs, id_col, text_col).groupBy("sig").agg(F.min(order).alias("head"), F.min("th").alias("th"), *same))
    found = grouped(docs, nodes, text_col)
    own = found.select(F.col("a").alias("sig"), F.col("b").alias("root"))
    heads = nodes.join(own, "sig", "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("head").alias("head"))
    # the join's keys are columns of the rows, so that dropping repeated rows needs no second shuffle of the texts
    key = lambda doc, th: {"__vg_null": F.isnull(doc), "__vg_key": F.coalesce(doc.cast("string"), F.lit("")), "__vg_th": th}
    heads = scratch.table(heads.select(*[c.alias(k) for k, c in key(F.col("head.doc"), F.col("head.th")).items()]))
    scratch.drop(nodes, found)
    mine = key(F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return docs.withColumns(mine).join(heads, list(mine), "left_semi").dropDuplicates(list(mine)).drop(*mine)
