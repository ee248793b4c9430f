"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents with the same set of sources (their membership pattern) are alike
to the flow, so the corpus is first summed by pattern. Each pattern can give its words to any of its sources, once at
no cost and each further time at a cost that rises with every repetition (convex, so a cheap pass is always used up
before a dearer one). Each source takes its quota. The min-cost flow of this small network says how many words of each
pattern go to each source in each pass; documents of a pattern are then taken in the order of a seeded hash until the
words are reached, the last of them in part.

Defined results: a null text has size 0 and takes nothing; a null source counts as a source of its own, after all
others; repeated rows and ties are ordered by the seeded hash of id and text and are taken one after another; all sizes zero give targets of zero; an empty table gives an empty result; reruns take the same words.

Scale: only sums by pattern meet on the driver, at most ``MAX_PATTERNS`` of them (a mix has a weight per source; more
is refused, not cut off). The words to take are found by cumulative sums over hash ranges, as many as a pattern's rows
want: one sum for each range, and exact running sums only within a range, so the order of a hot source is never made in
one task. Texts are shuffled once, by range, and only where the rows themselves are wanted (``mixed``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.plans import scratch

MAX_PATTERNS = 100_000
PASSES = 2
WEIGHTS = (5, 2, 1)
SHARE = 1.5
#: Bytes of a plan that is broadcast.
BROADCAST = 8 << 20
#: Rows of a range of the seeded order, about.
RANGE = 1000
SEED = 7


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = PASSES) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes, none above ``most`` times its source's size: what a
    source can't take is shared out again by weight among the others."""
    out, rest = [0.0] * len(sizes), min(share, most) * sum(sizes)
    open_ = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    weight = sum(weights)
    for k, i in enumerate(open_):
        if most * sizes[i] * weight > weights[i] * rest:
            for j in open_[k:]:
                out[j] = weights[j] * rest / weight
            break
        out[i] = float(most * sizes[i])
        rest, weight = rest - out[i], weight - weights[i]
    return out


def min_cost_flow(patterns: Sequence[tuple[frozenset[int], int]], quotas: Sequence[int], passes: int = PASSES) -> dict[tuple[int, int], int]:
    """Words that pattern p gives to source s: {(p, s): words}. A pattern's k-th pass costs k - 1 a word.

    The passes of a pattern are parallel arcs of rising cost to the sink, and all other arcs are free, so a cheapest path
    is any path to the cheapest pass with room: passes are filled in order. A pass is filled by rounds: one search from
    all sources with words left gives each node its distance, then paths that go one step further each time are filled
    until none is left (a path may move words of a pattern from one source to another). A round costs as much as the
    network has arcs, and the shortest path is longer with each.
    """
    flow: list[dict[int, int]] = [{} for _ in patterns]
    members: list[list[int]] = [[] for _ in quotas]
    for p, (of, _) in enumerate(patterns):
        for s in of:
            members[s].append(p)
    left, room = list(quotas), [0] * len(patterns)
    for _ in range(passes):  # all that costs as much is used before anything dearer
        room = [r + size for r, (_, size) in zip(room, patterns, strict=True)]
        while (far := _distances(members, flow, room, left)) is not None:
            _fill(members, flow, room, left, far)
    return {(p, s): n for p, own in enumerate(flow) for s, n in own.items() if n}


def _distances(members: list[list[int]], flow: list[dict[int, int]], room: list[int], left: list[int]) -> tuple[list[int], list[int]] | None:
    """How many steps sources and patterns are from a source with words left (-1: more than the first pattern with
    room); None if no such pattern is reached."""
    of_source, of_pattern = [0 if n > 0 else -1 for n in left], [-1] * len(room)
    now, steps = [s for s, n in enumerate(left) if n > 0], 0
    while now:
        reached = []
        for s in now:
            for p in members[s]:
                if of_pattern[p] < 0:
                    of_pattern[p] = steps + 1
                    reached.append(p)
        if any(room[p] > 0 for p in reached):
            return of_source, of_pattern
        steps += 2
        now = []
        for p in reached:
            for t, n in flow[p].items():
                if n > 0 and of_source[t] < 0:
                    of_source[t] = steps
                    now.append(t)
    return None


def _fill(members: list[list[int]], flow: list[dict[int, int]], room: list[int], left: list[int], far: tuple[list[int], list[int]]) -> None:
    """Fill shortest paths until none is left. A step that leads nowhere is not tried again."""
    of_source, of_pattern = far
    next_pattern = [0] * len(members)
    givers, next_giver = [list(own) for own in flow], [0] * len(flow)
    for start, words in enumerate(left):
        if words <= 0:
            continue
        path = [start]  # a source, a pattern, a source, ...
        while path and left[start] > 0:
            if len(path) % 2:
                s = path[-1]
                while next_pattern[s] < len(members[s]) and of_pattern[members[s][next_pattern[s]]] != of_source[s] + 1:
                    next_pattern[s] += 1
                if next_pattern[s] < len(members[s]):
                    path.append(members[s][next_pattern[s]])
                else:
                    path.pop()
                    if path:
                        next_giver[path[-1]] += 1
            else:
                p = path[-1]
                if room[p] > 0:
                    _carry(path, flow, room, left)
                    path = [start]
                    continue
                own = givers[p]
                while next_giver[p] < len(own) and not (flow[p][own[next_giver[p]]] > 0 and of_source[own[next_giver[p]]] == of_pattern[p] + 1):
                    next_giver[p] += 1
                if next_giver[p] < len(own):
                    path.append(own[next_giver[p]])
                else:
                    path.pop()
                    next_pattern[path[-1]] += 1


def _carry(path: list[int], flow: list[dict[int, int]], room: list[int], left: list[int]) -> None:
    """Move as many words along a path as it can carry."""
    moved = [(path[k], path[k + 1]) for k in range(1, len(path) - 1, 2)]  # (pattern, source that gives its words up)
    amount = min([left[path[0]], room[path[-1]], *[flow[p][t] for p, t in moved]])
    for k in range(0, len(path) - 1, 2):
        s, p = path[k], path[k + 1]
        flow[p][s] = flow[p].get(s, 0) + amount
    for p, t in moved:
        flow[p][t] -= amount
    room[path[-1]] -= amount
    left[path[0]] -= amount


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``id``, ``size``, ``pattern``, ``source_size``, ``target`` and ``taken`` of every document.

    ``sources_col`` is a source or an array of sources. Sources in code-point order, null last, have ``weights`` in
    turn. For a document of several sources, source_size and target are those of the first of them.
    """
    out = _placed(docs, id_col, text_col, sources_col, weights, share, whole=False)
    own = {"id": "__vg.id", "size": "__vg.size", "pattern": "__vg.pattern", "source_size": "__vg_source", "target": "__vg_target", "taken": "__vg_taken"}
    return out.select(*[F.col(c).alias(name) for name, c in own.items()])


def _pattern(docs: DataFrame, sources_col: str) -> Column:
    kind = dict(docs.dtypes)[sources_col]
    raw = F.col(f"`{sources_col}`")
    pattern = F.sort_array(F.array_distinct(F.coalesce(raw, F.array(F.lit(None).cast(kind[6:-1]))))) if kind.startswith("array") else F.array(raw)
    return pattern.cast("array<string>")


def _hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def _own(docs: DataFrame, id_col: str, text_col: str, sources_col: str) -> Column:
    """What is known of a row: id, hash of the text, size, pattern and place in the seeded order."""
    order = F.xxhash64(F.lit(SEED), F.col(f"`{id_col}`")).alias("order")
    return F.struct(F.col(f"`{id_col}`").alias("id"), _hash(text_col).alias("th"), n_words(F.col(f"`{text_col}`")).alias("size"), _pattern(docs, sources_col).alias("pattern"), order)


def _ranged(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with a struct ``__vg`` (see ``_own``) and the range of the seeded order that each is in."""
    bits = plan.select(F.col("pattern").alias("__vg_pattern"), F.col("bits").alias("__vg_bits"))
    own = rows.withColumn("__vg_pattern", F.col("__vg.pattern")).join(bits, "__vg_pattern")
    top = F.call_function("shiftrightunsigned", F.col("__vg.order"), 64 - F.col("__vg_bits"))
    return own.withColumn("__vg_range", F.when(F.col("__vg_bits") == 0, F.lit(0).cast("long")).otherwise(top)).drop("__vg_bits")


def _placed(docs: DataFrame, id_col: str, text_col: str, sources_col: str, weights: Sequence[float], share: float, whole: bool) -> DataFrame:
    """The rows of ``docs`` (``whole``: with all their columns) with ``__vg``, source_size and target as ``__vg_source``
    and ``__vg_target``, and the words taken as ``__vg_taken``."""
    own = docs.select(_own(docs, id_col, text_col, sources_col).alias("__vg"))
    own = scratch.table(own)
    plan = _plan(own, weights, share)
    key = ["__vg_pattern", "__vg_range"]
    ranges = _ranged(own, plan).groupBy(*key).agg(F.sum("__vg.size").alias("words"))
    # words of a pattern in earlier ranges: a running sum over one row per pattern and range
    before = F.sum("words").over(Window.partitionBy("__vg_pattern").orderBy("__vg_range").rowsBetween(Window.unboundedPreceding, -1))
    columns = [F.col("source_size").alias("__vg_source"), F.col("target").alias("__vg_target"), F.col("quotas").alias("__vg_quotas")]
    starts = ranges.select(*key, F.coalesce(before, F.lit(0)).alias("__vg_before"))
    starts = scratch.table(starts.join(plan.select(F.col("pattern").alias("__vg_pattern"), *columns), "__vg_pattern"))
    rows = docs.withColumn("__vg", _own(docs, id_col, text_col, sources_col)) if whole else own
    unsigned = F.col("__vg.order").bitwiseXOR(F.lit(-(2**63)))
    order = [unsigned, *[F.col(f"__vg.{c}").asc_nulls_last() for c in ("id", "size", "th")]]
    within = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = _ranged(rows, plan).join(starts, key).withColumn("__vg_at", F.col("__vg_before") + F.coalesce(F.sum("__vg.size").over(within), F.lit(0)))
    total = F.lit(0).cast("long")
    for k in range(PASSES):  # pass k takes the words [0, quota k) of the pattern in the seeded order
        total = total + F.greatest(F.lit(0).cast("long"), F.least(F.col("__vg.size"), F.get(F.col("__vg_quotas"), F.lit(k)) - F.col("__vg_at")))
    return placed.withColumn("__vg_taken", total)


def _plan(own: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """For each pattern its words to take in each pass, its first source's size and target, and how many bits of the
    order make its ranges."""
    spark = own.sparkSession
    found = own.groupBy(F.col("__vg.pattern").alias("pattern")).agg(F.sum("__vg.size").alias("words"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} different sets of sources: a mix needs a weight for each source")
    names = sorted({s for r in found for s in r["pattern"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    size = [0] * len(names)
    for r in found:
        for s in r["pattern"]:
            size[number[s]] += r["words"]
    target = targets(size, [weights[i % len(weights)] for i in range(len(names))], share)
    patterns = [(frozenset(number[s] for s in r["pattern"]), int(r["words"])) for r in found]
    flow = min_cost_flow(patterns, [round(t) for t in target])
    taken = [0] * len(found)
    for (p, _), words in flow.items():
        taken[p] += words
    out = []
    for r, words, (_, has) in zip(found, taken, patterns, strict=True):
        first = number[r["pattern"][0]]
        quotas = [max(0, min(has, words - k * has)) for k in range(PASSES)]
        out.append((r["pattern"], quotas, size[first], float(target[first]), (r["n"] // RANGE).bit_length()))
    plan = spark.createDataFrame(out, "pattern array<string>, quotas array<long>, source_size long, target double, bits int")
    # one row a pattern, whose size is known here; beyond the bound rows meet it by a join that is split where it is skewed
    size = sum(64 + sum(len((s or "").encode()) + 8 for s in r["pattern"]) for r in found)
    return F.broadcast(plan) if size <= BROADCAST else scratch.table(plan)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, one row for each time a document is taken (a document of which
    at least half is taken in a pass counts as taken whole; an empty one is left out)."""
    n = F.floor(F.col("__vg_taken") / F.col("__vg.size") + 0.5).cast("int")
    out = _placed(docs, id_col, text_col, sources_col, WEIGHTS, SHARE, whole=True).filter("__vg.size > 0").withColumn("__vg_n", n).filter("__vg_n > 0")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__vg_n"))).alias("__vg_k")).drop("__vg_k")
