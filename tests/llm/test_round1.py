"""Stages on near copies, common words and rows whose ids repeat or are null."""

import collections
import random

import pytest

from vigil.llm import decontaminate, mixing, near_copies, quality

SCHEMA = "doc_id long, text string, lang string, source string"


def _near_rows():
    rng = random.Random(3)
    rows, common = [], " ".join(f"line{i}" for i in range(12))
    for g in range(25):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))]
        rows.append((10 * g, " ".join(base), "en", "a"))
        for k in range(1, 5):
            own = list(base)
            for _ in range(rng.randint(1, len(base) // 25)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 9999)}"
            rows.append((10 * g + k, " ".join(own), "en", "a"))
    rows += [(400 + i, f"{common} " + " ".join(f"x{i}y{j}" for j in range(80)), "en", "a") for i in range(60)]
    return rows + [rows[0], (900, None, "en", "a"), (901, "", "en", "a"), (None, "few words", "en", "a"), (None, rows[5][1], "en", "a"), (10, "another text", "en", "a")]


@pytest.mark.parametrize("heavy", [32, 2])
def test_near_copies_against_brute_force(spark, heavy, monkeypatch):
    monkeypatch.setattr(near_copies, "HEAVY", heavy)
    rows = _near_rows()

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    want = [min((x for x in of if x is not None), default=None) for of in ids.values()]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(want)
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_word_distance_alone_rejects(spark):
    rng = random.Random(1)
    listed = quality.COMMON_WORDS["en"]
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(rng.choice(listed) if rng.random() < 0.2 else word() for _ in range(300)), "en", "a") for i in range(60)]
    rows.append((100, " ".join(word()[: rng.randint(4, 6)] for _ in range(300)), "en", "a"))
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[100]["base_failed"] and got[100]["class_distance"] <= quality.MAX_CLASS_DISTANCE
    assert not got[100]["kept"] and all(got[i]["kept"] for i in range(60))


def test_rows_with_null_or_repeated_ids(spark):
    item = " ".join(f"b{i}" for i in range(30))
    rows = [(None, item, "en", "a"), (None, "clean one", "en", "a"), (7, item, "en", "a"), (7, "clean two", "en", "b")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = decontaminate.without_leaks(spark.createDataFrame(rows, SCHEMA), bench)
    assert sorted(r["text"] for r in clean.collect()) == ["clean one", "clean two"]


def test_mix_meets_targets_whatever_the_ids(spark):
    rows = [(None if i % 3 else 5, " ".join([f"t{i}"] * 10), "en", "abc"[i % 3]) for i in range(300)] + [(1, "same " * 10, "en", "a")] * 40
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = collections.Counter(r["source"] for r in mixing.mixed(docs).collect())
    target = {r["pattern"][0]: r["target"] for r in mixing.mix(docs).collect()}
    assert all(abs(10 * taken[s] - target[s]) <= 10 for s in target)


def test_masks_meet_every_pair_within_the_radius():
    rng = random.Random(4)
    masks = [m for p in range(near_copies.PARTS) for m in near_copies.covering_masks(p)]
    assert len(masks) == 126 and min(m.bit_count() for m in masks) == 16
    for _ in range(3000):
        flips = sum(1 << i for i in rng.sample(range(64), near_copies.RADIUS))
        assert any(flips & m == 0 for m in masks)


def test_near_copies_are_found_by_simhash_and_covering_masks(spark, monkeypatch):
    """Without prefixes, the pairs within the radius and no others are left."""
    monkeypatch.setattr(near_copies, "_prefixes", lambda text, heavy: spark.createDataFrame([], "key long, sig long, at int"))
    rng = random.Random(8)
    rows, want = [], set()
    for g in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(100)]
        own = list(base)
        for _ in range(g % 4):
            own[rng.randrange(len(own))] = f"n{rng.randint(0, 9999)}"
        sets = [near_copies._shingle_set(" ".join(x).encode()) for x in (base, own)]
        shared = len(set(sets[0].tolist()) & set(sets[1].tolist()))
        apart = int(decontaminate._fingerprint(sets[0]) ^ decontaminate._fingerprint(sets[1])).bit_count()
        rows += [(2 * g, " ".join(base), "en", "a"), (2 * g + 1, " ".join(own), "en", "a")]
        linked = 9 * shared >= 4 * (len(sets[0]) + len(sets[1])) and apart <= near_copies.RADIUS
        want |= {2 * g} if linked else {2 * g, 2 * g + 1}
    assert 60 <= len(want) < 120
    assert {r["doc_id"] for r in near_copies.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def _nearly_linked(n):
    """Texts that share most of one base; each links with few others, though fingerprints are near."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(len(own)), 1 + (i % 8 > 0)):
            own[k] = f"n{i}x{k}"
        rows.append((i, " ".join(own), "en", "a"))
    return rows


@pytest.mark.parametrize("bucket", [512, 2])
def test_pairs_of_a_group_of_near_copies_do_not_grow_with_its_square(spark, bucket, monkeypatch):
    monkeypatch.setattr(near_copies, "BUCKET", bucket, raising=False)
    decided, pairs = near_copies._decided, []

    def counted(found, *args):
        pairs.append(found.count())
        return decided(found, *args)

    monkeypatch.setattr(near_copies, "_decided", counted)
    rows = _nearly_linked(400)
    sets = [set(near_copies._shingle_set(r[1].encode()).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 9 * len(a & sets[j]) >= 4 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {find(i) for i in range(len(rows))}
    assert {r["doc_id"] for r in near_copies.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()} == want
    assert sum(pairs) <= 10 * len(rows), pairs


def test_buckets_give_all_pairs_within_the_radius(spark):
    """Buckets of many sets that share a mask's bits by chance, too: the pairs leave the task, the sets do not."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 14))) for b in base for _ in range(5)]
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    row = lambda i, fp: (i, 100, i // 2, fp, *[0] * len(near_copies.SKETCH))
    names = ["sig long", "n long", "comp long", "fp long", *[f"{c} long" for c in near_copies.SKETCH]]
    nodes = spark.createDataFrame([row(i, fp) for i, fp in enumerate(signed)], ", ".join(names))
    got = set()
    for p in range(near_copies.PARTS):
        got |= {(r["a"], r["b"]) for r in near_copies._met(nodes, near_copies.covering_masks(p)).collect()}
    near = {(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= near_copies.RADIUS}
    assert got == {(i, j) for i, j in near if i // 2 != j // 2}
