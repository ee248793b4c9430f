"""Operators on texts against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash

from vigil.llm import decontaminate, hashing, license_scan, quality, repeated_bytes, repeated_words, repeats, simhash_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_repeated_words(docs, none, rows):
    found = repeated_words.removed_words(docs)
    # rows with the same id and text are one document; an id's other texts go by the hash of the text
    order = sorted({(d is None, d or 0, _signed(xxhash.xxh64_intdigest(t or "", 42)), t) for d, t, *_ in rows}, key=lambda x: x[:3])
    seen, want = set(), {}
    for null, d, _, t in order:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone.update(range(p, p + 20))
            seen.add(k)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[None if null else d, t] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert bag(found.collect()) == bag((d, *want[d, t]) for d, t, *_ in rows)
    assert any(x[1] for x in want.values())
    assert repeated_words.removed_words(none).count() == 0


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _bytes_removed(rows, window=400):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = collections.Counter(b[p : p + window] for b in texts for p in range(len(b) - window + 1))
    out = []
    for (d, *_), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((np.diff(np.concatenate(([False], gone)).astype(int)) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return bag(out)


@pytest.mark.parametrize("bucket", [64, 3, 1])
def test_repeated_bytes(docs, none, rows, bucket, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "BUCKET", bucket)  # small buckets take the way of large ones
    assert bag(repeated_bytes.removed_bytes(docs).drop("kept").collect()) == _bytes_removed(rows)
    assert repeated_bytes.removed_bytes(none).count() == 0


def test_refinement_of_a_bucket():
    rng = np.random.default_rng(0)
    members = [rng.integers(97, 99, n, np.uint8).tobytes() for n in (600, 430, 900)]
    members += [members[0][50:550], members[1] + b"x", members[2][:399]]
    at = collections.Counter(m[p : p + 400] for m in members for p in range(len(m) - 399))
    for m, starts in zip(members, repeated_bytes.repeated_starts(members), strict=True):
        assert starts.tolist() == [p for p in range(len(m) - 399) if at[m[p : p + 400]] > 1]


def test_window_least():
    h = np.random.default_rng(1).integers(0, 5, 300, np.uint64) << np.uint64(40)
    for size in (1, 4, 17, 300):
        assert hashing.window_least(h, size).tolist() == [p + int(np.argmin(h[p : p + size])) for p in range(len(h) - size + 1)]
    assert len(hashing.window_least(h[:3], 4)) == 0


def _fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(w)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@pytest.mark.parametrize("bucket", [512, 4])
def test_simhash_groups(docs, none, rows, bucket, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BUCKET", bucket)
    fps = [_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, *_) in enumerate(rows)]
    assert bag(simhash_dedup.near_duplicates(docs).collect()) == bag(want)
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_a_component_of_very_many_members(spark):
    """A hub with 10^5 neighbours, and a path whose numbers jump."""
    hub = spark.range(1, 100_001).selectExpr("id + 7 as a", "7L as b")
    path = spark.range(200).selectExpr("200000 + greatest(id * 7919 % 1000, (id + 1) * 7919 % 1000) as a", "200000 + least(id * 7919 % 1000, (id + 1) * 7919 % 1000) as b")
    found = simhash_dedup.components(hub.unionByName(path))
    counts = {r["b"]: r["count"] for r in found.groupBy("b").count().collect()}
    assert counts == {7: 100_000, 200_000: 200}
    assert found.count() == found.select("a").distinct().count()


def test_covering_masks_meet_every_pair_within_the_radius():
    rng = np.random.default_rng(2)
    for free in (2**64 - 1, 0x00FF00FF0F0F3333):
        masks, places = simhash_dedup.covering_masks(free), [i for i in range(64) if free >> i & 1]
        for _ in range(3000):
            flips = sum(1 << int(i) for i in rng.choice(places, 3, replace=False))
            assert any(flips & m == 0 for m in masks)


def _distances(text, lang, refs):
    """Class and word distance of a text, and whether they let it pass, from definitions."""
    w, t = WORD.findall(text or ""), text or ""
    name = lang if lang in quality.COMMON_WORDS else ""
    classes, hits = refs[name]
    at = {c: k for k, (chars, _) in enumerate(quality.CLASSES.values()) for c in chars} | {c: len(quality.CLASSES) + 1 for c in quality.LOWER}
    own = [0] * (len(quality.CLASSES) + 2)
    for c in t:
        own[at.get(c, len(quality.CLASSES))] += 1

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt(max(0, sum(sum(a * math.log2(a / c) for a, c in zip(x, m) if a) for x in (p, q)) / 2))

    other = len(quality.CLASSES)
    class_d = word_d = None
    if len(t) >= quality.MIN_CLASS_CHARS:
        if name:
            class_d = js(own, classes)
        elif 2 * own[other] <= len(t):
            class_d = js(own[:other] + own[other + 1 :], classes[:other] + classes[other + 1 :])
    limit = 1.0
    if len(w) >= quality.MIN_WORD_COUNT:
        word_d = 0.0
        if name:
            counts = [w.count(x) for x in quality.COMMON_WORDS[name]]
            word_d = js([*counts, len(w) - sum(counts)], [*hits, 1 - sum(hits)])
            limit = quality.WORD_FRACTION * js([0] * len(hits) + [1], [*hits, 1 - sum(hits)])
    return class_d, word_d, (class_d or 0) <= quality.MAX_CLASS_DISTANCE and (word_d or 0) <= limit


def test_quality(spark, docs, none, rows):
    rng = random.Random(12)
    odd = []
    for k in range(60):
        lang = ("de", "en", "es", "fr", "xx", None)[k % 6]
        listed = quality.COMMON_WORDS.get(lang, ("the", "de"))
        common, signs = k / 60, "".join(rng.sample("#$%09A.éж漢@_", 3))
        make = lambda: rng.choice(listed) if rng.random() < common else "".join(rng.choice("abcdefgh" * 3 + signs * (k % 4)) for _ in range(rng.randint(2, 8)))  # noqa: E731, B023
        odd.append((1000 + k, " ".join(make() for _ in range(rng.choice((60, 150, 400)))), lang, "a"))
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    got = quality.judge(docs).collect()
    want, refs = [], quality.references()
    for d, t, lang, _ in [*rows, *odd]:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        base = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        class_d, word_d, passes = _distances(t, lang, refs)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), base, not base and passes, class_d, word_d))
    in_order = lambda found: sorted(map(tuple, found), key=lambda r: [(x is None, x or 0) for x in r])
    for r, x in zip(in_order(got), in_order(want), strict=True):
        assert r[:8] == x[:8] and r[8:] == pytest.approx(x[8:], abs=2e-6)
    assert {r["kept"] for r in got if r["doc_id"] and r["doc_id"] >= 1000} == {True, False}
    assert quality.judge(none).count() == 0
    assert quality.keep_clean(docs).columns == docs.columns
    assert quality.keep_clean(docs).count() == sum(r["kept"] for r in got)
    renamed = docs.select(docs.doc_id.alias("my.id"), docs.text.alias("a.b"), docs.lang.alias("c.d"))
    assert quality.judge(renamed, "my.id", "a.b", "c.d").filter("kept").count() == sum(r["kept"] for r in got)


def test_references_fitted_on_good_documents(spark):
    rng = random.Random(2)
    listed = quality.COMMON_WORDS["fr"]
    good = [(i, " ".join(rng.choice(listed) if rng.random() < 0.5 else "mot" for _ in range(200)), "fr") for i in range(60)] + [(100, "ein Wort", "de")]
    refs = quality.fitted(spark.createDataFrame(good, "doc_id long, text string, lang string"))
    assert 0.47 < sum(refs["fr"][1]) < 0.53 and abs(sum(refs["fr"][0]) - 1) < 1e-9
    assert refs["de"] == quality.references()["de"]  # two words are too few


def test_divergence_rejects_odd_text(spark):
    plain = "the cat and the dog went to the house of a friend in that town for it was by the sea as on days with rain "
    rows = [(i, plain * 4 + str(i), "en") for i in range(40)] + [(100, "X#% 9$&! " * 80, "en"), (101, " ".join(f"w{i}@{i}" for i in range(200)), "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[101]["base_failed"] is False and got[101]["kept"] is False
    h = [4.0, 1.0, 0.0]
    p, q = [x / 5 for x in h], [0.2, 0.5, 0.3]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    js = math.sqrt((sum(a * math.log2(a / c) for a, c in zip(p, m) if a) + sum(b * math.log2(b / c) for b, c in zip(q, m))) / 2)
    from pyspark.sql import functions as F

    assert abs(spark.range(1).select(quality.js_distance([F.lit(x) for x in h], F.lit(5.0), q)).first()[0] - js) < 1e-12


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, none, rows, name):
    path = public_tokenizers.path(name)
    if name.endswith("model"):
        from sentencepiece import SentencePieceProcessor

        count = lambda t, own=SentencePieceProcessor(model_file=path): len(own.encode(t))
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    want = [(d, len((t or "").encode()), n := count(t) if t else 0, n > 512) for d, t, *_ in rows]
    assert bag(token_counts.token_counts(docs, path).collect()) == bag(want)
    assert token_counts.token_counts(none, path).count() == 0


def test_leaks(spark, docs, none, rows):
    items = [(1, " ".join(rows[0][1].split()[:30])), (2, rows[68][1]), (3, None), (4, "not in any of the documents here"), (5, "word"), (6, ""), (1, " ".join(rows[0][1].split()[:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (t or "").lower()).split()
    want, bad = {}, set()  # the row decides: another one with its id (or none) stays
    for d, t, *_ in rows:
        w = words(t)
        for i, it in items:
            v = words(it)
            if not v or not w:
                continue
            n, k = len(v), min(5, len(v))
            bagged = lambda x, k=k: collections.Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            b = bagged(v)
            best = max((sum((b & (c := bagged(w[s : s + n]))).values()) / max(1, sum((b | c).values())) for s in range(max(1, len(w) - n + 1))), default=0)
            if best >= 0.8:
                want[d, i] = max(want.get((d, i), 0), round(best, 6))
                bad.add((d, t))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and len(want) > 20
    clean = decontaminate.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert bag((r["doc_id"], r["text"]) for r in clean.collect()) == bag((d, t) for d, t, *_ in rows if (d, t) not in bad)
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == len(rows)


def test_candidates_come_from_the_hamming_blocks(spark, docs, rows, monkeypatch):
    item = " ".join(rows[0][1].split()[:30])
    near = item.split()
    near[15] = "another"
    index = decontaminate.Index([(1, item), (None, "an item without an id is searched too")])
    assert [x[0] for x in index.search(f"some words before {item} and after")] == [1]
    assert [x[0] for x in index.search("here an item without an id is searched too and more")] == [None]
    monkeypatch.setattr(decontaminate._Table, "within", lambda self, fps: (np.zeros(0, int), np.zeros(0, int)))
    assert index.search(item) == []


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(4)
    item = decontaminate._Item(1, " ".join(f"w{i}" for i in range(40)))
    table = decontaminate._Table([item, item])
    own = int(table.fps[0])
    for k in range(30):
        fps = np.array([own ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(50)], np.uint64)
        assert len(table.within(fps)[0]) == (100 if k <= decontaminate.RADIUS else 0)


def test_similarities_move_along():
    rng = np.random.default_rng(5)
    item = decontaminate._Item(1, " ".join(map(str, rng.integers(0, 6, 40))))
    hashes = item.hashes[rng.integers(0, len(item.hashes), 300)]
    width, starts = 30, [0, 1, 5, 6, 40, 100, 110, 111, 270]
    for (got, s), at in zip(decontaminate._similarities(item, hashes, starts, width), starts, strict=True):
        own = collections.Counter(hashes[at : at + width].tolist())
        shared = sum((own & item.counts).values())
        assert s == at and got == shared / (width + len(item.hashes) - shared)


def test_license_scan(spark, none):
    filler = "lorem ipsum dolor sit amet consectetur " * 30
    T = license_scan.TEMPLATES
    rows = [(i, f"{filler[: 37 * i]} {t.upper() if i % 2 else t} {filler}", "en") for i, t in enumerate(T.values())]
    rows += [(100, None, ""), (101, "", ""), (102, filler, ""), (103, "licensed under the", ""), (104, T["MIT"] * 3000, ""), (None, T["MIT"], ""), (105, T["MIT header"].replace("granted", "given"), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s string")
    got = {(r["doc_id"], r["template"]): r["containment"] for r in license_scan.scan(docs).collect()}
    want = {}
    for d, t, _ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        g = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, text in T.items():
            s = set(license_scan.template_shingles(text))
            c = license_scan.window_size(len(s))
            best = max((len(s & set(g[k : k + c])) / len(s) for k in range(0, len(g), license_scan.stride(c))), default=0) if s & set(g) else 0
            if best >= 0.8:
                want[d, name] = round(best, 6)
    assert got == want and {n for _, n in want} == set(T)
    assert license_scan.scan(none).count() == 0
    with pytest.raises(ValueError):
        license_scan.template_shingles("too short")


def test_key_words_are_in_every_sufficient_part():
    rng = random.Random(3)
    keys = license_scan.key_words(license_scan.TEMPLATES)
    assert len(keys) <= license_scan.MAX_KEYS
    for text in license_scan.TEMPLATES.values():
        shingles = license_scan.template_shingles(text)
        for _ in range(200):
            part = rng.sample(shingles, len(shingles) - int(0.2 * len(shingles) + 1e-9))
            assert any(set(k) <= {w for s in part for w in s.split()} for k in keys)


def test_license_scan_finds_copies_of_four_fifths(spark):
    """Planted copies with some words changed, held against the share of shingles that is left in each; a template of
    1,500 words, longer than all notices, included."""
    rng = random.Random(8)
    word = lambda: f"{rng.choice(('under', 'above', 'beside'))}{rng.randrange(900)}"
    templates = {"long": " ".join(word() for _ in range(1500))} | {k: license_scan.TEMPLATES[k] for k in ("MIT text", "BSD-3-Clause", "Apache-2.0 header", "ISC")}
    rows, want = [], {}
    for i in range(80):
        name = list(templates)[i % 5]
        own = re.findall(r"[^\W_]+", templates[name].lower())
        shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        left = list(own)
        for _ in range(rng.randint(0, max(1, len(own) // 26))):
            left[rng.randrange(len(left))] = word()
        share = len(shingles(own) & shingles(left)) / len(shingles(own))
        rows.append((i, " ".join([*[word() for _ in range(rng.randint(0, 900))], *left, *[word() for _ in range(rng.randint(0, 300))]]), 1))
        if share >= 0.8:
            want[i, name] = share
    docs = spark.createDataFrame([*rows, rows[0], (500, None, 1)], "doc_id long, text string, `template.x` int")
    got = {(r["doc_id"], r["template"]): r["containment"] for r in license_scan.scan(docs, templates).collect()}
    assert {n for _, n in want} == set(templates) and len(want) > 60
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_common_cells_send_one_row_a_part(spark):
    line = " ".join(f"w{i}" for i in range(60))
    texts = [line] * 400 + [f"{' '.join(f'x{i}y{j}' for j in range(12))} {' '.join(line.split()[20:32])} {' '.join(f'z{i}y{j}' for j in range(12))}" for i in range(100)]
    docs = repeats.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), "doc_id", "text")
    batch = docs.toArrow().to_batches()[0]
    made = repeated_words._cells([t.as_py() for t in batch.column(2)])
    assert len(made[0]) > 2000
    row, at, key, u, gram = repeats._settled(repeats.ranks(batch), made, ordered=True)
    few = collections.Counter(k for k, a in zip(key.tolist(), at.tolist()) if a & repeats.OPEN)
    assert max(few.values()) == 1 and any(a & repeats.MARK for a in at.tolist())
    assert max(collections.Counter(key.tolist()).values()) <= 2
    # copies are settled: all but the first document's cells
    assert {r for r, a in zip(row.tolist(), at.tolist()) if not a & 15} >= set(range(1, 400))


def test_spans_merge():
    a, b = np.array([5, 1, 2, 30]), np.array([9, 3, 5, 31])
    assert repeats.union_of(a, b) == [(1, 9), (30, 31)] and repeats.union_of(a[:0], b[:0]) == []


def test_long_words_hash_alike_wherever_they_stand():
    long = b"q" * 5000
    line = b" ".join([b"ab", long, b"cd", b"e" * 4096, long, b"ab"])
    h = hashing.word_hashes(line, *hashing.words(line))
    assert h[0] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 4


@pytest.mark.parametrize(("limit", "part"), [(300, 10), (700, 50), (1 << 20, 300_000)])
def test_repeats_whatever_the_parts(docs, rows, limit, part, monkeypatch):
    """Small parts and pieces take the way of long texts and of many parts; the functions are shipped with their settings
    only as defaults, so this runs without Spark's workers."""
    texts = [(t or "").encode() for _, t, *_ in rows]
    monkeypatch.setattr(repeats, "LIMIT", limit)
    monkeypatch.setattr(repeats, "CHUNK", max(1, limit // 100))
    for pieces, cells, window, split in ((repeated_words._pieces, repeated_words._cells, 20, lambda b: b.split()), (repeated_bytes._pieces, repeated_bytes._cells, 400, lambda b: b)):
        seen = collections.Counter()
        for own, base, of in repeats.blocks(enumerate(texts), pieces):
            piece, lo, n, *_ = cells(of)
            for i, a, k in zip(own[piece].tolist(), (lo + base[piece]).tolist(), n.tolist()):
                seen.update((i, p) for p in range(a, a + k))
        want = {(i, p) for i, b in enumerate(texts) for p in range(len(split(b)) - window + 1)}
        assert set(seen) == want and max(seen.values()) == 1
