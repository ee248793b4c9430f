"""The conversation trie, spelling variants and phrase fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import conversation_trie, decontaminate, phrase_fingerprint, spelling


def talks():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), 101, 103, 207, -3, 10**12 + 1]:
        for t in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hé", "", None, "x" * 50, f"own {c}"])))
    rows += [(500 + i, t, "user", f"the same {t}") for i in range(30) for t in range(4)]
    rows += [(600, 0, "user", "again"), (600, 0, "user", "again"), (None, 0, "user", "lost"), (700, 1, None, None)]
    return rows


def sequences(rows, splice):
    """Each conversation's turns as (role, text)."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((t is not None, t or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    if not splice:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        head = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(head, [])[:h] + turns[h:]
    return out


def brute_trie(seqs):
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]].append(prefix)

    def total(prefix):
        own = (len(members[prefix]) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        below = [total(k) for k in kids[prefix]]
        return own + sum(s for s, _ in below), sum(n for _, n in below) or 1

    out = []
    for prefix, own in members.items():
        saved, leaves = total(prefix)
        ends = ",".join(map(str, sorted(c for c in own if len(seqs[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(own), len(prefix), parent, len(own), len(kids[prefix]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def conversations(spark):
    df = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(1) for c in ("conv", "depth", "key", "cost", "n", "part", "node")})


@pytest.mark.parametrize(("splice", "small"), [(False, 1000), (True, 1000), (True, 1)])
def test_trie(conversations, splice, small, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SMALL", small)
    monkeypatch.setattr(conversation_trie, "PIECE", 3)
    turns = conversation_trie.numbered(conversations)
    turns, convs = conversation_trie.spliced(turns) if splice else (turns, None)
    got = sorted((tuple(r[c] for c in NODE) for r in conversation_trie.trie(turns, convs).collect()), key=repr)
    assert got == brute_trie(sequences(talks(), splice))


def test_trie_of_one_class_and_of_none(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "user", f"turn {t}") for c in (4, 9) for t in range(3)]
    got = conversation_trie.trie(conversation_trie.numbered(spark.createDataFrame(rows, schema)))
    assert sorted((tuple(r[c] for c in NODE) for r in got.collect()), key=repr) == brute_trie(sequences(rows, False))
    empty = conversation_trie.numbered(spark.createDataFrame([], schema))
    assert conversation_trie.trie(empty).count() == 0
    assert set(conversation_trie.trie(empty).columns) == set(NODE)


def test_trie_nodes_with_their_turns(conversations):
    nodes = conversation_trie.trie(conversation_trie.numbered(conversations))
    seqs = sequences(talks(), False)
    rows = conversation_trie.with_turns(nodes, conversations).collect()
    assert len(rows) == nodes.count()
    for r in rows:
        assert (r["role"], r["text"]) == (seqs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None))


def test_one_long_conversation_is_numbered_in_parts(spark):
    turns = [(c, t, "user", f"{t}") for c, n in ((1, 3000), (2, 5), (3, 2900)) for t in range(n)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    rows = conversation_trie.numbered(df).select("conv", "depth", "cost").collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == sorted((c, t + 1, len(str(t))) for c, t, _, _ in turns)


def misspelt():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    words += [w[:i] + rng.choice("abcdeéÿ") + w[i + rng.randint(0, 1) :] for w in words for i in range(2, 5)]
    words += [w + "x" for w in words[:20]] + ["aaaaaaa", "aaaaaa", "aaaaab", "aaaaaaaaa"]
    n = {w: int(5 * 5 ** (4 * rng.random())) for w in words}
    flat = [w for w, k in n.items() for _ in range(k)]
    rng.shuffle(flat)
    return flat


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, every):
    n = Counter()
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if every and h % every == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out = {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 5 * n[w] else None, n[w], len(near)]

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (f, root(w), k, near, f and n[f]) for w, (f, k, near) in out.items()}


@pytest.mark.parametrize("every", [None, 7])
def test_variants(spark, every):
    words = misspelt()
    rows = [(i, " ".join(words[k : k + 300])) for i, k in enumerate(range(0, len(words), 300))]
    rows += [(None, "Ünder " * 6 + "UNDERÀ,under-word"), (1, None), (2, ""), (3, "1 2 ĀĀ")] + rows[:1]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(2)})
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, every=every).collect()}
    assert got == brute_variants(rows, every)
    assert any(f and r != f for f, r, *_ in got.values())  # some path has two steps
    assert spelling.variants(df.filter("doc_id < 0")).count() == 0


def test_variants_when_all_keys_collide(spark, monkeypatch):
    """Hashes only bring rows together: with one key for all, strings still decide."""
    rows = [(0, " ".join(f"{w} " * 5 for w in ("planet", "planets", "planes", "plánet", "laplane")) + "planet " * 30)]
    words = spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = spelling.keyed(words).withColumns({"key": F.lit(0).cast("long"), "radix": F.lit(0)})
    got = {r["word"]: (r["n_near"], r["form"]) for r in spelling.near_words(keys).collect()}
    want = brute_variants(rows, None)
    assert got == {w: (near, min((v for v in want if one_edit(w, v)), key=lambda v: (-want[v][2], v))) for w, (_, _, _, near, _) in want.items() if near}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 10)
    text = "some words été, andaverylongonewithoutanyspaceatall then more"
    for every in (None, 3):
        whole = Counter()
        for c in spelling.altered(5, text.encode(), every):
            whole.update(c)
        monkeypatch.setattr(spelling, "PIECE", 1 << 20)
        again = Counter()
        for c in spelling.altered(5, text.encode(), every):
            again.update(c)
        assert whole == again
        monkeypatch.setattr(spelling, "PIECE", 10)


def brute_print(text):
    symbols = re.findall(rb"[\xE3-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}|[^\s\xE3-\xF4]{1,24}\s*|[\s\S]", text)
    phrases, now = set(), b""
    for s in symbols:
        now += s
        if now not in phrases:
            phrases.add(now)
            now = b""
    return phrases


def test_fingerprints(docs, rows, spark):
    got = phrase_fingerprint.beside_next(docs).collect()
    assert len(got) == len(rows)
    th = {(r["doc_id"], r["text"]): r["th"] for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    order = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), th[r]))
    want = []
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = (text[: len(text) - k] + after[:k]).encode()
        a, b, c = (phrase_fingerprint.fingerprint(x) for x in (text.encode(), edited, after.encode()))
        want.append((doc, len(text), hashlib.sha256(edited).hexdigest(), a, b, phrase_fingerprint.alike(a, b), phrase_fingerprint.alike(a, c)))
        for x, y, near in ((text.encode(), edited, want[-1][5]), (text.encode(), after.encode(), want[-1][6])):
            p, q = brute_print(x), brute_print(y)
            real = len(p & q) / len(p | q) if p | q else 1.0
            assert abs(near - real) < 0.25  # five deviations of 128 slots
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_fingerprints_of_small_tables(docs, none):
    assert phrase_fingerprint.beside_next(none).count() == 0
    one = phrase_fingerprint.beside_next(docs.filter("doc_id = 504")).collect()
    assert [r["near_next"] for r in one] == [1.0]
    own = phrase_fingerprint.fingerprints(docs)
    wide = phrase_fingerprint.beside_next(docs)
    assert sorted(map(repr, own.collect())) == sorted(map(repr, wide.select("doc_id", "n_chars", "fingerprint").collect()))
    for r in wide.select("near_edited", phrase_fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("l")).collect():
        assert abs(r["near_edited"] - r["l"]) < 1e-12


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_blocks_give_every_item_within_the_radius(n):
    """Few items are compared by blocks, many looked up under near values; both find what comparing all fingerprints finds."""
    rng = np.random.default_rng(n)
    base = rng.integers(2**64, size=n, dtype=np.uint64)
    table = decontaminate._Table([SimpleNamespace(hashes=np.array([x], np.uint64)) for x in base])
    assert (table.fps == base).all()  # the fingerprint of one hash is itself
    flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 26, size=400)]
    fps = np.concatenate([base[rng.integers(n, size=400)] ^ np.array(flips, np.uint64), rng.integers(2**64, size=200, dtype=np.uint64)])
    window, item = table.within(fps)
    want = np.nonzero(np.bitwise_count(fps[:, None] ^ base[None]) <= decontaminate.RADIUS)
    assert sorted(zip(window.tolist(), item.tolist())) == sorted(zip(*(x.tolist() for x in want)))
