"""Mixing, sharding, archives and the pipeline."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import os
import random
import re

import pytest

import corpus_pipeline
from vigil.llm import arc_convert, mixing, quality, sharding
from vigil.plans import scratch


def brute_targets(sizes, weights):
    """Share 150 %, put back what is above twice a size, again and again."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), 1.5 * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * rest / total > 2 * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * rest / total
            break
        for i in full:
            out[i] = 2.0 * sizes[i]
        rest -= sum(2 * sizes[i] for i in full)
        open_ -= set(full)
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 500], [0, 0], [0, 7], [3, 1000, 1000, 2, 90, 14]])
def test_targets(sizes):
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert mixing.targets(sizes, w) == pytest.approx(brute_targets(sizes, w))


def test_min_cost_flow_is_cheapest():
    patterns, quotas = [(frozenset({0}), 3), (frozenset({0, 1}), 2), (frozenset({1, 2}), 2)], [4, 3, 1]
    flow = mixing.min_cost_flow(patterns, quotas)
    cost = lambda used, size: sum(k // size for k in range(used))
    used = collections.Counter()
    for (p, s), n in flow.items():
        assert s in patterns[p][0]
        used[p] += n
    given = collections.Counter()
    for (_, s), n in flow.items():
        given[s] += n
    assert [given[s] for s in range(3)] == quotas
    best = None
    for a, b, c in itertools.product(range(7), range(5), range(5)):  # a: 0 from p0; b: 0 from p1; c: 1 from p1 ...
        rest1, rest2 = quotas[1] - c, quotas[2]
        if a + b == quotas[0] and rest1 >= 0 and a <= 6 and b + c <= 4 and rest1 + rest2 <= 4:
            x = cost(a, 3) + cost(b + c, 2) + cost(rest1 + rest2, 2)
            best = x if best is None else min(best, x)
    assert sum(cost(n, patterns[p][1]) for p, n in used.items()) == best


def brute_flow(patterns, quotas):
    """(most words, least cost) over all ways to spread the quotas."""
    arcs, best = [(p, s) for p, (of, _) in enumerate(patterns) for s in of], None

    def go(i, left, used):
        nonlocal best
        if i == len(arcs):
            own = (sum(left), sum(max(0, u - size) for u, (_, size) in zip(used, patterns)))
            best = own if best is None else min(best, own)
            return
        p, s = arcs[i]
        for n in range(min(left[s], 2 * patterns[p][1] - used[p]) + 1):
            go(i + 1, [x - n * (k == s) for k, x in enumerate(left)], [x + n * (k == p) for k, x in enumerate(used)])

    go(0, quotas, [0] * len(patterns))
    return best


def test_min_cost_flow_on_random_networks():
    rng, searched = random.Random(1), 0
    for _ in range(400):
        sources, patterns = rng.randint(1, 3), {}
        for _ in range(rng.randint(1, 4)):
            if of := frozenset(s for s in range(sources) if rng.random() < 0.6):
                patterns[of] = rng.randint(0, 2)
        patterns = list(patterns.items())
        if sum(len(of) for of, _ in patterns) > 7:
            continue
        quotas = [rng.randint(0, 4) for _ in range(sources)]
        flow = mixing.min_cost_flow(patterns, quotas)
        used, given = [0] * len(patterns), [0] * sources
        for (p, s), n in flow.items():
            assert n > 0 and s in patterns[p][0]
            used[p] += n
            given[s] += n
        assert all(u <= 2 * size for u, (_, size) in zip(used, patterns)) and all(g <= q for g, q in zip(given, quotas))
        assert (sum(quotas) - sum(used), sum(max(0, u - size) for u, (_, size) in zip(used, patterns))) == brute_flow(patterns, quotas)
        searched += 1
    assert searched > 200


@pytest.mark.parametrize("size", [1, 1000])
def test_mix_in_ranges_of_any_size(docs, rows, size, monkeypatch):
    """Every source's words meet its target however finely the order is cut; a document is taken by its place in it."""
    monkeypatch.setattr(mixing, "RANGE", size)
    taken = collections.Counter()
    got = mixing.mix(docs).collect()
    for r in got:
        taken[r["pattern"][0], r["target"]] += r["taken"]
    assert all(abs(n - target) <= 1 for (_, target), n in taken.items())
    monkeypatch.setattr(mixing, "RANGE", 7)
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))


def test_mix(docs, none, rows):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, brute_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken = collections.Counter()
    for r in got:
        (s,) = r["pattern"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert len(got) == len(rows) and mixing.mix(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"]) for i in range(50)] + [(100 + i, "w " * 10, ["a", "b"]) for i in range(20)] + [(200, "w " * 10, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in got) and sum(r["taken"] for r in got) > 700


def test_shards(docs, none, rows):
    table = collections.Counter(sharding.lookup_table())
    assert len(table) == 64 and max(table.values()) - min(table.values()) <= 1
    got = sharding.placed(docs).collect()
    for r in got:
        h = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert r["shard"] == sharding.lookup_table()[h % sharding.SLOTS]
    assert len(got) == len(rows) and sharding.placed(none).count() == 0
    moved = sum(a != b for a, b in zip(sharding.lookup_table(64), sharding.lookup_table(63)))
    assert moved < 0.1 * sharding.SLOTS
    with pytest.raises(ValueError):
        sharding.lookup_table(64, 65_536)


PAGES = [(3, "http://a/x y\n", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (4, "", ""), (5, "http://c", "\r\n\r\nWARC/1.1\r\n\r\nhttp://x 1 2 3 4\n"), (None, "http://d", "<p>é</p>"), (6, "http://e", "z" * 300_000), (1, None, "<p>é</p>")]


@pytest.mark.parametrize(("least", "segment"), [(0, 4 << 20), (6, 100)])
def test_archives(spark, least, segment, monkeypatch):
    monkeypatch.setattr(arc_convert, "SEGMENT", segment)
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, size long").repartition(3)
    got = arc_convert.archived(pages, least)
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if i is not None and len(b) >= least:
            first[b] = min(i, first.get(b, i))
    heads, want = set(), []
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        b = (h or "").encode()
        again = b in heads and len(b) >= least
        heads.add(b)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter(map(tuple, got.select(columns).collect())) == collections.Counter(want)
    assert got.select("record_id").distinct().count() == len(PAGES)
    assert arc_convert.archived(pages.limit(0)).count() == 0


def test_archives_of_one_name(spark, tmp_path):
    """Two files with one inner name, and one file in two places: every payload is read back."""
    one, two = [(1, "http://a", "A"), (2, "http://a", "A")], [(3, "http://b", "X"), (4, "http://b", "Y")]
    for i, pages in enumerate((one, two)):
        for version in (1, 2):
            os.makedirs(tmp_path / f"arc{version}", exist_ok=True)
            (tmp_path / f"arc{version}" / f"{i}.arc").write_bytes(b"\n".join(arc_convert._segments(iter(pages), version, "same")) + b"\n")
    for version in (1, 2):
        arc_convert.convert(spark, f"{tmp_path}/arc{version}", f"{tmp_path}/warc{version}")
        got = arc_convert.read_warc(spark, f"{tmp_path}/warc{version}")
        assert sorted(tuple(r) for r in got.select("page_id", "record_type").collect()) == [(1, "response"), (2, "revisit"), (3, "response"), (4, "response")]
    (tmp_path / "arc1" / "2.arc").write_bytes((tmp_path / "arc1" / "1.arc").read_bytes())
    arc_convert.convert(spark, f"{tmp_path}/arc1", f"{tmp_path}/again")
    got = arc_convert.read_warc(spark, f"{tmp_path}/again")
    kinds = collections.Counter(tuple(r) for r in got.select("page_id", "record_type", "refers_to").collect())
    assert kinds == {(1, "response", None): 1, (2, "revisit", 1): 1, (3, "response", None): 1, (3, "revisit", 3): 1, (4, "response", None): 1, (4, "revisit", 4): 1}
    assert got.select("record_id").distinct().count() == 6


def test_arc_versions():
    def arc(version, header):
        own = f"{version} 0 x\n{arc_convert.FIELDS[version]}\n"
        extra = " 200 - - 0 n" if version == 2 else ""
        return f"filedesc://t.arc 0.0.0.0 20080430204825 text/plain{extra} {len(own)}\n{own}\n{header}".encode()

    body = "HTTP/1.1 200 OK\r\n\r\nhi\nthere"
    v1 = arc(1, f"http://a/b c 1.2.3.4 20080430204825 text/html {len(body)}\n{body}\n")
    v2 = arc(2, f"http://a/ 1.2.3.4 20080430204826 text/html 200 ABC - 99 t.arc {len(body)}\n{body}\n")
    found = list(arc_convert.arc_records(v1 + v2))
    assert [(r["URL"], r["payload"], r["page_id"]) for r in found] == [("http://a/b c", b"hi\nthere", None), ("http://a/", b"hi\nthere", None)]
    assert found[1]["Result-code"] == "200" and arc_convert._warc_date(found[0]["Archive-date"]) == "2008-04-30T20:48:25Z"
    with pytest.raises(ValueError):
        list(arc_convert.arc_records(v1[:-9]))
    packed = gzip.compress(v1) + gzip.compress(v2)
    assert [r["payload"] for r in arc_convert.arc_records(packed)] == [b"hi\nthere"] * 2
    for cut in (len(packed) - 12, len(gzip.compress(v1)) - 3):
        with pytest.raises(ValueError, match="compression"):
            list(arc_convert.arc_records(packed[:cut]))
    with pytest.raises(ValueError):
        list(arc_convert.arc_records(b"http://a/ 1.2.3.4 20080430204826 text/html 2\nhi\n"))


def test_archives_are_read_piece_by_piece(monkeypatch):
    monkeypatch.setattr(arc_convert, "READ", 3)
    pages = [(i, f"http://a/{i}", "x\r\n\r\n\n" * i) for i in range(40)]
    for version in (1, 2):
        data = b"\n".join(arc_convert._segments(iter(pages), version, "n")) + b"\n"
        found = list(arc_convert.arc_records(gzip.compress(data)))
        assert [(r["page_id"], r["URL"], r["payload"].decode()) for r in found] == pages
        assert len({r["id"] for r in found}) == len(pages)


def _brute_quality(rows):
    from tests.llm.test_texts import WORD, _distances

    out = []
    for r in rows:
        w = WORD.findall(r["text"] or "")
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        if len(w) >= 50 and 100 * len(cover) <= 50 * len(w) and _distances(r["text"], r["lang"], quality.references())[2]:
            out.append(r)
    return out


def _brute_near(rows):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        if find(i) not in first or key < first[find(i)][0]:
            first[find(i)] = (key, r)
    return [r for _, r in first.values()]


def _brute_clean(rows, items):
    words = lambda t: re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", (t or "").lower()).split()
    bagged = lambda x, k: collections.Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
    known = [(len(v), min(5, len(v)), bagged(v, min(5, len(v)))) for v in map(words, items) if v]
    out = []
    for r in rows:
        w, found = words(r["text"]), False
        whole = bagged(w, 5)
        for n, k, b in known:
            if k == 5 and 9 * sum((whole & b).values()) < 4 * (min(n, len(w)) - 4 + n - 4):
                continue  # no window can share enough
            for s in range(max(1, len(w) - n + 1)):
                c = bagged(w[s : s + n], k)
                if c and 5 * sum((b & c).values()) >= 4 * sum((b | c).values()):
                    found = True
                    break
        if not found:
            out.append(r)
    return out


def _hash(rows, spark, *of):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, *(r[c] for c in of)) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in of))
    lead = [F.lit(mixing.SEED)] if of == ("doc_id",) else []
    return {r["i"]: r["h"] for r in df.select("i", F.xxhash64(*lead, *[F.coalesce(c, F.lit("")) if c == "text" else F.col(c) for c in of]).alias("h")).collect()}


def _brute_mix(rows, spark):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute_targets([sum(n for n, r in zip(size, rows) if r["source"] == s) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    order, th, out = _hash(rows, spark, "doc_id"), _hash(rows, spark, "text"), collections.Counter()
    unsigned = lambda x: x % 2**64 >> 54
    for s in names:
        mine = sorted((i for i, r in enumerate(rows) if r["source"] == s), key=lambda i: (unsigned(order[i]), order[i], rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, size[i], th[i]))
        whole, at, quota = sum(size[i] for i in mine), 0, round(target[s])
        for i in mine:
            taken = sum(max(0, min(size[i], min(whole, quota - k * whole) - at)) for k in range(2))
            at += size[i]
            if size[i]:
                out[i] += math.floor(taken / size[i] + 0.5)
    return [rows[i] for i in sorted(out) for _ in range(out[i])]


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    more = [dict(rows[0], doc_id=None), dict(rows[1], doc_id=rows[2]["doc_id"]), dict(rows[3]), dict(rows[4], source=None, doc_id=90_001), dict(rows[5], text=None), dict(rows[6], text="", lang=None)]
    rows += more
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = _brute_quality(rows)
    assert 0 < len(want) < len(rows)
    near = _brute_near(want)
    clean = _brute_clean(near, items)
    assert len(clean) < len(near) < len(want)
    table = sharding.lookup_table()
    placed = [(r["doc_id"], r["text"], r["source"], table[int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16) % sharding.SLOTS]) for r in _brute_mix(clean, spark)]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "shard"]
    assert collections.Counter((r["doc_id"], r["text"], r["source"], r["shard"]) for r in got.collect()) == collections.Counter(placed)


def test_pipeline_of_nothing(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_shared_folder_is_wanted_off_a_local_master(monkeypatch):
    class Conf:
        get = staticmethod(lambda k, d=None: d)

    class Session:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "yarn"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.folder(Session)
