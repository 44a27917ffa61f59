"""Operators over the whole corpus: near-duplicates, substrings, nearest neighbours, decontamination, and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from quarry.llm import components, decontaminate, mih, simhash, substring
from test_whole import brute_groups

SCHEMA = "doc_id long, text string, code string, gram int, digest string, least int"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "c", 1, "d", 2) for i, t in texts], SCHEMA)


# ---- SimHash


def brute_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(codes):
    codes, parent = np.array(codes, np.uint64), list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def near_codes(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        c = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            c ^= 1 << b
        out.append(c)
    return sorted(set(out))


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links_connect_what_is_within_three_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    codes = near_codes(600, 3) + [(1 << 20) - 1 ^ (1 << b) for b in range(20)]
    codes = sorted(set(codes))
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(zip(signed, range(len(codes)))), "code long, least long")
    got = {r.code: r.component_id for r in components.connected(nodes, simhash.links(nodes.select("code"))).collect()}
    assert [got[c] for c in signed] == brute_components(codes)


def test_thresholds_follow_the_pigeonhole():
    rng = np.random.default_rng(0)
    flat, steep = np.ones(1 << 16), np.zeros(1 << 16)
    steep[:4] = 1 << 14
    for h in ([flat] * 4, [flat, flat, flat, steep], [steep, flat, flat, flat]):
        t = simhash.allocate(h)
        assert sum(t) == simhash.RADIUS - 4 + 1
    assert simhash.allocate([flat * 40, flat * 40, flat * 40, steep * 1000])[3] == -1
    joint = np.cov(rng.integers(0, 2, (64, 500)))
    parts = simhash.correlated_partitions(np.abs(joint), 500)
    assert sorted(b for p in parts for b in p) == list(range(64))


def test_near_duplicates(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    edge = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one "), (1005, "É x y z"), (None, "one"), (1003, "One"), (1006, "word " * 40000)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + edge
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    roots = brute_components([brute_print(t) for _, t in rows])
    want = sorted((str(i), f"{brute_print(t):016x}", rows[r][0]) for (i, t), r in zip(rows, roots))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(table(spark, [(3, "a b c"), (1, "a b c"), (1, "a b c"), (2, "d e f g")])).collect()]
    assert sorted(kept) == [1, 2]


# ---- substrings


def brute_cover(bodies, length, later):
    seen = {}
    for i, b in enumerate(bodies):
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append((i, k))
    cover = [np.zeros(len(b), bool) for b in bodies]
    for places in seen.values():
        for i, k in places[1:] if later else places if len(places) > 1 else ():
            cover[i][k : k + length] = True
    return cover


def repeated_texts():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    base, out = [word(300) for _ in range(6)], []
    for _ in range(40):
        t = word(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            b, s = rng.choice(base), rng.randint(0, 250)
            t += b[s : s + rng.randint(10, 200)] + word(rng.randint(0, 30))
        out.append(t)
    return out + [out[3], out[3], "the " * 60, "xy" + "the " * 50 + "x", "a" * 200, None, "", base[0], "é" * 60, "ab" * 31 + "q", "abc" * 40 + base[1] + "abc" * 70, "the he " * 30 + base[2][:80]]


@pytest.mark.parametrize(("group", "later"), [(20_000, False), (20_000, True), (4, False), (4, True)])
def test_removals_match_all_strings(spark, monkeypatch, group, later):
    monkeypatch.setattr(substring, "GROUP", group)
    texts = repeated_texts()
    df = table(spark, list(enumerate(texts))).repartition(3)
    got = {r.doc_id: r for r in substring.removals(df, 60, 16, later).collect()}
    bodies = [(t or "").encode() for t in texts]
    for i, (b, cover) in enumerate(zip(bodies, brute_cover(bodies, 60, later))):
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), cover.sum(), hashlib.sha256(kept).hexdigest())
        assert got[i].n_spans == len(substring._runs(cover))


def test_removals_at_the_real_length(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "x"), (7000, "long " * 30000)]
    got = {r.doc_id: r for r in substring.removals(table(spark, rows)).collect()}
    for (i, _), cover in zip(rows, brute_cover([t.encode() for _, t in rows], 400, False)):
        assert got[i].n_removed == cover.sum()
    assert substring.removals(table(spark, [])).count() == 0


def test_anchors_are_shared_by_equal_strings():
    rng = np.random.default_rng(1)
    core = rng.integers(97, 107, 400).astype(np.uint8)
    for _ in range(20):
        a, b = (np.concatenate([rng.integers(97, 107, rng.integers(0, 300)).astype(np.uint8), core, rng.integers(97, 107, 50).astype(np.uint8)]) for _ in range(2))
        ha, hb = (set(substring.anchors(x)[1].tolist()) for x in (a, b))
        assert ha & hb


# ---- nearest neighbours


def brute_nearest(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            best = sorted((-float(v @ q), j) for j, v in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def test_nearest_neighbours_recall(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    want = brute_nearest([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    rows = mih.nearest(df).collect()
    found = {q: {r.vec_id for r in rows if r.query_id == q} for q in want}
    assert np.mean([len(found[q] & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.95
    exact = {(q, j): s for q, v in want.items() for j, s in v}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in rows if (r.query_id, r.vec_id) in exact)
    assert sorted(r["rank"] for r in rows if r.query_id == 0) == list(range(1, 21))


def test_nearest_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, float(i % 2)]) for i in range(60)] + [(100, None), (120, [nan, 1.0, 1.0]), (140, [inf, 1.0, 1.0]), (160, [0.0, 0.0, 0.0]), (180, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (200, [9.0, -9.0, 3.0]), (220, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, vkey string")
    got = {}
    for r in mih.nearest(df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(rows, 5, 20)
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in mih.nearest(few).collect()] == [(0, 1, 1, 4.0)]
    assert mih.nearest(few.limit(0)).count() == 0 and mih.nearest(few.filter("vec_id = 0")).count() == 0


# ---- decontamination


def test_leaks_are_found_and_clean_documents_are_not(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in bench.collect()}
    grams = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    bodies = {r.doc_id: grams(r.text) for r in docs.collect()}
    want = {(d, i) for i, t in items.items() for d, g in bodies.items() if len(grams(t) & g) >= 0.8 * len(grams(t))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    assert want <= got and all(bodies[d] & grams(items[i]) for d, i in got)
    clean = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert clean == set(bodies) - {d for d, _ in got}


def test_paraphrases_are_found(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    item = next(r for r in bench.collect() if len(r.text.split()) >= 40)
    words = item.text.split()
    words[3::8] = ["changed"] * len(words[3::8])
    fresh = table(spark, [(5000, "Before it some other words. " + " ".join(words) + " And after it."), (5001, None), (5002, ""), (None, item.text), (5003, item.text), (5003, item.text)])
    both = docs.select("doc_id", "text").unionByName(fresh.select("doc_id", "text"))
    hit = [r.doc_id for r in decontaminate.matches(both, bench).collect() if r.item_id == item.item_id]
    assert 5000 in hit and hit.count(5003) == 2 and None in hit and 5001 not in hit
    assert decontaminate.matches(fresh.limit(0), bench).count() == 0 and decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(fresh, spark.createDataFrame([(1, None), (2, ""), (3, "..")], "item_id int, text string")).count() == 0


def test_common_subsequences():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        item = decontaminate.Item(0, np.array(a, np.uint64), np.array([], np.uint64))
        assert item.common(b) == d[-1][-1]


# ---- the pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    at = docs
    for name, stage in c.STAGES[:-1]:
        before, at = at, c.materialize(stage(spark, at, small), name)
        assert at.columns == docs.columns and at.count() <= before.count()
    kept = {r.doc_id: r for r in at.collect()}
    # language and line stages take none of these; of what 5-word similarity connects one stays, unless it holds an item
    lined = {r.doc_id: r.text for r in c.STAGES[1][1](spark, c.STAGES[0][1](spark, docs, small), small).collect()}
    groups, leaked = brute_groups(list(lined.values())), {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    ids = list(lined)
    assert set(kept) == {min(ids[i] for i in range(len(ids)) if groups[i] == g) for g in set(groups)} - leaked
    packed = c.run(spark, small)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)


def test_pipeline_on_edges(spark, tmp_path):
    import corpus_pipeline as c

    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "the house and the river " * 5, "en", None, 1), (3, "the house and the river " * 5, "en", None, 1), (None, "a stone", "en", "b", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("documents", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, "some item of the benchmark")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = c.run(spark, str(folder)).collect()
        assert {r.doc_id for r in got} == ({3, None} if data else set()) and len(got) == len({r.doc_id for r in got})
