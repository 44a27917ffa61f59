"""Losses, crashes and caps that were once there, and the methods held against brute force."""

import itertools
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from quarry.llm import _base, components, decontaminate, language, lines, mih, pack, pii, simhash, substring, token_count
from test_corpus import brute_components, brute_cover, brute_nearest, near_codes, repeated_texts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


# ---- personal data


def test_personal_data_at_any_distance():
    assert pii.find("0" * 5000 + "1.2.3.4")["ip"] == [(0, 5007)] and pii.find("0" * 5000 + "256.2.3.4")["ip"] == []
    assert pii.find("a" * 80 + " (at) example (dot) com")["handle"] == [(0, 103)]
    assert pii.find("ssn" + "." * 13 + "123-45-67890")["ssn"] == []
    assert pii.find("ssn " + "x " * 200 + "123-45-6789")["ssn"] == [(404, 415)] and pii.find("ssn\n123-45-6789")["ssn"] == []
    assert pii.find("SSN (social security number): 123-45-6789")["ssn"] == [(30, 41)]
    assert pii.find("Customer ID: AB-1234567 and cUsToMeR iD AB-1234568")["account"] == [(13, 23), (40, 50)]
    assert pii.find("İ iban DE89 3704 0044 0532 0130 00")["iban"] == [(7, 34)]
    pii.find("account " * 50_000 + "[at]" * 50_000)  # in linear time


# ---- tokens


@pytest.mark.parametrize("text", [" " * 3000, "a" + " " * 3000 + "b", "\n" * 1500 + "x" + "\t" * 1200 + "<|endoftext|>" + " \n" * 900 + ".", " " * 1500 + "<|endoftext|>", " " * 1500 + "\nz", "a" + "　" * 2000 + " b", "x\x1c" * 10 + " " * 1100 + "\x1cq"])
def test_long_gaps_are_packed_as_the_library_cuts_them(text):
    assert pack.ByteBpe(BYTE)(text).tolist() == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_gaps_of_any_length_are_packed():
    assert len(pack.ByteBpe(BYTE)(" " * 2_000_000)) == 2_000_000


def test_long_words_keep_within_the_bound_on_states():
    counter, rng = token_count.Counter(WORD), random.Random(1)
    counter._transducer._bound = 500
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (20_000, 3, 7000)]
    assert counter.counts(words).tolist() == [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(words, add_special_tokens=False)]
    assert len(counter._transducer._open) <= 502 and not any(len(w) > token_count.KEPT for w in counter._known)


# ---- rows, names and lines


def test_rows_are_kept_for_themselves_whatever_their_ids_and_columns(spark):
    texts = ["rivers run to the sea at night", "a quite different stone on the hill", "bread and cheese were on that table"]
    rows = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (5, texts[0] + " x"), (1, texts[1] + " y"), (5, texts[2] + " z w")]
    names = ["_gone", "_twice", "_bad", "key", "id", "whole", "row", "group", "code"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    item = "who wrote the long book about the stone bridge over the cold river"
    bench = spark.createDataFrame([(1, item), (1, None), (2, "..")], "item_id int, text string")
    more = docs.unionByName(spark.createDataFrame([(None, f"so {item} then", *range(len(names))), (3, item, *range(len(names)))], docs.schema))
    clean = decontaminate.keep_clean(more, bench)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))


def test_lines_of_small_hosts_and_taken_names(spark):
    rows = [(1, "only\npage", "a"), (2, "menu\nown one", "b"), (3, "menu\nown two", "b"), (4, "menu\n" + "long " * 100_000, None)]
    docs = spark.createDataFrame([(*r, 7, 8, "b") for r in rows], "doc_id long, text string, source string, _lines int, _dropped int, host string")
    kept = lines.drop_boilerplate(docs)
    assert kept.columns == [*docs.columns, "__lines", "__dropped"]
    assert {r.doc_id: (r.text, r["_lines"], r["__dropped"]) for r in kept.collect()} == {1: ("only\npage", 7, 0), 2: ("own one", 7, 1), 3: ("own two", 7, 1), 4: (rows[3][1], 7, 0)}


def test_boilerplate_too_large_for_a_broadcast(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted(map(tuple, lines.line_report(docs).collect()))
    monkeypatch.setattr(lines, "BROADCAST_MB", -1)
    assert sorted(map(tuple, lines.line_report(docs).collect())) == want


def test_spans_are_cut_whatever_the_ids_and_columns(spark):
    rows = [(1, "one two three"), (2, None), (None, "four five"), (3, "")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, cuts int, _cuts int, row int")
    spans = spark.createDataFrame([(1, 4, 8), (1, 0, 1), (None, 0, 5)], "doc_id long, start long, end long")
    cut = lines.remove_spans(docs, spans)
    assert cut.columns == docs.columns and {(r.doc_id, r.text) for r in cut.collect()} == {(1, "ne three"), (2, None), (None, "five"), (3, "")}
    assert lines.remove_spans(docs, spans.limit(0)).count() == 4 and lines.remove_spans(docs.limit(0), spans).count() == 0


# ---- sums and components


def test_sums_over_a_tree_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(_base, "FAN_IN", 3)

    def add(frames):
        for f in frames:
            if len(f):
                yield f.groupby("k", as_index=False).agg({"n": "sum"})

    rows = spark.range(1000).repartition(20).selectExpr("cast(id % 5 as int) as k", "id as n")
    total = _base.tree_sum(rows, ["k"], add)
    assert {r.k: r.n for r in total.groupBy("k").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()} == {k: sum(range(k, 1000, 5)) for k in range(5)}


def test_components_of_long_paths_and_unfinished_ones(spark, monkeypatch):
    rng = random.Random(3)
    order = rng.sample(range(300), 300)
    nodes = spark.createDataFrame([(c, i) for i, c in enumerate(range(310))], "code long, least long")
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(300, 301), (303, 303)], "a long, b long")
    got = {r.code: r.component_id for r in components.connected(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 300: 300, 301: 300, **{i: i for i in range(302, 310)}}
    monkeypatch.setattr(components, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="unfinished"):
        components.connected(nodes, edges)


def test_large_buckets_are_parted_by_their_bits(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    codes = np.array(near_codes(900, 8), np.uint64)
    parent = list(range(len(codes)))
    at = {int(c): i for i, c in enumerate(codes)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in simhash.near(codes, np.ones(len(codes), bool)):
        assert (a ^ b).bit_count() <= simhash.RADIUS
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(codes))] == brute_components(codes.tolist())


# ---- longest previous factors


def test_previous_factors_of_a_suffix_order():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(2, 60)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), 0)
        lcp = np.array([-1] + [common(i, j) for i, j in zip(order, order[1:])])
        got = substring.previous_factors(np.array(order), lcp, len(order))
        assert got.tolist() == [max((common(i, j) for j in range(i)), default=-1) for i in order]


@pytest.mark.parametrize(("group", "held"), [(1000, 9), (4, 200_000), (4, 0)])
def test_later_copies_and_shorter_repeats(spark, monkeypatch, group, held):
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "HELD", held)
    texts = repeated_texts()
    bodies = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, digest string, rank int, gram int").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_later, r.n_repeated) for r in substring.removals(docs, 60, 16, least=40).collect()}
    want = zip(brute_cover(bodies, 60, False), brute_cover(bodies, 60, True), brute_cover(bodies, 40, False))
    assert got == {i: tuple(int(c.sum()) for c in covers) for i, covers in enumerate(want)}


def test_blocks_of_a_very_long_text_have_the_anchors_of_the_whole():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 103, 5000), np.full(700, 97), rng.integers(97, 103, 3000)]).astype(np.uint8)
    own = lambda x: {(int(a), int(u)) for a, f, e in zip(x[0], x[2], x[3]) for u in range(f, e)}
    whole = own(substring.anchors(data))
    half, parts = 3000, set()
    for i in range(0, len(data), half):
        parts |= {(a + i, u + i) for a, u in own(substring.anchors(data[i : i + half + substring.LEAST - 1]))}
    assert whole <= parts


# ---- nearest neighbours


def test_ties_at_the_last_place_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(0)
    rows = [(0, [1.0] + [0.0] * 15)] + [(801 + i, [0.5, *(rng.standard_normal(15) * 0.3).tolist()]) for i in range(190)]
    rows += [(2001 + i, [0.1, *rng.standard_normal(15).tolist()]) for i in range(1500)]
    got = mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(801, 821))


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    short, long = ([(i, rng.standard_normal(d).tolist()) for i in range(lo, lo + 40)] for lo, d in ((0, 4), (100, 7)))
    rows = short + long + [(20, short[3][1]), (20, short[20][1])]
    got = {}
    for r in mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score)))
    for part in (short, long):
        for q, hits in brute_nearest(part, 6, 20).items():
            if q != 20:
                same = [(i, s) for i, s in hits if i != 20]
                assert [h for h in got[q] if h[0] != 20][: len(same) - 1] == same[: len(same) - 1]
    assert 20 not in {v for v, _ in got[20]} and set(got) == {0, 20, 100, 120}


def test_probing_retrieves_every_code_within_a_radius_and_only_those_are_multiplied():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 32))
    x[1:200] = x[0] + rng.standard_normal((199, 32)) * 0.15
    directions = mih.learn_rotation(mih.extend(x, longest := float(np.linalg.norm(x, axis=1).max())))
    index = mih.Index(x, mih.codes_of(mih.extend(x, longest), directions))
    code = index.codes[0]
    far = np.bitwise_count(index.codes ^ code).sum(axis=1)
    seen = np.unique(np.concatenate([index.probe(code, t) for t in range(3)]))
    assert set(np.flatnonzero(far < 3 * mih.SUBSTRINGS)) <= set(seen.tolist())
    assert (index.distances(code) == far).all()
    before = index.products
    rows, products = index.search(mih.codes_of(mih.extend(x[:1], longest, query=True), directions)[0], x[0], float(np.linalg.norm(x[0])) * longest, 21)
    query = mih.codes_of(mih.extend(x[:1], longest, query=True), directions)[0]
    far = np.bitwise_count(index.codes ^ query).sum(axis=1)
    assert len(set(np.argsort(-(x @ x[0]))[:21].tolist()) & set(rows.tolist())) >= 18 and index.products - before <= (far < 80).sum()


# ---- decontamination


def test_windows_and_subsequences_by_brute_force(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    n, df, z = decontaminate.sketch(docs)
    counted, passages = {}, 0
    of = lambda t: decontaminate.terms(decontaminate.words([t])[0]).tolist()
    for t in texts.values():
        w = of(t)
        for i in range(0, len(w), 2 * decontaminate.BLOCK):
            passages += 1
            for x in set(w[i : i + 2 * decontaminate.BLOCK]):
                counted[x] = counted.get(x, 0) + 1
    assert n == passages and {int(i): int(df[i]) for i in np.flatnonzero(df)} == counted
    table = decontaminate.latent(n, df, z)

    def vector(w):
        v = np.zeros(len(table))
        for x in set(w):
            v += (1 + math.log(w.count(x))) * table[:, x]
        return v / np.linalg.norm(v)

    def subsequence(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    size, got = decontaminate.BLOCK, {}
    for r in decontaminate.matches(docs, bench).collect():
        got[r.doc_id, r.item_id] = r
    for d in list(texts)[:40]:
        w = of(texts[d])
        starts = range(0, max(1, len(w) - size), size) if len(w) > size else [0]
        windows = np.array([vector(w[i : i + 2 * size]) for i in starts if w])
        for i, t in items.items():
            v = of(t)
            probes = np.array([vector(v[k : k + 2 * size]) for k in range(0, max(1, len(v) - 2 * size + decontaminate.STEP), decontaminate.STEP)])
            near = len(w) and (windows @ probes.T).max() >= decontaminate.COSINE + 1e-4
            whole = near and max(subsequence(v, w[k : k + len(v) + len(v) // 4 + 2]) for k in range(max(1, len(w) - len(v)))) / len(v) if near and len(set(v) & set(w)) >= decontaminate.WHOLE * len(set(v)) else 0
            assert ((d, i) in got) == (whole >= decontaminate.WHOLE), (d, i, whole)


def test_paraphrases_at_each_rate(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    hosts, items = [r.text.split() for r in docs.collect()], [(r.item_id, r.text.split()) for r in bench.collect()]
    vocabulary, rng, rows = [w for h in hosts[:50] for w in h], random.Random(7), []
    for rate in (0, 10, 20, 30):
        for n in range(40):
            i, w = items[n % len(items)]
            host, w = rng.choice(hosts)[:300], [rng.choice(vocabulary) if rng.random() * 100 < rate else x for x in w]
            at = rng.randint(0, len(host))
            rows.append((rate * 1000 + n, " ".join(host[:at] + w + host[at:]), i))
    both = docs.select("doc_id", "text").filter("doc_id < 0").unionByName(spark.createDataFrame(rows, "doc_id long, text string, item long").drop("item"))
    hit = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs.select("doc_id", "text").unionByName(both.selectExpr("doc_id + 1000000 AS doc_id", "text")), bench).collect()}
    share = {rate: np.mean([(d + 1_000_000, i) in hit for d, _, i in rows if d // 1000 == rate]) for rate in (0, 10, 20, 30)}
    assert share[0] == 1 and share[10] >= 0.95 and share[20] >= 0.9 and share[30] >= 0.8


def test_signatures_reject_only_what_cannot_match(spark, small):
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text, None) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    n, df, z = decontaminate.sketch(spark.read.parquet(f"{small}/documents.parquet"))
    search = decontaminate.Searcher(items, decontaminate.latent(n, df, z))
    want = search.find(docs)
    search.marks[:], search.folded[:] = 0, 0  # nothing is rejected
    assert search.find(docs) == want and want


# ---- languages


def test_mixtures_by_plain_expectation_maximisation(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    known = language.learn(docs.filter("lang IS NOT NULL"))
    logs, mask = np.stack(list(known.values())).astype(float), (1 << 64) - 1

    def bucket(a, b, c):
        h = (ord(a) * 0x9E3779B97F4A7C15 + ord(b) * 0xC2B2AE3D27D4EB4F + ord(c) * 0x165667B19E3779F9) & mask
        h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9 & mask) >> 48

    def plain(text, rounds=8, penalty=0.5):
        found = [" " + w.lower() + " " for w in regex.findall(r"\p{L}+", text)]
        words = [[sum(row[bucket(*w[i : i + 3])] for i in range(len(w) - 2)) for w in found] for row in logs]
        k, n = len(logs), len(found)
        p = [[math.exp(words[j][i] - max(words[x][i] for x in range(k))) for i in range(n)] for j in range(k)]
        pi, on = [1 / k] * k, [True] * k

        def step(pi):
            totals = [sum(pi[j] * p[j][i] for j in range(k)) for i in range(n)]
            return [sum(pi[j] * p[j][i] / totals[i] for i in range(n)) / n for j in range(k)]

        for _ in range(rounds):
            pi = step(pi)
        for _ in range(k - 1):
            totals = [sum(pi[j] * p[j][i] for j in range(k)) for i in range(n)]
            lost = [-sum(math.log(max(totals[i] - pi[j] * p[j][i], 1e-300) / max(1 - pi[j], 1e-12)) - math.log(totals[i]) for i in range(n)) if on[j] else math.inf for j in range(k)]
            j = lost.index(min(lost))
            if lost[j] >= penalty * math.log(n) + 1 or sum(on) == 1:
                break
            on[j] = False
            pi = [x if o else 0 for x, o in zip(pi, on)]
            pi = step([x / sum(pi) for x in pi])
        return step(step(pi)), on

    texts = [r.text for r in docs.collect() if len(r.text) < 1500][:25]
    texts += [a + " " + b for a, b in itertools.pairwise(texts[:8])]
    share, active, has = language.infer(texts, np.stack(list(known.values())))
    for t, s, a, h in zip(texts, share, active, has):
        assert h
        want, on = plain(t)
        assert a.tolist() == on and np.allclose(s, want, atol=1e-3)


# ---- stages


def test_stages_on_nulls_ties_repeats_and_taken_names(spark, small):
    import corpus_pipeline as c

    base = spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()
    english = [r.text for r in base if r.lang == "en" and len(r.text) > 300][:3]
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in base]
    rows += [(None, english[0][160:480] + " null one", "en", "s", 1), (None, english[1][:200] + " null two and more words here", "en", None, None), (9001, None, None, None, None), (9002, "", "en", "s", 0)]
    rows += [(9003, english[2], "en", "s", 1), (9003, english[0][:150] + " unlike the other row", "en", "s", 1), (9004, item, "en", "s", 1), (9005, " ".join(reversed(english[1].split())) * 300, "en", "s", 1), (9006, english[2], "en", "s", 1), (9006, english[2], "en", "s", 1)]
    names = ["_bad", "_gone", "_twice", "_lines", "_dropped", "host", "row", "key", "code", "digest"]
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    at = docs
    for name, stage in c.STAGES[:-1]:
        before, at = at, c.materialize(stage(spark, at, small), name)
        assert at.columns == docs.columns and at.count() <= before.count()
        assert stage(spark, docs.limit(0), small).count() == 0
    left = at.collect()
    assert sum(r.doc_id is None for r in left) == 2 and {9005} <= {r.doc_id for r in left} and not {9001, 9002, 9004} & {r.doc_id for r in left}
    assert sum(r.doc_id == 9003 for r in left) >= 1 and sum(r.doc_id == 9006 for r in left) <= 1
    packed = c.STAGES[-1][1](spark, at, small)
    assert packed.filter("doc_id = 9005").count() > 1 and c.STAGES[-1][1](spark, docs.limit(0), small).count() == 0
