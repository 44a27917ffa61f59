"""Operators that take documents one by one: personal data, token counts, language, packing."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import language, lines, pack, pii, token_count

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
#: null in every column, empty and very long texts, ties, repeated rows, special strings, columns whose names the operators use inside
EDGES = [
    (1, None, None, None),
    (None, "Texto sem id, a@b.co", "es", "s"),
    (2, "", "en", None),
    (3, " \t\n ", "en", "s"),
    (4, "12 .. !!", "en", "s"),
    (5, "the house and the river with the stone " * 3000, "en", "s"),
    (6, "la casa y el rio con la piedra <|endoftext|> x", "es", "s"),
    (6, "la casa y el rio con la piedra <|endoftext|> x", "es", "s"),
    (7, "the house and the river", "en", "s"),
    (8, "la casa y el rio", None, "s"),
    (9, "la casa y el rio", "es", "s"),
]
NAMES = "doc_id long, text string, lang string, source string, part int, code string, digest string, _bad int, n int, key string"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, 1, "c", "d", 2, 3, "k") for r in EDGES], NAMES)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def brute_pii(t):
    found = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and pii.luhn(d)],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15],
    }
    return found


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.b@@-1234 56789.+().0-%c é", max_size=70))
def test_anchors_find_what_the_patterns_find(t):
    found = pii.find(t)
    assert {k: found[k] for k in pii.BASE} == brute_pii(t)


def test_added_kinds_and_redaction():
    t = "bob (at) example (dot) com, http://x.yz/a?b=1. Account: AB-1234567 ssn 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 accounting 5"
    found = {k: [t[a:b] for a, b in v] for k, v in pii.find(t).items() if v}
    assert found == {"handle": ["bob (at) example (dot) com"], "url": ["http://x.yz/a?b=1"], "account": ["AB-1234567"], "ssn": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00"]}
    assert pii.redact("mail a@b.co now") == "mail [email] now"


def test_personal_data_rows(edges, docs):
    rows = pii.personal_data(edges).collect()
    assert len(rows) == len(EDGES)
    assert next(r for r in rows if r.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()
    assert next(r for r in rows if r.doc_id is None).n_email == 1
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for r in docs.collect():
        want = brute_pii(r.text)
        spans = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
        assert got[r.doc_id].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert pii.personal_data(edges.limit(0)).count() == 0


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD), token_count.Counter(WORD)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdefrstlvm'' ''RVEL!?  \n\t1²½éÉßΣςİ日本́\x1c\x85", max_size=60)))
def test_transducer_counts_as_the_library(word, t):
    assert word[1].counts([t])[0] == len(word[0].encode(t, add_special_tokens=False).ids)


def test_transducer_on_long_words_chunk_edges_and_specials(word):
    texts = ["x" * 5000, "ab" * 3000 + "'", ("a" * (token_count.CHUNK - 1) + "'re'll ") * 5, "<|startoftext|>a<|endoftext|>", "", "'ll 've 're it's"]
    assert word[1].counts(texts).tolist() == [len(e.ids) for e in word[0].encode_batch(texts, add_special_tokens=False)]
    few = token_count.Transducer.__new__(token_count.Transducer)
    few.__dict__ = word[1]._transducer.__dict__ | {"_bound": 1}
    few.clear()
    assert [few.count(w) for w in (b"running", b"walking")] == [len(word[0].encode(w, add_special_tokens=False).ids) for w in ("running", "walking")]


def test_token_count_rows(edges, docs, word):
    rows = token_count.token_counts(edges, WORD).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[:2] == sorted((i or 0, len(word[0].encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in EDGES)[:2]
    assert next(r for r in rows if r.doc_id == 5).over_limit and next(r for r in rows if r.doc_id == 1).n_bytes == 0
    want = dict(zip([r.doc_id for r in docs.collect()], [len(e.ids) for e in word[0].encode_batch([r.text for r in docs.collect()], add_special_tokens=False)]))
    assert {r.doc_id: r.n_tokens for r in token_count.token_counts(docs, WORD).collect()} == want
    assert token_count.token_counts(edges.limit(0), WORD).count() == 0


def test_languages_on_held_out_documents(docs):
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.collect())
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixtures_name_both_languages(spark, docs):
    known = language.learn(docs.filter("lang IS NOT NULL"))
    logs = np.stack(list(known.values()))
    names = list(known)
    en, de = (docs.filter(f"lang = '{x}' AND n_chars > 2000").first().text[:2000] for x in ("en", "de"))
    share, active, has = language.infer([en + " " + de, en, ""], logs)
    assert {n for n, a in zip(names, active[0]) if a} == {"en", "de"} and 0.25 < share[0, names.index("en")] < 0.75
    assert active[1].sum() == 1 and not has[2]


def test_language_rows(edges):
    rows = language.identify(edges).collect()
    assert len(rows) == len(EDGES)
    none = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert none == {1, 2, 3, 4} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.doc_id: r.lang_pred for r in rows}[8] == "es"
    assert {r.lang_pred for r in language.identify(edges.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert language.identify(edges.limit(0)).count() == 0
    assert {r.doc_id for r in language.keep_identified(edges).collect()} == {None, 5, 6, 7, 8, 9}


def check_packing(pieces, texts, capacity):
    tokenizer = Tokenizer.from_file(BYTE)
    want = []
    for i, t in texts:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for n, (start, length) in enumerate(pack.cut(len(ids), capacity)):
            want.append((i, n, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, want)) == sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in pieces)
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in pieces) // capacity)


def test_packing(edges, docs):
    assert pack.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and pack.cut(2048, 2048) == [(0, 2048)] and pack.cut(4096, 2048) == [(0, 2048), (2048, 2048)]
    check_packing(pack.pack(edges, BYTE).collect(), [r[:2] for r in EDGES], 2048)
    used, least = check_packing(pack.pack(docs.repartition(5), BYTE).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= least * 1.02 + 1
    assert pack.pack(edges.limit(0), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), min_size=1, max_size=40))
def test_plans_place_every_length_once(histogram):
    places, total = pack.plan(histogram, 100, groups=6)
    bins = {}
    for n, rows in places.items():
        at = 0
        for lo, hi, first, copies, offset in rows:
            assert lo == at and hi > lo
            at = hi
            for k in range(hi - lo):
                bins.setdefault(first + k // copies, []).append((offset + k % copies * n, n))
        assert at == histogram[n]
    assert set(bins) == set(range(total))
    for places_ in bins.values():
        at = 0
        for offset, n in sorted(places_):
            assert offset == at
            at += n
        assert at <= 100
    assert total >= -(-sum(n * c for n, c in histogram.items()) // 100)


def test_boilerplate_lines(spark, edges):
    rows = [(i, f"menu\nown {i}\n\nfooter {i % 2}", "en", "a") for i in range(20)] + [(100 + i, f"menu\nb {i}", "en", "b") for i in range(3)] + [(200 + i, "x\nmenu", "en", None) for i in range(6)] + [(300, None, "en", "a"), (301, "", None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r for r in lines.drop_boilerplate(df).collect()}
    assert kept[3].text == "own 3\n" and kept[101].text == "b 1" and kept[203].text == "" and kept[300].text is None and kept[301].text == "" and kept[3]._dropped == 2
    assert lines.drop_boilerplate(edges).columns == [*edges.columns, "_lines", "_dropped"]
    assert lines.line_report(edges).count() == len(EDGES) and lines.line_report(edges.limit(0)).count() == 0


def test_boilerplate_matches_sql(spark, small, docs):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    want = sorted(c.sql(lines.LINE_SQL).df()[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].itertuples(index=False, name=None))
    assert sorted(tuple(r) for r in lines.line_report(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()) == want


def brute_units(rows, unit="sentence", least=8):
    seen, out = set(), []
    for i, t in sorted((r for r in rows if r[1]), key=lambda r: (r[0] is not None, r[0] or 0)):
        for s, e, _, normal in lines.units_of(t, unit, least):
            if normal in seen:
                out.append((i, s, e))
            seen.add(normal)
    return sorted(out, key=str)


def test_repeated_units(spark, edges, docs):
    sample = [(r.doc_id, r.text) for r in docs.collect()]
    found = lines.repeated_units(docs)
    assert sorted(((r.doc_id, r.start, r.end) for r in found.collect()), key=str) == brute_units(sample)
    cut = {r.doc_id: r.text for r in lines.remove_spans(docs.select("doc_id", "text"), found).collect()}
    for i, t in sample:
        for s, e in sorted(((s, e) for d, s, e in brute_units(sample) if d == i), reverse=True):
            t = t[:s] + t[e:]
        assert cut[i] == t
    one = "A sentence of eight words that repeats itself here."
    rows = [(2, f"x. {one.upper()} y"), (1, f"{one}\n{one}"), (None, f"{one}"), (3, None), (4, ""), (1, "short one. short one.")]
    got = lines.repeated_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.kept_doc_id) for r in got) == [(1, 0, None), (1, len(one) + 1, None), (2, 3, None)]
    assert lines.repeated_units(edges.limit(0)).count() == 0 and {r.doc_id for r in lines.repeated_units(edges).collect()} == {6}


def test_units_of_lines_and_paragraphs():
    assert [(s, e) for s, e, *_ in lines.units_of("a b\nc d\n\ne f", "line", 2)] == [(0, 3), (4, 7), (9, 12)]
    assert [(s, e) for s, e, *_ in lines.units_of("a b\nc d\n\ne f", "paragraph", 2)] == [(0, 7), (9, 12)]
    assert [(s, e) for s, e, *_ in lines.units_of("A b. C d! e", "sentence", 1)] == [(0, 4), (5, 9), (10, 11)]
