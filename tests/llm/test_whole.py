"""Whole results: what the operators once left out."""

import itertools
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from quarry.llm import language, lines, queries, similar, simhash


def test_rows_under_null_and_repeated_ids_stay(spark):
    rows = [(1, "same words in both of these texts"), (None, "same words in both of these texts"), (None, "rivers run to the sea at night"), (None, "a quite different stone on the hill"), (2, "first text under the id two here"), (2, "bread and cheese were on that table"), (2, "bread and cheese were on that table")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in {*rows} - {rows[1]})


def brute_shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_groups(texts):
    sets, group = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((group[i], group[j]))
            group = [a if g == b else g for g in group]
    return group


@pytest.mark.parametrize("bucket", [4096, 8])
def test_the_stage_finds_what_is_similar(spark, small, monkeypatch, bucket):
    import corpus_pipeline as c

    monkeypatch.setattr(similar, "BUCKET", bucket)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    base = [rng.choice(words) for _ in range(300)]
    for edits in [1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16] * 2:  # around similarity 0.8
        copy = list(base)
        for at in rng.sample(range(300), edits):
            copy[at] = "edited"
        texts += [" ".join(copy), " ".join(copy)]
    texts += ["one", "One", "two words", "a b c d e", "a b c d f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in c.keep_one_of_near_duplicates(spark, docs, small).collect())
    assert kept == sorted(set(brute_groups(texts)))


def test_fingerprints_give_candidates_of_the_stage(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1])]
    print_of = [similar.simhash.majority(similar.shingles(t)) for t in texts]
    assert (print_of[0] ^ print_of[1]).bit_count() <= simhash.RADIUS < (print_of[0] ^ print_of[2]).bit_count()
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    nodes = similar.with_components(similar.sketches(rows)).withColumn("bands", F.slice("bands", similar.BANDS + 1, 1))  # those of MinHash left out
    codes = {r.row: r.code for r in nodes.select("row", "code").collect()}
    assert [set(r.codes) for r in similar.buckets(nodes.select("code", "bands")).collect()] == [{codes[0], codes[1]}]


def test_forest_connects_what_is_similar():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in rng.integers(5, 60, 12)]
    sets += [np.unique(np.concatenate([s[rng.random(len(s)) > 0.08], rng.integers(0, 1 << 60, 2).astype(np.uint64)])) for s in sets for _ in range(6)]
    near = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(b := np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and len(b)}
    found = similar.forest(np.arange(len(sets)), sets)

    def parts(links):
        group = list(range(len(sets)))
        for i, j in links:
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
        return group

    assert all((min(p), max(p)) in near for p in found) and parts(sorted(near)) == parts(found)


def test_the_mixture_decides_which_documents_are_identified(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    fresh = [(9000, "жил был у бабушки серенький козлик " * 4, None), (9001, "x" + "qzjvkw xqzzv " * 20, None), (9002, "12 .. !!", None)]
    both = docs.unionByName(spark.createDataFrame(fresh, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language.keep_identified(both).collect()}
    assert not kept & {9000, 9001, 9002} and {r.doc_id for r in docs.filter("lang IS NOT NULL").collect()} <= kept
    unlabelled = both.selectExpr("doc_id", "text", "cast(null AS string) AS lang")
    assert {r.doc_id for r in language.keep_identified(unlabelled).collect()} >= {9000, 9001} and 9002 not in {r.doc_id for r in language.keep_identified(unlabelled).collect()}


def test_copied_passages_go_whole(spark, tmp_path):
    dialogue = "Who is it?\n- Me.\n- Come in!\n- No. You come out, please. It rains.\n- Never."
    code = "for x in y:\n    f(x)\n    g(x)\nprint(z)\nreturn z, x"
    chinese = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u6563\u6b65\u5427\u7136\u540e\u56de\u5bb6\u5403\u996d"
    rows = [(i, t) for i, t in enumerate([dialogue, code, chinese, "Before.\n" + dialogue, code + "\nafter it", chinese, "One thing. Never. Other thing."])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op5_unit_dedup(spark, str(tmp_path))
    left = {r.doc_id: r.text.strip() for r in lines.remove_spans(docs, found).collect()}
    assert [left[i].split() for i in range(3)] == [t.split() for _, t in rows[:3]]
    assert left[3].replace("\n", "").strip() == "Before." and left[4] == "after it" and left[5] == "" and left[6] == rows[6][1]
