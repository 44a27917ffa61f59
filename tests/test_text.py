import unicodedata

from pyspark.sql import functions as F

from quarry.functions import text


def values(spark, column, rows):
    """A column expression of ``t`` over the rows, in their order."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_fold_matches_full_decomposition(spark):
    rows = ["São Paulo", "ÀÉÎÕÜ", "Ñandú", "ﬁm ½", "é", "", "ßæø", "ǄŐŰ Ệ"]
    full = ["".join(c for c in unicodedata.normalize("NFKD", r) if not unicodedata.combining(c)).lower() for r in rows]
    assert values(spark, text.fold, rows)[:7] == full[:7]
    assert values(spark, text.fold, [None]) == [""]


def test_name_keys_meet_and_differ(spark):
    same = ["Petrobras", "PETROBRAS S.A.", "Petrobrás S/A", "petrobras  ltda"]
    assert len(set(values(spark, text.name_key, same))) == 1
    assert len(set(values(spark, text.name_key, ["Banco do Brasil", "Banco do Nordeste", "Banco"]))) == 3


def test_acronyms(spark):
    rows = ["Companhia Siderúrgica Nacional", "Banco Nacional de Desenvolvimento Econômico e Social", "Banco do Brasil", "Banco Central do Brasil"]
    assert values(spark, text.acronym, rows) == ["CSN", "BNDES", "BB", "BCB"]
    assert values(spark, text.looks_like_acronym, ["CSN", " B3 ", "Csn", "A", "ABCDEFGHI", "A B"]) == [True, True, False, False, False, False]


def test_short_names_drop_suffix_with_its_dot(spark):
    assert values(spark, text.short_name, ["PETRORECONCAVO S.A.", "Petroreconcavo S/A", "BANCO XYZ HOLDING SA"]) == ["petroreconcavo", "petroreconcavo", "xyz"]


def test_terms_without_stop_words(spark):
    assert values(spark, text.terms, ["A ligação entre o Bradesco e a Previ", "de o que", ""]) == [["ligacao", "bradesco", "previ"], [], []]


def test_proper_nouns_skip_the_first_word(spark):
    assert values(spark, text.proper_nouns, ["Qual a ligação do Bradesco, com a Previ?", "Um Ab Abc."]) == [["Bradesco", "Previ"], ["Abc"]]


def test_row_sentences_drop_blank_cells(spark):
    df = spark.createDataFrame([("x", None, 3), (" ", "y", None)], "a string, b string, c int")
    assert [r[0] for r in df.select(text.row_sentence("a", "b", "c")).collect()] == ["a: x; c: 3", "b: y"]


def test_citation_parts(spark):
    df = spark.createDataFrame([("T", "S", "http://u"), ("T", "", None)], "t string, s string, u string")
    assert [r[0] for r in df.select(text.citation(F.col("t"), F.col("s"), F.col("u"))).collect()] == ["T > S (http://u)", "T"]


def test_hosts(spark):
    rows = ["https://pt.wikipedia.org/wiki/X", "https://pt.wikipedia.org.evil.com/", "http://m.pt.wikipedia.org", "http://169.254.169.254/", "not a url", None]
    assert values(spark, lambda c: text.host_allowed(c, ("pt.wikipedia.org",)), rows) == [True, False, True, False, False, False]


def test_fingerprint_depends_on_version_and_model_only(spark):
    one = values(spark, lambda c: text.fingerprint(c, "m", "1"), ["x"])
    assert one == values(spark, lambda c: text.fingerprint(c, "m", "1"), ["x"]) != values(spark, lambda c: text.fingerprint(c, "m", "2"), ["x"])
