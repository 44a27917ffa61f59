"""Corpus selection over filings: pairs of companies where one's filing names the other, and a capped choice of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import fixed, text

FILING = ("company", "subject", "category", "date", "protocol", "url")


def filings(raw: DataFrame) -> DataFrame:
    """Renamed columns; seq is the order of the file."""
    renamed = raw.select(*[F.trim(F.coalesce(F.col(a), F.lit(""))).alias(b) if b in ("company", "subject") else F.col(a).alias(b) for a, b in zip(fixed.FILING_COLUMNS, FILING)])
    return renamed.withColumn("seq", F.monotonically_increasing_id())


def facts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("category").isin(*fixed.FILING_CATEGORIES) & F.col("subject").rlike("(?iu)" + fixed.FILING_OPERATION)).withColumn("key", text.short_name(F.col("company")))


def citation_pairs(rows: DataFrame) -> DataFrame:
    """citing, cited, seq of the filings whose subject holds another company's short name. rows: facts().

    The names are found by an equi-join: a name occurs only where all its runs of five characters do, so a subject's runs meet the one
    run of each name that fewest other names have, and only those are compared. Names that begin alike don't meet in it.
    """
    names = rows.groupBy("key").agg(F.max_by("company", "seq").alias("cited")).filter(F.length("key") >= 5)
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 4, F.lit(1))), lambda i: F.substring(c, i, 5)))
    parts = names.select("key", F.explode(gram(F.col("key"))).alias("gram"))
    shared = parts.join(parts.groupBy("gram").agg(F.count("*").alias("n")), "gram")
    rarest = shared.groupBy("key").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    head = names.join(rarest, "key").withColumnRenamed("key", "name")
    subjects = rows.select(F.col("company").alias("citing"), F.col("key").alias("own"), "seq", text.fold(F.col("subject")).alias("body"))
    met = subjects.withColumn("gram", F.explode(gram(F.col("body")))).join(head, "gram")
    return met.filter(F.col("body").contains(F.col("name")) & (F.col("name") != F.col("own"))).select("citing", "cited", "seq").distinct()


def select_documents(rows: DataFrame, most: int = 60, per_company: int = 4) -> tuple[list[dict], list[tuple[str, str]]]:
    """The chosen filings and their pairs. Pairs with most filings come first; the choice is sequential and small, so it is made on the driver.

    Only the richest ``most`` pairs can be reached, and of each pair and company only so many filings as can be chosen.
    """
    pairs = citation_pairs(rows)
    ranked = pairs.groupBy("citing", "cited").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.array_sort(F.collect_list("seq")).alias("seqs"))
    order = ranked.orderBy(F.desc("n"), "first", "cited")
    chosen, kept, seen, count = [], [], set(), {}
    for pair in order.toLocalIterator():
        if len(chosen) >= most:
            break
        kept.append((pair.citing, pair.cited))
        wanted = rows.filter(F.col("seq").isin(pair.seqs) if len(pair.seqs) < 1000 else F.col("company") == pair.citing).orderBy("seq").limit(most + 1)
        other = rows.filter(F.col("company") == pair.cited).orderBy("seq").limit(per_company)
        for r in [*wanted.collect(), *other.collect()]:
            if r.protocol in seen or count.get(r.company, 0) >= per_company or len(chosen) >= most:
                continue
            seen.add(r.protocol)
            count[r.company] = count.get(r.company, 0) + 1
            chosen.append(r.asDict())
    return chosen, kept


def by_manifest(rows: DataFrame, protocols: list[str]) -> DataFrame:
    """The filings of a manifest in its order; of a protocol's rows the last; missing ones are left out."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(enumerate(protocols)), "pos int, protocol string")
    last = rows.groupBy("protocol").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "protocol"]), "seq").alias("r"))
    return wanted.join(last, "protocol").select("pos", "protocol", "r.*").orderBy("pos")
