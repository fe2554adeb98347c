"""Vocabulary, TF-IDF weights and lexical richness of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: Terms that are in more than one of so many (document, term) pairs are looked up in a broadcast table: there are no more
#: than this many of them. All others are joined by term, and none has more rows than that share.
HOT_TERMS = 10_000
#: Words that are drawn in the measure of diversity.
DRAWN = 42


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null as none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, n), stored: how often each document has each term. Rows with the same key are one document.

    Whole texts are spread over tasks of even size first, whatever their keys: a file of one row group is one task's scan, and
    cutting texts into words is most of the work.
    """
    spread = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).hint("rebalance")
    long = spread.select("doc", F.explode(words(F.col("text"))).alias("term"))
    return materialise(long.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n")), "term-counts")


def vocabulary(counts: DataFrame) -> DataFrame:
    """(term, df, total, idf): documents that have the term, its occurrences, and ln((1 + N) / (1 + df)) + 1 over the N
    documents that have any."""
    n_docs = counts.select("doc").distinct().count()
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
    return terms.withColumn("idf", F.ln(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1)


def tfidf(counts: DataFrame) -> DataFrame:
    """(doc, term, n, score): occurrences times idf, the scores of a document scaled to length one."""
    terms = materialise(vocabulary(counts).select("term", "df", "idf"), "vocabulary")
    pairs = terms.agg(F.sum("df").alias("n")).head()["n"] or 0
    hot = F.col("df") * HOT_TERMS > pairs
    known = counts.join(F.broadcast(terms.where(hot).select("term", F.col("idf").alias("hot_idf"))), "term", "left")
    common = known.where(F.col("hot_idf").isNotNull()).withColumnRenamed("hot_idf", "idf")
    rest = known.where(F.col("hot_idf").isNull()).drop("hot_idf").join(terms.where(~hot).select("term", "idf"), "term")
    weighed = common.unionByName(rest).withColumn("w", F.col("n") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))
    return weighed.select("doc", "term", "n", (F.col("w") / length).alias("score"))


def top_terms(scored: DataFrame, group: str, k: int) -> DataFrame:
    """(group, place, term, score): the terms of each group with the highest scores; equal ones (to nine digits) by name."""
    order = W.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(group, "place", "term", "score")


def group_scores(scored: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, term, score): mean score of each term over the documents of a group, those without the term included.

    ``groups`` has ``doc`` and the group, a row a document.
    """
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("docs"))
    sums = scored.join(groups, "doc").groupBy(group, "term").agg(F.sum("score").alias("s"))
    return sums.join(sizes, group).select(group, "term", (F.col("s") / F.col("docs")).alias("score"))


def lexical_richness(counts: DataFrame) -> DataFrame:
    """(doc, n_words, n_terms, type_token, once_share, diversity).

    ``diversity`` is the hypergeometric one: the share of different words to expect among ``DRAWN`` drawn from the document
    without putting back (all of a shorter one). It comes from how many terms occur once, twice, ...; no text is read again.
    """
    per_doc = W.partitionBy("doc")
    spectrum = counts.groupBy("doc", "n").agg(F.count(F.lit(1)).alias("terms"))
    sized = spectrum.withColumn("n_words", F.sum(F.col("n") * F.col("terms")).over(per_doc))
    drawn = F.least(F.lit(DRAWN), F.col("n_words")).cast("int")
    # The chance that a term of n occurrences is not among those drawn.
    missed = F.aggregate(
        F.sequence(F.lit(0), drawn - 1),
        F.lit(1.0),
        lambda p, i: p * F.greatest(F.lit(0.0), F.col("n_words") - F.col("n") - i) / (F.col("n_words") - i),
    )
    parts = sized.select("doc", "n", "terms", "n_words", drawn.alias("drawn"), ((1 - missed) * F.col("terms")).alias("seen"))
    return parts.groupBy("doc", "n_words").agg(
        F.sum("terms").alias("n_terms"),
        (F.sum("terms") / F.max("n_words")).alias("type_token"),
        (F.sum(F.when(F.col("n") == 1, F.col("terms")).otherwise(0)) / F.sum("terms")).alias("once_share"),
        (F.sum("seen") / F.max("drawn")).alias("diversity"),
    )
