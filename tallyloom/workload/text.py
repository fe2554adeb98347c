"""Text analysis: vocabulary, TF-IDF, lexical richness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import text
from tallyloom.workload.inputs import registry, table

Q, SQL, query = registry()

COUNTS = r"""counts AS (
  SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')) AS term FROM documents)
  WHERE term <> '' GROUP BY ALL
)"""
SCORES = (
    COUNTS
    + """, voc AS (
  SELECT term, count(*) AS df, sum(n)::BIGINT AS total,
         ln((1.0::DOUBLE + (SELECT count(DISTINCT doc_id) FROM counts)) / (count(*) + 1)) + 1 AS idf
  FROM counts GROUP BY term
), scores AS (
  SELECT doc_id, term, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS score FROM counts JOIN voc USING (term)
)"""
)


def counts_of(spark: SparkSession, sf: str) -> DataFrame:
    return text.term_counts(table(spark, sf, "documents"), "doc_id", "text")


@query("vocabulary", f"WITH {SCORES} SELECT term, df, total, round(idf, 9) AS idf FROM voc")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of the documents."""
    return text.vocabulary(counts_of(spark, sf)).withColumn("idf", F.round("idf", 9))


@query(
    "tfidf_top_terms",
    f"""WITH {SCORES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, term) AS place, term,
    round(score, 9) AS score FROM scores QUALIFY place <= 5""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The five terms that tell each document from the others best."""
    top = text.top_terms(text.tfidf(counts_of(spark, sf)), "doc", 5)
    return top.select(F.col("doc").alias("doc_id"), F.col("place").cast("bigint").alias("place"), "term", F.round("score", 9).alias("score"))


@query(
    "tfidf_by_language",
    f"""WITH {SCORES}, docs AS (SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL),
    means AS (SELECT lang, term, round(sum(score) / any_value(docs), 9) AS score
              FROM scores JOIN docs USING (doc_id) JOIN (SELECT lang, count(*) AS docs FROM docs GROUP BY 1) USING (lang) GROUP BY 1, 2)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS place, term, score
    FROM means QUALIFY place <= 10""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The ten terms with the highest mean score in each language."""
    docs = table(spark, sf, "documents").where(F.col("lang").isNotNull()).select(F.col("doc_id").alias("doc"), "lang")
    top = text.top_terms(text.group_scores(text.tfidf(counts_of(spark, sf)), docs, "lang"), "lang", 10)
    return top.select("lang", F.col("place").cast("bigint").alias("place"), "term", F.round("score", 9).alias("score"))


@query(
    "lexical_richness",
    f"""WITH {COUNTS}, sized AS (SELECT *, sum(n) OVER (PARTITION BY doc_id)::BIGINT AS n_words FROM counts),
    seen AS (SELECT doc_id, n, n_words, least(42, n_words) AS drawn,
                    1 - list_product([greatest(0.0::DOUBLE, n_words - n - i) / (n_words - i) FOR i IN range(least(42, n_words))]) AS seen
             FROM sized)
    SELECT doc_id, n_words, count(*) AS n_terms, count(*) / n_words::DOUBLE AS type_token,
           count(*) FILTER (n = 1) / count(*)::DOUBLE AS once_share, round(sum(seen) / any_value(drawn), 9) AS diversity
    FROM seen GROUP BY doc_id, n_words""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """How varied the words of each document are."""
    rich = text.lexical_richness(counts_of(spark, sf))
    return rich.withColumnRenamed("doc", "doc_id").withColumn("diversity", F.round("diversity", 9))
