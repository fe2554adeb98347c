"""Statistics, preparation, clustering, supervised models and insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import brackets
from tallyloom.operators import clustering, insights, prep, stats, supervised
from tallyloom.workload.commerce import RFM_ASOF, RFM_SCORES, relations, segments_of
from tallyloom.workload.inputs import LINES, order_log, registry, sales_lines, table
from tallyloom.workload.profiling import PROFILE, numeric_sql, profile_of, stored_profile, tables

Q, SQL, query = registry()


NAN = float("nan")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def line_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The measures of every order line, some with a missing tax: null or not a number."""
    lines = table(spark, sf, "lineitem")
    return lines.select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.when(F.col("l_orderkey") % 20 == 0, NAN).when(F.col("l_orderkey") % 10 != 0, F.col("l_tax")).alias("l_tax"),
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MEASURED = """full_rows AS (
  SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_orderkey % 10 <> 0
)"""


def pairs_sql(source: str) -> str:
    parts = [
        f"SELECT '{a}' AS var1, '{b}' AS var2, {i} AS i, {j} AS j, corr({a}, {b}) AS r, count(*) AS rows FROM {source}"
        for i, a in enumerate(MEASURES)
        for j, b in enumerate(MEASURES)
        if i < j
    ]
    return "pairs AS (" + " UNION ALL ".join(parts) + ")"


def matrix_sql() -> str:
    diagonal = " UNION ALL ".join(f"SELECT '{m}', '{m}', 1.0::DOUBLE" for m in MEASURES)
    return (
        "SELECT var1, var2, round(r, 6) AS correlation FROM pairs UNION ALL SELECT var2, var1, round(r, 6) FROM pairs "
        f"UNION ALL {diagonal}"
    )


RANKED = (
    MEASURED
    + ", ranked AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2 AS {m}" for m in MEASURES)
    + " FROM full_rows)"
)


@query("corr_pearson", f"WITH {MEASURED}, {pairs_sql('full_rows')} {matrix_sql()}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = stats.correlation_pairs(line_measures(spark, sf))
    return rounded(stats.correlation_matrix(pairs), 6, "correlation")


@query("corr_spearman", f"WITH {RANKED}, {pairs_sql('ranked')} {matrix_sql()}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = stats.correlation_pairs(line_measures(spark, sf), method="spearman")
    return rounded(stats.correlation_matrix(pairs), 6, "correlation")


@query(
    "top_correlations",
    f"""WITH {MEASURED}, {pairs_sql('full_rows')}
    SELECT var1, var2, round(r, 6) AS correlation, round(abs(r), 6) AS abs_correlation,
           CASE WHEN r > 0.7 THEN 'Strong Positive' WHEN r > 0.3 THEN 'Moderate Positive' WHEN r < -0.7 THEN 'Strong Negative'
                WHEN r < -0.3 THEN 'Moderate Negative' ELSE 'Weak / None' END AS relationship
    FROM pairs ORDER BY abs(r) DESC, i, j LIMIT 10""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    top = stats.top_correlations(stats.correlation_pairs(line_measures(spark, sf)))
    return rounded(top, 6, "correlation", "abs_correlation")


@query(
    "corr_embedding",
    """WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS r(i))
    SELECT 'e' || (a.i - 1) AS var1, 'e' || (b.i - 1) AS var2, round(corr(a.x, b.x), 6) AS correlation, count(*) AS rows
    FROM e a JOIN e b USING (vec_id) WHERE a.i < b.i GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of 64 dimensions of the embeddings, in one scan."""
    wide = table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(stats.correlation_pairs(wide).drop("i", "j"), 6, "correlation")


QUANTILES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
QUANTILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]


@query(
    "column_quantiles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {p}::DOUBLE AS probability, quantile_cont({c}::DOUBLE, {p}) AS quantile, count({c}) AS n FROM lineitem"
        for c in QUANTILE_COLUMNS
        for p in QUANTILES
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of the numbers of all order lines, by closing brackets."""
    return brackets.quantiles_of(table(spark, sf, "lineitem"), QUANTILE_COLUMNS, QUANTILES)


@query(
    "key_correlation",
    f"""WITH {MEASURED}, pairs AS (
      SELECT 'l_quantity' AS var1, 'charge' AS var2, corr(l_quantity, l_extendedprice * (1 - l_discount)) AS r, count(*) AS rows FROM full_rows
      UNION ALL SELECT 'l_extendedprice', 'charge', corr(l_extendedprice, l_extendedprice * (1 - l_discount)), count(*) FROM full_rows
      UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice), count(*) FROM full_rows)
    SELECT var1, var2, round(r, 6) AS correlation, rows FROM pairs WHERE abs(r) > 0.65 AND rows >= 15
    ORDER BY abs(r) DESC LIMIT 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    charged = line_measures(spark, sf).withColumn(
        "charge", F.when(F.col("l_tax") < 1, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    )
    pairs = stats.correlation_pairs(charged, ["l_quantity", "l_extendedprice", "charge"])
    return rounded(stats.key_correlation(pairs), 6, "correlation")


@query(
    "welch_ttest",
    """WITH g AS (SELECT l_linestatus AS label, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) / count(*) AS se
                 FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1),
    p AS (SELECT min(label) AS group1, max(label) AS group2, arg_min(m, label) - arg_max(m, label) AS d,
                 arg_min(se, label) AS s1, arg_max(se, label) AS s2, arg_min(n, label) AS n1, arg_max(n, label) AS n2 FROM g),
    t AS (SELECT group1, group2, d / sqrt(s1 + s2) AS statistic, (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS dof FROM p)
    -- The tail by the midpoint rule, over the whole by the same rule.
    SELECT group1, group2, round(statistic, 6) AS statistic, round(dof, 3) AS dof, round((
             SELECT sum(pow(1 + x * x / dof, -(dof + 1) / 2)) FROM (SELECT abs(statistic) + (i + 0.5) * 0.001 AS x FROM range(60000) AS r(i))) / (
             SELECT sum(pow(1 + x * x / dof, -(dof + 1) / 2)) FROM (SELECT (i + 0.5) * 0.001 AS x FROM range(60000) AS r(i))), 6) AS p_value
    FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    lines = lines.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 11 == 0, NAN).otherwise(F.col("l_extendedprice")))
    test = stats.welch_ttest(lines, "l_linestatus", "l_extendedprice")
    return rounded(rounded(test, 6, "statistic", "p_value"), 3, "dof")


@query(
    "anova_oneway",
    """WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1),
    t AS (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS grand, count(*) OVER () AS k, sum(n) OVER () AS total FROM g)
    SELECT round((sum(n * (m - grand) * (m - grand)) / (max(k) - 1)) / (sum((n - 1) * v) / (max(total) - max(k))), 6) AS statistic,
           CAST(max(k) - 1 AS BIGINT) AS dof1, CAST(max(total) - max(k) AS BIGINT) AS dof2,
           -- With four degrees of freedom above, the tail of F is finite: x^a (1 + a (1 - x)).
           round((SELECT pow(x, d / 2) * (1 + d / 2 * (1 - x)) FROM (SELECT d, d / (d + 4 * f) AS x FROM (
             SELECT (max(total) - max(k))::DOUBLE AS d,
                    (sum(n * (m - grand) * (m - grand)) / 4) / (sum((n - 1) * v) / (max(total) - max(k))) AS f FROM t))), 6) AS p_value
    FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    customer = customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, NAN).otherwise(F.col("c_acctbal")))
    test = stats.anova_oneway(customer, "c_mktsegment", "c_acctbal")
    return rounded(test, 6, "statistic", "p_value")


@query(
    "chi_square",
    """WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2),
    e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / (sum(n) OVER ())::DOUBLE AS e FROM c)
    SELECT round(sum((n - e) * (n - e) / e), 6) AS statistic,
           (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM c) AS dof,
           -- With eight degrees of freedom the tail is finite.
           round((SELECT exp(-h) * (1 + h + h * h / 2 + h * h * h / 6) FROM (SELECT sum((n - e) * (n - e) / e) / 2 AS h FROM e)), 6) AS p_value
    FROM e""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    test = stats.chi_square(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(test, 6, "statistic", "p_value")


@query(
    "chi_square_yates",
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2),
    g AS (SELECT x.a, y.b FROM (SELECT DISTINCT a FROM c) x, (SELECT DISTINCT b FROM c) y),
    f AS (SELECT a, b, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (a, b)),
    e AS (SELECT n, sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / (sum(n) OVER ())::DOUBLE AS e FROM f),
    d AS (SELECT abs(n - e) - least(0.5::DOUBLE, abs(n - e)) AS d, e, n FROM e),
    t AS (SELECT sum(d * d / e) AS statistic FROM d HAVING count(*) FILTER (n >= 5) >= 0.8 * count(*))
    SELECT round(statistic, 6) AS statistic, 1 AS dof, round((
             SELECT sum(exp(-x * x / 2)) FROM (SELECT sqrt(statistic) + (i + 0.5) * 0.001 AS x FROM range(40000) AS r(i))) / (
             SELECT sum(exp(-x * x / 2)) FROM (SELECT (i + 0.5) * 0.001 AS x FROM range(40000) AS r(i))), 6) AS p_value
    FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    test = stats.chi_square(table(spark, sf, "labels"), "quality", "toxic")
    return rounded(test, 6, "statistic", "p_value")


@query("statistical_tests")
def _(spark: SparkSession, sf: str) -> DataFrame:
    known = stored_profile(spark, sf).where("dataset_id = 'lineitem'").select("column_name", "unique_count").collect()
    distinct = {r["column_name"]: r["unique_count"] for r in known}
    return stats.statistical_tests(tables(spark, sf)["lineitem"], distinct)


@query(
    "factorize",
    """WITH v AS (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1)
    SELECT o_orderpriority, row_number() OVER (ORDER BY k) - 1 AS code FROM v""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stats.factorize(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


@query(
    "feature_target_corr",
    """WITH s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS c FROM orders
          WHERE o_orderkey % 31 <> 0 GROUP BY 1),
    p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS c FROM orders
          WHERE o_orderkey % 19 <> 0 AND o_orderkey % 31 <> 0 GROUP BY 1),
    coded AS (SELECT o.*, s.c AS sc, CASE WHEN o.o_orderkey % 19 = 0 THEN -1 ELSE p.c END AS pc
              FROM orders o JOIN s USING (o_orderstatus) JOIN p USING (o_orderpriority) WHERE o.o_orderkey % 31 <> 0)
    SELECT 'o_custkey' AS feature, round(corr(o_custkey, o_totalprice), 6) AS correlation FROM coded
    UNION ALL SELECT 'o_orderstatus', round(corr(sc, o_totalprice), 6) FROM coded
    UNION ALL SELECT 'o_orderpriority', round(corr(pc, o_totalprice), 6) FROM coded""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderpriority"))
    ).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 31 == 0, NAN).otherwise(F.col("o_totalprice")))
    features = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    return rounded(stats.feature_target_corr(orders, "o_totalprice", features, "o_orderkey"), 6, "correlation")


@query(
    "binned_relationship",
    """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1]))) AS e FROM lineitem),
    b AS (SELECT l_quantity AS x, l_extendedprice AS y, len(list_filter(e[2:len(e) - 1], lambda v: l_quantity > v)) AS bin, e
          FROM lineitem, e)
    SELECT bin, round(avg(x), 6) AS feature_avg, round(avg(y), 4) AS target_avg, count(*) AS rows,
           any_value(e[bin + 1]) AS low, any_value(e[bin + 2]) AS high FROM b GROUP BY bin""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    binned = stats.binned_relationship(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(rounded(binned, 6, "feature_avg"), 4, "target_avg")


# --- preparation -----------------------------------------------------------

GAPPY = """gappy AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice END AS price,
         CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS priority FROM orders
)"""


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 46 == 0, NAN).when(F.col("o_orderkey") % 23 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderpriority")).alias("priority"),
    )


@query(
    "impute_median",
    f"WITH {GAPPY} SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM gappy)) AS price FROM gappy",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.impute_median(gappy(spark, sf), ["price"]).drop("priority")


@query(
    "impute_mode",
    f"""WITH {GAPPY}, m AS (SELECT priority FROM gappy WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT o_orderkey, coalesce(priority, (SELECT priority FROM m)) AS priority FROM gappy""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.impute_mode(gappy(spark, sf), ["priority"]).drop("price")


@query(
    "zscale",
    """SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) /
              (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scaled = prep.zscale(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return rounded(scaled, 6, "c_acctbal")


@query(
    "stratified_split",
    """SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat(o_orderkey, '42')), o_orderkey)
              <= floor(count(*) OVER (PARTITION BY o_orderpriority) * 0.8::DOUBLE) AS is_train FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prep.stratified_split(orders, "o_orderkey", "o_orderpriority")


@query(
    "scatter_sample",
    "SELECT c_custkey, c_name FROM customer ORDER BY md5(concat(c_custkey, '42')), c_custkey LIMIT 500",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return prep.random_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey")


# --- clustering ------------------------------------------------------------


_clustered: dict[tuple[str, str], clustering.Clustering] = {}


def clustered_orders(spark: SparkSession, sf: str) -> clustering.Clustering:
    """Orders clustered on value, lines and quantity; computed once per session."""
    run = (spark.sparkContext.applicationId, sf)
    if run not in _clustered:
        _clustered[run] = cluster_orders(spark, sf)
    return _clustered[run]


def cluster_orders(spark: SparkSession, sf: str) -> clustering.Clustering:
    per_order = (
        sales_lines(spark, sf)
        .groupBy("invoice_id")
        .agg(
            F.sum("total_price").cast("double").alias("amount"),
            F.count(F.lit(1)).alias("lines"),
            F.sum("quantity").alias("quantity"),
        )
        .withColumn("amount", F.when(F.col("invoice_id") % 50 == 0, NAN).otherwise(F.col("amount")))
    )
    return clustering.cluster_table(per_order, "invoice_id", ["amount", "lines", "quantity"])


@query("kmeans_sweep")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.curve_table(clustered_orders(spark, sf))


@query("cluster_summary")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_summary(clustered_orders(spark, sf))


@query("segments")
def _(spark: SparkSession, sf: str) -> DataFrame:
    placed, _ = clustering.customer_segments(segments_of(spark, sf).drop("segment_label"))
    return placed.select("customer_code", "cluster", "segment_label", "pca_x", "pca_y")


@query(
    "segments_checked",
    f"""WITH {RFM_SCORES} SELECT customer_code, recency_days, frequency, monetary, r_score, f_score, m_score, true AS labelled
    FROM scored""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The segmented customers without what the clusters decide: every one has scores, a cluster, a place and a label."""
    placed, found = clustering.customer_segments(segments_of(spark, sf).drop("segment_label"))
    labelled = F.col("cluster").between(0, found.k - 1) & F.col("segment_label").isNotNull() & ~F.isnan("pca_x") & ~F.isnan("pca_y")
    return placed.select(
        "customer_code",
        "recency_days",
        "frequency",
        F.col("monetary").cast("double").alias("monetary"),
        "r_score",
        "f_score",
        "m_score",
        labelled.alias("labelled"),
    )


@query(
    "silhouette",
    """WITH z AS (
      SELECT (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x,
             (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y, c_acctbal > 4500 AS c FROM customer
    ), s AS (SELECT c, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM z GROUP BY c),
    d AS (
      SELECT (own.n * (x * x + y * y) - 2 * (x * own.sx + y * own.sy) + own.q) / (own.n - 1) AS a,
             (x * x + y * y) - 2 * (x * other.sx + y * other.sy) / other.n + other.q / other.n AS b
      FROM z JOIN s own ON own.c = z.c JOIN s other ON other.c <> z.c)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM d""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """How well a split at a balance of 4500 separates the customers."""
    labelled = table(spark, sf, "customer").select(
        "c_custkey",
        "c_acctbal",
        F.col("c_nationkey").cast("double").alias("nation"),
        (F.col("c_acctbal") > 4500).cast("double").alias("cluster"),
    )
    points = clustering.vectors(labelled, "c_custkey", ["c_acctbal", "nation"]).join(
        labelled.select("c_custkey", "cluster"), "c_custkey"
    )
    return rounded(spark.createDataFrame([(clustering.silhouette(points),)], "silhouette double"), 6, "silhouette")


@query(
    "pca_2d",
    """WITH z AS (
      SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a,
             (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b,
             CASE WHEN corr(p_size, p_retailprice) OVER () >= 0 THEN 1 ELSE -1 END AS s FROM part)
    SELECT p_partkey, round((a + s * b) / sqrt(2), 6) AS pca_x, round((a - s * b) / sqrt(2), 6) AS pca_y FROM z""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    points, _ = clustering.project_2d(clustering.vectors(parts, "p_partkey", ["p_size", "p_retailprice"]))
    return rounded(points.select("p_partkey", "pca_x", "pca_y"), 6, "pca_x", "pca_y")


@query("persona_labels")
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = segments_of(spark, sf).withColumn("cluster", F.col("m_score") % 4)
    return clustering.persona_labels(scored).groupBy("cluster", "segment_label").agg(F.count(F.lit(1)).alias("customers"))


COHORT = """rows_ AS (
  SELECT CAST(l_linenumber % 3 AS INTEGER) AS cluster, l_quantity * (1 + l_linenumber % 3) AS quantity,
         l_extendedprice AS price FROM lineitem
)"""


@query(
    "cohort_labels",
    f"""WITH {COHORT}, o AS (SELECT avg(quantity) AS q, avg(price) AS p, count(*) AS n FROM rows_),
    g AS (SELECT cluster, count(*) AS count, avg(quantity) / any_value(o.q) AS rq, avg(price) / any_value(o.p) AS rp,
                 count(*) * 100.0::DOUBLE / any_value(o.n) AS percentage FROM rows_, o GROUP BY cluster)
    SELECT cluster, count, percentage,
           CASE WHEN greatest(rq, rp) > 1.3 THEN CASE WHEN rq >= rp THEN 'High Quantity Cohort' ELSE 'High Price Cohort' END
                WHEN least(rq, rp) < 0.7 THEN CASE WHEN rq <= rp THEN 'Low Quantity Cohort' ELSE 'Low Price Cohort' END
                ELSE concat('Balanced Tier ', cluster + 1) END AS segment_label FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    group = F.col("l_linenumber") % 3
    rows = table(spark, sf, "lineitem").select(
        group.alias("cluster"), (F.col("l_quantity") * (1 + group)).alias("quantity"), F.col("l_extendedprice").alias("price")
    )
    features = ["quantity", "price"]
    return clustering.cohort_labels(clustering.cluster_means(rows, features), features)


@query("scatter_points")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.scatter_sample(clustered_orders(spark, sf), "invoice_id")


# --- supervised ------------------------------------------------------------


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"
    )


def quality_models(spark: SparkSession, sf: str) -> supervised.Comparison:
    documents = labelled_documents(spark, sf)
    return supervised.compare_models(documents, "doc_id", "quality", ["n_chars", "lang", "source"])


@query("clf_leaderboard")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return quality_models(spark, sf).leaderboard


@query("model_metrics_long")
def _(spark: SparkSession, sf: str) -> DataFrame:
    documents = labelled_documents(spark, sf)
    found = supervised.compare_models(documents, "doc_id", "toxic", ["n_chars", "lang"])
    return supervised.metrics_long(found.leaderboard)


@query("reg_leaderboard")
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    features = ["p_brand", "p_type", "p_size"]
    return supervised.compare_models(parts, "p_partkey", "p_retailprice", features).leaderboard


def price_drivers(spark: SparkSession, sf: str) -> supervised.Importance:
    known = profile_of(spark, sf, "part").select("column_name", "unique_count").collect()
    distinct = {r["column_name"]: r["unique_count"] for r in known}
    features = ["p_name", "p_brand", "p_type", "p_size"]
    return supervised.feature_importance(table(spark, sf, "part"), "p_partkey", "p_retailprice", features, distinct)


@query("feature_importance")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return price_drivers(spark, sf).features


@query("driver_report")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return supervised.driver_report(price_drivers(spark, sf).features)


@query(
    "confusion_metrics",
    """WITH p AS (SELECT quality AS label, toxic AS prediction FROM labels),
    c AS (SELECT DISTINCT label AS cls FROM p UNION SELECT DISTINCT prediction FROM p),
    m AS (SELECT cls, count(*) FILTER (label = cls) AS s, count(*) FILTER (prediction = cls) AS k,
                 count(*) FILTER (label = cls AND prediction = cls) AS h FROM c, p GROUP BY cls),
    r AS (SELECT *, CASE WHEN k > 0 THEN h::DOUBLE / k ELSE 0 END AS pr, CASE WHEN s > 0 THEN h::DOUBLE / s ELSE 0 END AS re FROM m),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)
    SELECT sum(h)::DOUBLE / sum(s)::DOUBLE AS accuracy, round(sum(s * pr) / sum(s), 9) AS precision,
           round(sum(s * re) / sum(s), 9) AS recall, round(sum(s * f1) / sum(s), 9) AS f1_score FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    predicted = table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return rounded(supervised.classification_metrics(predicted), 9, "precision", "recall", "f1_score")


@query(
    "regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS f FROM lineitem)
    SELECT round(avg(abs(y - f)), 4) AS mae, round(sqrt(sum((y - f) * (y - f)) / count(*)), 4) AS rmse,
           round(1 - sum((y - f) * (y - f)) / (var_pop(y) * count(*)), 6) AS r2_score FROM p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    predicted = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    return rounded(rounded(supervised.regression_metrics(predicted), 4, "mae", "rmse"), 6, "r2_score")


# --- insights --------------------------------------------------------------

VIP_SQL = """vip AS (
  SELECT CAST(coalesce(sum(CAST(monetary AS DECIMAL(18,2))) FILTER (segment_label = 'VIP Customers'), 0) AS DOUBLE) AS vip_revenue,
         CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
         count(*) FILTER (segment_label = 'VIP Customers') AS vip_customers, count(*) AS customers
  FROM rfm JOIN segments USING (customer_id)
)"""


@query(
    "vip_concentration",
    f"""WITH {RFM_ASOF}, {VIP_SQL} SELECT *, vip_revenue / total_revenue * 100 AS vip_revenue_pct,
        vip_customers::DOUBLE / customers::DOUBLE * 100 AS vip_customer_pct FROM vip""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, segments = relations(spark, sf)
    return insights.vip_concentration(scores, segments)


@query(
    "at_risk_share",
    f"""WITH {RFM_ASOF} SELECT count(*) FILTER (segment_label = 'At-Risk Customers') AS at_risk, count(*) AS customers,
        count(*) FILTER (segment_label = 'At-Risk Customers')::DOUBLE / count(*)::DOUBLE * 100 AS at_risk_pct FROM segments""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return insights.at_risk_share(relations(spark, sf)[3])


@query(
    "repeat_rate",
    f"""WITH {RFM_ASOF} SELECT count(*) FILTER (frequency > 1) AS repeaters, count(*) AS customers,
        count(*) FILTER (frequency > 1)::DOUBLE / count(*)::DOUBLE * 100 AS repeat_pct FROM rfm""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return insights.repeat_rate(relations(spark, sf)[2])


@query(
    "country_concentration",
    f"""WITH {LINES}, c AS (SELECT country, CAST(sum(total_price) AS DOUBLE) AS revenue,
             row_number() OVER (ORDER BY sum(total_price) DESC, country) AS place FROM lines GROUP BY country)
    SELECT max(country) FILTER (place = 1) AS first, max(country) FILTER (place = 2) AS second,
           max(country) FILTER (place = 3) AS third,
           max(revenue) FILTER (place = 1) / (SELECT CAST(sum(total_price) AS DOUBLE) FROM lines) * 100 AS top_pct FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return insights.country_concentration(sales_lines(spark, sf, country=True))


@query(
    "aov_skew",
    f"""WITH {LINES}, s AS (SELECT CAST(sum(total_price) AS DOUBLE) / count(*) AS aov,
             quantile_cont(CAST(total_price AS DOUBLE), 0.5) AS median_order FROM lines)
    SELECT *, aov > median_order * 1.5 AS skewed FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return insights.aov_skew(sales_lines(spark, sf))


@query(
    "business_insights",
    f"""WITH {RFM_ASOF}, {VIP_SQL}, shares AS (
      SELECT vip_revenue / total_revenue * 100 AS vip_pct,
             (SELECT count(*) FILTER (segment_label = 'At-Risk Customers') * 100.0::DOUBLE / count(*) FROM segments) AS risk_pct,
             (SELECT count(*) FILTER (frequency > 1) * 100.0::DOUBLE / count(*) FROM rfm) AS repeat_pct,
             (SELECT max(r) / sum(r) * 100 FROM (SELECT CAST(sum(total_price) AS DOUBLE) AS r FROM lines GROUP BY country)) AS top_pct,
             (SELECT avg(total_price) > 1.5 * quantile_cont(CAST(total_price AS DOUBLE), 0.5) FROM lines) AS skewed
      FROM vip)
    SELECT 'vip-concentration' AS id, 'high' AS priority, 'opportunity' AS category FROM shares WHERE vip_pct > 40
    UNION ALL SELECT 'at-risk-warning', 'high', 'warning' FROM shares WHERE risk_pct > 15
    UNION ALL SELECT 'repeat-rate', 'medium', CASE WHEN repeat_pct > 50 THEN 'growth' ELSE 'recommendation' END FROM shares
    UNION ALL SELECT 'country-concentration', 'medium', 'recommendation' FROM shares WHERE top_pct > 30
    UNION ALL SELECT 'aov-skew', 'low', 'opportunity' FROM shares WHERE skewed""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, _, scores, segments = relations(spark, sf)
    found = insights.business_insights(scores, segments, sales_lines(spark, sf, country=True))
    return found.select("id", "priority", "category")


@query(
    "pareto_share",
    f"""WITH {LINES}, c AS (SELECT customer_id, sum(total_price) AS amount FROM lines GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, customer_id) AS place, count(*) OVER () AS n FROM c),
    t AS (SELECT max(n) AS entities, max(greatest(CAST(floor(n * 0.2::DOUBLE) AS BIGINT), 1)) AS top_count,
                 CAST(sum(amount) FILTER (place <= greatest(floor(n * 0.2::DOUBLE), 1)) AS DOUBLE) AS top_sum,
                 CAST(sum(amount) AS DOUBLE) AS total_sum FROM r)
    SELECT *, top_sum / total_sum * 100 AS pareto_pct FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return insights.pareto_share(sales_lines(spark, sf), "customer_id", "total_price")


@query(
    "outlier_columns",
    f"""WITH {PROFILE}, {numeric_sql()} SELECT p.dataset_id, p.column_name, n.outlier_count,
           n.outlier_count * 100.0::DOUBLE / p.row_count AS outlier_pct, n.max, n.median
    FROM profile p JOIN numbers n USING (dataset_id, column_name) WHERE n.outlier_count > p.row_count * 0.03::DOUBLE""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return insights.outlier_columns(stored_profile(spark, sf)).drop("position")


@query(
    "category_skew",
    """WITH v AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN 'usual' ELSE o_orderpriority END AS label FROM orders),
    c AS (SELECT label, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM v) AS pct,
                 row_number() OVER (ORDER BY count(*) DESC, label) AS place FROM v GROUP BY 1)
    SELECT max(label) FILTER (place = 1) AS top_value, max(pct) FILTER (place = 1) AS top_pct,
           max(label) FILTER (place = 2) AS next_value, max(pct) FILTER (place = 2) AS next_pct FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 3 > 0, "usual").otherwise(F.col("o_orderpriority")).alias("label")
    )
    return insights.category_skew(orders, "label")


@query(
    "table_insights",
    """WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS v
                 FROM orders GROUP BY 1),
    last AS (SELECT v, lag(v) OVER (ORDER BY month) AS p FROM m QUALIFY row_number() OVER (ORDER BY month DESC) = 1),
    change AS (SELECT (v - p) / p * 100 AS pct FROM last WHERE p > 0)
    SELECT 'insight_monthly_trend' AS id, 'trend' AS type, CASE WHEN pct < -15 THEN 'high' ELSE 'medium' END AS priority,
           printf('%+.1f%%', pct) AS metric_value FROM change""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = insights.table_insights(order_log(spark, sf), stored_profile(spark, sf), "orders")
    return found.select("id", "type", "priority", "metric_value")

