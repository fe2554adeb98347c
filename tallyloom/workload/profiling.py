"""Profiles, quality, catalog rules over all driver tables, and profile-based roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import catalog, profile, supervised
from tallyloom.workload.inputs import money, registry, table

Q, SQL, query = registry()


# Column kinds of the driver's tables, for writing the SQL.
COLUMNS = {
    "region": "r_regionkey:integer r_name:string",
    "nation": "n_nationkey:integer n_name:string n_regionkey:integer",
    "customer": "c_custkey:integer c_name:string c_nationkey:integer c_acctbal:float c_mktsegment:string",
    "supplier": "s_suppkey:integer s_name:string s_nationkey:integer s_acctbal:float",
    "part": "p_partkey:integer p_name:string p_brand:string p_type:string p_size:integer p_retailprice:float",
    "orders": "o_orderkey:integer o_custkey:integer o_orderstatus:string o_totalprice:float o_orderdate:datetime "
    "o_orderpriority:string",
    "lineitem": "l_orderkey:integer l_partkey:integer l_suppkey:integer l_linenumber:integer l_quantity:float "
    "l_extendedprice:float l_discount:float l_tax:float l_returnflag:string l_linestatus:string l_shipdate:datetime",
    "events": "event_id:integer ts:datetime user_id:integer event_type:string value:float props:string",
    "documents": "doc_id:integer text:string lang:string source:string n_chars:integer",
    "embeddings": "vec_id:integer embedding:nested label:integer",
    "pages": "page_id:integer url:string html:string",
    "benchmark": "item_id:integer text:string",
    "labels": "doc_id:integer quality:integer toxic:integer",
    "conversations": "conv_id:integer turn:integer role:string text:string",
    "orders_dirty": "o_orderkey:integer o_custkey:integer o_orderstatus:string o_totalprice:float "
    "o_orderdate:datetime o_orderpriority:string constant:string",
}
SCHEMA = {t: [tuple(c.split(":")) for c in cols.split()] for t, cols in COLUMNS.items()}

# orders with nulls, repeated rows and a constant column, all by modulus rules.
DIRTY = """(
  SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_custkey % 7 <> 0 THEN o_orderdate END AS o_orderdate,
         CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS o_orderpriority, 'x' AS constant
  FROM orders, (SELECT unnest([1, 2]) AS copy) WHERE copy = 1 OR o_orderkey % 50 = 0)"""


def source(name: str) -> str:
    return DIRTY if name == "orders_dirty" else name


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All driver tables, with float columns as exact decimals, plus the dirty orders."""
    found = {}
    for name, columns in SCHEMA.items():
        if name == "orders_dirty":
            continue
        df = table(spark, sf, name)
        found[name] = df.withColumns({c: money(c) for c, kind in columns if kind == "float"})
    orders = found["orders"]
    copies = F.when(F.col("o_orderkey") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    found["orders_dirty"] = (
        orders.withColumns(
            {
                "o_totalprice": F.when(F.col("o_orderkey") % 23 != 0, F.col("o_totalprice")),
                "o_orderdate": F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderdate")),
                "o_orderpriority": F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderpriority")),
                "constant": F.lit("x"),
            }
        )
        .withColumn("copy", F.explode(copies))
        .drop("copy")
    )
    return found


_stored: dict[tuple[str, str], DataFrame] = {}


def stored_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog's profile, computed once per session and read again by each rule."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        _stored[key] = profile.profile_tables(tables(spark, sf))
    return _stored[key]


def profile_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The profile of one table; the others are read only by those who need them."""
    found = _stored.get((spark.sparkContext.applicationId, sf))
    if found is None:
        found = profile.profile_tables({name: tables(spark, sf)[name]})
    return found.where(F.col("dataset_id") == name)


# --- SQL of the profile ----------------------------------------------------


def facts_sql() -> str:
    parts = []
    for name, columns in SCHEMA.items():
        for position, (column, kind) in enumerate(columns):
            if kind == "string":
                data_type = (
                    f"CASE WHEN count(TRY_CAST({column} AS TIMESTAMP))::DOUBLE / count({column}) > 0.85 THEN 'datetime' "
                    f"WHEN sum(length({column}))::DOUBLE / count({column}) > 35 THEN 'text' ELSE 'categorical' END"
                )
                length = f"sum(length({column}))::DOUBLE / count({column})"
            else:
                data_type = "'text'" if kind == "nested" else f"'{kind}'"
                length = "1000.0::DOUBLE" if kind == "nested" else "NULL::DOUBLE"
            parts.append(
                f"SELECT '{name}' AS dataset_id, {position} AS position, '{column}' AS column_name, "
                f"{data_type} AS data_type, count(*) AS row_count, count(*) - count({column}) AS missing_count, "
                f"count(DISTINCT {column}) AS unique_count, {length} AS avg_length FROM {source(name)}"
            )
    return "facts AS (" + " UNION ALL ".join(parts) + ")"


def any_sql(value: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, '{w}')" for w in words) + ")"


ID_LIST = ", ".join(f"'{t}'" for t in profile.ID_TOKENS)
NUMERIC = "data_type IN ('integer', 'float')"
PROFILE = f"""{facts_sql()}, named AS (
  SELECT *, lower(column_name) AS low, replace(replace(lower(column_name), ' ', '_'), '-', '_') AS nm FROM facts
), profile AS (
  SELECT *, CASE
    WHEN (len(list_intersect(string_split(nm, '_'), [{ID_LIST}])) > 0 OR suffix(nm, 'id') OR suffix(nm, 'no'))
         AND (unique_count > row_count * 0.7 OR unique_count > 50) THEN 'id'
    WHEN {NUMERIC} AND {any_sql('nm', profile.MONEY_TOKENS)} THEN 'monetary'
    WHEN {NUMERIC} AND {any_sql('nm', profile.QUANTITY_TOKENS)} THEN 'quantity'
    WHEN data_type = 'datetime' OR {any_sql('nm', profile.DATE_TOKENS)} THEN 'datetime'
    WHEN data_type = 'boolean' OR unique_count = 2 THEN 'boolean'
    WHEN data_type = 'categorical' OR (unique_count < 50 AND unique_count < row_count * 0.2) THEN 'categorical'
    WHEN data_type = 'text' OR avg_length > 30 THEN 'text'
    WHEN {any_sql('nm', profile.TARGET_TOKENS)} THEN 'target_candidate'
    ELSE data_type END AS semantic_type
  FROM named
)"""


def numeric_sql() -> str:
    parts = []
    for name, columns in SCHEMA.items():
        for column, kind in columns:
            if kind in ("integer", "float"):
                exact = f"CAST({column} AS DECIMAL(18,2))" if kind == "float" else column
                parts.append(
                    f"""SELECT '{name}' AS dataset_id, '{column}' AS column_name, count(*) AS row_count,
                    count(*) - count(v) AS missing_count, count(DISTINCT v) AS unique_count,
                    min(v) AS min, max(v) AS max, CAST(sum(exact) AS DOUBLE) / count(v) AS mean,
                    round(stddev_samp(v), 4) AS std, max(q25) AS q25, max(median) AS median, max(q75) AS q75,
                    max(q75) - max(q25) AS iqr,
                    count(*) FILTER (v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25)) AS outlier_count
                    FROM (SELECT CAST({column} AS DOUBLE) AS v, {exact} AS exact FROM {source(name)}),
                         (SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q25,
                                 quantile_cont(CAST({column} AS DOUBLE), 0.5) AS median,
                                 quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q75 FROM {source(name)})"""
                )
    return "numbers AS (" + " UNION ALL ".join(parts) + ")"


@query("profile_numeric", f"WITH {numeric_sql()} SELECT * FROM numbers")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return (
        stored_profile(spark, sf)
        .where(F.col("data_type").isin(profile.NUMERIC_TYPES))
        .select(
            "dataset_id", "column_name", "row_count", "missing_count", "unique_count", "min", "max", "mean",
            F.round("std", 4).alias("std"), "q25", "median", "q75", "iqr", "outlier_count",
        )
    )


def strings_sql(select: str, kinds: str) -> str:
    parts = []
    for name, columns in SCHEMA.items():
        for column, kind in columns:
            if kind == "string":
                parts.append(
                    f"SELECT '{name}' AS dataset_id, '{column}' AS column_name, {column} AS v FROM {source(name)}"
                )
    return f"""cells AS ({' UNION ALL '.join(parts)}), lengths AS (
      SELECT dataset_id, column_name, sum(length(v))::DOUBLE / count(v) AS avg_length, min(length(v)) AS min_length,
             max(length(v)) AS max_length, count(DISTINCT v) AS unique_count FROM cells GROUP BY 1, 2
    ), kept AS (SELECT * FROM lengths WHERE avg_length {kinds}) {select}"""


@query(
    "profile_categorical",
    "WITH "
    + strings_sql(
        """, tops AS (
      SELECT dataset_id, column_name, v AS value, count(*) AS rows,
             row_number() OVER (PARTITION BY dataset_id, column_name ORDER BY count(*) DESC, v) AS place
      FROM cells SEMI JOIN kept USING (dataset_id, column_name) WHERE v IS NOT NULL GROUP BY 1, 2, 3)
    SELECT tops.*, unique_count FROM tops JOIN kept USING (dataset_id, column_name) WHERE place <= 5""",
        "<= 35",
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_profile(spark, sf).where(F.col("data_type") == "categorical")
    return found.select(
        "dataset_id", "column_name", "unique_count", F.posexplode("top_values").alias("place", "top")
    ).select(
        "dataset_id",
        "column_name",
        "unique_count",
        (F.col("place") + 1).alias("place"),
        F.col("top.value").alias("value"),
        F.col("top.rows").alias("rows"),
    )


@query("profile_text", "WITH " + strings_sql("SELECT * FROM kept", "> 35"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_profile(spark, sf).where((F.col("data_type") == "text") & (F.col("column_name") != "embedding"))
    return found.select("dataset_id", "column_name", "avg_length", "min_length", "max_length", "unique_count")


def datetimes_sql() -> str:
    parts = [
        f"""SELECT '{name}' AS dataset_id, '{column}' AS column_name, strftime(min({column}), '%Y-%m-%d %H:%M:%S') AS min_date,
            strftime(max({column}), '%Y-%m-%d %H:%M:%S') AS max_date,
            date_diff('day', CAST(min({column}) AS DATE), CAST(max({column}) AS DATE)) AS range_days,
            count(*) - count({column}) AS missing_count FROM {source(name)}"""
        for name, columns in SCHEMA.items()
        for column, kind in columns
        if kind == "datetime"
    ]
    return " UNION ALL ".join(parts)


@query("profile_datetime", datetimes_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_profile(spark, sf).where(F.col("data_type") == "datetime")
    layout = "yyyy-MM-dd HH:mm:ss"
    return found.select(
        "dataset_id",
        "column_name",
        F.date_format("first", layout).alias("min_date"),
        F.date_format("last", layout).alias("max_date"),
        "range_days",
        "missing_count",
    )


@query("column_types", f"WITH {PROFILE} SELECT dataset_id, position, column_name, data_type FROM profile")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.catalog_facts(tables(spark, sf)).select("dataset_id", "position", "column_name", "data_type")


@query(
    "semantic_types",
    f"WITH {PROFILE} SELECT dataset_id, column_name, data_type, semantic_type, unique_count, row_count FROM profile",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return stored_profile(spark, sf).select(
        "dataset_id", "column_name", "data_type", "semantic_type", "unique_count", "row_count"
    )


@query("type_counts", f"WITH {PROFILE} SELECT dataset_id, data_type, count(*) AS columns FROM profile GROUP BY 1, 2")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.type_counts(stored_profile(spark, sf))


@query(
    "sample_values",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{c}' AS column_name, row_number() OVER (ORDER BY c_custkey) AS place,
            CAST({c} AS VARCHAR) AS value FROM customer WHERE {c} IS NOT NULL) WHERE place <= 5"""
        for c in ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sample_values(table(spark, sf, "customer"), "c_custkey")


DUPLICATES = "duplicates AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS dataset_id, (SELECT count(*) FROM {source(name)}) - "
    f"(SELECT count(*) FROM (SELECT DISTINCT * FROM {source(name)})) AS duplicate_rows"
    for name in SCHEMA
) + ")"


@query("duplicate_rows", f"WITH {DUPLICATES} SELECT * FROM duplicates")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.catalog_duplicates(tables(spark, sf))


@query(
    "quality_score",
    f"""WITH {PROFILE}, {DUPLICATES}, {numeric_sql()}, sums AS (
      SELECT p.dataset_id, max(p.row_count) AS row_count, count(*) AS column_count,
             sum(p.missing_count)::BIGINT AS missing_cells, sum(coalesce(outlier_count, 0))::BIGINT AS outliers,
             count(*) FILTER (p.unique_count <= 1) AS constants
      FROM profile p LEFT JOIN numbers n USING (dataset_id, column_name) GROUP BY p.dataset_id
    ), shares AS (
      SELECT *, missing_cells::DOUBLE / (row_count * column_count)::DOUBLE * 100 AS missing_pct,
             duplicate_rows::DOUBLE / row_count::DOUBLE * 100 AS duplicate_pct
      FROM sums JOIN duplicates USING (dataset_id))
    SELECT dataset_id, row_count, column_count, missing_cells, missing_pct, duplicate_rows, outliers,
           greatest(100.0::DOUBLE - (least(missing_pct * 1.5::DOUBLE, 30.0::DOUBLE)
             + least(duplicate_pct * 2.0::DOUBLE, 20.0::DOUBLE) + constants * 5.0::DOUBLE
             + least(outliers::DOUBLE / row_count::DOUBLE * 10.0::DOUBLE, 15.0::DOUBLE)), 10.0::DOUBLE) AS quality_score,
           (missing_pct > 0)::INTEGER + (duplicate_pct > 0)::INTEGER + (constants > 0)::INTEGER
             + (outliers > 0)::INTEGER AS issue_count
    FROM shares""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scores = profile.quality_scores(stored_profile(spark, sf), profile.catalog_duplicates(tables(spark, sf)))
    return scores.withColumn("issue_count", F.size("issues")).drop("issues", "recommendations", "constant_columns")


@query(
    "quality_report",
    f"""WITH {PROFILE}, {numeric_sql()}, joined AS (
      SELECT p.dataset_id, p.column_name, p.missing_count,
             p.missing_count::DOUBLE / p.row_count::DOUBLE * 100 AS missing_pct, coalesce(outlier_count, 0) AS outlier_count
      FROM profile p LEFT JOIN numbers n USING (dataset_id, column_name))
    SELECT * FROM joined WHERE missing_pct > 0 OR outlier_count > 0""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.quality_report(stored_profile(spark, sf))


@query(
    "table_size",
    """SELECT 'documents' AS dataset_id, sum(16 + strlen(text) + strlen(lang) + strlen(source))::BIGINT AS bytes,
              count(*) AS row_count FROM documents
       UNION ALL SELECT 'orders', sum(32 + strlen(o_orderstatus) + strlen(o_orderpriority))::BIGINT, count(*) FROM orders""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        profile.table_size(table(spark, sf, name)).withColumn("dataset_id", F.lit(name))
        for name in ("documents", "orders")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "profile_light",
    """SELECT 'orders_dirty' AS dataset_id, * FROM (VALUES """
    + ", ".join(f"({i}, '{c}')" for i, (c, _) in enumerate(SCHEMA["orders_dirty"]))
    + ") c(position, column_name) JOIN ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{'float' if k in ('integer', 'float') else 'text'}' AS data_type,
            '{'monetary' if 'price' in c else 'generic'}' AS semantic_type, count(*) AS row_count,
            count(*) - count({c}) AS missing_count, (count(*) - count({c}))::DOUBLE / count(*)::DOUBLE * 100 AS missing_pct,
            {f'min({c})::DOUBLE' if k in ('integer', 'float') else 'NULL::DOUBLE'} AS min,
            {f'max({c})::DOUBLE' if k in ('integer', 'float') else 'NULL::DOUBLE'} AS max,
            {f'sum(CAST({c} AS DECIMAL(18,2)))::DOUBLE / count({c})' if k in ('integer', 'float') else 'NULL::DOUBLE'} AS mean
            FROM {DIRTY}"""
        for c, k in SCHEMA["orders_dirty"]
    )
    + ") USING (column_name)",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return profile.profile_light(tables(spark, sf)["orders_dirty"], "orders_dirty")


@query(
    "light_quality",
    f"""WITH s AS (
      SELECT count(*) AS row_count, 7 AS column_count,
             (3 * count(*) - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority))::BIGINT AS missing_cells
      FROM {DIRTY}
    ), t AS (SELECT *, missing_cells::DOUBLE / (row_count * column_count)::DOUBLE * 100 AS missing_pct FROM s)
    SELECT 'orders_dirty' AS dataset_id, *, 3 AS numeric_columns, 4 AS text_columns,
           greatest(100.0::DOUBLE - least(missing_pct * 1.5::DOUBLE, 40.0::DOUBLE), 10.0::DOUBLE) AS quality_score FROM t""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    light = profile.profile_light(tables(spark, sf)["orders_dirty"], "orders_dirty")
    return profile.light_quality(light).drop("issues")


# --- catalog rules ---------------------------------------------------------


def classify_sql() -> str:
    firsts, scores, options = [], [], []
    for place, (domain, (tokens, weight, least)) in enumerate(catalog.DOMAINS.items()):
        cases = " ".join(f"WHEN contains(nm, '{t}') THEN '{t}'" for t in tokens)
        firsts.append(f"list_sort(list(DISTINCT CASE {cases} END)) AS {domain}")
        n = f"len(list_filter({domain}, lambda x: x IS NOT NULL))"
        scores.append(
            f"CASE WHEN {n} >= {least} THEN least({n}::DOUBLE / columns::DOUBLE * {weight}::DOUBLE * 100 + {n} * 12, "
            f"98.0::DOUBLE) END AS s_{domain}"
        )
        options.append((domain, place))
    found = []
    for domain, place in options:
        score, order = f"s_{domain}", str(place)
        if domain == "ecommerce":
            score = f"CASE WHEN invoice AND buyer THEN greatest(coalesce({score}, 0), 92.0::DOUBLE) ELSE {score} END"
            order = "CASE WHEN s_ecommerce IS NULL THEN 9 ELSE 0 END"
        if domain == "survey":
            score = f"CASE WHEN asked THEN greatest(coalesce({score}, 0), 88.0::DOUBLE) ELSE {score} END"
            order = "CASE WHEN s_survey IS NULL THEN 10 ELSE 7 END"
        found.append(f"SELECT dataset_id, '{domain}' AS dataset_type, {score} AS confidence, {order} AS place FROM scored")
    found.append(
        "SELECT dataset_id, 'time-series', CASE WHEN dated AND numbers >= 1 AND columns <= 6 THEN 85.0::DOUBLE END, 8 FROM scored"
    )
    labels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.DOMAIN_LABELS.items())
    return f"""WITH {PROFILE}, seen AS (
      SELECT dataset_id, count(*) AS columns, count(*) FILTER ({NUMERIC}) AS numbers,
             bool_or(semantic_type = 'datetime') AS dated, bool_or(contains(nm, 'invoice')) AS invoice,
             bool_or(contains(nm, 'customer')) AS buyer,
             count(*) FILTER ({any_sql('nm', catalog.RATING_TOKENS)}) >= 3
               AND count(*) FILTER ({any_sql('nm', catalog.RATING_TOKENS)}) >= count(*) * 0.4 AS asked,
             {', '.join(firsts)}
      FROM profile GROUP BY dataset_id
    ), scored AS (SELECT *, {', '.join(scores)} FROM seen
    ), options AS ({' UNION ALL '.join(found)}
    ), best AS (
      SELECT * FROM options WHERE confidence IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY confidence DESC, place) = 1
    ), chosen AS (
      SELECT dataset_id, coalesce(dataset_type, 'generic-tabular') AS dataset_type, coalesce(confidence, 60.0::DOUBLE) AS confidence
      FROM seen LEFT JOIN best USING (dataset_id))
    SELECT *, CASE dataset_type {labels} END AS dataset_type_label FROM chosen"""


@query("classify_datasets", classify_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.classify_datasets(stored_profile(spark, sf)).drop("matched_features", "reason")


CATEGORY = "data_type IN ('categorical', 'boolean')"


def first_sql(test: str, pick: str = "arg_min") -> str:
    return f"{pick}(column_name, position) FILTER ({test})"


def names_sql(test: str) -> str:
    return f"coalesce(string_agg(column_name, ',' ORDER BY position) FILTER ({test}), '')"


DATED = "(data_type = 'datetime' OR semantic_type = 'datetime')"
ROLES = f"""{PROFILE}, roles AS (
  SELECT dataset_id, max(row_count) AS row_count, count(*) AS column_count,
         count(*) FILTER ({NUMERIC}) AS numbers, count(*) FILTER ({CATEGORY}) AS categories,
         count(*) FILTER (data_type = 'text' OR semantic_type = 'text') AS texts,
         {first_sql(DATED)} AS date_column, {first_sql("data_type = 'text' OR semantic_type = 'text'")} AS text_column,
         {first_sql(any_sql('low', catalog.BUYER_WORDS))} AS customer_column,
         {first_sql(NUMERIC + ' AND ' + any_sql('low', catalog.SPEND_WORDS))} AS monetary_column,
         {first_sql(NUMERIC + ' AND ' + any_sql('low', catalog.SALES_WORDS))} AS sales_column,
         coalesce({first_sql(any_sql('low', catalog.BUYER_WORDS))},
                  {first_sql("semantic_type = 'id' OR " + any_sql('low', ['id', 'code']))}) AS entity_column,
         coalesce({first_sql("semantic_type = 'target_candidate' OR " + any_sql('low', catalog.TARGET_WORDS))},
                  {first_sql(CATEGORY, 'arg_max')}) AS target_column,
         coalesce({first_sql(NUMERIC + ' AND ' + any_sql('low', catalog.SALES_WORDS))}, {first_sql(NUMERIC)}) AS measure_column
  FROM profile GROUP BY dataset_id
), tests AS (
  SELECT *, customer_column IS NOT NULL AND date_column IS NOT NULL AND monetary_column IS NOT NULL AS buyers,
         numbers >= 2 AND row_count >= 10 AS grouped, date_column IS NOT NULL AND numbers >= 1 AS timed,
         numbers + categories >= 2 AND row_count >= 20 AS learn, column_count >= 1 AND row_count >= 1 AS filled
  FROM roles
)"""


@query(
    "dataset_roles",
    f"""WITH {ROLES} SELECT r.dataset_id, date_column, text_column, entity_column, target_column, measure_column,
        CASE WHEN p.data_type IN ('integer', 'float') THEN 'regression' ELSE 'classification' END AS recommended_task
        FROM roles r LEFT JOIN profile p ON p.dataset_id = r.dataset_id AND p.column_name = r.target_column""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.dataset_roles(stored_profile(spark, sf)).select(
        "dataset_id", "date_column", "text_column", "entity_column", "target_column", "measure_column", "recommended_task"
    )


PLAN_TESTS = [
    ("feature", "analytics", "true"), ("feature", "eda", "filled"), ("feature", "statistics", "numbers >= 2"),
    ("feature", "visualization", "filled"), ("feature", "correlation", "numbers >= 2"),
    ("feature", "outliers", "numbers >= 1"), ("feature", "ml", "learn"), ("feature", "segmentation", "grouped"),
    ("feature", "time_series", "timed"), ("feature", "rfm", "buyers"), ("feature", "nlp", "texts >= 1"),
    ("feature", "insights", "true"), ("feature", "recommendations", "true"), ("feature", "reports", "true"),
    ("module", "rfm", "buyers"), ("module", "sales", "sales_column IS NOT NULL"),
    ("module", "customers", "entity_column IS NOT NULL"), ("module", "segmentation", "grouped"),
    ("module", "ml", "learn"), ("module", "time_series", "timed"), ("module", "nlp", "texts >= 1"),
    ("module", "statistics", "numbers >= 2"), ("analysis", "eda", "true"), ("analysis", "statistics", "numbers >= 2"),
    ("analysis", "trends", "timed"), ("analysis", "segmentation", "grouped"),
    ("analysis", "ml", "learn AND target_column IS NOT NULL"), ("analysis", "rfm", "buyers"),
    ("analysis", "nlp", "texts >= 1"),
]


@query(
    "capability_plan",
    f"WITH {ROLES} "
    + " UNION ALL ".join(
        f"SELECT dataset_id, '{s}' AS section, '{k}' AS key, {test} AS available FROM tests" for s, k, test in PLAN_TESTS
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    plan = catalog.capability_plan(catalog.dataset_roles(stored_profile(spark, sf)))
    return plan.drop("title", "reason")


@query(
    "capability_list",
    f"WITH {ROLES} "
    + " UNION ALL ".join(
        f"SELECT dataset_id, '{k}' AS key, {test} AS available, 0.95::DOUBLE AS confidence FROM tests"
        for s, k, test in PLAN_TESTS
        if s == "feature"
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    plan = catalog.capability_plan(catalog.dataset_roles(stored_profile(spark, sf)))
    return catalog.capability_list(plan).drop("name", "reason")


@query(
    "column_roles",
    f"""WITH {PROFILE} SELECT dataset_id, {names_sql(NUMERIC)} AS numeric_columns,
        {names_sql("data_type = 'categorical'")} AS categorical_columns,
        {names_sql("data_type = 'datetime'")} AS datetime_columns, {names_sql("data_type = 'text'")} AS text_columns,
        {names_sql("data_type = 'boolean'")} AS boolean_columns,
        {names_sql("semantic_type = 'id' OR " + any_sql('low', catalog.ROLE_ID_WORDS))} AS possible_ids,
        {names_sql(any_sql('low', catalog.ROLE_TARGET_WORDS))} AS possible_targets
        FROM profile GROUP BY dataset_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    roles = catalog.column_roles(stored_profile(spark, sf))
    return roles.withColumns({c: F.array_join(c, ",") for c in roles.columns if c != "dataset_id"})


KEYED = "(" + " OR ".join(f"suffix(low, '{s}')" for s in ["id", "uuid", "key", "code"]) + ")"


@query(
    "candidate_targets",
    f"""WITH {PROFILE} SELECT dataset_id, column_name,
          CASE WHEN {NUMERIC} OR data_type = 'boolean' THEN 'numeric' ELSE 'categorical' END AS data_type, unique_count,
          {any_sql('low', supervised.TARGET_KEYWORDS)} OR ({NUMERIC} AND unique_count >= 3) AS is_candidate
        FROM profile WHERE NOT ({KEYED} AND unique_count > row_count * 0.8) AND unique_count > 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return supervised.candidate_targets(stored_profile(spark, sf)).drop("display_name")


INDEXED = "(" + " OR ".join(f"suffix(low, '{s}')" for s in ["id", "uuid", "key", "code", "index"]) + ")"


@query(
    "predictor_columns",
    f"""WITH {PROFILE} SELECT dataset_id, column_name, data_type FROM profile
        WHERE column_name <> 'l_extendedprice' AND NOT ({INDEXED} AND unique_count > row_count * 0.8) AND unique_count > 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    predictors = supervised.predictor_columns(stored_profile(spark, sf), "l_extendedprice")
    return predictors.select("dataset_id", "column_name", "data_type")
