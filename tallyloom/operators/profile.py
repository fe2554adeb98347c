"""Column profiles, quality scores and duplicate counts of arbitrary tables.

A full profile reads each table twice, however wide it is: once for the additive
facts (nulls, min, max, mean, text lengths), once for the distinct-value table.
Distinct counts, most frequent values, exact quartiles and outliers are then all
taken from that value table. Several tables are profiled together in one job.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.columns import is_complex, is_integral, is_numeric, is_temporal
from tallyloom.functions.exprs import contains_any, percent_text, quoted, ratio, timestamp_sql
from tallyloom.functions.ranking import exact_quantiles
from tallyloom.session import materialise

TEXT_LENGTH = 35
DATE_SHARE = 0.85
NUMERIC_TYPES = ["integer", "float"]
#: Slots by which rows that may repeat are told from the others.
DUPLICATE_SLOTS = 1 << 20

# Name tokens of the semantic types.
ID_TOKENS = ["id", "code", "uuid", "key", "no", "number", "num", "hash", "sku"]
MONEY_TOKENS = [
    "price", "revenue", "amount", "total", "cost", "salary", "spend", "sales", "fare", "fee", "rate",
    "income", "value",
]
QUANTITY_TOKENS = ["quantity", "qty", "count", "units", "items", "volume", "inventory", "stock", "orders"]
DATE_TOKENS = [
    "date", "time", "timestamp", "year", "month", "day", "created_at", "updated_at", "invoicedate",
]
TARGET_TOKENS = [
    "target", "label", "churn", "attrition", "status", "converted", "class", "default", "outcome",
]


def kind_of(field: T.StructField) -> str:
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if is_integral(kind):
        return "integer"
    if is_numeric(kind):
        return "float"
    if is_temporal(kind):
        return "datetime"
    return "string"


def cell_sql(field: T.StructField) -> str:
    """SQL for the column's value, with NaN as null and nested values as JSON text."""
    name = quoted(field.name)
    if isinstance(field.dataType, T.BinaryType):
        return f"hex({name})"
    if is_complex(field.dataType):
        return f"to_json({name})"
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return f"nullif({name}, cast('NaN' AS {field.dataType.simpleString()}))"
    return name


# The measures of each kind of column and their type in the result; {v} is the value,
# {t} its parsed timestamp.
MEASURES = {
    "number": {
        "min": ("cast(min({v}) AS double)", "double"),
        "max": ("cast(max({v}) AS double)", "double"),
        "mean": ("cast(sum({v}) AS double) / count({v})", "double"),
        "std": ("stddev_samp(cast({v} AS double))", "double"),
    },
    "string": {
        "avg_length": ("cast(sum(length({v})) AS double) / count({v})", "double"),
        "min_length": ("min(length({v}))", "bigint"),
        "max_length": ("max(length({v}))", "bigint"),
    },
    "datetime": {"first": ("min({t})", "timestamp"), "last": ("max({t})", "timestamp")},
}


def table_facts(df: DataFrame, dataset_id: str) -> DataFrame:
    """One row per column with the facts a single scan can add up.

    Written as SQL text: wide tables need hundreds of expressions, which the parser
    builds much faster than one call per operator.
    """
    cells, sums, records = [], ["count(*) AS row_count"], []
    for i, field in enumerate(df.schema.fields):
        kind = kind_of(field)
        value, parsed = f"c{i}", f"t{i}"
        cells.append(f"{cell_sql(field)} AS {value}")
        groups = []
        if kind in NUMERIC_TYPES:
            groups = ["number"]
        elif kind == "datetime":
            cells.append(f"cast({quoted(field.name)} AS timestamp) AS {parsed}")
            groups = ["datetime"]
        elif kind == "string":
            cells.append(f"{timestamp_sql(cell_sql(field))} AS {parsed}")
            groups = ["string", "datetime"]
            sums.append(f"count({parsed}) AS {value}_dates")
        sums.append(f"count({value}) AS {value}_present")
        entries = []
        for group, measures in MEASURES.items():
            for name, (formula, result) in measures.items():
                if group in groups:
                    sums.append(f"{formula.format(v=value, t=parsed)} AS {value}_{name}")
                    entries.append(f"cast({value}_{name} AS {result}) AS {name}")
                else:
                    entries.append(f"cast(NULL AS {result}) AS {name}")
        data_type = f"'{kind}'"
        if kind == "string":
            data_type = (
                f"CASE WHEN try_divide({value}_dates, {value}_present) > {DATE_SHARE} THEN 'datetime' "
                f"WHEN {value}_avg_length > {TEXT_LENGTH} THEN 'text' ELSE 'categorical' END"
            )
        missing = f"(row_count - {value}_present)"
        label = field.name.replace("\\", "\\\\").replace("'", "\\'")
        records.append(
            f"struct({i} AS position, '{label}' AS column_name, '{kind}' AS kind, {data_type} AS data_type, row_count, "
            f"{missing} AS missing_count, coalesce(try_divide({missing}, row_count), 0D) * 100 AS missing_pct, "
            f"{', '.join(entries)})"
        )
    summed = df.selectExpr(*cells).selectExpr(*sums)
    return summed.selectExpr(f"inline(array({', '.join(records)}))").withColumn("dataset_id", F.lit(dataset_id))


def catalog_facts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Facts of all tables in one frame, stored: it has one row per column."""
    facts = reduce(DataFrame.unionByName, [table_facts(df, name) for name, df in tables.items()])
    return materialise(facts.coalesce(1), "facts")


def _counted(df: DataFrame, dataset_id: str, cells: Mapping[str, str], text: str, number: str) -> DataFrame:
    """The distinct values of the columns in ``cells``, which share a type, counted; ``text`` and ``number`` are taken of each."""
    names = [quoted(c) for c in cells]
    long = df.selectExpr(*[f"{cell} AS {name}" for cell, name in zip(cells.values(), names)])
    if len(names) > 1:
        places = ", ".join(f"{i}, {name}" for i, name in enumerate(names))
        long = long.selectExpr(f"stack({len(names)}, {places}) AS (place, value)")
    else:
        long = long.selectExpr("0 AS place", f"{names[0]} AS value")
    counted = long.where("value IS NOT NULL").groupBy("place", "value").agg(F.count(F.lit(1)).alias("rows"))
    listed = F.array(*[F.lit(c) for c in cells])
    return counted.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.get(listed, F.col("place")).alias("column_name"),
        F.expr(text).alias("text"),
        F.expr(number).alias("number"),
        "rows",
    )


def value_table(tables: Mapping[str, DataFrame], facts: DataFrame) -> DataFrame:
    """(dataset_id, column_name, text, number, rows): every distinct value, counted; numbers and times have no text.

    Columns of one type are counted together by their place and the value as it is: short keys of fixed width for all but
    strings. Columns of long text are counted by the SHA-256 of the whole value, so the texts themselves are not shuffled.
    The choice reads the facts, a row per column.
    """
    long_text = {
        (r["dataset_id"], r["column_name"])
        for r in facts.where(F.col("data_type") == "text").select("dataset_id", "column_name").collect()
    }
    parts = []
    for dataset_id, df in tables.items():
        alike: dict[tuple[str, str, str], dict[str, str]] = {}
        for field in df.schema.fields:
            cell, kind = cell_sql(field), kind_of(field)
            text, number, stored = "cast(NULL AS string)", "cast(NULL AS double)", field.dataType.simpleString()
            if kind in NUMERIC_TYPES:
                number = "cast(value AS double)"
                if kind == "integer":
                    cell, stored = f"cast({cell} AS bigint)", "bigint"
            elif kind != "datetime":
                hashed = (dataset_id, field.name) in long_text
                cell = f"sha2(cast({cell} AS string), 256)" if hashed else f"cast({cell} AS string)"
                text, stored = "value", "string"
            alike.setdefault((stored, text, number), {})[field.name] = cell
        parts += [_counted(df, dataset_id, cells, text, number) for (_, text, number), cells in alike.items()]
    return materialise(reduce(DataFrame.unionByName, parts), "values")


COLUMN = ["dataset_id", "column_name"]


def quartiles(values: DataFrame) -> DataFrame:
    """q25, median, q75 and IQR of every numeric column."""
    numbers = values.where(F.col("number").isNotNull())
    found = exact_quantiles(numbers, COLUMN, "number", [0.25, 0.5, 0.75])

    def at(p: float) -> Column:
        return F.max(F.when(F.col("probability") == p, F.col("quantile")))

    return (
        found.groupBy(*COLUMN)
        .agg(at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
        .withColumn("iqr", F.col("q75") - F.col("q25"))
    )


def outliers(values: DataFrame, quarts: DataFrame) -> DataFrame:
    """Rows outside 1.5 IQR of the quartiles, per numeric column."""
    outside = (F.col("number") < F.col("q25") - 1.5 * F.col("iqr")) | (
        F.col("number") > F.col("q75") + 1.5 * F.col("iqr")
    )
    # quarts has one row per column.
    return (
        values.where(F.col("number").isNotNull())
        .join(F.broadcast(quarts), COLUMN)
        .groupBy(*COLUMN)
        .agg(F.coalesce(F.sum(F.when(outside, F.col("rows"))), F.lit(0)).alias("outlier_count"))
    )


def top_values(values: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent texts per column, ties by value. The row limit is applied
    before the shuffle as well as after it."""
    order = W.partitionBy(*COLUMN).orderBy(F.desc("rows"), "value")
    return (
        values.where("text IS NOT NULL")
        .withColumnRenamed("text", "value")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select(*COLUMN, "place", "value", "rows")
    )


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Full profile: facts, distinct counts, quartiles, outliers, top values, semantic
    type. One row per column of every table; stored, so that rules can reuse it."""
    facts = catalog_facts(tables)
    values = value_table(tables, facts)
    quarts = materialise(quartiles(values).coalesce(1), "quartiles")
    unique = values.groupBy(*COLUMN).agg(F.count(F.lit(1)).alias("unique_count"))
    top = (
        top_values(values)
        .groupBy(*COLUMN)
        .agg(F.array_sort(F.collect_list(F.struct("place", "value", "rows"))).alias("top"))
    )
    listed = F.when(
        F.col("data_type") == "categorical",
        F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["rows"].alias("rows"))),
    )
    profile = (
        facts.join(unique, COLUMN, "left")
        .join(quarts, COLUMN, "left")
        .join(outliers(values, quarts), COLUMN, "left")
        .join(top, COLUMN, "left")
        .withColumns(
            {
                "unique_count": F.coalesce("unique_count", F.lit(0)),
                "outlier_count": F.coalesce("outlier_count", F.lit(0)),
                "top_values": listed,
                "range_days": F.when(F.col("data_type") == "datetime", F.datediff("last", "first")),
            }
        )
        .drop("top")
    )
    return materialise(profile.withColumn("semantic_type", semantic_type()).coalesce(1), "profile")


def normalised_name() -> Column:
    return F.translate(F.lower(F.col("column_name")), " -", "__")


def semantic_type() -> Column:
    """Meaning of a column, by the first rule that fits; over a profile frame."""
    name, kind = normalised_name(), F.col("data_type")
    unique, rows = F.col("unique_count"), F.col("row_count")
    numeric = kind.isin(NUMERIC_TYPES)
    id_like = (
        F.arrays_overlap(F.split(name, "_"), F.array(*[F.lit(t) for t in ID_TOKENS]))
        | name.endswith("id")
        | name.endswith("no")
    )
    return (
        F.when(id_like & ((unique > rows * 0.7) | (unique > 50)), "id")
        .when(numeric & contains_any(name, MONEY_TOKENS), "monetary")
        .when(numeric & contains_any(name, QUANTITY_TOKENS), "quantity")
        .when((kind == "datetime") | contains_any(name, DATE_TOKENS), "datetime")
        .when((kind == "boolean") | (unique == 2), "boolean")
        .when((kind == "categorical") | ((unique < 50) & (unique < rows * 0.2)), "categorical")
        .when((kind == "text") | (F.col("avg_length") > 30), "text")
        .when(contains_any(name, TARGET_TOKENS), "target_candidate")
        .otherwise(kind)
    )


def sample_values(df: DataFrame, row_key: str, k: int = 5) -> DataFrame:
    """The first k non-null values of every column, in key order."""
    columns = [f.name for f in df.schema.fields]
    cells = [f"cast({cell_sql(f)} AS string) AS {quoted(f.name)}" for f in df.schema.fields]
    long = df.selectExpr(f"{quoted(row_key)} AS _key", *cells).unpivot(["_key"], columns, "column_name", "value")
    order = W.partitionBy("column_name").orderBy("_key")
    return (
        long.where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select("column_name", "place", "value")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row. All rows are counted by a typed hash, which is all that is shuffled; those whose hash
    shares its low bits with one that occurs again are read once more and compared in full, by the SHA-256 of their JSON form.
    Rows that are compared needlessly count nothing, so the number is exact; few are, unless much is repeated."""
    cells = {f.name: cell_sql(f) for f in df.schema.fields}
    # A hash passes over nulls, so that which cells are null is hashed as well.
    nulls = ", ".join(f"{c} IS NULL" for c in cells.values())
    typed = F.expr(f"xxhash64({', '.join([*cells.values(), f'array({nulls})'])})")
    again = df.select(typed.alias("_h1")).groupBy("_h1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # At most DUPLICATE_SLOTS rows; whole rows of the table stay where they are.
    slots = again.select(F.pmod("_h1", F.lit(DUPLICATE_SLOTS)).alias("_slot")).distinct()
    whole = ", ".join(f"{cell} AS {quoted(name)}" for name, cell in cells.items())
    whole = F.expr(f"unhex(sha2(to_json(struct({whole}), map('ignoreNullFields', 'false')), 256))")
    suspects = df.withColumn("_slot", F.pmod(typed, F.lit(DUPLICATE_SLOTS))).join(F.broadcast(slots), "_slot", "left_semi")
    copies = suspects.groupBy(whole.alias("row_hash")).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def catalog_duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset_id, duplicate_rows) of all tables in one job."""
    parts = [duplicate_rows(df).withColumn("dataset_id", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def type_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy("dataset_id", "data_type").agg(F.count(F.lit(1)).alias("columns"))


def table_size(df: DataFrame) -> DataFrame:
    """Bytes held in the cells: fixed widths plus UTF-8 text bytes."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    fixed, sizes = 0, []
    for field in df.schema.fields:
        if kind_of(field) == "string":
            sizes.append(F.coalesce(F.expr(f"octet_length({cell_sql(field)})"), F.lit(0)))
        else:
            fixed += widths.get(field.dataType.simpleString(), 8)
    row = reduce(lambda a, b: a + b, sizes, F.lit(fixed).cast("bigint"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("row_count"))


def quality_scores(profile: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Per dataset: score 10..100, issues and advice.

    Deductions: 1.5 per percent of missing cells (at most 30), 2 per percent of
    duplicate rows (20), 5 per constant column, 10 x outliers per row (15).
    """
    constant = F.col("unique_count") <= 1
    sums = (
        profile.groupBy("dataset_id")
        .agg(
            F.max("row_count").alias("row_count"),
            F.count(F.lit(1)).alias("column_count"),
            F.sum("missing_count").alias("missing_cells"),
            F.sum("outlier_count").alias("outliers"),
            F.transform(
                F.array_sort(F.collect_list(F.when(constant, F.struct("position", "column_name")))),
                lambda c: c["column_name"],
            ).alias("constant_columns"),
        )
        .join(duplicates, "dataset_id", "left")
        .withColumn("duplicate_rows", F.coalesce("duplicate_rows", F.lit(0)))
        .withColumns(
            {
                "missing_pct": ratio(F.col("missing_cells"), F.col("row_count") * F.col("column_count")) * 100,
                "duplicate_pct": ratio(F.col("duplicate_rows"), F.col("row_count")) * 100,
                "constants": F.size("constant_columns"),
            }
        )
    )
    deduction = (
        F.least(F.col("missing_pct") * 1.5, F.lit(30.0))
        + F.least(F.col("duplicate_pct") * 2.0, F.lit(20.0))
        + F.col("constants") * 5.0
        + F.least(ratio(F.col("outliers"), F.col("row_count")) * 10.0, F.lit(15.0))
    )
    findings = [
        (
            F.col("missing_pct") > 0,
            F.concat(percent_text(F.col("missing_pct")), F.lit(" of values across the dataset are missing.")),
            "Consider imputing missing values or dropping high-missingness columns.",
        ),
        (
            F.col("duplicate_pct") > 0,
            F.format_string("%d duplicate rows detected (%.1f%%).", "duplicate_rows", "duplicate_pct"),
            "Deduplicate redundant records before training machine learning models.",
        ),
        (
            F.col("constants") > 0,
            F.format_string(
                "%d constant or zero-variance column(s) detected: %s.",
                F.col("constants"),
                F.array_join("constant_columns", ", "),
            ),
            "Drop constant columns as they carry no statistical variance.",
        ),
        (
            F.col("outliers") > 0,
            F.format_string("%d numerical outlier instances identified using IQR thresholds.", "outliers"),
            "Inspect outliers to evaluate if log-transformation or capping is appropriate.",
        ),
    ]
    empty = F.col("row_count") == 0
    issues = F.array_compact(F.array(*[F.when(test, text) for test, text, _ in findings]))
    advice = F.array_compact(F.array(*[F.when(test, F.lit(plan)) for test, _, plan in findings]))
    return sums.select(
        "dataset_id",
        "row_count",
        "column_count",
        "missing_cells",
        "missing_pct",
        "duplicate_rows",
        "outliers",
        "constant_columns",
        F.when(empty, 0.0).otherwise(F.greatest(F.lit(100.0) - deduction, F.lit(10.0))).alias("quality_score"),
        F.when(empty, F.array(F.lit("Dataset is empty."))).otherwise(issues).alias("issues"),
        F.when(empty, F.array(F.lit("Upload a non-empty CSV or XLSX file with headers.")))
        .otherwise(advice)
        .alias("recommendations"),
    )


def quality_report(profile: DataFrame) -> DataFrame:
    """Columns with missing values or outliers, per dataset."""
    return profile.where((F.col("missing_pct") > 0) | (F.col("outlier_count") > 0)).select(
        *COLUMN, "missing_count", "missing_pct", "outlier_count"
    )


def profile_light(df: DataFrame, dataset_id: str) -> DataFrame:
    """One-scan profile without distinct counts or quantiles: every measure adds up
    over partitions, files or micro-batches."""
    numeric = F.col("kind").isin(NUMERIC_TYPES)
    money = contains_any(F.lower("column_name"), ["amount", "price", "revenue"])
    return table_facts(df, dataset_id).select(
        "dataset_id",
        "position",
        "column_name",
        F.when(numeric, "float").otherwise("text").alias("data_type"),
        F.when(money, "monetary").otherwise("generic").alias("semantic_type"),
        "row_count",
        "missing_count",
        "missing_pct",
        "min",
        "max",
        "mean",
    )


def light_quality(light: DataFrame) -> DataFrame:
    """Score of a light profile: 1.5 per percent of missing cells, at most 40."""
    sums = light.groupBy("dataset_id").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("missing_count").alias("missing_cells"),
        F.count_if(F.col("data_type") == "float").alias("numeric_columns"),
        F.count_if(F.col("data_type") == "text").alias("text_columns"),
    )
    share = ratio(F.col("missing_cells"), F.col("row_count") * F.col("column_count")) * 100
    return sums.withColumn("missing_pct", share).withColumns(
        {
            "quality_score": F.greatest(100.0 - F.least(F.col("missing_pct") * 1.5, F.lit(40.0)), F.lit(10.0)),
            "issues": F.array_compact(
                F.array(
                    F.when(
                        F.col("missing_pct") > 10,
                        F.format_string(
                            "High missingness: %.2f%% of values across dataset are empty.", "missing_pct"
                        ),
                    )
                )
            ),
        }
    )
