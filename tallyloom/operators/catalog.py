"""Rules over profiles: domain of a table, analyses it supports, roles of its columns.

All functions take the profile frame (one row per column) of any number of tables
and work on the whole catalog at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.exprs import contains_any, titled
from tallyloom.operators.profile import NUMERIC_TYPES, normalised_name

# Tokens, weight and least matches of each business domain.
DOMAINS = {
    "ecommerce": (
        ["invoice", "invoiceno", "order", "order_id", "product", "sku", "quantity", "unitprice", "customer",
         "customerid", "shipping", "cart"], 1.2, 3),
    "sales": (
        ["sales", "revenue", "revenue_usd", "amount", "profit", "discount", "margin", "deal", "pipeline", "quota",
         "lead", "opportunity", "closed_date"], 1.1, 2),
    "customer": (
        ["customer", "client", "churn", "clv", "ltv", "retention", "tenure", "segment", "loyalty", "satisfaction",
         "nps", "tier"], 1.1, 2),
    "hr": (
        ["employee", "staff", "department", "salary", "wage", "attrition", "hire_date", "performance", "job_role",
         "manager", "resignation", "education", "overtime", "years_at_company"], 1.3, 2),
    "finance": (
        ["balance", "asset", "liability", "expense", "budget", "cashflow", "interest", "debt", "equity", "dividend",
         "roi", "ebitda", "audit", "account_no"], 1.2, 2),
    "marketing": (
        ["campaign", "clicks", "impressions", "ctr", "cpc", "cpa", "conversions", "roas", "channel", "ad_group",
         "utm_source", "bounce_rate"], 1.2, 2),
    "operations": (
        ["inventory", "warehouse", "stock", "supplier", "lead_time", "dispatch", "logistics", "defect", "machine",
         "yield", "downtime", "batch"], 1.1, 2),
    "survey": (
        ["respondent", "question", "agree", "disagree", "rating", "feedback", "strongly_agree", "likert", "score",
         "q1", "q2", "q3"], 1.2, 2),
}
DOMAIN_LABELS = {
    "ecommerce": "E-commerce Transactions",
    "sales": "Sales & Revenue",
    "customer": "Customer Profile & Loyalty",
    "hr": "Human Resources & Workforce",
    "finance": "Financial & Accounting",
    "marketing": "Marketing & Campaign Performance",
    "operations": "Operations & Supply Chain",
    "time-series": "Time-Series & Sequential",
    "survey": "Survey & Questionnaire",
    "generic-tabular": "General Tabular Data",
}
RATING_TOKENS = ["rate", "score", "scale", "q"]

# Name keywords of the column roles.
BUYER_WORDS = ["customer", "client", "buyer", "user_id", "member_id", "account_id"]
SPEND_WORDS = ["total", "price", "revenue", "amount", "spend", "cost", "monetary", "sales"]
SALES_WORDS = ["sales", "revenue", "amount", "total_price", "price", "profit"]
TARGET_WORDS = ["target", "label", "churn", "attrition", "status", "outcome", "converted", "default"]
ROLE_TARGET_WORDS = ["target", "label", "churn", "status", "revenue", "salary"]
ROLE_ID_WORDS = ["id", "code", "uuid", "key", "number"]


def classify_datasets(profile: DataFrame) -> DataFrame:
    """Business domain of each dataset with confidence and reason.

    The tokens are literals in the plan, so matching names against them needs no
    join; a dataset's columns meet in one aggregate.
    """
    name = normalised_name()
    numeric = F.col("data_type").isin(NUMERIC_TYPES)

    def first_token(tokens: list[str]) -> Column:
        hits = F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(name, t))
        return F.try_element_at(hits, F.lit(1))

    rating = contains_any(name, RATING_TOKENS)
    seen = profile.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(numeric).alias("numbers"),
        F.bool_or(F.col("semantic_type") == "datetime").alias("dated"),
        F.bool_or(name.contains("invoice")).alias("invoice"),
        F.bool_or(name.contains("customer")).alias("buyer"),
        F.transform(
            F.array_sort(F.collect_list(F.when(rating, F.struct("position", name.alias("name"))))),
            lambda c: c["name"],
        ).alias("ratings"),
        *[F.array_sort(F.collect_set(first_token(tokens))).alias(d) for d, (tokens, _, _) in DOMAINS.items()],
    )

    scores: dict[str, Column] = {}
    features: dict[str, Column] = {}
    for domain, (_, weight, least) in DOMAINS.items():
        matches = F.size(domain)
        points = F.least(matches / F.col("columns") * weight * 100 + matches * 12, F.lit(98.0))
        scores[domain] = F.when(matches >= least, points)
        features[domain] = F.when(matches >= least, F.col(domain)).otherwise(F.array().cast("array<string>"))

    shop = F.col("invoice") & F.col("buyer")
    questions = F.size("ratings")
    asked = (questions >= 3) & (questions >= F.col("columns") * 0.4)
    sequence = F.col("dated") & (F.col("numbers") >= 1) & (F.col("columns") <= 6)
    # Equal scores go to the domain found first: token matches in order, then the special checks.
    late = {
        "ecommerce": F.when(scores["ecommerce"].isNull(), 9).otherwise(0),
        "survey": F.when(scores["survey"].isNull(), 10).otherwise(7),
    }
    place = {d: late.get(d, F.lit(i)) for i, d in enumerate(DOMAINS)} | {"time-series": F.lit(8)}
    found = dict(scores)
    found["ecommerce"] = F.when(shop, F.greatest(F.coalesce(scores["ecommerce"], F.lit(0.0)), F.lit(92.0))).otherwise(
        scores["ecommerce"]
    )
    found["survey"] = F.when(asked, F.greatest(F.coalesce(scores["survey"], F.lit(0.0)), F.lit(88.0))).otherwise(
        scores["survey"]
    )
    found["time-series"] = F.when(sequence, 85.0)
    features["ecommerce"] = F.when(
        shop, F.concat(features["ecommerce"], F.array(F.lit("transaction invoice and customer identifier")))
    ).otherwise(features["ecommerce"])
    features["survey"] = F.when(asked, F.col("ratings")).otherwise(features["survey"])
    features["time-series"] = F.array(F.lit("datetime column paired with sequential numerical measures"))

    options = F.array_compact(
        F.array(
            *[
                F.when(
                    found[d].isNotNull(),
                    F.struct(
                        found[d].alias("confidence"),
                        (-place[d]).alias("place"),
                        F.lit(d).alias("domain"),
                        features[d].alias("features"),
                    ),
                )
                for d in found
            ]
        )
    )
    labels = F.create_map(*[F.lit(x) for pair in DOMAIN_LABELS.items() for x in pair])
    best = F.col("best")
    return (
        seen.select("dataset_id", F.array_max(options).alias("best"))
        .withColumn("dataset_type", F.coalesce(best["domain"], F.lit("generic-tabular")))
        .select(
            "dataset_id",
            "dataset_type",
            F.element_at(labels, F.col("dataset_type")).alias("dataset_type_label"),
            F.coalesce(best["confidence"], F.lit(60.0)).alias("confidence"),
            F.coalesce(best["features"], F.array().cast("array<string>")).alias("matched_features"),
            F.when(
                best.isNotNull(),
                F.format_string(
                    "Detected characteristic %s patterns (matched key fields: %s).",
                    best["domain"],
                    F.array_join(F.slice(best["features"], 1, 4), ", "),
                ),
            )
            .otherwise("Structured tabular data with general numeric and categorical distributions.")
            .alias("reason"),
        )
    )


def _first(test: Column) -> Column:
    """Name of the first column, in table order, that passes the test."""
    return F.min_by(F.when(test, F.col("column_name")), F.when(test, F.col("position")))


def _last(test: Column) -> Column:
    return F.max_by(F.when(test, F.col("column_name")), F.when(test, F.col("position")))


def _names(test: Column) -> Column:
    """Names of all columns that pass the test, in table order."""
    return F.transform(
        F.array_sort(F.collect_list(F.when(test, F.struct("position", "column_name")))), lambda c: c["column_name"]
    )


def dataset_roles(profile: DataFrame) -> DataFrame:
    """One row per dataset: column lists by type and the columns chosen for each role."""
    name = F.lower("column_name")
    kind, meaning = F.col("data_type"), F.col("semantic_type")
    numeric = kind.isin(NUMERIC_TYPES)
    category = kind.isin("categorical", "boolean")
    dated = (kind == "datetime") | (meaning == "datetime")
    wordy = (kind == "text") | (meaning == "text")
    known_as = (meaning == "id") | contains_any(name, ["id", "code"])
    target = (meaning == "target_candidate") | contains_any(name, TARGET_WORDS)
    roles = profile.groupBy("dataset_id").agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        _names(numeric).alias("numeric_columns"),
        _names(category).alias("categorical_columns"),
        _names(dated).alias("datetime_columns"),
        _names(wordy).alias("text_columns"),
        _names(known_as).alias("id_columns"),
        _first(contains_any(name, BUYER_WORDS)).alias("customer_column"),
        _first(numeric & contains_any(name, SPEND_WORDS)).alias("monetary_column"),
        _first(numeric & contains_any(name, SALES_WORDS)).alias("sales_column"),
        F.coalesce(_first(target), _last(category)).alias("target_column"),
        F.map_from_entries(F.collect_list(F.struct("column_name", "data_type"))).alias("types"),
    )

    def head(names: str) -> Column:
        return F.try_element_at(F.col(names), F.lit(1))

    target_type = F.try_element_at(F.col("types"), F.coalesce("target_column", F.lit("")))
    return (
        roles.withColumns(
            {
                "date_column": head("datetime_columns"),
                "text_column": head("text_columns"),
                "entity_column": F.coalesce("customer_column", head("id_columns")),
                "measure_column": F.coalesce("sales_column", head("numeric_columns")),
                "recommended_task": F.when(target_type.isin(NUMERIC_TYPES), "regression").otherwise(
                    "classification"
                ),
            }
        )
        .drop("types")
    )


def capability_plan(roles: DataFrame) -> DataFrame:
    """(dataset_id, section, key, title, available, reason) for the 14 features, 8
    modules and 7 suggested analyses."""
    numbers, categories = F.size("numeric_columns"), F.size("categorical_columns")
    texts, rows, width = F.size("text_columns"), F.col("row_count"), F.col("column_count")
    date_col, text_col = F.coalesce("date_column", F.lit("")), F.coalesce("text_column", F.lit(""))
    target = F.col("target_column")
    yes = F.lit(True)
    filled = (width >= 1) & (rows >= 1)
    two_numbers = numbers >= 2
    buyers = F.col("customer_column").isNotNull() & F.col("date_column").isNotNull() & F.col("monetary_column").isNotNull()
    groups = two_numbers & (rows >= 10)
    timed = F.col("date_column").isNotNull() & (numbers >= 1)
    wordy = texts >= 1
    learn = (numbers + categories >= 2) & (rows >= 20)
    selling = F.col("sales_column").isNotNull()
    entity = F.col("entity_column").isNotNull()

    def say(text: str, *values: Column) -> Column:
        return F.format_string(text, *values) if values else F.lit(text)

    # Titles and reasons. Each entry: key, title, test, reason when met, reason when not.
    rfm = (
        "rfm", "RFM Analysis", buyers,
        say("Customer identifier, transaction date, and monetary columns detected."),
        say("No customer identifier + transaction date + monetary field were detected."),
    )
    segmentation = (
        "segmentation", "Segmentation", groups,
        say("Unsupervised K-Means clustering and PCA projection supported across %d numeric features.", numbers),
        say("Clustering requires at least 2 numerical continuous variables and at least 10 rows."),
    )
    learning = (
        "ml", "Machine Learning", learn,
        say("Supervised predictive models can be benchmarked (%s).",
            F.coalesce(F.concat(F.lit("Target: "), target), F.lit("Select Target"))),
        say("Machine learning requires at least 2 features and at least 20 records."),
    )
    series = (
        "time_series", "Time Series", timed,
        say("Temporal trends and rolling metrics supported using '%s'.", date_col),
        say("Requires a valid date/time column and a numerical metric."),
    )
    text = (
        "nlp", "NLP & Text Analytics", wordy,
        say("%d free-text column(s) detected for word frequencies and lexical analysis.", texts),
        say("No free-text columns detected for text analysis."),
    )
    statistics = (
        "statistics", "Statistics", two_numbers,
        say("Descriptive moments, confidence intervals, and hypothesis tests available for %d numeric variables.",
            numbers),
        say("Requires at least 2 numerical continuous variables for hypothesis testing."),
    )
    features = [
        ("analytics", "Data Analytics", yes,
         say("Active dataset loaded with %d columns and %s rows ready for aggregated analytics.", width,
             F.format_number(rows, 0)), say("")),
        ("eda", "EDA (Exploratory Data Analysis)", filled,
         say("Sufficient distribution and frequency data to construct univariate and bivariate summaries."),
         say("Requires at least 1 column and 1 row.")),
        statistics,
        ("visualization", "Visualization", filled,
         say("Multi-dimensional chart configurations can be generated across categorical and numerical axes."),
         say("Insufficient data to plot charts.")),
        ("correlation", "Correlation Analysis", two_numbers,
         say("Pearson and Spearman matrices supported across %d numerical features.", numbers),
         say("Correlation analysis requires at least 2 numerical columns.")),
        ("outliers", "Outlier Detection", numbers >= 1,
         say("Interquartile Range (IQR) and Z-score outlier detection available on %d numerical features.", numbers),
         say("Requires at least 1 numerical column.")),
        learning,
        segmentation,
        series,
        rfm,
        text,
        ("insights", "Business Insights", yes,
         say("Automated discovery of anomalies, top drivers, and key domain trends grounded in actual data."), say("")),
        ("recommendations", "Recommendations", yes,
         say("Actionable playbooks with impact and effort ratings synthesized from dataset findings."), say("")),
        ("reports", "Reports", yes,
         say("Exportable executive summaries, statistical audits, and full analytical briefs."), say("")),
    ]
    modules = [
        rfm,
        ("sales", "Sales Analytics", selling,
         say("Revenue metric '%s' detected.", F.coalesce("sales_column", F.lit(""))),
         say("Sales Analytics is unavailable because no revenue or transaction amount fields were detected.")),
        ("customers", "Customer / Entity Directory", entity,
         say("Entity identifier '%s' detected.", F.coalesce("entity_column", F.lit(""))),
         say("Customer/Entity analysis is unavailable because no distinct entity identifier was detected.")),
        segmentation,
        learning,
        series,
        text,
        statistics,
    ]
    analyses = [
        ("eda", "Exploratory Data Analysis", yes,
         say("Calculates complete summary statistics, distributions, missing values, and data health profiles."),
         say("")),
        ("statistics", "Statistical & Correlation Analysis", two_numbers,
         say("Evaluates Pearson & Spearman correlations and hypothesis tests across %d numeric variables.", numbers),
         say("Disabled: requires at least 2 numerical measures.")),
        ("trends", "Trend & Temporal Analysis", timed,
         say("Trend Analysis is recommended because a valid date column ('%s') and numeric measures were detected.",
             date_col),
         say("Disabled: no temporal date column detected.")),
        ("segmentation", "Customer / Record Segmentation", groups,
         say("Unsupervised K-Means clustering and PCA dimensionality reduction across continuous variables."),
         say("Disabled: requires at least 2 numerical continuous variables.")),
        ("ml", "Predictive Machine Learning", learn & target.isNotNull(),
         say("Trains and benchmarks competing classification / regression algorithms against target '%s'.",
             F.coalesce(target, F.lit("candidate"))),
         say("Disabled: insufficient rows or features for training.")),
        ("rfm", "RFM Customer Quintile Scoring", buyers,
         say("Evaluates Recency, Frequency, and Monetary quintile scores to segment customer loyalty."),
         say("Disabled: required customer, date, and monetary columns were not detected.")),
        ("nlp", "Text & Sentiment / Lexical Analysis", wordy,
         say("Computes lexical richness, TF-IDF terms, and vocabulary frequencies on '%s'.", text_col),
         say("Disabled: no free-text columns detected.")),
    ]
    entries = []
    for section, listed in (("feature", features), ("module", modules), ("analysis", analyses)):
        for key, title, test, met, unmet in listed:
            # The learning analysis explains itself by its data, even when no target was found.
            explained = learn if (section, key) == ("analysis", "ml") else test
            entries.append(
                F.struct(
                    F.lit(section).alias("section"),
                    F.lit(key).alias("key"),
                    F.lit(title).alias("title"),
                    test.alias("available"),
                    F.when(explained, met).otherwise(unmet).alias("reason"),
                )
            )
    return roles.select("dataset_id", F.inline(F.array(*entries)))


def capability_list(plan: DataFrame) -> DataFrame:
    """The feature cards with their default confidence."""
    return plan.where(F.col("section") == "feature").select(
        "dataset_id", "key", titled(F.col("key")).alias("name"), "available", F.lit(0.95).alias("confidence"), "reason"
    )


def column_roles(profile: DataFrame) -> DataFrame:
    """Columns by type, possible identifiers and possible targets, per dataset."""
    name, kind = F.lower("column_name"), F.col("data_type")
    return profile.groupBy("dataset_id").agg(
        _names(kind.isin(NUMERIC_TYPES)).alias("numeric_columns"),
        _names(kind == "categorical").alias("categorical_columns"),
        _names(kind == "datetime").alias("datetime_columns"),
        _names(kind == "text").alias("text_columns"),
        _names(kind == "boolean").alias("boolean_columns"),
        _names((F.col("semantic_type") == "id") | contains_any(name, ROLE_ID_WORDS)).alias("possible_ids"),
        _names(contains_any(name, ROLE_TARGET_WORDS)).alias("possible_targets"),
    )
