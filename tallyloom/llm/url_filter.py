"""Allow and block rules for URLs, looked up by hashed expressions. DataFrame functions only.

A rule is a host and a path. It fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's. Each URL is expanded into the host suffixes and path prefixes that a rule could name, and the hashes of these
expressions are joined with the hashes of the rules: first on a short prefix, then on the whole digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join is on.
HASH_DIGITS = 8
#: Up to so many rules (of about 200 bytes) are sent to every executor; more are joined by a shuffle.
BROADCAST_RULES = 20_000
#: Parts that a frequent expression is dealt over in the shuffled join.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """One row for each distinct rule (host, path): its digest, short hash, verdict and rank.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). Rules without a host are ignored, a null
    path is empty, and where one rule is given both verdicts it blocks.
    """
    clean = rules.where(F.length("host") > 0).select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    one = clean.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(
        F.concat("host", "path").alias("rule"),
        "rule_verdict",
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h")).alias("rank"),
        digest.alias("rule_digest"),
        F.substring(digest, 1, HASH_DIGITS).alias("short_hash"),
        _labels(F.col("host")).alias("n_labels"),
        F.length("path").alias("n_path"),
    )


def filter_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row for each row of ``pages``: ``id``, ``host``, ``path``, ``rule``, ``verdict``.

    * Of the rules that fit, the longest (host and path together, then the host) decides; ``rule`` is its text.
      Where none fits, ``rule`` is null and ``verdict`` is ``default``.
    * A null or malformed URL has an empty host and path, which no rule fits. Long URLs are expanded only into the shapes
      (number of labels, length of path) that occur among the rules, so a URL of any length gives at most one expression
      a shape.
    * Repeated rows give repeated results. Other columns are ignored. No rules: everything gets ``default``.
    """
    known = hashed_rules(rules)
    # A row for each shape of a rule, never for each rule.
    shapes = [(r.n_labels, r.n_path) for r in known.select("n_labels", "n_path").distinct().collect()]

    # Equal rows are judged once.
    url = pages.groupBy(F.col(id_col).alias("id"), F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    url = url.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    if not shapes:
        judged = url.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
        return _repeated(judged)

    host, path, labels = F.col("host"), F.col("path"), _labels(F.col("host"))
    wanted = F.array(*[F.struct(F.lit(a).alias("n_labels"), F.lit(b).alias("n_path")) for a, b in shapes])
    fitting = F.filter(wanted, lambda s: (labels >= s.n_labels) & (F.length(path) >= s.n_path))
    digests = F.transform(
        fitting, lambda s: _digest(
            F.call_function("substring_index", host, F.lit("."), -s.n_labels), F.substring(path, F.lit(1), s.n_path)
        ),
    )
    asked = url.withColumn("digest", F.explode_outer(digests)).withColumn("short_hash", F.substring("digest", 1, HASH_DIGITS))
    known = known.drop("n_labels", "n_path")
    on = ["short_hash"]
    if known.count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    else:
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on.append("salt")
    found = asked.join(known, on, "left")
    hit = F.col("digest") == F.col("rule_digest")
    best = F.max(F.when(hit, F.struct("rank", "rule", "rule_verdict")))
    judged = found.groupBy("id", "url").agg(
        F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"), best.alias("best")
    )
    judged = judged.withColumns(
        {"rule": F.col("best.rule"), "verdict": F.coalesce("best.rule_verdict", F.lit(default))}
    )
    return _repeated(judged)


def _repeated(judged: DataFrame) -> DataFrame:
    once = judged.select("id", "host", "path", "rule", "verdict", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return once.drop("col")
