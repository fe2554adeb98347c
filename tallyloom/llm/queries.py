"""The registered queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat_windows, decontaminate, exact_dedup, language_id, line_templates, main_text, merkle, quality, simhash, url_filter, warc, whitening
from tallyloom.session import scratch_path
from tallyloom.workload.inputs import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def keep(function):
        Q[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf)


@query("op1_bpe")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode_documents(table(spark, sf, "documents"), vocabulary)
    return bpe.decode_documents(encoded, vocabulary).select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_main_text")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return main_text.main_text(table(spark, sf, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks"
    )


@query("op3_quality")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """The quality of every document, by two views that teach each other; a fifth of the ids is kept out of training."""
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    fold = language_id.held_out(F.col("doc_id"))
    model = quality.co_train(documents.where(~fold), labels.where(~fold))
    return quality.score(documents, model).select(
        F.col("id").alias("doc_id"),
        language_id.held_out(F.col("id")).alias("held_out"),
        "text_score",
        "metadata_score",
        "score",
        "keep",
    )


@query(
    "op4_line_templates",
    r"""
    WITH lines AS (
        SELECT doc_id, i - 1 AS line_no, x[i] AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS r(i)
    ), collapsed AS (
        SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS bare FROM lines
    ), masked AS (
        SELECT doc_id, line_no, line, bare,
               list_transform(string_split(bare, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w,
               list_transform(string_split(replace(bare, ' ', ''), ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS c
        FROM collapsed WHERE bare <> ''
    ), kinds AS (
        SELECT *, CASE WHEN len(list_filter(w, lambda t: t <> '<*>')) >= 3 THEN 'w'
                       WHEN len(list_filter(c, lambda t: t <> '<*>')) >= 20 THEN 'c' ELSE 's' END AS kind
        FROM masked
    ), cut AS (
        SELECT doc_id, line_no, line, kind, CASE kind WHEN 'w' THEN w WHEN 'c' THEN c ELSE [bare] END AS tokens FROM kinds
    ), own AS (
        SELECT *, len(tokens) AS n, list_prepend(kind, list_slice(tokens, 1, 3)) AS lead FROM cut
    ), distinct_lines AS (
        SELECT n, lead, tokens, min(doc_id) AS low, max(doc_id) AS high FROM own GROUP BY ALL
    ), open_lines AS (
        SELECT * FROM distinct_lines QUALIFY count(*) OVER (PARTITION BY n, lead) > 1
    ), cells AS (
        SELECT n, lead, tokens, low, high, p, tokens[p] AS token,
               list_concat(list_slice(tokens, 1, p - 1), list_slice(tokens, p + 1, n)) AS rest
        FROM open_lines, unnest(range(4, n + 1)) AS r(p)
    ), judged AS (
        SELECT *, count(*) OVER own_token > 1 AND min(low) OVER own_token <> max(high) OVER own_token AS shared,
               count(*) OVER own_rest > 1 AND min(low) OVER own_rest <> max(high) OVER own_rest AS field
        FROM cells WINDOW own_token AS (PARTITION BY n, lead, p, token), own_rest AS (PARTITION BY n, lead, p, rest)
    ), general AS (
        SELECT n, lead, tokens, list((p, token) ORDER BY p) AS template
        FROM judged WHERE shared AND NOT field GROUP BY ALL
        HAVING (count(*) + 3) * 100 >= n * 80
    ), known AS (
        SELECT d.*, template FROM distinct_lines d LEFT JOIN general USING (n, lead, tokens)
    ), kept AS (
        SELECT n, lead, tokens, min(low) OVER w AS keeper, max(high) OVER w AS most FROM known
        WINDOW w AS (PARTITION BY n, lead, template, CASE WHEN template IS NULL THEN tokens END)
    ), gone AS (
        SELECT doc_id, line_no FROM own JOIN kept USING (n, lead, tokens) WHERE keeper <> most AND doc_id <> keeper
    )
    SELECT l.doc_id, count(*) AS n_lines, count(g.doc_id) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (g.doc_id IS NULL), '') AS text
    FROM lines l LEFT JOIN gone g USING (doc_id, line_no)
    GROUP BY l.doc_id
    """,
)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines whose template recurs from another document."""
    documents = table(spark, sf, "documents")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    counted = documents.select("doc_id", "text", n_lines.alias("n_lines"))
    return line_templates.drop_recurring_lines(counted).select(
        "doc_id", "n_lines", F.col("n_lines_dropped").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("text")
    )


@query(
    "op5_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER w = 1 AS kept,
           sha256(t) AS text_sha256
    FROM n
    WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)
    """,
)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Exact copies among all documents."""
    return exact_dedup.exact_duplicates(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_language_id")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document, by a model of the labelled documents outside the test fold."""
    documents = table(spark, sf, "documents")
    fold = language_id.held_out(F.col("doc_id"))
    model = language_id.train(documents.where(~fold))
    return language_id.label_languages(documents, model).select(
        F.col("id").alias("doc_id"),
        language_id.held_out(F.col("id")).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").alias("n_spans"),
    )


@query("op7_simhash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents and the components of near copies."""
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


#: The rules of the URL query: host, path, verdict.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


@query(
    "op9_url_filter",
    r"""
    WITH rules(rule_host, rule_path, rule_verdict) AS (
        VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
               ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
    ), u AS (
        SELECT row_number() OVER () AS n, page_id,
               translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
        FROM pages
    ), f AS (
        SELECT *, row_number() OVER (
                   PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
        FROM u LEFT JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    )
    SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
    FROM f WHERE k = 1
    """,
)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf, "pages"), rules).withColumnRenamed("id", "page_id")


@query(
    "op10_decontaminate",
    r"""
    WITH split AS (
        SELECT 'd' AS side, doc_id AS id, lower(coalesce(text, '')) AS t FROM documents
        UNION ALL SELECT 'b', item_id, lower(coalesce(text, '')) FROM benchmark
    ), words AS (
        SELECT side, id, string_split(bare, ' ') AS w
        FROM (SELECT side, id,
                     trim(regexp_replace(t, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS bare
              FROM split WHERE id IS NOT NULL)
        WHERE bare <> ''
    ), shingles AS (
        SELECT DISTINCT side, id, list_slice(w, i, i + 4) AS s FROM words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i)
    ), items AS (
        SELECT id AS item, s, count(*) OVER (PARTITION BY id) AS n_shingles FROM shingles WHERE side = 'b'
    )
    SELECT id AS doc_id, item AS item_id, count(*) AS n_found, any_value(n_shingles) AS n_shingles
    FROM shingles JOIN items USING (s)
    WHERE side = 'd'
    GROUP BY id, item
    HAVING count(*) * 100 >= any_value(n_shingles) * 80
    """,
)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains."""
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_found", "n_shingles")


@query(
    "op8_chat_windows",
    r"""
    WITH own AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
    ), counted AS (
        SELECT *, greatest(CAST(ceil(strlen(text) / 4.0) AS BIGINT), 1) AS tokens,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS k,
               20 + 3 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
                  + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS chars
        FROM own
    ), led AS (
        SELECT *, sum(CASE WHEN k = 1 AND role = 'system' THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS led,
               k = 1 AND role = 'system' AS is_system,
               count(*) OVER (PARTITION BY conv_id) AS n_all
        FROM counted
    ), summed AS (
        SELECT *, greatest((2048 - 512 - led) // 2, 1) AS half,
               sum(tokens) OVER (PARTITION BY conv_id ORDER BY k) - tokens - led AS before
        FROM led
    ), placed AS (
        SELECT *, (before // half) * 2 + CASE WHEN tokens > half THEN 1 ELSE 0 END AS span,
               before + least(512, half) AS reach
        FROM summed
    ), spans AS (
        SELECT conv_id, span, min(before) AS start FROM placed WHERE NOT is_system GROUP BY ALL
        UNION ALL SELECT conv_id, 0, 0 FROM placed WHERE is_system AND n_all = 1
    ), shown AS (
        SELECT p.conv_id, sum(p.chars) AS chars
        FROM placed p JOIN spans s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
             AND (is_system OR s.span = p.span OR (s.span > p.span AND s.start <= p.reach))
        GROUP BY ALL
    ), n_spans AS (SELECT conv_id, count(*) AS n FROM spans GROUP BY ALL)
    SELECT p.conv_id,
           count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
           (any_value(shown.chars) + 3 * any_value(n_spans.n))::BIGINT AS formatted_chars
    FROM placed p JOIN shown ON p.conv_id IS NOT DISTINCT FROM shown.conv_id
         JOIN n_spans ON p.conv_id IS NOT DISTINCT FROM n_spans.conv_id
    GROUP BY p.conv_id
    """,
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one full of control strings, formatted and read back, as digests."""
    marks = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    back = chat_windows.read_back(chat_windows.chat_windows(turns))
    spoken = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    loss = F.array_join("losses", "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query(
    "op11_merkle",
    r"""
    WITH RECURSIVE crc_table AS (
        SELECT list(c ORDER BY b) AS t
        FROM (SELECT b, list_reduce(list_concat([b], range(8)),
                                    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
              FROM range(256) AS r(b))
    ), crcs AS (
        SELECT doc_id, xor(4294967295, list_reduce(
                   list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                   lambda c, a: xor(c >> 8, t[(xor(c, a) & 255) + 1]))) AS crc
        FROM (SELECT DISTINCT doc_id FROM documents) CROSS JOIN crc_table
    ), own AS (
        SELECT doc_id, source, text,
               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
               coalesce(strlen(text) || ':' || text, '-') AS body,
               coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS bare
        FROM documents
    ), leaves AS (
        SELECT o.doc_id, source, sha256(head || body) AS leaf,
               CASE WHEN crc % 2 = 0 THEN sha256(head || bare) ELSE sha256(head || body) END AS seen
        FROM own o LEFT JOIN crcs c ON o.doc_id = c.doc_id
    ), placed AS (
        SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
               row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
               count(*) OVER (PARTITION BY source) AS n
        FROM leaves
    ), up AS (
        SELECT tree, 0 AS lvl, idx, n, leaf AS d FROM placed
        UNION ALL
        SELECT tree, lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY idx))
        FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 3
    ), subroots AS (
        SELECT tree, d AS subroot FROM up WHERE n = 1
    ), top AS (
        SELECT 1000 AS lvl, tree AS idx, (SELECT count(*) FROM subroots) AS n, subroot AS d FROM subroots
        UNION ALL
        SELECT lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(d, '' ORDER BY idx))
        FROM top WHERE n > 1 GROUP BY lvl, idx // 3
    ), nodes AS (
        SELECT * FROM up WHERE n > 1 UNION ALL SELECT -1, * FROM top WHERE n > 1
    ), steps AS (
        SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l,
               coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
        FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3
        GROUP BY ALL
    ), paths AS (
        SELECT p.tree, p.idx, list({'l': l, 'r': r, 'd': ''} ORDER BY lvl) AS path
        FROM placed p JOIN steps s
          ON (s.tree = p.tree AND s.idx = p.idx // (3 ** lvl)::BIGINT) OR (s.tree = -1 AND s.idx = p.tree // (3 ** (lvl - 1000))::BIGINT)
        GROUP BY ALL
    ), folded AS (
        SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root,
               sha256(coalesce(array_to_string(list_transform(path, lambda s: s.l || s.r), ''), '')) AS proof_sha256,
               list_reduce(list_concat([{'l': '', 'r': '', 'd': seen}], coalesce(path, [])),
                           lambda a, s: {'l': '', 'r': '', 'd': sha256(s.l || a.d || s.r)}).d AS folded_root
        FROM placed JOIN subroots USING (tree) LEFT JOIN paths USING (tree, idx)
    )
    SELECT *, folded_root = root AS verified FROM folded
    """,
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """A leaf, a proof and a check for every document; half of the ids are checked with line feeds deleted from the text."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    documents = table(spark, sf, "documents")
    bare = F.replace("text", F.lit("\n"), F.lit(""))
    changed = merkle.leaf_of([F.col(c) if c != "text" else bare for c in columns])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed)
    tree = merkle.manifest(documents, "doc_id", "source", columns, carry={"tampered": tampered})
    found = tree.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query("op12_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable embedding on its leading components, whitened."""
    grid = whitening.on_grid(table(spark, sf, "embeddings"))
    model = whitening.fit(grid)
    schema = (
        "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if model is None or not model.eigenvalues:
        return spark.createDataFrame([], schema)
    white = whitening.whiten(grid, model)
    error = whitening.identity_error(white, model.n)
    n, sums = F.lit(model.n).cast("bigint"), F.array(*[F.lit(s).cast("bigint") for s in model.sums])
    gaps = F.zip_with("x", sums, lambda x, s: (n * x - s) * (n * x - s))
    explained = F.array(*[F.lit(e / model.trace) for e in model.eigenvalues])
    # Once a vector, before there is a row a component.
    deviation = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)
    rows = grid.select("at", F.col("id").alias("vec_id"), deviation.alias("deviation")).join(white, "at")
    rows = rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        n.alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query(
    "op13_warc",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
               row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS FIRST) AS k,
               first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS FIRST) AS lead
        FROM pages
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND k > 1 THEN lead END AS refers_to,
           true AS intact
    FROM p
    """,
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Every page, written to an archive and read back from it."""
    pages = table(spark, sf, "pages")
    path = scratch_path(spark, "warc")
    warc.write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read_archive(spark, path).select(
        F.col("id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "intact",
    )
