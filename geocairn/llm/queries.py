"""Registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from geocairn.llm import (
    decision_list, filter_audit, hard_negatives, licenses, line_templates, mixing, page_text, pii, piece_dropout, simhash, spotsigs, toxicity, url_cascade)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_dropout.with_pieces(docs).select("doc_id", "n_pieces", "lossless", "ids")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.spot_report(table(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source / thousands / hundreds / id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100), "doc_id")
    return licenses.license_scan(docs.select(path.alias("path"), "text"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_list.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.with_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh vector are shifted by one first; every fiftieth is an anchor."""
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_toxicity, op3_piece_dropout, op4_pii, op5_url_cascade, op6_spotsigs, op7_line_templates,
    op8_licenses, op9_pareto_mix, op10_decision_list, op11_filter_audit, op12_page_text, op13_hard_negatives)}

_PARETO = """
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
               (('0x' || substr(md5(concat_ws(':', 'mix', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(coalesce(text, '')))), 1, 13))::BIGINT
                + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
        FROM documents),
    totals AS (
        SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
               (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS weight
        FROM sized GROUP BY source),
    shares AS (
        SELECT *, (sum(source_size) OVER ()
                   - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                  / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST
                                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
        FROM totals),
    targets AS (
        SELECT source, docs, source_size, CASE WHEN most <= share * weight THEN most::DOUBLE ELSE weight * (
            SELECT arg_min(share, most::DOUBLE / weight) FROM shares WHERE most > share * weight) END AS target
        FROM shares),
    copied AS (
        SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies,
               least(floor(copies + 1e-12), 3)::BIGINT AS whole,
               CASE WHEN copies - whole > 1e-9 THEN copies - whole ELSE 0 END AS fraction,
               source_size::DOUBLE / docs AS mean_size, least(fraction, 1 - fraction) / 2 AS lean
        FROM targets),
    joined AS (
        SELECT d.doc_id, d.size, d.u, s.*, d.size / (d.size + s.mean_size) AS pull
        FROM sized d JOIN copied s ON d.source IS NOT DISTINCT FROM s.source),
    pulls AS (
        SELECT *, sum(round(pull * size * 1024)::BIGINT) FILTER (size > 0) OVER (PARTITION BY source)::DOUBLE / 1024
                  / sum(size) OVER (PARTITION BY source)::DOUBLE AS mean_pull
        FROM joined),
    odds AS (
        SELECT *, fraction + lean * (pull - mean_pull) AS p, (u / (1 - u)) / (p / (1 - p)) AS ratio,
               ratio / (1 + ratio) AS v
        FROM pulls),
    ranked AS (
        SELECT *, sum(CASE WHEN fraction > 0 AND size > 0 THEN size ELSE 0 END) OVER (
            PARTITION BY source ORDER BY CASE WHEN fraction > 0 AND size > 0 THEN v ELSE 2 END, doc_id) AS running
        FROM odds)
    SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN fraction > 0 AND size > 0 AND v < 1
        AND running - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM ranked"""

_FILTERS = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate("ABCDE"))
_AUDIT = rf"""
    WITH words AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS txt,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    firsts AS (SELECT txt, min(doc_id) AS first FROM words GROUP BY txt),
    marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS bad
              FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    masked AS (
        SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
               (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
               + 4 * (100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 10 * length(txt))::INT
               + 8 * regexp_matches(txt, '[#$%&*|]')::INT + 16 * coalesce(words.doc_id > first, false)::INT AS mask
        FROM words JOIN firsts USING (txt) LEFT JOIN marks ON words.doc_id = marks.doc_id),
    counts AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
               FROM masked GROUP BY part, mask),
    f(c, b) AS (VALUES {_FILTERS}),
    orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM f a, f b, f c, f d, f e
               WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
    steps AS (
        SELECT filter_order, step::INT AS step, f.b AS bit,
               (SELECT coalesce(sum(g.b), 0) FROM f g WHERE strpos(filter_order, g.c) < step)::INT AS before
        FROM orders, generate_series(1, 5) AS s(step) JOIN f ON f.c = substr(filter_order, step, 1)),
    result AS (
        SELECT part, filter_order, step, bit,
               coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
               coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
        FROM counts, steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM result"""

_MINED = """
    WITH rows AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
        FROM rows a JOIN rows b ON a.id % 50 = 0 AND a.id <> b.id),
    positives AS (
        SELECT anchor_id, id, score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT p.anchor_id, p.id AS positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
           n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
        AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    QUALIFY rank <= 3"""

# The articles of the given pages stand in one element, in which only these references occur.
_ARTICLES = r"""
    WITH found AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS part FROM pages),
    plain AS (SELECT page_id, url, regexp_replace(regexp_replace(part, '<(/?(p|h1|br)[^>]*)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM found),
    decoded AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM plain)
    SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(t, '\s+', ' ', 'g')))::BIGINT AS n_chars
    FROM decoded"""

_HOST = r"translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op11_filter_audit": _AUDIT,
    "op12_page_text": _ARTICLES,
    "op13_hard_negatives": _MINED,
    "op9_pareto_mix": _PARETO,
    "op5_url_cascade": rf"""
        WITH rests AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {list(url_cascade.LISTED_TERMS)}) THEN 'block'
            ELSE 'allow' END AS verdict
        FROM ruled""",
}
