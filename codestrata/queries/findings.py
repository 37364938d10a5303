"""Findings analytics re-aimed at documents, pages, parts, events and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions.text import clean_code, clean_id, extract, extract_number
from codestrata.operators import findings as fnd
from codestrata.queries import Catalog, table
from codestrata.session import work_path
from codestrata.sources.readers import keep_with_key

CATALOG = Catalog()
query = CATALOG.add

SOURCE_ID = r"(src\d+)"
LANGS = ["de", "en", "es", "fr"]  # columns of the flagship pivot; other languages share one
HOST = r"^https?://([^/]+)/"
SECTION = r"^https?://[^/]+/([^/?#]+)"

PAGE_PARTS_SQL = r"""
  SELECT nullif(regexp_extract(url, '^https?://([^/]+)/', 1), '') AS host,
         nullif(regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1), '') AS section
  FROM pages"""


@query(
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
    """
)
def findings_scan(spark, d):
    logged = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("j"))
    return fnd.not_null(logged.select("event_id", F.col("j.k").alias("k")), "k")


@query(
    """
    SELECT event_id, user_id, json_extract_string(props, '$.k') AS k
    FROM events WHERE list_contains(json_keys(props), 'k')
    """
)
def findings_key_present(spark, d):
    lines = table(spark, d, "events").select("event_id", "user_id", F.col("props").alias("value"))
    return keep_with_key(lines, "k", "k string")


@query(
    r"""
    SELECT p_partkey, CAST(nullif(regexp_extract(p_brand, 'Brand#(\d+)', 1), '') AS BIGINT) AS brand_no,
           nullif(regexp_extract(p_name, '^(red|small) ', 1), '') AS lead_word
    FROM part
    """
)
def findings_extract(spark, d):
    part = table(spark, d, "part")
    return part.select(
        "p_partkey",
        extract_number(F.col("p_brand"), r"Brand#(\d+)").alias("brand_no"),
        extract(F.col("p_name"), "^(red|small) ").alias("lead_word"),
    )


@query(
    """
    SELECT nullif(regexp_extract(source, '(src[0-9]+)', 1), '') AS src_id,
           count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en,
           count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr,
           count(*) FILTER (WHERE lang IS NULL) AS "null", count(*) FILTER (WHERE lang NOT IN ('de', 'en', 'es', 'fr')) AS other
    FROM documents WHERE source IS NOT NULL AND regexp_matches(source, '(src[0-9]+)') GROUP BY 1
    """
)
def findings_pivot(spark, d):
    docs = fnd.not_null(table(spark, d, "documents"), "source")
    found = fnd.extract_id(fnd.match_filter(docs, "source", SOURCE_ID), "source", SOURCE_ID, "src_id")
    return fnd.pivot_counts(found, "src_id", "lang", LANGS)


def _page_parts(spark, d):
    pages = table(spark, d, "pages")
    return pages.select(
        extract(F.col("url"), HOST).alias("host"), extract(F.col("url"), SECTION).alias("section")
    )


@query(f"SELECT host, section, count(*) AS occurrences FROM ({PAGE_PARTS_SQL}) GROUP BY ALL")
def findings_value_counts(spark, d):
    return fnd.ranked_counts(_page_parts(spark, d), ["host"], "section")


@query(
    f"""
    WITH c AS (SELECT host, section, count(*) AS n FROM ({PAGE_PARTS_SQL}) GROUP BY ALL)
    SELECT host, string_agg(section || '=' || n, ',' ORDER BY n DESC, section) AS sections
    FROM c GROUP BY host
    """
)
def findings_value_counts_nested(spark, d):
    nested = fnd.value_counts_nested(_page_parts(spark, d), ["host"], "section", "n")
    text = F.transform("n", lambda e: F.concat(e["section"], F.lit("="), e["n"].cast("string")))
    return nested.select("host", F.array_join(text, ",").alias("sections"))


@query(f"SELECT host, section, count(*) AS occurrences FROM ({PAGE_PARTS_SQL}) GROUP BY ALL")
def findings_unnest(spark, d):
    nested = fnd.value_counts_nested(_page_parts(spark, d), ["host"], "section")
    return fnd.unnest(nested, "occurrences")


@query(
    """
    WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
         g AS (SELECT s.source, l.lang, coalesce(c.n, 0) AS n
               FROM (SELECT DISTINCT source FROM documents) s
               CROSS JOIN (SELECT DISTINCT lang FROM documents) l
               LEFT JOIN c ON c.source = s.source AND c.lang IS NOT DISTINCT FROM l.lang)
    SELECT coalesce(lang, 'null') AS lang, string_agg(source, ',' ORDER BY source) AS ids,
           string_agg(CAST(n AS VARCHAR), ',' ORDER BY source) AS counts
    FROM g GROUP BY lang
    """
)
def findings_series(spark, d):
    wide = fnd.pivot_counts(table(spark, d, "documents"), "source", "lang")
    series = fnd.chart_series(wide, "source", "lang")
    return series.select(
        "lang",
        F.array_join("ids", ",").alias("ids"),
        F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"),
    )


@query(
    """
    WITH c AS (SELECT source, lang, count(*) AS occurrences FROM documents GROUP BY ALL)
    SELECT source, lang, occurrences,
           CAST(coalesce(sum(occurrences) OVER (PARTITION BY source ORDER BY lang
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base
    FROM c
    """
)
def findings_stack(spark, d):
    counts = fnd.value_counts(table(spark, d, "documents"), ["source"], "lang")
    return fnd.stack_offsets(counts, "source", "lang")


@query(
    """
    SELECT p_type, count(*) FILTER (WHERE regexp_matches(p_name, '^(red|small) ')) AS hits,
           count(*) AS total,
           count(*) FILTER (WHERE regexp_matches(p_name, '^(red|small) ')) / count(*) AS ratio
    FROM part GROUP BY p_type
    """
)
def findings_ratio(spark, d):
    return fnd.hit_ratio(table(spark, d, "part"), F.col("p_name").rlike("^(red|small) "), ["p_type"])


@query("SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)the')) AS hits FROM documents")
def findings_height(spark, d):
    """Height of the whole table and of the rows that match."""
    docs = table(spark, d, "documents")
    flagged = docs.select(F.col("text").rlike("(?i)the").alias("hit"))
    counted = fnd.height(flagged.where("hit"), "hits").withColumn("n", F.lit(0)).unionByName(fnd.height(flagged).withColumn("hits", F.lit(0)))
    return counted.agg(F.max("n").alias("n"), F.max("hits").alias("hits"))


@query(r"SELECT count(DISTINCT nullif(regexp_extract(p_brand, '(Brand#\d+)', 1), '')) AS ids FROM part")
def findings_distinct_ids(spark, d):
    return fnd.distinct_ids(fnd.extract_id(table(spark, d, "part"), "p_brand", r"(Brand#\d+)", "brand"), "brand")


@query(
    """
    SELECT event_type AS kind, strftime(ts, '%Y-%m') AS period, count(DISTINCT user_id) AS ids, true AS close FROM events GROUP BY ALL
    UNION ALL SELECT 'all', strftime(ts, '%Y-%m'), count(DISTINCT user_id), true FROM events GROUP BY ALL
    UNION ALL SELECT event_type, 'all', count(DISTINCT user_id), true FROM events GROUP BY ALL
    """
)
def distinct_by_period(spark, d):
    """Distinct users of each kind and month, of each month and of each kind, from sketches of days that three batches
    added, one of them twice; next to the exact number, whether the estimate is within 5 % of it."""
    events = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.to_date("ts").alias("day"), "user_id", "event_id")
    days = fnd.DistinctTable(spark, work_path(spark, "sketches"), ["kind"])
    for part in (0, 1, 2, 0):
        days.add(events.where(F.col("event_id") % 3 == part), "user_id")
    month = F.date_format("day", "yyyy-MM")
    every = F.lit("all")
    estimates = [
        days.count(period=month, out="estimate"),
        days.count(by=[], period=month, out="estimate").withColumn("kind", every),
        days.compact(work_path(spark, "sketches")).count(out="estimate").withColumn("period", every),
    ]
    exact = [
        events.groupBy("kind", month.alias("period")),
        events.groupBy(every.alias("kind"), month.alias("period")),
        events.groupBy("kind", every.alias("period")),
    ]
    columns = ["kind", "period"]
    found = estimates[0].unionByName(estimates[1]).unionByName(estimates[2])
    counts = [e.agg(F.count_distinct("user_id").alias("ids")) for e in exact]
    counts = counts[0].unionByName(counts[1]).unionByName(counts[2])
    close = F.abs(F.col("estimate") - F.col("ids")) <= 1 + 0.05 * F.col("ids")
    return counts.join(found, columns, "full").select(*columns, "ids", close.alias("close"))


@query(r"SELECT nullif(regexp_extract(p_brand, '(Brand#\d+)', 1), '') AS brand, count(*) AS occurrences FROM part GROUP BY 1")
def findings_id_counts(spark, d):
    return fnd.id_counts(fnd.extract_id(table(spark, d, "part"), "p_brand", r"(Brand#\d+)", "brand"), "brand")


@query(
    """
    SELECT source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS real,
           count(*) FILTER (WHERE quality = 1) / count(*) AS ratio
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
    """
)
def findings_adjudicated(spark, d):
    judged = fnd.adjudicate(
        table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"]
    )
    return fnd.real_ratio(judged, ["source"], F.col("quality") == 1)


def _flags(spark, d):
    """Verdict text per document: padded YES/NO for labelled ones, another word otherwise."""
    judged = fnd.adjudicate(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])
    flag = F.when(F.col("quality") == 1, " YES\n").when(F.col("quality") == 0, "NO ").otherwise("unlabelled")
    return judged.select("doc_id", flag.alias("flag"))


@query(
    """
    SELECT CASE quality WHEN 1 THEN 'YES' ELSE 'NO' END AS flag, count(*) AS n
    FROM documents JOIN labels USING (doc_id) GROUP BY 1
    """
)
def verdict_tally(spark, d):
    return fnd.verdict_tally(fnd.validated_flag(_flags(spark, d), "flag")[0], "flag")


@query("SELECT doc_id, 'unlabelled' AS flag FROM documents ANTI JOIN labels USING (doc_id)")
def verdict_rejected(spark, d):
    return fnd.validated_flag(_flags(spark, d), "flag")[1]


@query(
    r"""
    WITH b AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t,
                      regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a FROM pages)
    SELECT page_id, CASE WHEN t <> '' AND a <> '' THEN t ELSE '' END AS title,
           md5(CASE WHEN t <> '' AND a <> '' THEN a ELSE '' END) AS article_md5
    FROM b
    """
)
def tagged_title(spark, d):
    blocks = fnd.tagged_blocks(table(spark, d, "pages"), "html", {"title": "title", "article": "article"})
    return blocks.select("page_id", "title", F.md5("article").alias("article_md5"))


@query(
    r"""
    SELECT page_id, md5(trim(trim(regexp_replace(regexp_replace(html, '^(?:<!DOCTYPE html>)+', ''),
               '^(?:<html lang="en">)+', ''), '`'), chr(10))) AS code_md5,
           regexp_replace(url, '^(?:https://)+', '') AS ident
    FROM pages
    """
)
def cleaned_text(spark, d):
    pages = table(spark, d, "pages")
    return pages.select(
        "page_id",
        F.md5(clean_code(F.col("html"), "!DOCTYPE html", '<html lang="en">')).alias("code_md5"),
        F.regexp_replace("url", "^(?:https://)+", "").alias("ident"),
    )


@query(
    r"""
    SELECT doc_id, regexp_replace('<CWE-ID><CWE-ID>CWE-' || doc_id || ' in ' || source, '^(?:<CWE-ID>)+', '') AS ident,
           doc_id AS cwe_no
    FROM documents
    """
)
def cleaned_ids(spark, d):
    logged = table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("<CWE-ID><CWE-ID>CWE-"), F.col("doc_id").cast("string"), F.lit(" in "), F.col("source")).alias("cweID"),
    )
    return logged.select(
        "doc_id", clean_id(F.col("cweID")).alias("ident"), extract_number(F.col("cweID")).alias("cwe_no")
    )
