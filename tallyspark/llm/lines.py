"""Dropping lines that many pages of the same site share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, packed, read, resting, unpacked

#: A line is boilerplate if more than this share of its site's pages hold it, and at least so many pages.
RATIO = 0.1
MIN_PAGES = 3
#: Sites of over one in MOST_HOT_SITES of all pages are dealt to several tasks, SITE_TASKS at most.
MOST_HOT_SITES, SITE_TASKS = 1000, 200
OUTPUTS = ["kept_text", "n_lines", "n_dropped"]
#: The tags that end a line of a web page, and any other tag.
BLOCK_TAG = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|article|section|title|body|head|nav|footer|header|script|style|table|tr|td)\b[^>]*>"
ANY_TAG = r"<[^>]*>"
BLANKS = " \t\r"


def host(url: Column) -> Column:
    """The host part of a URL, in lower case; empty if there is none, null for null."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def page_text(html: Column) -> Column:
    """A web page's text, a line for each block."""
    return F.regexp_replace(F.regexp_replace(html, BLOCK_TAG, "\n"), ANY_TAG, "")


def dedup_lines(df: DataFrame, *, site: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, alike: DataFrame | None = None) -> DataFrame:
    """`df` with kept_text (the lines left, joined again), n_lines and n_dropped (of lines that are not blank).

    A line (without blanks at its ends) is dropped from all pages of a site if over `ratio` of the site's pages, and at
    least `min_pages`, hold it, counted once a page: with the ratio alone (`min_pages` 1) every line of a site of a few pages
    would go. Blank lines stay. Null text: null, 0 and 0. Null sites are one site. An empty table gives an empty result.
    Repeated rows count as pages of their own, unless `alike` (doc_id, text_key, page; each pair of the first two once) names
    their page: rows of `df` (its doc_id, the MD5 of its text) of the same page then count as one, here and in the site's
    pages, and a line counts if any of them holds it; `alike` is not read later. Input columns named as an output are replaced; others clash with nothing.

    Pages are counted by 64-bit line hashes with map-side sums, so neither a hot site nor a hot line meets in one task.
    A site has at most (mean lines a page) / ratio boilerplate lines, so its list of them is bounded; those lists join the
    pages by site, broadcast only if Spark finds the written table small enough. Else sites of over a thousandth of all
    pages (a thousand of them at most, which bounds their broadcast) are dealt to several tasks, with a copy of their list each.
    """
    bare = lambda line: F.trim(line, F.lit(BLANKS))
    hashed = lambda lines: F.transform(F.filter(F.transform(lines, bare), lambda x: x != ""), lambda x: F.xxhash64(x))
    split = {"site": site, "lines": F.split(text, "\n")}
    seen = df.select(site.alias("site"), F.array_distinct(hashed(F.split(text, "\n"))).alias("h"))
    counted, lines = df.select(site.alias("site")), seen.select("site", F.explode("h").alias("h"))
    if alike is not None:
        hashes = materialize(df.select(site.alias("site"), F.array_distinct(hashed(F.split(text, "\n"))).alias("h"), F.col("doc_id").alias("id"), F.md5(text.cast("binary")).alias("digest")))  # no text is shuffled
        seen = materialize(hashes.join(alike, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("digest").eqNullSafe(F.col("text_key"))).select("site", "page", "h"))
        discard(hashes)
        counted = seen.select("site", "page").distinct()
        lines = seen.select("site", "page", F.explode("h").alias("h")).distinct()
    totals = materialize(counted.groupBy(F.col("site").alias("total_site")).agg(F.count(F.lit(1)).alias("pages")))
    everything = totals.agg(F.sum("pages")).first()[0] or 0
    tasks = F.least(F.ceil(F.col("pages") * MOST_HOT_SITES / F.lit(max(1, everything))), F.lit(SITE_TASKS)).cast("int")
    totals = resting(totals.withColumn("tasks", F.when(F.col("pages") * MOST_HOT_SITES > everything, tasks).otherwise(1)), totals)
    same = F.col("site").eqNullSafe(F.col("total_site"))
    held = lines.groupBy("site", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    common = held.join(totals, same).filter(F.col("n") > ratio * F.col("pages"))
    common = common.groupBy("site").agg(F.collect_list("h").alias("common"), F.first("tasks").alias("tasks"))
    common = materialize(common.select(F.col("site").alias("common_site"), "common", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")))
    discard(seen)  # written only where pages are alike
    hot = F.broadcast(totals.filter("tasks > 1").select("total_site", "tasks"))  # fewer than MOST_HOT_SITES rows
    base = packed(df, split).join(hot, same, "left").withColumn("own_task", F.pmod(F.xxhash64("lines"), F.coalesce("tasks", F.lit(1))).cast("int"))
    none = F.array().cast("array<bigint>")
    rows = base.join(common, F.col("site").eqNullSafe(F.col("common_site")) & (F.col("own_task") == F.col("task")), "left")
    rows = rows.withColumn("hit", F.when(F.col("common").isNull(), none).otherwise(F.array_intersect(hashed(F.col("lines")), F.col("common"))))
    kept = F.when(F.size("hit") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: (bare(x) == "") | ~F.array_contains(F.col("hit"), F.xxhash64(bare(x)))))
    rows = rows.withColumn("kept", kept)
    filled = lambda lines: F.coalesce(F.size(F.filter(lines, lambda x: bare(x) != "")), F.lit(0))
    out = {"kept_text": F.array_join("kept", "\n"), "n_lines": F.greatest(filled(F.col("lines")), F.lit(0)).cast("long"), "n_dropped": F.greatest(filled(F.col("lines")) - filled(F.col("kept")), F.lit(0)).cast("long")}
    return resting(rows.select(*unpacked(df.columns, OUTPUTS), *[c.alias(n) for n, c in out.items()]), totals, common)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without the lines of over RATIO of their host's pages (MIN_PAGES at least). Null pages: null, 0 and 0."""
    pages = read(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"), "html")
    return dedup_lines(pages, site=F.col("host"), text=page_text(F.col("html"))).drop("html")


OP2_SQL = f"""
WITH pages_text AS (
  SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(html, '{BLOCK_TAG}', chr(10), 'g'), '{ANY_TAG}', '', 'g'), chr(10)) AS ls
  FROM pages
), lines AS (
  SELECT r, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM pages_text
), bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM lines
), totals AS (SELECT host, count(*) AS pages FROM pages_text GROUP BY host
), held AS (SELECT host, b, count(DISTINCT r) AS n FROM bare WHERE b <> '' GROUP BY host, b
), common AS (
  SELECT h.host, h.b FROM held h JOIN totals t ON h.host IS NOT DISTINCT FROM t.host WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages
), judged AS (
  SELECT x.*, c.b IS NOT NULL AS gone FROM bare x LEFT JOIN common c ON x.host IS NOT DISTINCT FROM c.host AND x.b = c.b
), done AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept, count(*) FILTER (WHERE b <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped
  FROM judged GROUP BY r
)
SELECT p.page_id, p.host, CASE WHEN p.ls IS NULL THEN NULL ELSE coalesce(d.kept, '') END AS kept_text,
  coalesce(d.n_lines, 0) AS n_lines, coalesce(d.n_dropped, 0) AS n_dropped
FROM pages_text p LEFT JOIN done d ON p.r = d.r
"""
