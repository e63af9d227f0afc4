"""S7-S9, K12, A2, A16, A17, P10, P14, T5, T6, F20, F21 over pages, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.catalog.registry import query, table
from reviewlake.functions.labels import season
from reviewlake.operators import frontier
from reviewlake.operators.metrics import crawl_report
from reviewlake.sources.html import (
    Field,
    Pick,
    Picked,
    attribute_of,
    cards_to_bronze,
    extract_cards,
    extract_fields,
    nested_text,
    read_cards,
)

_CARD = r"<li>.*?</li>"
_CARD_FIELDS = [
    Field("href", (r'<a href="([^"]*)"',), "No Link"),
    Field("label", (r"<a[^>]*>([^<]*)</a>",), "No Label"),
    Field("rating", (r'data-rating="([^"]*)"', r"<em>([^<]*)</em>"), "No Rating"),
]


@query(
    "page_field_extract",
    f"""WITH cards AS (SELECT page_id, unnest(l) AS card, unnest(generate_series(0, len(l) - 1))::INTEGER AS card_no
  FROM (SELECT page_id, regexp_extract_all(html, '{_CARD}') AS l FROM pages))
SELECT page_id, card_no,
  coalesce(nullif(trim(regexp_extract(card, '<a href="([^"]*)"', 1)), ''), 'No Link') AS href,
  coalesce(nullif(trim(regexp_extract(card, '<a[^>]*>([^<]*)</a>', 1)), ''), 'No Label') AS label,
  'No Rating' AS rating FROM cards""",
)
def page_field_extract(spark, sf_dir):
    return extract_cards(table(spark, sf_dir, "pages"), "html", _CARD, _CARD_FIELDS, ["page_id"])


_PAGE_FIELDS = [
    Field("heading", (r'<meta property="og:title" content="([^"]*)"', r"<h2>([^<]*)</h2>", r"<h1>([^<]*)</h1>")),
    Field("language", (attribute_of("html", "lang"),), "Unknown"),
    Field("author", (r'<meta name="author" content="([^"]*)"', r"<address>([^<]*)</address>"), "No Name"),
]


@query(
    "page_field_fallback",
    """SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<meta property="og:title" content="([^"]*)"', 1)), ''),
  nullif(trim(regexp_extract(html, '<h2>([^<]*)</h2>', 1)), ''),
  nullif(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '')) AS heading,
  coalesce(nullif(trim(regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1)), ''), 'Unknown') AS language,
  coalesce(nullif(trim(regexp_extract(html, '<meta name="author" content="([^"]*)"', 1)), ''),
  nullif(trim(regexp_extract(html, '<address>([^<]*)</address>', 1)), ''), 'No Name') AS author FROM pages""",
)
def page_field_fallback(spark, sf_dir):
    fields = extract_fields(table(spark, sf_dir, "pages"), "html", _PAGE_FIELDS)
    return fields.select("page_id", "heading", "language", "author")


@query(
    "page_nested_text",
    """SELECT page_id, nullif(trim(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1)), '') AS notice
FROM pages""",
)
def page_nested_text(spark, sf_dir):
    return nested_text(table(spark, sf_dir, "pages"), "page_id", "html", "class", "ad", "notice")


def _sql_shown(c: str) -> str:
    """What a reader sees of inline text: entities decoded, blanks collapsed."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(
    "page_nested_fields",
    f"""WITH cut AS (SELECT page_id, html, split_part(split_part(html, '<nav>', 2), '</nav>', 1) AS nav,
  split_part(split_part(html, '<h1>', 2), '</h1>', 1) AS h1 FROM pages WHERE contains(html, '<html'))
SELECT page_id, 0::INTEGER AS card_no, split_part(split_part(html, ' lang="', 2), '"', 1) AS language,
  coalesce(nullif(array_to_string(list_filter(list_transform(string_split(nav, '<li>')[2:], lambda x:
    {_sql_shown("split_part(split_part(x, '>', 2), '<', 1)")}), lambda x: x <> ''), chr(10)), ''), '') AS menu,
  {_sql_shown('h1')} AS heading, 'No Author' AS author FROM cut""",
)
def page_nested_fields(spark, sf_dir):
    fields = [
        Picked("menu", (Pick("nav"),), ""),
        Picked("heading", (Pick("h1"),), ""),
        Picked("author", (Pick("span", "class", "author"),), "No Author"),
    ]
    page = [Picked("language", (Pick("html", take="lang"),), "")]
    return read_cards(table(spark, sf_dir, "pages"), "html", ["page_id"], Pick("html"), fields, page)


# A page of cards around the stand-in page's first link and heading, with markup inside them.
_CARD_PAGE = (
    "<nav aria-label='Breadcrumb'><a class=\"x breadcrumb\">City <b>", "</b></a></nav>"
    '<div data-testid="review-card"><div class="b08850ce41 f546354b44"><span></span><i>', "</i></div>"
    "<div class='b99b6ef58f d14152e7c3'><span>Great</span> ", " &amp; pool<br>near <b>beach</b></div></div>"
)


@query(
    "bronze_from_pages",
    """SELECT 'City ' || (page_id % 7) AS city, url AS hotel_name, 'R' || page_id AS reviewer_name,
  'Unknown Nationality' AS reviewer_nationality, 'No Type' AS travel_type,
  'Great <' || (page_id % 5) || '> & pool' || chr(10) || 'near beach' AS positive_review,
  'No Negative Feedback' AS negative_review, TRUE AS has_id, 13::INTEGER AS n_columns FROM pages""",
)
def bronze_from_pages(spark, sf_dir):
    number = lambda n: (F.col("page_id") % n).cast("string")
    head, name, text, end = (F.lit(part) for part in _CARD_PAGE)
    html = F.concat(
        head, number(7), name, F.lit("R"), F.col("page_id").cast("string"), text, F.lit("&lt;"), number(5), F.lit("&gt;"), end
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))
    bronze = cards_to_bronze(pages, "page_id", "html", "url")
    return bronze.select(
        "city", "hotel_name", "reviewer_name", "reviewer_nationality", "travel_type", "positive_review", "negative_review",
        F.col("id").isNotNull().alias("has_id"), F.lit(len(bronze.columns)).alias("n_columns"),
    )


_SQL_LINKS = """links AS (SELECT url AS link, html,
  CASE page_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_scraped FROM pages)"""
_SQL_OUTCOMES = """outcomes AS (SELECT link, contains(html, '<h2>') OR contains(html, 'lang="en"') AS ok
  FROM links WHERE NOT coalesce(is_scraped, FALSE))"""


def _links(spark, sf_dir):
    flag = F.when(F.col("page_id") % 3 == 0, True).when(F.col("page_id") % 3 == 1, False)
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("link"), flag.alias("is_scraped"), "html"
    )


def _outcomes(links):
    ok = F.col("html").contains("<h2>") | F.col("html").contains('lang="en"')
    return frontier.pending_links(links).select("link", ok.alias("ok"))


@query(
    "frontier_pending",
    f"WITH {_SQL_LINKS} SELECT link FROM links WHERE is_scraped = FALSE OR is_scraped IS NULL",
)
def frontier_pending(spark, sf_dir):
    return frontier.pending_links(_links(spark, sf_dir)).select("link")


@query(
    "frontier_mark_done",
    f"""WITH {_SQL_LINKS}, {_SQL_OUTCOMES}
SELECT l.link, CASE WHEN o.ok THEN TRUE ELSE l.is_scraped END AS is_scraped,
  CASE WHEN o.ok THEN 'done' WHEN NOT o.ok THEN 'failed' END AS status
FROM links l LEFT JOIN outcomes o ON o.link = l.link""",
)
def frontier_mark_done(spark, sf_dir):
    links = _links(spark, sf_dir)
    return frontier.mark_done(links.drop("html"), _outcomes(links))


@query(
    "crawl_statistics",
    f"""WITH {_SQL_LINKS}
SELECT (SELECT count(*) FROM events WHERE ts::DATE = DATE '2024-01-20') AS reviews_today,
  (SELECT count(*) FROM events) AS total_reviews, count(*) FILTER (is_scraped) AS scraped_hotels,
  count(*) AS total_hotels, count(*) FILTER (is_scraped = FALSE OR is_scraped IS NULL) AS unscraped_hotels,
  round(count(*) FILTER (is_scraped) / count(*) * 100, 6) AS completion_rate FROM links""",
)
def crawl_statistics(spark, sf_dir):
    stats = frontier.crawl_statistics(
        table(spark, sf_dir, "events"), _links(spark, sf_dir), scraped_at="ts", day=F.lit("2024-01-20")
    )
    return stats.withColumn("completion_rate", F.round("completion_rate", 6))


_SQL_OUTCOME = """tried AS (SELECT count(ok) AS processed, count(*) FILTER (NOT ok) AS failed FROM outcomes)"""


@query(
    "session_outcome",
    f"""WITH {_SQL_LINKS}, {_SQL_OUTCOMES}, {_SQL_OUTCOME}
SELECT processed, failed, processed - failed AS successful,
  round((processed - failed) / processed * 100, 6) AS success_rate FROM tried""",
)
def session_outcome(spark, sf_dir):
    outcome = frontier.session_outcome(_outcomes(_links(spark, sf_dir)), "ok")
    return outcome.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "crawl_report",
    f"""WITH {_SQL_LINKS}, {_SQL_OUTCOMES}, {_SQL_OUTCOME}
SELECT (SELECT count(*) FROM links) AS total_hotels, processed, failed,
  round((processed - failed) / processed * 100, 6) AS success_rate,
  (SELECT count(*) FROM events) AS total_reviews,
  CASE WHEN failed = 0 THEN 'SUCCESS' ELSE 'PARTIAL SUCCESS' END AS status FROM tried""",
)
def crawl_report_query(spark, sf_dir):
    links = _links(spark, sf_dir)
    report = crawl_report(
        frontier.session_outcome(_outcomes(links), "ok"), table(spark, sf_dir, "events"), links
    )
    return report.withColumn("success_rate", F.round("success_rate", 6))


@query(
    "limit_per_key",
    """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3""",
)
def limit_per_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return frontier.limit_per_key(events, "user_id", 3, F.asc("ts"), F.asc("event_id")).drop("ts")


@query(
    "hash_sample",
    "SELECT event_id, user_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 100",
)
def hash_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return frontier.shuffled_limit(events, "event_id", 100, seed=42)


_SQL_SEASON = """CASE quarter(o_orderdate) WHEN 1 THEN 'Dec-Feb' WHEN 2 THEN 'Mar-May'
  WHEN 3 THEN 'Jun-Aug' WHEN 4 THEN 'Sep-Nov' END"""


def _seasons(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        season(F.col("o_orderdate")).alias("season"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
    )


@query(
    "season_rollup",
    f"""SELECT {_SQL_SEASON} AS season, count(*) AS orders,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY 1""",
)
def season_rollup(spark, sf_dir):
    seasons = _seasons(spark, sf_dir).groupBy("season")
    return seasons.agg(F.count("*").alias("orders"), F.sum("price").cast("double").alias("total"))


@query(
    "season_filter",
    f"SELECT o_orderkey, {_SQL_SEASON} AS season FROM orders WHERE quarter(o_orderdate) = 2",
)
def season_filter(spark, sf_dir):
    return frontier.filter_season(_seasons(spark, sf_dir), "season", "mar-may").select("o_orderkey", "season")


@query(
    "season_filter_partial",
    f"SELECT o_orderkey, {_SQL_SEASON} AS season FROM orders WHERE quarter(o_orderdate) IN (2, 3)",
)
def season_filter_partial(spark, sf_dir):
    # No season is called May-Jun; its two ends match two seasons.
    return frontier.filter_season(_seasons(spark, sf_dir), "season", "May-Jun").select("o_orderkey", "season")
