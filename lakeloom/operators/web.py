"""Parsers for captured web pages: title, host, links, article text, entities, canonical address.

Regular expressions, not XML: real pages leave tags open, and scripts contain markup in strings.
Missing parts give an empty string or no rows; a null page gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.plans.registry import Registry
from lakeloom.sources.tables import table

registry = Registry()

#: Named entities that are decoded; the ampersand comes last, so nothing is decoded twice.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))


def decoded(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def article_text(html: Column) -> Column:
    """Text of the article: scripts and comments go first, tags become spaces, then blanks are folded."""
    body = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    body = F.regexp_replace(body, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    body = decoded(F.regexp_replace(body, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(body, r"[ \t\n\r]+", " "))


def canonical(url: Column) -> Column:
    """Lower-case host without its mobile prefix; no query, fragment or closing slash."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1), r"/+$", "")
    return F.concat(F.lit("https://"), F.regexp_replace(host(url), r"^(m|www)\.", ""), path)


@registry.query("w1_page_title", "SELECT page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1) AS title FROM pages")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", title(F.col("html")).alias("title"))


@registry.query("w2_url_host", "SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", host(F.col("url")).alias("host"))


@registry.query("w3_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS link FROM pages")
def links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
    return table(spark, d, "pages").select("page_id", F.explode(found).alias("link"))


@registry.query(
    "w4_article_text",
    r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1),
    '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
  '[ \t\n\r]+', ' ', 'g')) AS text FROM pages
""",
)
def article(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", article_text(F.col("html")).alias("text"))


@registry.query(
    "w5_footer_entities",
    r"""
SELECT page_id, replace(replace(replace(regexp_extract(html, '(?s)<footer[^>]*>(.*?)</footer>', 1), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS footer FROM pages
""",
)
def footer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", decoded(F.regexp_extract("html", r"(?is)<footer[^>]*>(.*?)</footer>", 1)).alias("footer"))


@registry.query(
    "w6_canonical_url",
    r"""
SELECT page_id, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^(m|www)\.', '')
       || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '') AS canonical FROM pages
""",
)
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", canonical(F.col("url")).alias("canonical"))
