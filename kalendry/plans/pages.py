"""Queries on quotes, addresses and redirects of pages, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kalendry.functions.text import upper_each
from kalendry.operators import quotes, redirects
from kalendry.plans.queries import query, table

_FOLD = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


@query(f"""WITH q AS (SELECT 'p' || page_id AS id, CASE page_id % 5 WHEN 0 THEN upper(substr(html, 133, 60)) WHEN 1 THEN substr(html, 700, 25) WHEN 2 THEN substr(html, 401, 9) WHEN 3 THEN replace(substr(html, 500, 80), ' ', '  ') END AS quote FROM pages
  UNION ALL SELECT 'b' || item_id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, left(text, 30) FROM documents),
f AS (SELECT id, {_FOLD.format("quote")} AS quote FROM q), t AS (SELECT page_id, {_FOLD.format("html")} AS page FROM pages)
SELECT id, page_id FROM f JOIN t ON contains(page, quote) WHERE quote <> ''""")
def quotes_on_pages(spark, sf_dir):
    """Quotes cut from pages, benchmark texts and the beginnings of documents against all pages."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 5
    cut = F.when(k == 0, upper_each(F.substring("html", 133, 60))).when(k == 1, F.substring("html", 700, 25)).when(k == 2, F.substring("html", 401, 9)).when(k == 3, F.replace(F.substring("html", 500, 80), F.lit(" "), F.lit("  ")))
    asked = p.select(F.concat(F.lit("p"), "page_id").alias("id"), cut.alias("quote"))
    asked = asked.union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id"), "text"))
    asked = asked.union(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id"), F.substring("text", 1, 30)))
    return quotes.on_pages(asked, p.select("page_id", F.col("html").alias("text")))


_NEXT = "CASE WHEN o_orderkey % 11 < 3 THEN NULL WHEN o_orderkey % 11 = 3 THEN 'http://127.0.0.1/' WHEN o_orderkey % 11 = 4 THEN 'http://a.org/' || o_orderkey WHEN o_orderkey % 11 = 5 THEN 'http://none.org/' ELSE 'http://a.org/' || (o_orderkey // 2) END"


@query(f"""WITH RECURSIVE an AS (SELECT 'http://a.org/' || o_orderkey AS url, {_NEXT} AS target FROM orders),
ch(url, place, hops) AS (SELECT url, url, 0 FROM an UNION ALL SELECT ch.url, target, hops + 1 FROM ch JOIN an ON an.url = ch.place WHERE hops < 5 AND target IS NOT NULL AND target <> 'http://127.0.0.1/'),
la AS (SELECT url, arg_max(place, hops) AS place, max(hops) AS hops FROM ch GROUP BY url)
SELECT la.url, CASE WHEN an.url IS NULL THEN 'unknown' WHEN target IS NULL THEN 'page' WHEN hops = 5 THEN 'too many' ELSE 'refused' END AS outcome, CASE WHEN an.url IS NOT NULL AND target IS NULL THEN place END AS final_url, hops
FROM la LEFT JOIN an ON an.url = la.place""")
def redirect_chains(spark, sf_dir):
    """Orders as addresses that send the reader to others: half of the key, themselves, a private host, or nowhere known."""
    k = F.col("o_orderkey")
    turn = k % 11
    half = F.floor(k / 2).cast("string")
    location = F.when(turn < 3, None).when(turn == 3, "//127.0.0.1").when(turn == 4, F.concat(F.lit("./x/../"), k.cast("string"), F.lit("#top"))).when(turn == 5, "HTTP://None.org").otherwise(F.concat(F.lit("/"), half, F.lit("/")))
    answers = table(spark, sf_dir, "orders").select(F.concat(F.lit("http://a.org/"), k.cast("string")).alias("url"), location.alias("location"))
    return redirects.followed(answers.select("url"), answers)
