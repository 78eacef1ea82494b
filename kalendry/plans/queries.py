"""The catalogue's queries over the driver's tables, each with its SQL. Orders stand in for dated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalendry.functions import deadlines as dl
from kalendry.functions import text as tx
from kalendry.operators import catalog, merge, notify, quality

_A = "TIMESTAMP '2000-06-15 12:00:00'"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def at(text: str = "2000-06-15 12:00:00"):
    """The moment that a query is asked as of."""
    return F.lit(text).cast("timestamp")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: an order that is not pending has its date as deadline."""
    o = table(spark, sf_dir, "orders")
    when = F.col("o_orderdate").cast("timestamp")
    return o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.array("o_orderpriority").alias("sub"), F.col("o_orderstatus").alias("type"), F.year(when).alias("year"), F.col("o_totalprice").alias("hindex"), F.when(F.col("o_orderstatus") != "P", when).alias("next_at"), "o_custkey")


def with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").cast("timestamp").alias("start"), F.max("l_shipdate").cast("timestamp").alias("end"))
    return orders(spark, sf_dir).join(spans, "id", "left")


_EV = "ev AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderstatus AS type, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS hindex, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS next_at, o_custkey FROM orders)"
_SPANS = "sp AS (SELECT l_orderkey AS id, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1)"
_TS = "'%Y-%m-%d %H:%M:%S'"


@query(f"WITH {_EV} SELECT id, title, strftime(next_at, {_TS}) AS next_at FROM ev WHERE next_at > {_A} ORDER BY ev.next_at, id LIMIT 5")
def upcoming_topk(spark, sf_dir):
    return catalog.upcoming(orders(spark, sf_dir), "next_at", at(), 5).select("id", "title", text_of("next_at").alias("next_at"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(regexp_replace(lower(p_name || p_brand || p_type), '\\s+', '', 'g'), 'brand#1')")
def search_normalized(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "part"), " Brand #1", "p_name", "p_brand", "p_type").select("p_partkey", "p_name")


@query(f"WITH {_EV} SELECT id, title, type, year FROM ev WHERE title IN ('1-URGENT', '2-HIGH') AND year = 1997 AND type IN ('F', 'O')")
def filter_conjunctive(spark, sf_dir):
    return catalog.narrow(orders(spark, sf_dir), ["1-URGENT", "2-HIGH"], 1997, ["F", "O"]).select("id", "title", "type", "year")


@query(f"""WITH {_EV}, {_SPANS}, j AS (SELECT ev.*, s, e, coalesce(CAST(s AS DATE), CAST(e AS DATE), make_date(year, 1, 1)) AS first_day,
  coalesce(CAST(e AS DATE), CAST(s AS DATE), make_date(year, 12, 31)) AS last_day FROM ev LEFT JOIN sp USING (id)),
t AS (SELECT *, CASE WHEN next_at > {_A} THEN 0 WHEN next_at IS NOT NULL THEN 2 WHEN CAST(last_day + 1 AS TIMESTAMP) <= {_A} THEN 3 ELSE 1 END AS tier FROM j)
SELECT id, CAST(tier AS INTEGER) AS tier,
  CAST(CASE tier WHEN 0 THEN epoch_us(next_at) WHEN 2 THEN -epoch_us(next_at) WHEN 3 THEN -datediff('day', DATE '1970-01-01', first_day) ELSE CASE WHEN s IS NULL AND e IS NULL THEN 1 ELSE 0 END END AS BIGINT) AS key1,
  CAST(CASE WHEN tier = 1 THEN CASE WHEN s IS NULL AND e IS NULL THEN year ELSE datediff('day', DATE '1970-01-01', first_day) END ELSE 0 END AS BIGINT) AS key2 FROM t""")
def tiered_sort(spark, sf_dir):
    return catalog.tiered(with_dates(spark, sf_dir), at()).select("id", "tier", "key1", "key2").orderBy("tier", "key1", "key2", "id")


@query(f"WITH {_EV} SELECT id, hindex FROM ev ORDER BY hindex DESC, id LIMIT 12 OFFSET 12")
def sort_hindex_page2(spark, sf_dir):
    return catalog.page(orders(spark, sf_dir), [F.desc("hindex"), F.asc("id")], 2).select("id", "hindex")


@query(f"WITH {_EV}, {_SPANS} SELECT id, strftime(s, {_TS}) AS start FROM ev LEFT JOIN sp USING (id) ORDER BY coalesce(s, TIMESTAMP '1970-01-01 00:00:00') DESC, id LIMIT 12")
def sort_start_desc(spark, sf_dir):
    first = F.coalesce("start", F.lit("1970-01-01").cast("timestamp"))
    return catalog.page(with_dates(spark, sf_dir), [first.desc(), F.asc("id")], 1).select("id", text_of("start").alias("start"))


@query(f"WITH {_EV} SELECT DISTINCT year FROM ev")
def facet_years(spark, sf_dir):
    return catalog.facet(orders(spark, sf_dir), F.col("year"), "year").orderBy(F.desc("year"))


@query(f"WITH {_EV} SELECT DISTINCT title AS subject FROM ev")
def facet_subjects(spark, sf_dir):
    return catalog.facet(orders(spark, sf_dir), F.explode("sub"), "subject").orderBy("subject")


@query(f"""WITH {_SPANS} SELECT o_orderkey AS id, CASE WHEN s > {_A} THEN 'Abstract Deadline' ELSE 'Paper Submission' END AS label,
  strftime(CASE WHEN s > {_A} THEN s ELSE e END, {_TS}) AS at FROM orders JOIN sp ON id = o_orderkey""")
def next_deadline(spark, sf_dir):
    both = with_dates(spark, sf_dir).where("start is not null")
    n = dl.next_deadline(dl.deadlines(F.col("start"), F.col("end")), at())
    return both.select("id", n.alias("n")).select("id", "n.label", text_of("n.at").alias("at"))


_DAYS = f"CAST(ceil((epoch_us(next_at) - epoch_us({_A})) / 86400000000.0) AS BIGINT)"


@query(f"""WITH {_EV}, d AS (SELECT id, {_DAYS} AS n FROM ev WHERE next_at IS NOT NULL)
SELECT id, n AS days_left, CASE WHEN n <= 3 THEN 'urgent' WHEN n <= 7 THEN 'soon' WHEN n <= 30 THEN 'month' ELSE 'later' END AS urgency,
 CASE WHEN n < 0 THEN 'Expired' WHEN n = 0 THEN 'Today!' WHEN n < 7 THEN n || CASE WHEN n = 1 THEN ' day' ELSE ' days' END
  WHEN n < 30 THEN (n // 7) || CASE WHEN n // 7 = 1 THEN ' week' ELSE ' weeks' END ELSE (n // 30) || CASE WHEN n // 30 = 1 THEN ' month' ELSE ' months' END END AS remaining FROM d""")
def days_left_labels(spark, sf_dir):
    n = dl.days_left(F.col("next_at"), at())
    rows = orders(spark, sf_dir).where("next_at is not null").select("id", n.alias("days_left"))
    return rows.select("id", "days_left", dl.urgency(F.col("days_left")).alias("urgency"), dl.remaining(F.col("days_left")).alias("remaining"))


@query("""WITH l AS (SELECT event_id, epoch_us(ts) // 1000000 - epoch_us(TIMESTAMP '2024-01-15 12:00:00') // 1000000 AS s FROM events)
SELECT event_id, s <= 0 AS expired, CAST(greatest(s, 0) // 86400 AS BIGINT) AS d, CAST(greatest(s, 0) % 86400 // 3600 AS BIGINT) AS h, CAST(greatest(s, 0) % 3600 // 60 AS BIGINT) AS m FROM l""")
def countdown_parts(spark, sf_dir):
    s = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - F.unix_seconds(at("2024-01-15 12:00:00"))
    left = table(spark, sf_dir, "events").select("event_id", s.alias("s")).withColumn("left", F.greatest("s", F.lit(0)))
    whole = lambda c: F.floor(c).cast("bigint")
    return left.select("event_id", (F.col("s") <= 0).alias("expired"), whole(F.col("left") / 86400).alias("d"), whole(F.col("left") % 86400 / 3600).alias("h"), whole(F.col("left") % 3600 / 60).alias("m"))


@query(f"""WITH z AS (SELECT o_orderkey AS id, o_orderdate AS t, ['AoE', 'EDT', 'BST', 'Pacific Time', 'UTC+9', 'Klingon'][1 + o_custkey % 6] AS said FROM orders)
SELECT id, said, strftime(CASE said WHEN 'AoE' THEN t + INTERVAL 12 HOUR WHEN 'EDT' THEN t + INTERVAL 4 HOUR WHEN 'BST' THEN t - INTERVAL 1 HOUR WHEN 'UTC+9' THEN t - INTERVAL 9 HOUR
  WHEN 'Pacific Time' THEN timezone('UTC', timezone('America/Los_Angeles', t)) END, {_TS}) AS at_utc FROM z""")
def zone_to_utc(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, ("AoE", "EDT", "BST", "Pacific Time", "UTC+9", "Klingon"))), (F.col("o_custkey") % 6).cast("int"))
    local = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), said.alias("said"), local.alias("local")).withColumn("zone", dl.zone_of(F.col("said")))
    return rows.select("id", "said", text_of(dl.instant(F.col("local"), F.col("zone"))).alias("at_utc"))


@query(f"WITH {_EV}, d AS (SELECT id, {_DAYS} AS days_left FROM ev WHERE next_at > {_A}) SELECT id, days_left FROM d WHERE days_left IN (30, 7, 3)")
def reminders_exact_day(spark, sf_dir):
    rows = orders(spark, sf_dir).where(F.col("next_at") > at()).select("id", dl.days_left(F.col("next_at"), at()).alias("days_left"))
    return notify.due(rows, [30, 7, 3])


@query(f"""WITH {_EV}, d AS (SELECT id, title, {_DAYS} AS days_left FROM ev WHERE next_at > {_A}),
u AS (SELECT c_custkey, CASE c_nationkey % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' WHEN 4 THEN '5-LOW' END AS subject,
  unnest(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN [30, 7, 3] ELSE [14, 1] END) AS days_left FROM customer)
SELECT c_custkey AS "user", id, d.days_left FROM u JOIN d ON u.days_left = d.days_left AND (subject IS NULL OR subject = title)""")
def user_reminders_fanout(spark, sf_dir):
    subject = F.get(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (F.col("c_nationkey") % 6).cast("int"))
    days = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.array(*map(F.lit, (30, 7, 3)))).otherwise(F.array(*map(F.lit, (14, 1)))).cast("array<bigint>")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"), subject.alias("subject"), days.alias("reminder_days"))
    rows = orders(spark, sf_dir).where(F.col("next_at") > at()).select("id", F.col("title").alias("sub"), dl.days_left(F.col("next_at"), at()).alias("days_left"))
    return notify.fan_out(users, rows)


@query(f"WITH {_SPANS}, d AS (SELECT id, CAST(ceil((epoch_us(CAST(CAST(s AS DATE) AS TIMESTAMP)) - epoch_us(TIMESTAMP '2000-06-15 00:00:00')) / 86400000000.0) AS BIGINT) AS days_left FROM sp) SELECT id, days_left FROM d WHERE days_left IN (30, 7, 0)")
def event_starts_on_days(spark, sf_dir):
    starts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").cast("timestamp").alias("start"))
    rows = starts.select("id", dl.days_left(F.date_trunc("day", "start"), F.date_trunc("day", at())).alias("days_left"))
    return notify.due(rows, [30, 7, 0])


@query("SELECT p_partkey, p_name FROM part WHERE lower(CAST(p_partkey AS VARCHAR)) = 'brand#11' OR regexp_replace(lower(p_brand), '\\s+', '', 'g') = 'brand#11' OR contains(regexp_replace(lower(p_name), '\\s+', '', 'g'), 'brand#11') ORDER BY lower(CAST(p_partkey AS VARCHAR)) = 'brand#11' DESC, p_partkey LIMIT 1")
def lookup_two_stage(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("title"), F.col("p_name").alias("full_name"), F.col("p_partkey").alias("ord"))
    return catalog.lookup(rows, "Brand#11").select(F.col("ord").alias("p_partkey"), F.col("full_name").alias("p_name"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1")
def duplicate_ids(spark, sf_dir):
    return catalog.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, rule, severity FROM customer, LATERAL (VALUES
 ('negative balance', 'E', c_acctbal < 0), ('unknown segment', 'W', c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')), ('name not lower case', 'W', c_name <> lower(c_name))) AS r(rule, severity, bad) WHERE bad
UNION ALL SELECT CAST(user_id AS VARCHAR), 'duplicate id', 'E' FROM events GROUP BY user_id HAVING count(*) > 1""")
def quality_findings(spark, sf_dir):
    rules = [("negative balance", "E", F.col("c_acctbal") < 0), ("unknown segment", "W", ~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY")), ("name not lower case", "W", F.col("c_name") != F.lower("c_name"))]
    alone = quality.findings(table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string"), rules)
    return alone.union(quality.repeated_ids(table(spark, sf_dir, "events").select(F.col("user_id").cast("string")), "user_id"))


@query(f"""WITH {_EV}, y AS (SELECT o_custkey, year, max(id) AS last_id FROM ev GROUP BY 1, 2),
p AS (SELECT o_custkey, year, lag(year) OVER w AS previous_year, lag(last_id) OVER w AS previous FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY year))
SELECT id, year, previous_year, previous FROM ev JOIN p USING (o_custkey, year)""")
def previous_edition(spark, sf_dir):
    return catalog.earlier_editions(orders(spark, sf_dir), "o_custkey", "year", "ord", "id").select("id", "year", "previous_year", "previous")


_FACTS = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL (CAST(o_orderkey % 120 AS INTEGER)) DAY WHEN o_orderkey % 3 = 1 THEN o_orderdate END"


@query(f"""WITH c AS (SELECT o_orderkey AS id, o_orderdate AS old, {_FACTS} AS new FROM orders)
SELECT id, 'deadline' AS field, strftime(old, {_TS}) AS old, strftime(new, {_TS}) AS new, id % 7 = 0 AS pinned FROM c WHERE new IS NOT NULL AND new <> old""")
def upsert_change_log(spark, sf_dir):
    return merge.change_log(*_upsert_sides(spark, sf_dir), "id", ["deadline"])


def _upsert_sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    current = o.select("id", text_of("at").alias("deadline"), F.when(F.col("id") % 7 == 0, F.array(F.lit("deadline"))).alias("sync_pin"))
    moved = F.when(F.col("id") % 3 == 0, F.col("at") + F.make_dt_interval((F.col("id") % 120).cast("int"))).when(F.col("id") % 3 == 1, F.col("at"))
    return current, o.select("id", text_of(moved).alias("deadline"))


@query(f"WITH c AS (SELECT o_orderkey AS id, o_orderdate AS old, {_FACTS} AS new FROM orders) SELECT id, CAST(round(abs(epoch_us(new) - epoch_us(old)) / 86400000000.0) AS BIGINT) AS days FROM c WHERE abs(epoch_us(new) - epoch_us(old)) / 86400000000.0 > 60")
def big_moves(spark, sf_dir):
    return merge.big_moves(merge.change_log(*_upsert_sides(spark, sf_dir), "id", ["deadline"]), ["deadline"]).select("id", "days")


def _html_sql(x: str) -> str:
    """Visible text in RE2, which has no backreference: one replacement for each hidden element."""
    for name in ("head", *(n for n in tx.HIDDEN if n != "head")):
        x = rf"regexp_replace({x}, '<{name}\b.*?</{name}\s*>', ' ', 'gis')"
    x = rf"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    x = rf"regexp_replace({x}, '</t[dh]>', ' | ', 'gi')"
    x = rf"regexp_replace({x}, '<(br|hr)\b[^>]*>|</({tx.BLOCKS})>', chr(10), 'gi')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for name, text in tx.ENTITIES:
        x = f"replace({x}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')"
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


_ANCHOR = r"""'<a\b[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a\s*>'"""


@query(rf"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, {_ANCHOR}, 1, 'is')) AS href, unnest(regexp_extract_all(html, {_ANCHOR}, 2, 'is')) AS t,
 unnest(range(len(regexp_extract_all(html, {_ANCHOR}, 1, 'is')))) AS i FROM pages),
f AS (SELECT page_id, i, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE href END AS href, trim(regexp_replace({_html_sql("t")}, '\s+', ' ', 'g')) AS text FROM l),
n AS (SELECT page_id, i, array_to_string([CASE WHEN c > '~' THEN url_encode(c) ELSE c END FOR c IN string_split(CASE WHEN regexp_matches(href, '^https?://[^/]*/$') THEN href ELSE regexp_replace(regexp_replace(href, '#.*$', ''), '/$', '') END, '')], '') AS href, text FROM f WHERE text <> '' AND regexp_matches(href, '^https?:')),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS r FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place FROM d WHERE r = 1)
SELECT page_id, href, text FROM k WHERE place <= 200""")
def extract_links(spark, sf_dir):
    found = tx.page_links(F.col("html"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("l")).select("page_id", "l.href", "l.text")


@query(r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS b, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS head FROM pages)
SELECT page_id, CASE WHEN head <> '' THEN lower(head) || CASE WHEN b[len(head) + 1:] IN ('', '/') THEN '/' ELSE regexp_replace(b[len(head) + 1:], '/$', '') END END AS url,
 CASE WHEN NOT regexp_matches(lower(b), '^https?:') THEN 'scheme' END AS refusal FROM u""")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.normal_url(F.col("url")).alias("url"), tx.url_refusal(F.col("url")).alias("refusal"))


@query("""SELECT CASE WHEN grouping(role) = 1 THEN 'all' ELSE role END AS role, CAST(sum(len(text)) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY ROLLUP (role)""")
def usage_cost(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").rollup("role").agg(F.sum(F.length("text")).alias("tokens"), F.count(F.lit(1)).alias("turns"), F.grouping("role").alias("g"))
    return by.select(F.when(F.col("g") == 1, "all").otherwise(F.col("role")).alias("role"), "tokens", "turns")


@query(f"""WITH e AS (SELECT user_id AS channel, ts, event_id, event_type = 'signup' AS joined FROM events WHERE event_type IN ('signup', 'error')),
l AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, event_id DESC) AS r FROM e) SELECT channel, strftime(ts, {_TS}) AS since FROM l WHERE r = 1 AND joined""")
def subscription_state(spark, sf_dir):
    from kalendry.streaming import subscriptions

    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    rows = e.select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "signup").alias("joined"))
    return subscriptions.active(rows).select("channel", text_of("since").alias("since"))


@query(f"""WITH {_EV}, {_SPANS} SELECT id, kind, strftime(a, {_TS}) AS start_at, strftime(b, {_TS}) AS end_at FROM ev LEFT JOIN sp USING (id),
LATERAL (VALUES ('all day', CAST(CAST(s AS DATE) AS TIMESTAMP), CAST(CAST(e AS DATE) + 1 AS TIMESTAMP)), ('submission', next_at, next_at + INTERVAL 1 HOUR)) AS k(kind, a, b) WHERE a IS NOT NULL AND b IS NOT NULL""")
def calendar_rows(spark, sf_dir):
    day = lambda c: F.date_trunc("day", c)
    rows = with_dates(spark, sf_dir)
    kinds = [("all day", day("start"), day("end") + F.expr("interval 1 day")), ("submission", F.col("next_at"), F.col("next_at") + F.expr("interval 1 hour"))]
    each = F.array_compact(F.array(*[F.when(a.isNotNull() & b.isNotNull(), F.struct(F.lit(k).alias("kind"), a.alias("a"), b.alias("b"))) for k, a, b in kinds]))
    return rows.select("id", F.explode(each).alias("k")).select("id", "k.kind", text_of("k.a").alias("start_at"), text_of("k.b").alias("end_at"))


@query("SELECT o_custkey, count(*) AS n, to_json(list(o_orderkey ORDER BY year(o_orderdate) DESC, o_orderkey)) AS newest_first FROM orders GROUP BY 1")
def nested_sort(spark, sf_dir):
    by = orders(spark, sf_dir).groupBy("o_custkey").agg(F.collect_list(F.struct((-F.col("year")).alias("y"), "id")).alias("own"))
    newest = F.concat(F.lit("["), F.concat_ws(",", F.transform(F.array_sort("own"), lambda x: x["id"].cast("string"))), F.lit("]"))
    return by.select("o_custkey", F.size("own").cast("bigint").alias("n"), newest.alias("newest_first"))
