"""Crawl-shaped tables derived from the driver's tables.

One text serves Spark and DuckDB; two tokens differ. It ends up behind ``WITH``.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .session import use_utc

TEXT = r"""
ev AS (
  SELECT event_id, user_id, event_type, event_id % 3 AS x,
    CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k, {{US}} AS us,
    (SELECT count(*) FROM pages) AS n
  FROM events),
seeds AS (
  SELECT page_id,
    CASE WHEN page_id % 7 = 0 THEN replace(u, '.example.com', '.example.us')
         WHEN page_id % 11 = 0 THEN replace(u, '.example.com', '.example.ch') ELSE u END AS url
  FROM (SELECT page_id, replace(replace(url, '.example.org', '.example.uk'), '.example.net', '.example.de') AS u
        FROM pages) p0),
raw_requests AS (
  SELECT
    CASE ev.x WHEN 0 THEN 'chromiumnocookies_e0' WHEN 1 THEN 'firefoxwithcookies_e1'
              ELSE 'chromiumwithcookies_e2' END AS experiment_id,
    CAST(ev.event_id AS STRING) AS request_id,
    concat('w', CAST(ev.user_id % 25 AS STRING)) AS worker_id,
    concat('s', CAST(ev.x AS STRING), '_', CAST(ev.user_id AS STRING), '_',
           CASE WHEN ev.k % 4 = 0 THEN '1' ELSE '0' END) AS crawl_session_id,
    sd.url AS crawled_url,
    tg.url AS current_page_url,
    CASE WHEN ev.k % 3 = 0 THEN sd.url ELSE tg.url END AS url,
    sd.url AS frame_url,
    CASE ev.event_type WHEN 'view' THEN 'document' WHEN 'click' THEN 'script'
         WHEN 'signup' THEN 'xhr' WHEN 'purchase' THEN 'image' ELSE 'other' END AS resource_type,
    concat(CAST(us {{DIV}} 1000000 AS STRING), '.', lpad(CAST(us % 1000000 AS STRING), 6, '0')) AS timestamp,
    CAST((ev.k {{DIV}} 3) % 3 AS INTEGER) AS crawl_depth,
    ev.k AS k
  FROM ev
  JOIN seeds sd ON sd.page_id = ev.user_id % ev.n
  JOIN seeds tg ON tg.page_id = (ev.user_id * 13 + ev.k % 12) % ev.n),
raw_responses AS (
  SELECT experiment_id, request_id, crawl_session_id, crawled_url, url,
    CASE WHEN k < 70 THEN 200 WHEN k < 80 THEN 301 WHEN k < 90 THEN 403 WHEN k < 95 THEN 404 ELSE 503 END AS status,
    timestamp, crawl_depth
  FROM raw_requests WHERE k % 10 <> 9),
raw_consents AS (
  SELECT experiment_id, crawl_session_id, crawled_url, current_page_url AS url, timestamp, crawl_depth
  FROM raw_requests WHERE resource_type = 'xhr' AND experiment_id <> 'chromiumnocookies_e0' AND k % 2 = 0),
raw_site_metadata AS (
  SELECT experiment_id, crawl_session_id, min(timestamp) AS timestamp,
    concat('desc ', min(crawled_url)) AS description
  FROM raw_requests WHERE resource_type = 'document' AND k % 7 <> 0
  GROUP BY experiment_id, crawl_session_id),
raw_worker_metadata AS (
  SELECT w.experiment_id, w.worker_id,
    CASE WHEN w.age > 0 THEN 'XX' WHEN n.n_regionkey = 0 THEN 'DE' WHEN n.n_regionkey = 1 THEN 'US'
         WHEN n.n_regionkey = 2 THEN 'NL' WHEN n.n_regionkey = 3 THEN 'AT' ELSE 'FR' END AS country_code,
    n.n_regionkey <> 4 AS is_residential,
    CAST(1704067200 + n.n_nationkey - w.age AS DOUBLE) AS timestamp
  FROM (SELECT DISTINCT experiment_id, worker_id, 0 AS age FROM raw_requests WHERE worker_id <> 'w24'
        UNION ALL SELECT DISTINCT experiment_id, worker_id, 100 AS age FROM raw_requests WHERE worker_id <> 'w24') w
  JOIN nation n ON w.worker_id = concat('w', CAST(n.n_nationkey AS STRING))),
metadata AS (
  SELECT 'chromiumnocookies_e0' AS exp_id, 200 AS total_urls, FALSE AS auto_accept_cookies, TRUE AS navigate_subpages,
         'chromium' AS browser_type, FALSE AS headless
  UNION ALL SELECT 'firefoxwithcookies_e1', 200, TRUE, TRUE, 'firefox', FALSE
  UNION ALL SELECT 'chromiumwithcookies_e2', 200, TRUE, TRUE, 'chromium', FALSE
  UNION ALL SELECT 'webkitempty_e3', 200, TRUE, FALSE, 'webkit', TRUE),
tranco AS (
  SELECT CAST(min(page_id) * 400 + 1 AS INTEGER) AS tranco_rank,
    regexp_extract(url, '^https?://(?:www[.])?([^:/]+)', 1) AS domain
  FROM seeds WHERE page_id % 5 <> 0 GROUP BY 2),
countries AS (
  SELECT CASE n_nationkey WHEN 0 THEN '.de' WHEN 1 THEN '.uk,.gb' WHEN 2 THEN '.ch' WHEN 3 THEN '.us'
           ELSE concat('.X', CAST(n_nationkey AS STRING), ',.y', CAST(n_nationkey AS STRING)) END AS tld,
    CASE WHEN n_nationkey < 3 THEN 'Europe' WHEN n_nationkey = 3 THEN 'Americas' ELSE 'Asia' END AS region,
    concat('Part ', CAST(n_regionkey AS STRING)) AS subregion,
    CASE n_nationkey WHEN 0 THEN 'DE' WHEN 1 THEN 'GB' WHEN 2 THEN 'CH' WHEN 3 THEN 'US' WHEN 4 THEN 'FR' ELSE 'ZZ' END AS cca2
  FROM nation),
queue_depths AS (
  SELECT concat('crawl.urls.', CASE WHEN experiment_id = 'firefoxwithcookies_e1' THEN 'firefox' ELSE 'chromium' END,
                CASE WHEN k % 2 = 0 THEN '.headed.' ELSE '.headless.' END, experiment_id) AS subject,
    count(DISTINCT crawl_session_id) AS pending
  FROM raw_requests WHERE experiment_id <> 'chromiumwithcookies_e2' GROUP BY 1
  UNION ALL
  SELECT 'other.queue' AS subject, count(*) AS pending FROM nation),
object_keys AS (
  SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('experiment=exp', CAST(o_custkey AS STRING), '/metadata.json')
              WHEN o_orderkey % 3 = 1 THEN concat('experiment=exp', CAST(o_custkey AS STRING), '/data_type=requests/a.parquet')
              ELSE 'notes/plan.md' END AS key
  FROM orders),
ip_reports AS (
  SELECT concat('w', CAST(c_custkey AS STRING)) AS worker_id, CAST(c_custkey AS DOUBLE) AS timestamp,
    CASE WHEN c_custkey % 97 = 0 THEN 'not json' ELSE concat('{"ip": "192.0.2.1", "location": {"country_code": "C',
      CAST(c_nationkey AS STRING), '"}, "risk": {"is_vpn": ', CASE WHEN c_custkey % 31 = 0 THEN 'true' ELSE 'false' END,
      ', "is_proxy": ', CASE WHEN c_custkey % 37 = 0 THEN 'true' ELSE 'false' END,
      ', "is_datacenter": ', CASE WHEN c_mktsegment = 'MACHINERY' THEN 'true' ELSE 'false' END, '}}') END AS report
  FROM customer),
browser_events AS (
  SELECT CASE WHEN k % 19 = 0 THEN NULL ELSE experiment_id END AS experiment, worker_id, 'requests' AS data_type,
    concat('{"request_id": "', request_id, '", "crawl_session_id": "', crawl_session_id, '", "timestamp": ', timestamp,
      ', "crawled_url": "', crawled_url, '", "current_page_url": "', current_page_url, '", "url": "', url, '", ',
      CASE WHEN k % 5 = 0 THEN '' ELSE concat('"frame_url": "', frame_url, '", ') END,
      '"resource_type": "', resource_type, '", "method": "GET", "headers": {"accept": "*/*", "x-k": "', CAST(k AS STRING),
      '"}, "crawl_depth": ', CAST(crawl_depth AS STRING), '}') AS event
  FROM raw_requests
  UNION ALL
  SELECT experiment_id, 'w', 'responses',
    concat('{"request_id": "', request_id, '", "crawl_session_id": "', crawl_session_id, '", "crawled_url": "', crawled_url,
      '", "url": "', url, '", "status": ', CAST(CASE WHEN k < 70 THEN 200 ELSE 404 END AS STRING),
      ', "headers": {"server": "s"}, "set_cookie": ["a=1", "k=', CAST(k AS STRING), '"], "timing": {',
      CASE WHEN k % 4 = 0 THEN '' ELSE concat('"startTime": ', CAST(k AS STRING), '000.5, ') END,
      '"responseStart": 789.0}, "crawl_depth": ', CAST(crawl_depth AS STRING), '}')
  FROM raw_requests WHERE k % 10 <> 9
  UNION ALL
  SELECT experiment_id, 'w', 'cookie_warning_consents',
    concat('{"crawl_session_id": "', crawl_session_id, '", "crawled_url": "', crawled_url, '", "url": "', url,
      '", "timestamp": 1704067', lpad(CAST(k AS STRING), 6, '0'), ', "crawl_depth": ', CAST(crawl_depth AS STRING), '}')
  FROM raw_requests WHERE resource_type = 'xhr' AND k % 2 = 0
  UNION ALL
  SELECT experiment_id, 'w', 'site_metadata',
    concat('{"crawl_session_id": "', crawl_session_id, '", "timestamp": "', timestamp, '", "description": "about ', crawled_url, '"}')
  FROM raw_requests WHERE resource_type = 'document' AND k % 7 <> 0),
consent_pages AS (
  SELECT page_id, url,
    concat(html, CASE page_id % 8
      WHEN 0 THEN '<button class="x">Accept   <b>All</b></button><button>OK</button>'
      WHEN 1 THEN '<a href="/x">accept all</a><a href="#" >Alle Cookies zulassen</a>'
      WHEN 2 THEN '<button disabled>accept</button><input type="submit" value="I Agree">'
      WHEN 3 THEN '<div role="button" aria-label="Tout accepter"></div>'
      WHEN 4 THEN '<button>unacceptable</button>'
      WHEN 5 THEN '<button aria-hidden="true">ok</button><a target="_blank" href="#">ok</a>'
      WHEN 6 THEN '<button>ok</button><button>please accept cookies now</button>'
      ELSE '' END) AS html
  FROM pages),
described_pages AS (
  SELECT page_id, url, page_id % 2 AS crawl_depth,
    CASE page_id % 4 WHEN 0 THEN replace(html, '</head>', concat('<meta name="description" content="About ', url, ' &amp; more"></head>'))
      WHEN 2 THEN replace(html, '</head>', concat('<meta content=''', repeat('x', 600), ''' name="description"/><meta name="description" content="second"></head>'))
      ELSE html END AS html
  FROM pages),
site_links AS (
  SELECT p.url AS url, q.url AS link
  FROM (SELECT url, (page_id * 13 + 1) % n AS target FROM (SELECT page_id, url, (SELECT count(*) FROM pages) AS n FROM pages) a
        UNION ALL
        SELECT url, (page_id * 7 + 2) % n AS target FROM (SELECT page_id, url, (SELECT count(*) FROM pages) AS n FROM pages) b
        UNION ALL
        SELECT url, (page_id + 5) % n AS target FROM (SELECT page_id, url, (SELECT count(*) FROM pages) AS n FROM pages) c) p
  JOIN pages q ON q.page_id = p.target)
"""
# columns the derived tables use, so that no file is opened to find a schema
DRIVER_TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
}
# rules of the labelling fixture, one list each
FILTER_LISTS = {
    "easylist": ["! title", "||spam-farm.example.uk^", "||blog.tionsh.example.de^", "@@||blog.tionsh.example.de^$image", "##.ad"],
    "easyprivacy": ["utm_source=feed", "||example.us^$script"],
}


def duckdb_text() -> str:
    return "WITH " + TEXT.replace("{{US}}", "epoch_us(ts)").replace("{{DIV}}", "//").strip()


def _tables() -> dict[str, str]:
    """The text by derived table."""
    parts = re.split(r"(?m)^(\w+) AS \(", TEXT.replace("{{US}}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("{{DIV}}", "div"))
    return {name: "(" + body.strip().rstrip(",") for name, body in zip(parts[1::2], parts[2::2])}


def _needed(name: str, tables: dict[str, str], found: list[str]) -> list[str]:
    """Tables a derived table rests on, itself last."""
    for other in tables:
        if other not in found and other != name and re.search(rf"\b(?:FROM|JOIN) {other}\b", tables[name]):
            _needed(other, tables, found)
    if name not in found:
        found.append(name)
    return found


class Fixture:
    """The derived tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        use_utc(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self.tables = _tables()
        self.steps: dict[str, DataFrame] = {}  # stored steps of one query
        self.tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]

    def source(self, table: str) -> DataFrame:
        return self.spark.read.schema(DRIVER_TABLES[table]).parquet(f"{self.sf_dir}/{table}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        wanted = _needed(name, self.tables, [])
        text = ", ".join(f"{n} AS {self.tables[n]}" for n in wanted)
        for table in DRIVER_TABLES:
            text, uses = re.subn(rf"\b(FROM|JOIN) {table}\b", rf"\1 {table}_{self.tag}", text)
            if uses:
                self.source(table).createOrReplaceTempView(f"{table}_{self.tag}")
        return self.spark.sql(f"WITH {text} SELECT * FROM {name}")
