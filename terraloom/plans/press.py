"""Feed items and table rows made of pages, and the companies that they name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import press
from ..sources import feeds
from .base import query

# A feed of two items a page, and every seventh page's second item isn't closed; a table of its links by fives.
_FEEDS = r"""SELECT page_id, concat('<rss><channel><item><title><![CDATA[', regexp_extract(html, '<title>([^<]*)</title>', 1), ']]></title><link>', url, '</link><pubDate>Mon, 01 Jan 2024 08:00:00 GMT</pubDate><content:encoded><![CDATA[', substr(html, 200, 900),
  ']]></content:encoded></item><item><title>No. ', CAST(page_id AS string), ' &amp; more&nbsp;news</title><description>', CASE WHEN page_id % 5 = 0 THEN '' ELSE 'Some &lt;b&gt; <b>short</b> &quot;text&quot;' END, CASE WHEN page_id % 7 = 0 THEN '</description><item>' ELSE '</description></item><item>' END,
  '<title>Last</title><description>end', CAST(page_id AS string), '</description></item></channel></rss>') AS xml FROM pages"""


def _clean_sql(x: str) -> str:
    out = rf"regexp_replace(regexp_replace({x}, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'), '<[^>]+>', ' ', 'g')"
    for entity, c in feeds.ENTITIES.items():
        quoted = c.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _tag_sql(name: str) -> str:
    return _clean_sql(f"regexp_extract(item, '(?s)<{name}[^>]*>(.*?)</{name}>', 1)")


_ITEMS = f"""feeds AS ({_FEEDS}), items AS (SELECT page_id, generate_subscripts(blocks, 1) - 1 AS nth, unnest(blocks) AS item FROM (SELECT page_id, regexp_extract_all(xml, '(?s)<item>(.*?)</item>', 1) AS blocks FROM feeds)),
parsed AS (SELECT page_id, nth::INT AS nth, {_tag_sql("title")} AS title, {_tag_sql("link")} AS link, substr({_tag_sql("pubDate")}, 1, 16) AS date, coalesce(nullif({_tag_sql("content:encoded")}, ''), {_tag_sql("description")}) AS body, contains(item, '<item>') AS open FROM items)"""


def _items(t):
    t.pages.createOrReplaceTempView("pages")
    return feeds.feed_items(t.spark.sql(_FEEDS.replace("\\", "\\\\")), ["page_id"], "xml")


@query("s16_feed_items", f"WITH {_ITEMS} SELECT page_id, nth, title, link, date, body, body = '' OR open AS broken FROM parsed")
def _(t):
    return _items(t)


_TABLE = r"""SELECT page_id, concat('<table><tr><th>Name</th><th>Link</th></tr>', array_join_rows, '</table>') AS html FROM (SELECT page_id, regexp_replace(html, '(?s)<li><a href="([^"]*)">([^<]*)</a></li>', '<tr class="r"><td>\2</td><td> \1 </td><td>a&amp;b</td><td><b>x</b></td><td>5</td></tr>'G) AS array_join_rows FROM pages)"""


@query("s14_five_cell_rows", "WITH tables AS (" + _TABLE.replace("'G)", "', 'g')") + f"), rows AS (SELECT page_id, generate_subscripts(r, 1) - 1 AS nth, unnest(r) AS row FROM (SELECT page_id, regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1) AS r FROM tables)), cells AS (SELECT page_id, nth, list_transform(regexp_extract_all(row, '(?is)<td[^>]*>(.*?)</td>', 1), lambda x: {_clean_sql('x')}) AS cells FROM rows) SELECT page_id, nth::INT AS nth, cells FROM cells WHERE len(cells) = 5")
def _(t):
    t.pages.createOrReplaceTempView("pages")
    tables = t.spark.sql(_TABLE.replace("'G)", "')").replace(r"\2", "$2").replace(r"\1", "$1"))
    return feeds.table_rows(tables, ["page_id"], "html")


_NAMES = r"SELECT concat('n', lower(name)) AS company, concat(CASE WHEN length(name) % 2 = 0 THEN 'The ' ELSE '' END, name, ' Ltd') AS name FROM (SELECT DISTINCT regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^([A-Z][a-z]+)', 1) AS name FROM pages) WHERE length(name) > 3"


@query("f11_press_mentions", rf"""WITH {_ITEMS}, names AS ({_NAMES}), asked AS (SELECT company, lower(regexp_extract(name, '([A-Z][a-z]+) Ltd$', 1)) AS word FROM names),
articles AS (SELECT page_id * 10 + nth AS article, title, body FROM parsed WHERE NOT (body = '' OR open)),
pieces AS (SELECT article, where_, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT article, 'body' AS where_, regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM articles UNION ALL SELECT article, 'title', regexp_extract_all(title, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') FROM articles)),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY article, where_ ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS pos FROM pieces),
hits AS (SELECT article, company, where_, min(pos) FILTER (piece <> upper(word)) AS first, min(pos) AS any_ FROM placed JOIN asked ON piece = concat(upper(word[1]), word[2:]) OR piece = upper(word) WHERE length(word) >= 6 GROUP BY ALL)
SELECT article, company, max(coalesce(first, any_)) FILTER (where_ = 'body') AS "at", count(*) FILTER (where_ = 'title') > 0 AS in_title FROM hits GROUP BY article, company""")
def _(t):
    articles = _items(t).where("not broken").select((F.col("page_id") * 10 + F.col("nth")).alias("article"), "title", "body")
    return press.press_mentions(articles, t.spark.sql(_NAMES))
