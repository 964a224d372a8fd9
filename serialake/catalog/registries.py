"""H: set operations on registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from serialake.catalog.registry import Catalog
from serialake.operators import registries

catalog = Catalog()
q = catalog.query


@q("h1_merge_completed", "select distinct o_custkey from orders")
def _(t):
    parts = [t.orders.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    return registries.merge_completed(parts, key="o_custkey")


@q("h2_difference", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'N')")
def _(t):
    actual = t.lineitem.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return registries.difference(t.orders.select("o_orderkey"), actual, on=["o_orderkey"])


@q("h3_append_unseen", """select user_id, event_id from (select user_id, min(event_id) as event_id from events where event_type = 'view' group by 1)
    union all select user_id, min(event_id) from events where event_type = 'error' and user_id not in (select user_id from events where event_type = 'view') group by 1""")
def _(t):
    registry = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    new = t.events.where("event_type = 'error'").select("user_id", "event_id")
    return registries.append_unseen(registry, new, key=["user_id"], order=["event_id"])


@q("h3_append_unseen_links", """select url, min(page_id) as page_id from (select page_id, regexp_replace(url, '[?#].*$', '') as url from pages union all
    select page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^http:', 'https:') from pages) group by 1""")
def _(t):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    registry = t.pages.select(bare.alias("url"), "page_id").groupBy("url").agg(F.min("page_id").alias("page_id"))
    new = t.pages.select(F.regexp_replace(bare, "^http:", "https:").alias("url"), "page_id")
    return registries.append_unseen(registry, new, key=["url"], order=["page_id"])


@q("h3_append_all", "select event_id from events where event_type in ('view', 'error')")
def _(t):
    return registries.append_all(t.events.where("event_type = 'view'").select("event_id"), t.events.where("event_type = 'error'").select("event_id"))


@q("h4_retried", "select distinct user_id from events where event_type = 'error' and user_id not in (select user_id from events where event_type = 'purchase' and value > 90)")
def _(t):
    failed = t.events.where("event_type = 'error'").select("user_id").distinct()
    done = t.events.where("event_type = 'purchase' and value > 90").select("user_id")
    return registries.difference(failed, done, on=["user_id"])
