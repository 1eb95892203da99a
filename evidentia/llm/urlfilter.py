"""URL filters with dated lists (operator 7).

A list is a log of dated entries: at a time a domain, host or URL prefix is added to a category, or removed. Entries
become validity intervals, from an addition up to the next removal; each capture is then held, as of its fetch time,
against the intervals of its host, of its host's parent domains and of its URL's prefixes.

A capture is asked about its host, those ends of the host that begin at a label and are as long as a domain listed under
its last label, and those beginnings of its URL that are as long as a prefix listed for its host and end at a slash or
with the path: never more than the list holds there, however many dots and slashes the URL has. Keys then meet by equality, with the interval as a further condition: no cross join. A list of
at most FEW_ROWS intervals is broadcast. A longer one is shuffled by key and salted: each capture goes to one of SALTS
parts of its keys, and the intervals of a key to all of them, so a key that all captures ask for (a top-level domain, a
busy host) is dealt over many tasks. Equal captures are judged once and the verdict is joined back to each row.

Defined results: a null or malformed URL or a null fetch time matches nothing; entries with a null key, time or an
unknown action are ignored; entries at one time: an addition wins over a removal; repeated entries change nothing; an
interval holds from its start and not at its end; rows of captures are all kept, equal ones too; empty tables give no
rows or no matches; columns with clashing names are ignored. Host and scheme are compared in lower case, paths as they
are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import shared

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?"
#: Intervals that are broadcast at most (some 100 bytes each), and parts of each key beyond that.
FEW_ROWS, SALTS = 200_000, 32


def intervals(entries: DataFrame) -> DataFrame:
    """entries: kind (domain, host, prefix), key, category, action (add, remove), at. Gives valid_from and valid_to (null: still valid).

    A list key's entries are few; what grows with the corpus, the captures, takes no part here.
    """
    host = F.lower(F.substring_index("key", "/", 1))
    key = F.when(F.col("kind") == "prefix", F.concat(host, F.expr("substring(key, length(substring_index(key, '/', 1)) + 1)"))).otherwise(F.lower("key"))
    good = entries.select("kind", key.alias("key"), "category", "action", "at").filter("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    marks = good.groupBy("kind", "key", "category", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    w = Window.partitionBy("kind", "key", "category").orderBy("at")
    changes = marks.withColumn("was", F.lag("on").over(w)).filter("on <> coalesce(was, 0)")
    spans = changes.withColumn("valid_to", F.lead("at").over(w))
    return spans.filter("on = 1").select("kind", "key", "category", F.col("at").alias("valid_from"), "valid_to")


def _meet(asked: DataFrame, listed: DataFrame, on: list[str], by: list[str], few: bool, how: str = "inner") -> DataFrame:
    """asked joined to listed; a key of many rows is dealt by a hash of ``by`` unless the list is small."""
    if few:
        return asked.join(F.broadcast(listed), on, how)
    dealt = asked.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copied = listed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


def asked_keys(once: DataFrame, spans: DataFrame, few: bool) -> DataFrame:
    """url, fetched_at, kind, key of everything on the list that could speak of a capture."""
    lengths = lambda kind, part, name: spans.filter(F.col("kind") == kind).select(part.alias(name), F.length("key").alias("n")).groupBy(name).agg(F.collect_set("n").alias(f"{kind}_lengths"))
    named = once.filter(F.col("url").rlike(HOST)).withColumn("host", F.lower(F.regexp_extract("url", HOST, 1))).withColumn("last", F.substring_index("host", ".", -1))
    named = _meet(named, lengths("domain", F.substring_index("key", ".", -1), "last"), ["last"], ["url", "fetched_at"], few, "left")
    named = _meet(named, lengths("prefix", F.substring_index("key", "/", 1), "host"), ["host"], ["url", "fetched_at"], few, "left")
    named = named.withColumn("whole", F.concat("host", F.regexp_extract("url", PATH, 1)))
    none, short, long = F.array().cast("array<int>"), F.length("host"), F.length("whole")
    tails = F.filter(F.coalesce("domain_lengths", none), lambda n: (n == short) | (n < short) & (F.substring("host", short - n, F.lit(1)) == "."))
    domains = F.transform(tails, lambda n: F.struct(F.lit("domain").alias("kind"), F.substring("host", short - n + 1, n).alias("key")))
    heads = F.filter(F.coalesce("prefix_lengths", none), lambda n: (n == long) | (n < long) & (F.substring("whole", n + 1, F.lit(1)) == "/"))
    prefixes = F.transform(heads, lambda n: F.struct(F.lit("prefix").alias("kind"), F.substring("whole", F.lit(1), n).alias("key")))
    hosts = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key")))
    return named.select("url", "fetched_at", F.explode(F.array_distinct(F.concat(domains, hosts, prefixes))).alias("k")).select("url", "fetched_at", "k.kind", "k.key")


def judge(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, at_col: str, few_rows: int = FEW_ROWS) -> DataFrame:
    """Every capture's id, url and time with n_active (intervals that hold at its fetch), reason (the categories, sorted) and blocked."""
    rows = captures.select(F.col(id_col), F.col(url_col).alias("url"), F.col(at_col).alias("fetched_at"))
    once = rows.filter("url IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at").distinct()
    spans = shared.save(intervals(entries), "intervals")
    few = spans.count() <= few_rows
    asked = asked_keys(once, spans, few)
    held = _meet(asked, spans, ["kind", "key"], ["url", "fetched_at"], few).filter("fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)")
    found = held.groupBy("url", "fetched_at").agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("reason"))
    return rows.join(found, ["url", "fetched_at"], "left").select(id_col, "url", "fetched_at", F.coalesce("n_active", F.lit(0)).alias("n_active"), "reason", F.col("n_active").isNotNull().alias("blocked"))


def fetch_time(id_col: str):
    """The synthetic pages have no fetch time; each gets an hour of 2024 from its id."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col(id_col) * 7919, F.lit(8784)) * 3600)


def synthetic_list(pages: DataFrame) -> DataFrame:
    """A list made from the pages' own hosts and first path parts, with times and removals by a digest of the key."""
    host = F.lower(F.regexp_extract("url", HOST, 1))
    first = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)", 1)
    keyed = pages.filter(F.col("url").rlike(HOST)).select(F.explode(F.array(F.struct(F.lit("domain").alias("kind"), F.regexp_replace(host, r"^[^.]*\.", "").alias("key")), F.struct(F.lit("host").alias("kind"), host.alias("key")), F.struct(F.lit("prefix").alias("kind"), F.concat(host, first).alias("key")))).alias("k")).select("k.kind", "k.key").distinct()
    day = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "key")), 1, 4), 16, 10).cast("long")
    at = lambda d: F.timestamp_seconds(F.lit(1_704_067_200) + d * 86_400)
    steps = F.array(F.struct(F.lit("add").alias("action"), at(day % 150).alias("at")), F.struct(F.lit("remove").alias("action"), at(day % 150 + 20 + day % 60).alias("at")), F.struct(F.lit("add").alias("action"), at(day % 150 + 230).alias("at")))
    return keyed.select("kind", "key", F.concat(F.lit("list"), (day % 3).cast("string")).alias("category"), F.explode(steps).alias("e")).select("kind", "key", "category", "e.action", "e.at")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's capture against a dated list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", fetch_time("page_id").alias("fetched_at"))
    got = judge(pages, synthetic_list(pages), "page_id", "url", "fetched_at")
    return got.select("page_id", "url", F.unix_timestamp("fetched_at").alias("fetched_at"), F.col("n_active").cast("long").alias("n_active"), "reason", "blocked")


OP7_SQL = r"""
WITH c AS (SELECT page_id, url, 1704067200 + (page_id * 7919 % 8784) * 3600 AS ts FROM pages),
h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) AS path FROM c
  WHERE regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)')),
k AS (SELECT DISTINCT unnest(['domain', 'host', 'prefix']) AS kind, unnest([regexp_replace(host, '^[^.]*\.', ''), host,
  host || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1)]) AS key FROM h),
d AS (SELECT *, ('0x' || substr(md5(kind || '|' || key), 1, 4))::BIGINT AS day FROM k),
v AS (SELECT kind, key, 'list' || (day % 3) AS category, 1704067200 + (day % 150) * 86400 AS a, 1704067200 + (day % 150 + 20 + day % 60) * 86400 AS b FROM d
  UNION ALL SELECT kind, key, 'list' || (day % 3), 1704067200 + (day % 150 + 230) * 86400, NULL FROM d),
q AS (SELECT DISTINCT page_id, ts, kind, key FROM (
  SELECT page_id, ts, 'host' AS kind, host AS key FROM h
  UNION ALL SELECT page_id, ts, 'domain', array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h)
  UNION ALL SELECT page_id, ts, 'prefix', host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/') FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM h))),
f AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT category, ',' ORDER BY category) AS reason
  FROM q JOIN v USING (kind, key) WHERE ts >= a AND (b IS NULL OR ts < b) GROUP BY page_id)
SELECT c.page_id, c.url, c.ts AS fetched_at, coalesce(n_active, 0) AS n_active, reason, n_active IS NOT NULL AS blocked
FROM c LEFT JOIN f USING (page_id)
"""
