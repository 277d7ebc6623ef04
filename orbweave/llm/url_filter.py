"""URL filters as a temporal list join.

A list is a log of dated changes (an entry is added or removed). Changes become validity intervals, one row
for each stretch in which an entry is active. Every capture asks for the domains above its host and the path
prefixes of its URL; an as-of join on that key keeps the entries that were active when it was fetched, and
the most specific one decides. Equal (url, fetch day) pairs are asked once, so a hot URL costs one lookup;
both joins have plain equality keys, where Spark splits hot ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.shared import fresh_name, table

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"

# An invented list. A domain entry covers its subdomains; an entry with a slash is a path prefix.
LIST_CHANGES = (
    ("spam-farm.example.org", "block", "add", "2023-11-01"),
    ("spam-farm.example.org", "block", "remove", "2024-04-10"),
    ("spam-farm.example.org", "block", "add", "2024-06-01"),
    ("cheap-pills.example.com", "block", "add", "2024-02-15"),
    ("cheap-pills.example.com/en/", "allow", "add", "2024-09-01"),
    ("cheap-pills.example.com/en/", "allow", "remove", "2024-10-01"),
    ("tionsh.example.net", "block", "add", "2024-05-05"),
    ("tionsh.example.net", "block", "remove", "2024-05-20"),
    ("blog.tionsh.example.net", "allow", "add", "2024-05-10"),
    ("ththth.example.org/en/", "block", "add", "2024-01-20"),
    ("ththth.example.org/en/", "block", "remove", "2024-12-01"),
    ("ththan.example.net", "block", "add", "2024-07-01"),
    ("ththan.example.net/es/", "allow", "add", "2024-07-15"),
    ("example.com", "block", "add", "2024-12-20"),
    ("example.com", "block", "remove", "2024-12-24"),
)
FIRST_DAY, DAYS = "2024-01-01", 366


def validity(changes: DataFrame) -> DataFrame:
    """(entry, action, active_from, active_to) of a change log (entry, action, change, dated).

    The interval is half-open; active_to is null while the entry stays. Entries are the same whatever the case
    of their host. Where an entry is both removed and added on one day, it stays (added last) if it was active before
    that day, and is not added otherwise: an entry removed and put back keeps one stretch, and one that is added
    and taken off within a day never counts. An entry added again while active begins a new stretch. Rows with a
    null in any of the four columns are left out; repeated rows count once; an empty log gives no intervals.
    """
    same = Window.partitionBy("entry", "action").orderBy("dated")
    host = F.substring_index("entry", "/", 1)  # a path keeps its case
    known = changes.select(F.concat(F.lower(host), F.substr("entry", F.length(host) + 1)).alias("entry"), "action", "change", F.to_date("dated").alias("dated")).where("change in ('add', 'remove')").dropna()
    days = known.groupBy("entry", "action", "dated").agg(F.max((F.col("change") == "add").cast("int")).alias("added"), F.max((F.col("change") == "remove").cast("int")).alias("removed"))
    # after a day with one kind of change the entry is on or off; a day with both leaves it as it was
    plain = F.when((F.col("added") == 1) & (F.col("removed") == 0), True).when(F.col("added") == 0, False)
    kept = days.withColumn("on", plain).where("on is not null")
    return kept.withColumn("active_to", F.lead("dated").over(same)).where("on").select("entry", "action", F.col("dated").alias("active_from"), "active_to")


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def lookup_keys(url):
    """The domains above the host (at least two labels) and the path prefixes that end with a slash."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    parts = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1), "/")
    prefixes = F.when(F.size(parts) >= 2, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, prefixes))


def filter_urls(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """``captures`` (with url and fetched, a date) and columns host, verdict, entry, since.

    verdict is ``block`` or ``allow`` by the longest active entry (``allow`` on a tie), else ``unlisted``. A
    null or unparsable url or a null fetch day is unlisted. Rows are neither dropped nor repeated, an empty
    list or table included; columns that are called like an added one are replaced.
    """
    spans = validity(changes)
    rows = captures.drop("host", "verdict", "entry", "since")
    asked = rows.select("url", "fetched").where("url is not null and fetched is not null").distinct()
    keys = asked.select("url", "fetched", F.explode(lookup_keys(F.col("url"))).alias("key"))
    active = (F.col("fetched") >= F.col("active_from")) & (F.col("active_to").isNull() | (F.col("fetched") < F.col("active_to")))
    found = keys.join(spans, (F.col("key") == F.col("entry")) & active)
    # longest entry first; then allow before block
    best = F.max(F.struct(F.length("entry").alias("size"), (F.col("action") == "allow").alias("allow"), "entry", "action", F.col("active_from").cast("string").alias("since")))
    at, day, won = (fresh_name(rows.columns, x) for x in ("asked_url", "asked_day", "best"))
    decided = found.groupBy(F.col("url").alias(at), F.col("fetched").alias(day)).agg(best.alias(won))
    out = rows.join(decided, (F.col("url") == F.col(at)) & (F.col("fetched") == F.col(day)), "left")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return out.select(*kept, host_of(F.col("url")).alias("host"), F.coalesce(f"{won}.action", F.lit("unlisted")).alias("verdict"), F.col(f"{won}.entry").alias("entry"), F.col(f"{won}.since").alias("since"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as captured on a day derived from its id, against the list as it was on that day."""
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(DAYS)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    changes = spark.createDataFrame(list(LIST_CHANGES), "entry string, action string, change string, dated string")
    found = filter_urls(captures, changes)
    return found.withColumn("fetched", F.col("fetched").cast("string"))


_VALUES = ", ".join(f"('{e}', '{a}', '{c}', DATE '{d}')" for e, a, c, d in LIST_CHANGES)
SQL = f"""
WITH changes(entry, action, change, dated) AS (VALUES {_VALUES}),
spans AS (
  SELECT entry, action, dated AS active_from, active_to FROM (
    SELECT *, lead(dated) OVER (PARTITION BY entry, action ORDER BY dated, change) AS active_to FROM changes)
  WHERE change = 'add' AND (active_to IS NULL OR active_to > dated)),
captures AS (
  SELECT page_id, url, CAST(DATE '{FIRST_DAY}' + CAST((page_id * 37) % {DAYS} AS INTEGER) AS DATE) AS fetched,
         lower(regexp_extract(url, '{_HOST}', 1)) AS host, regexp_extract(url, '{_PATH}', 1) AS path FROM pages),
hits AS (
  SELECT c.page_id, s.entry, s.action, CAST(s.active_from AS VARCHAR) AS since,
         row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.entry) DESC, (s.action = 'allow') DESC) AS place
  FROM captures c JOIN spans s
    ON c.fetched >= s.active_from AND (s.active_to IS NULL OR c.fetched < s.active_to)
   AND CASE WHEN contains(s.entry, '/') THEN starts_with(c.host || c.path, s.entry)
            ELSE c.host = s.entry OR ends_with(c.host, '.' || s.entry) END)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, c.host,
       coalesce(h.action, 'unlisted') AS verdict, h.entry, h.since
FROM captures c LEFT JOIN hits h ON h.page_id = c.page_id AND h.place = 1
"""
