import datetime

import duckdb

from orbweave.llm import url_filter as u
from tests.llm.helpers import SF


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF}/pages.parquet')")
    got = u.op7_url_filter(spark, SF)
    want = con.execute(u.SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def day(text):
    return datetime.date.fromisoformat(text) if text else None


def test_entries_active_at_fetch_time(spark):
    changes = spark.createDataFrame(
        [("bad.org", "block", "add", "2024-01-10"), ("bad.org", "block", "remove", "2024-02-01"), ("bad.org", "block", "remove", "2024-02-01"), ("bad.org/ok/", "allow", "add", "2024-01-15"), ("tie.org", "block", "add", "2024-01-01"), ("tie.org", "allow", "add", "2024-01-01"), ("one.org", "block", "add", "2024-01-05"), ("one.org", "block", "remove", "2024-01-05"), (None, "block", "add", "2024-01-01"), ("late.org", "block", None, "2024-01-01")],
        "entry string, action string, change string, dated string",
    )
    rows = [
        ("http://www.BAD.org/x", "2024-01-09", "unlisted"), ("http://www.bad.org/x", "2024-01-10", "block"), ("http://bad.org:80/ok/y?z", "2024-01-20", "unlisted"), ("http://bad.org/ok/y", "2024-01-20", "allow"),
        ("http://bad.org/ok", "2024-01-20", "block"), ("http://bad.org/", "2024-02-01", "unlisted"), ("http://notbad.org/", "2024-01-20", "unlisted"), ("https://tie.org", "2024-06-01", "allow"), ("http://one.org/", "2024-01-05", "unlisted"),
        (None, "2024-01-20", "unlisted"), ("http://bad.org/", None, "unlisted"), ("", "2024-01-20", "unlisted"), ("no url", "2024-01-20", "unlisted"), ("http://a.bad.org/" + "x/" * 5000, "2024-01-20", "block"),
    ]
    rows[2] = ("http://bad.org:80/ok/y?z", "2024-01-20", "allow")
    captures = spark.createDataFrame([(k, r[0], day(r[1]), "clash", "clash") for k, r in enumerate(rows)] * 2, "page_id long, url string, fetched date, entry string, `odd.name` string")
    got = u.filter_urls(captures, changes)
    assert got.columns == ["page_id", "url", "fetched", "odd.name", "host", "verdict", "entry", "since"]
    found = got.collect()
    assert len(found) == 2 * len(rows) and {(r["page_id"], r["verdict"]) for r in found} == {(k, r[2]) for k, r in enumerate(rows)}
    assert {r["verdict"] for r in u.filter_urls(captures, changes.where("false")).collect()} == {"unlisted"}
    assert u.filter_urls(captures.where("false"), changes).collect() == []


def test_changes_of_one_day_and_of_any_case(spark):
    log = [
        ("Bad.org", "block", "add", "2024-01-10"), ("bad.org", "block", "remove", "2024-02-01"),
        ("back.org", "block", "add", "2024-01-01"), ("back.org", "block", "remove", "2024-01-20"), ("back.org", "block", "add", "2024-01-20"), ("BACK.org", "block", "remove", "2024-03-01"),
        ("never.org", "block", "remove", "2024-01-03"), ("never.org", "block", "add", "2024-01-03"),
        ("Case.org/En/", "block", "add", "2024-01-01"), ("twice.org", "block", "add", "2024-01-01"), ("twice.org", "block", "add", "2024-01-05"), ("odd.org", "block", "rename", "2024-01-01"),
    ]
    changes = spark.createDataFrame(log, "entry string, action string, change string, dated string")
    got = sorted((r["entry"], str(r["active_from"]), str(r["active_to"])) for r in u.validity(changes).collect())
    assert got == [("back.org", "2024-01-01", "2024-03-01"), ("bad.org", "2024-01-10", "2024-02-01"), ("case.org/En/", "2024-01-01", "None"), ("twice.org", "2024-01-01", "2024-01-05"), ("twice.org", "2024-01-05", "None")]
    rows = [(1, "http://CASE.org/En/x", day("2024-01-02"), 1, 2, 3), (2, "http://case.org/en/x", day("2024-01-02"), 1, 2, 3)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, best int, asked_url int, _url int")
    got = u.filter_urls(captures, changes).collect()
    assert [(r["page_id"], r["verdict"], r["best"], r["asked_url"]) for r in sorted(got)] == [(1, "block", 1, 2), (2, "unlisted", 1, 2)]
    assert u.validity(changes.where("false")).collect() == []
