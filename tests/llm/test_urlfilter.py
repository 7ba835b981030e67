import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from llm.oracle import rows, spark_rows
from strideline.llm import catalog, urlfilter

RULES = "host string, path string, verdict string"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert spark_rows(catalog.op5_urls(spark, sf)) == rows(catalog.OP5_SQL, sf)


def canonical(href):
    return f'<html><head><LINK  rel="canonical" href="{href}"></head></html>'


PAGES = [
    (1, "http://a.net/x", "", "net/", "block"),
    (2, "http://A.Example.NET/en/1?q#f", None, "example.net/en/", "allow"),
    (3, "http://b.org/p", canonical("http://a.net/x"), None, "block"),
    (4, "http://c.org/p", canonical("http://b.org/p#top"), None, "block"),
    (5, "http://d.org/q", canonical("//a.net/y"), None, "allow"),
    (6, "http://d.org/fr/q", canonical("/q"), "org/fr/", "allow"),
    (7, "http://a.net/y", "", "net/", "block"),
    (8, "http://e.org/r/s?z", '<meta http-equiv=refresh content="0; URL=t">', None, "allow"),
    (9, "http://e.org/r/t", '<meta http-equiv="Refresh" content="0;url=http://a.net/z">', None, "block"),
    (10, "http://a.net/z", "", "net/", "block"),
    (11, None, canonical("http://a.net/x"), None, "allow"),
    (12, "no scheme", None, None, "allow"),
    (13, "http://net", "", None, "allow"),
    (14, "http://NET/", "", "net/", "block"),
    (15, "http://internet/", "", None, "allow"),
    (16, "x://y://z/a", "", None, "allow"),
    (17, "http://", "", None, "allow"),
    (None, "http://www.example.com/de/\nx", "", "example.com/de/", "block"),
    (1, "http://a.net/x", "", "net/", "block"),
]


@pytest.mark.parametrize("limit", [10_000, 0])
def test_aliases_and_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    pages = spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("address", F.lit(2))
    rules = spark.createDataFrame(catalog.RULES, RULES)
    found = urlfilter.judge(pages, rules).collect()
    # page 8 is an alias of 9, which is one of 10
    expected = [(i, r, "block" if i == 8 else v) for i, _, _, r, v in PAGES]
    assert sorted(((r["page_id"], r["rule"], r["verdict"]) for r in found), key=str) == sorted(expected, key=str)
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_long_chain(spark):
    pages = [(i, f"http://h{i}.org/", canonical(f"http://h{i + 1}.org/")) for i in range(40)] + [(40, "http://h40.org/", "")]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame([("h40.org", "/", "block")], RULES)
    assert {r["verdict"] for r in urlfilter.judge(pages, rules).collect()} == {"block"}


def test_native(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", canonical("http://b.org/"))], "page_id long, url string, html string")
    plan = urlfilter.judge(pages, spark.createDataFrame(catalog.RULES, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_links_planted_into_real_pages_equal_sql(spark, tmp_path):
    """Every seventh page names another page's address (one that is its own normal form) as canonical, every eleventh refreshes to one."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    urls = [r["url"] for r in pages.select("url").where("url rlike '^[a-z]+://[^#&A-Z\"\\\\s<>]+$'").orderBy("page_id").collect()]
    pick = spark.createDataFrame(list(enumerate(urls)), "k long, target string")
    named = pages.join(F.broadcast(pick), F.pmod(F.xxhash64("page_id"), F.lit(len(urls))) == pick.k, "left").drop("k")
    link = F.when(F.col("page_id") % 7 == 0, F.format_string('<link rel="canonical" href="%s">', "target")).when(F.col("page_id") % 11 == 0, F.format_string('<meta http-equiv="refresh" content="0; url=%s">', "target")).otherwise("")
    named.withColumn("html", F.concat(link, F.coalesce("html", F.lit("")))).drop("target").write.parquet(f"{tmp_path}/pages.parquet")
    found = urlfilter.judge(spark.read.parquet(f"{tmp_path}/pages.parquet"), spark.createDataFrame(catalog.RULES, RULES))
    assert found.where("cause = 'alias'").count() > 3
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = c.sql(catalog.OP5_SQL)
    assert sorted(map(str, found.select(*rel.columns).collect())) == sorted(map(str, (Row(**dict(zip(rel.columns, r))) for r in rel.fetchall())))
