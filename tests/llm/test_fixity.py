import hashlib

import duckdb
import pytest

from quotewright.llm import fixity
from quotewright.llm.common import Scratch


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(fixity.ORACLE)
    got = fixity.op6_merkle_fixity(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_equal_replicas_and_roots(spark, pages):
    again = pages.repartition(7)
    assert fixity.Tree(fixity.records(pages), Scratch(spark), "a").root() == fixity.Tree(fixity.records(again), Scratch(spark), "b").root()
    assert fixity.compare_replicas(pages, again, Scratch(spark)).where("status <> 'same'").count() == 0


def test_record_bytes(spark):
    df = spark.createDataFrame([("http://a/é", "<p>ü</p>")], "url string, html string")
    got = bytes(df.select(fixity.warc_record(df.url, df.html)).first()[0])
    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>ü</p>".encode()
    assert got == f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/é\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    assert fixity.records(df.selectExpr("1L as page_id", "url", "html")).first().sha256 == hashlib.sha256(got).hexdigest()


def test_missing_added_null_and_repeated(spark):
    kind = "page_id bigint, url string, html string, file string"
    rows = [(i, f"u{i}", "h" * i, "x") for i in range(300)] + [(5, "u5", "hhhhh", "x"), (None, None, None, None), (None, "u", "z" * 100_000, None)]
    a = spark.createDataFrame(rows, kind)
    b = spark.createDataFrame(rows[:299] + rows[300:] + [(9000, "new", "n", "x")], kind)  # 299 is missing, 9000 added
    got = fixity.compare_replicas(a, b, Scratch(spark)).where("status <> 'same'").collect()
    assert [(r.page_id, r.status) for r in sorted(got, key=lambda r: r.page_id)] == [(299, "missing"), (9000, "added")]
    assert fixity.compare_replicas(a, a.limit(0), Scratch(spark)).where("status = 'missing'").count() == len(rows)
    assert fixity.compare_replicas(a.limit(0), a, Scratch(spark)).where("status = 'added'").count() == len(rows)
    assert fixity.compare_replicas(a.limit(0), a.limit(0), Scratch(spark)).count() == 0
