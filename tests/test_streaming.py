"""Streaming canonical ingest: incremental files, cross-batch dedup, exactly-once replays."""

from valuelens.streaming import start_canonical_ingest

HEADER = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
FILE1 = HEADER + ("100,A,x,2,2010-01-01 10:00:00,2.5,1.0,UK\n"
                  "C101,A,x,-1,2010-01-02 10:00:00,5.0,1.0,UK\n"
                  "103,B,y,1,2010-01-04 10:00:00,4.0,,France\n")
FILE2 = HEADER + ("100,A,x,2,2010-01-01 10:00:00,2.5,1.0,UK\n"      # repeat of a first-file line
                  "102,B,y,1,2010-02-03 10:00:00,4.0,2.0,France\n")


def test_streaming_ingest_is_incremental_and_deduplicated(spark, tmp_path):
    src, out, ck = tmp_path / "src", str(tmp_path / "canonical"), str(tmp_path / "ck")
    src.mkdir()
    (src / "part1.csv").write_text(FILE1)
    q = start_canonical_ingest(spark, str(src), "Year 1", out, ck)
    q.awaitTermination(120)
    first = spark.read.parquet(out)
    assert first.count() == 2
    (src / "part2.csv").write_text(FILE2)
    q = start_canonical_ingest(spark, str(src), "Year 1", out, ck)
    q.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 3
    assert sorted(r["invoice_id"] for r in rows) == ["100", "102", "C101"]
    assert {r["invoice_month"] for r in rows} == {"2010-01", "2010-02"}
    # replay with no new files changes nothing
    q = start_canonical_ingest(spark, str(src), "Year 1", out, ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_a_reordered_header_is_refused(spark, tmp_path):
    import pytest
    src, out, ck = tmp_path / "src", str(tmp_path / "canonical"), str(tmp_path / "ck")
    src.mkdir()
    (src / "part1.csv").write_text("StockCode,Invoice" + HEADER[len("Invoice,StockCode"):] + "SKU1,1001,x,2,2010-01-01 10:00:00,2.5,1.0,UK\n")
    q = start_canonical_ingest(spark, str(src), "Year 1", out, ck)
    with pytest.raises(Exception, match="header"):
        q.awaitTermination(120)
        raise AssertionError(q.exception())
    assert not list(tmp_path.glob("canonical/**/*.parquet"))
