from decimal import Decimal

from pyspark.sql import functions as F

from tillspark.operators.clean import RULE_NAMES, clean, clean_report, drop_by
from tillspark.schemas import RETAIL_LINE
from tillspark.sources.retail import jdbc_options, read_csv
from tillspark.sinks.tables import replace_lines_by_month, replace_table


def line(no="1", code="A", desc="jam", qty="1", price="2.5", cust="7"):
    return (no, code, desc, qty, "12/1/2010 8:26", None if price is None else Decimal(price), cust, "UK")


KEPT = [
    line(), line(no=None), line(code=None), line(qty=None), line(price=None), line(desc="  "),
    line(price="0.0001"),
]
DROPPED = {
    "invoice": [line(no="C536"), line(no="c536"), line(no="53C6")],
    "customer": [line(cust=None)],
    "quantity": [line(qty="-3"), line(qty="3-")],
    "price": [line(price="0"), line(price="-1")],
    "description": [line(desc=None), line(desc="lost?")],
    "postage": [line(code="POST")],
}


def frame(spark, rows):
    return spark.createDataFrame(rows, RETAIL_LINE)


def test_unknown_values_are_kept_and_each_rule_drops_its_rows(spark):
    df = frame(spark, KEPT + [r for rows in DROPPED.values() for r in rows])
    assert clean(df).count() == len(KEPT)
    for rule in RULE_NAMES:
        only = frame(spark, KEPT + DROPPED[rule])
        assert drop_by(only, rule).count() == len(KEPT), rule
    report = clean_report(df).first()
    assert report["raw_rows"] == df.count() and report["kept_rows"] == len(KEPT)
    assert [report[f"hit_{r}"] for r in RULE_NAMES] == [len(DROPPED[r]) for r in RULE_NAMES]


def test_cleaning_is_one_filter_reaching_the_scan(spark, tmp_path):
    replace_table(frame(spark, KEPT), str(tmp_path / "t"))
    plan = clean(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(CustomerID)" in plan and "Exchange" not in plan


def test_csv_edges(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(
        "﻿invoiceno, Description ,STOCKCODE,extra,UnitPrice,Quantity,CustomerID\n"
        '1,"say ""hi"", friend",007,x, 2.5 ,1,17850\n'
        '2,"two\nlines",A,x,1e3,2,\n'
        "3,  padded  ,A,x,\"1,000\",3,NA\n"
        "4,plain,A,x,abc,4,5\n"
        "5,,A,x,0.00004,4,5\n".encode()
    )
    rows = {r["InvoiceNo"]: r for r in read_csv(spark, str(path), multi_line=True).collect()}
    assert rows["1"]["Description"] == 'say "hi", friend' and rows["1"]["StockCode"] == "007"
    assert rows["1"]["UnitPrice"] == Decimal("2.5000") and rows["1"]["Country"] is None
    assert rows["2"]["Description"] == "two\nlines" and rows["2"]["UnitPrice"] == Decimal("1000")
    assert rows["2"]["CustomerID"] is None and rows["3"]["CustomerID"] == "NA"
    assert rows["3"]["Description"] == "padded" and rows["3"]["UnitPrice"] is None
    assert rows["4"]["UnitPrice"] is None and rows["5"]["Description"] is None
    assert rows["5"]["UnitPrice"] == Decimal("0")
    tokens = read_csv(spark, str(path), null_tokens=("", "NA"))
    assert tokens.filter("InvoiceNo = '3'").first()["CustomerID"] is None


def test_jdbc_scan_is_split_by_bounds():
    plain = jdbc_options("t", None, None, None, 8, 100)
    assert plain == {"dbtable": "t", "fetchsize": "100"}
    split = jdbc_options("t", "id", 1, 1000, 8, 100)
    assert split["numPartitions"] == "8" and split["upperBound"] == "1000"


def test_counts_come_from_the_write_and_months_are_partitions(spark, tmp_path):
    df = frame(spark, [line(), line(no="2"), ("3", "A", "x", "1", "not a date", None, "1", "UK")])
    folder = str(tmp_path / "m")
    assert replace_lines_by_month(df, folder) == 3
    months = {r[0]: r[1] for r in spark.read.parquet(folder).groupBy("invoice_month").agg(F.count("*")).collect()}
    assert months == {"2010-12": 2, None: 1}


def test_a_large_month_is_split_into_files_of_the_advisory_size(spark, tmp_path):
    """A month with nine tenths of the rows gets many files, the small ones a file each, from many tasks."""
    rows = spark.range(0, 200_000, 1, 40).select(
        F.col("id").cast("string").alias("InvoiceNo"), F.sha2(F.col("id").cast("string"), 256).alias("Description"),
        F.when(F.col("id") % 10 > 0, F.lit("12/1/2010 8:26")).otherwise(F.concat((F.col("id") % 9 + 1).cast("string"), F.lit("/1/2011 8:26"))).alias("InvoiceDate"),
    )
    names = ["spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"]
    folder = str(tmp_path / "m")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "true")
        spark.conf.set(names[1], "2m")
        spark.conf.set(names[2], "64")  # so many places that the months of this test do not meet
        assert replace_lines_by_month(rows, folder) == 200_000
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    sizes = {m.name: [f.stat().st_size for f in m.glob("*.parquet")] for m in (tmp_path / "m").glob("invoice_month=*")}
    large = sizes.pop("invoice_month=2010-12")
    assert len(large) >= 4 and max(large) <= 3 * sorted(large)[len(large) // 2] and all(len(s) <= 2 for s in sizes.values())
    assert len(sizes) == 9
