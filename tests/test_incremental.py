from tillspark.operators.clean import clean
from tillspark.operators.incremental import load_part, profile
from tillspark.operators.profile import transaction_stats
from tillspark.schemas import RETAIL_LINE


def lines(spark, rows):
    return spark.createDataFrame([(no, "S", name, "1", "12/1/2010 8:26", None, "c", None) for no, name in rows], RETAIL_LINE)


def check(spark, folder, parts, names=None):
    rows = [r for k, part in parts.items() if names is None or k in names for r in part]
    raw = lines(spark, rows)
    assert [tuple(r) for r in profile(spark, folder, names).collect()] == [tuple(r) for r in transaction_stats(raw, clean(raw)).collect()]


def test_parts_are_merged_replaced_and_emptied(spark, tmp_path):
    folder = str(tmp_path / "p")
    parts = {
        "jan": [("1", "tea"), ("1", "tea"), ("1", "jam"), ("2", "tea"), (None, "tea"), ("C9", "tea")],
        "feb": [("2", "jam"), ("3", "tea"), (None, "jam"), ("4", None), ("12", "3x"), ("1", "23x")],
    }
    check(spark, folder, {})
    for name, rows in parts.items():
        load_part(lines(spark, rows), folder, name)
    check(spark, folder, parts)
    check(spark, folder, parts, ["feb"])
    check(spark, folder, parts, ["unknown"])
    # Loaded again without some rows, then without any.
    parts["jan"] = parts["jan"][:1]
    load_part(lines(spark, parts["jan"]), folder, "jan")
    check(spark, folder, parts)
    parts["jan"] = []
    load_part(lines(spark, []), folder, "jan")
    check(spark, folder, parts)


def test_a_load_reads_no_lines_of_other_parts(spark, tmp_path):
    """Lines of the first part are gone before the second is loaded."""
    folder, first = str(tmp_path / "p"), str(tmp_path / "lines")
    lines(spark, [("1", "tea"), ("2", "jam")]).write.parquet(first)
    load_part(spark.read.parquet(first), folder, "a")
    for f in (tmp_path / "lines").iterdir():
        f.unlink()
    load_part(lines(spark, [("2", "jam"), ("3", "tea")]), folder, "b")
    check(spark, folder, {"a": [("1", "tea"), ("2", "jam")], "b": [("2", "jam"), ("3", "tea")]})


def test_a_load_shuffles_each_value_once_and_numbers_stay_unique(spark, tmp_path):
    """Values were sorted by name and joined to all others again before, which sent each about three times."""
    def sent():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None).iterator()
        total = 0
        while stages.hasNext():
            total += stages.next().shuffleWriteRecords()
        return total

    schema = "InvoiceNo string, StockCode string, Description string, Quantity string, UnitPrice decimal(28, 4), CustomerID string"
    rows = spark.range(2000).selectExpr("concat('i', id)", "'s'", "concat('p', id % 50)", "'1'", "CAST(1 AS DECIMAL(28, 4))", "'c'").toDF(
        *(c.split()[0] for c in schema.split(", ") if " " in c))
    before = sent()
    load_part(rows, str(tmp_path), "a")
    assert sent() - before < 2 * (3 * 2000 + 50)
    load_part(rows.limit(100), str(tmp_path), "b")
    numbers = spark.read.parquet(f"{tmp_path}/values")
    assert numbers.count() == numbers.select("number").distinct().count() == numbers.select("kind", "value").distinct().count() == 6050
