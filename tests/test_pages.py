import pytest
from pyspark.sql import functions as F

from meterspark.operators.pages import index_pages, read_page


def order():
    return [F.col("grade").desc_nulls_last(), F.col("row")]


@pytest.fixture(scope="module")
def listing(spark):
    """Half of the rows share one grade, some have none; two columns are named like the index's own."""
    grade = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 5 > 0, F.col("id") % 11)
    number = F.col("id") * 37 % 1009
    return spark.range(1009).select(grade.alias("grade"), number.alias("row"), F.lit("x").alias("position"))


@pytest.fixture(scope="module")
def index(listing, tmp_path_factory):
    return index_pages(listing, order(), str(tmp_path_factory.mktemp("pages") / "index"), rows_per_range=100)


@pytest.mark.parametrize("size", [1, 7, 250, 2000])
def test_pages_in_order(spark, listing, index, size):
    wanted = [tuple(r) for r in listing.orderBy(*order()).collect()]
    for number in {1, 2, 1009 // size, 1009 // size + 1}:
        if number < 1:
            continue
        page = [tuple(r) for r in read_page(spark, index, number, size).collect()]
        assert page == wanted[(number - 1) * size : number * size]


def test_ranges_are_even_and_whole(spark, index):
    ranges = index.ranges(spark).orderBy("range_no").collect()
    assert len(ranges) > 5 and max(r.n_rows for r in ranges) < 300
    assert [r.first_row for r in ranges] == [sum(q.n_rows for q in ranges[:i]) for i in range(len(ranges))]
    assert sum(r.n_rows for r in ranges) == 1009


def test_late_page_opens_its_ranges_only(spark, index):
    plan = read_page(spark, index, 100, 10)._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "range_no" in scan.split("PushedFilters")[0]
    assert "GreaterThanOrEqual(position" in scan
    assert len(read_page(spark, index, 100, 10).inputFiles()) > 0
    assert "Offset" not in plan and "TakeOrdered" not in plan


def test_empty_and_beyond(spark, listing, index, tmp_path):
    empty = index_pages(listing.where("false"), order(), str(tmp_path / "none"))
    assert read_page(spark, empty, 1, 10).collect() == []
    assert read_page(spark, empty, 1, 10).columns == listing.columns
    assert read_page(spark, index, 10**6, 10).collect() == []
    for number, size in ((0, 10), (1, 0)):
        with pytest.raises(ValueError):
            read_page(spark, index, number, size)
