import uuid

import pytest

from meterspark.schemas import UCI_COLUMNS
from meterspark.sources.ingest import ImportTarget
from meterspark.streaming.landing import import_landing

HEADER = ";".join(UCI_COLUMNS)
LINE = "3/7/2011;08:{:02d}:00;1.732;0.064;229.410;7.600;2.000;0.000;11.000"


def write(folder, name, minutes, header=HEADER):
    (folder / name).write_text("\n".join([header] + [LINE.format(m) for m in minutes]) + "\n")


def test_new_files_are_imported_once(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    target = ImportTarget(*(str(tmp_path / n) for n in ("m", "i", "r")))
    name = f"landing-{uuid.uuid4()}"
    write(folder, "a.txt", range(10))
    import_landing(spark, str(folder), target, name=name).awaitTermination(120)
    write(folder, "b.txt", range(5))
    import_landing(spark, str(folder), target, name=name).awaitTermination(120)
    stored = spark.read.parquet(target.measurements)
    counts = {r[0]: r[1] for r in stored.groupBy("dataset_version_id").count().collect()}
    assert counts == {"a.txt": 10, "b.txt": 5}
    rows = stored.where("dataset_version_id = 'a.txt'").orderBy("source_row_number").collect()
    assert [r.source_row_number for r in rows] == list(range(2, 12))
    write(folder, "c.txt", range(5), header="x;y")
    with pytest.raises(Exception, match="unexpected header"):
        import_landing(spark, str(folder), target, name=name).awaitTermination(120)
    assert spark.read.parquet(target.measurements).count() == 15


def test_files_of_one_name_are_versions_of_their_own(spark, tmp_path):
    folder = tmp_path / "nested"
    target = ImportTarget(*(str(tmp_path / n) for n in ("m", "i", "r")))
    for place in ("left", "right side"):
        (folder / f"place={place}").mkdir(parents=True)
        write(folder / f"place={place}", "d.txt", range(3))
    import_landing(spark, str(folder), target, name=f"landing-{uuid.uuid4()}").awaitTermination(120)
    reports = {r.dataset_version_id: r.source_rows for r in spark.read.parquet(target.reports).collect()}
    assert len(reports) == 2 and reports["place=left/d.txt"] == 3 and sum(reports.values()) == 6
