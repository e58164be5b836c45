"""Import of files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterspark.schemas import UCI_COLUMNS, UCI_TIMEZONE
from meterspark.session import shared_checkpoint_dir, use_utc
from meterspark.sources.files import data_lines, number_lines, raw_lines
from meterspark.sources.ingest import ImportTarget, store_import
from meterspark.sources.rows import parse_uci_lines


def import_landing(
    spark: SparkSession,
    folder: str,
    target: ImportTarget,
    *,
    name: str,
    timezone: str = UCI_TIMEZONE,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Import every household-power file of ``folder`` not imported before, then stop.

    Each file is one dataset version named by its path below ``folder``. A batch replaces the versions it holds, so a
    batch that is run again after a failure leaves the tables as one run would. Progress is kept
    under the shared checkpoint folder. A file without the expected header fails its batch before
    anything of it is written.
    """
    use_utc(spark)
    text = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).format("text").load(folder)
    )
    header = ";".join(UCI_COLUMNS)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = files.makeQualified(root).toUri().getRawPath().rstrip("/") + "/"
    path = F.regexp_replace("source_file", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    # A folder given by a pattern has no path of its own; its files go by their names.
    version = F.when(path.startswith(below), F.substring(path, len(below) + 1, 1 << 30)).otherwise(
        F.element_at(F.split(path, "/"), -1)
    )

    def store(batch: DataFrame, _: int) -> None:
        lines = data_lines(number_lines(batch), header, version)
        parsed = parse_uci_lines(lines, timezone=timezone)
        store_import(parsed, target, profile="uci")

    return (
        raw_lines(text)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{shared_checkpoint_dir(spark)}/{name}")
        .trigger(availableNow=True)
        .start()
    )
