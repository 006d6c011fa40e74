"""The upload queue as a stream: waiting files are taken in order of arrival, one at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labspark.operators.quality import MALFORMED
from labspark.sources.tables import read_csv


def upload_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the CSV files of a folder, oldest first, one per micro-batch; contents are not read."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.csv")
        .option("maxFilesPerTrigger", 1)
        .load(folder)
        .select("path")
    )


def process_uploads(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Call handle(upload, file_id) for each file; `upload` has line numbers from 2 on.

    `checkpoint` is a folder that outlives the run: a restart goes on with the first file
    not yet finished. `handle` may see that file again, under the same file_id, which is a
    hash of the path; `append_batch` overwrites what it wrote for it. Records that do not
    fit the header are kept in the column malformed_record, which the checks report.
    """

    def one_file(paths: DataFrame, batch_id: int) -> None:
        for row in paths.select("path", F.abs(F.xxhash64("path")).alias("file_id")).collect():  # the stream gives one path per batch
            upload = read_csv(paths.sparkSession, row.path, line_no="line_no", malformed=MALFORMED)
            handle(upload, row.file_id)

    writer = stream.writeStream.foreachBatch(one_file).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
