"""New files as a stream: an extension for folders that only ever grow; scans (``operators.library``) do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from diskloom.operators.library import index_files

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, pattern: str = "*", most_files: int = 1000) -> DataFrame:
    """Files that appear under ``folder``, each once, up to ``most_files`` in a batch."""
    reader = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files)
    return reader.load(folder)


def index_new_files(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Entries of new files appended to a Parquet table; all files there are read, then the query ends.

    The checkpoint remembers which files were read, so a restart neither loses nor repeats one.
    """
    return index_files(files.select("path", "content")).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
