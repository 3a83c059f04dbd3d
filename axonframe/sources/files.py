"""Sources and sinks: partitioned Parquet, CSV, JSON dictionaries, session scans.

Parameters that file names carry elsewhere are partition columns here, so that a slice of
sessions, bands or stages prunes folders, and a slice of frequencies or times is pushed
down to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_signal(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """A signal as Parquet, one folder for each value of ``by``."""
    df.write.mode(mode).partitionBy(*by).parquet(path)


def read_signal(spark: SparkSession, path: str, freqs: list | None = None, times: tuple | None = None) -> DataFrame:
    """A stored signal; the label slices (times inclusive at both ends) reach the scan."""
    df = spark.read.parquet(path)
    if freqs is not None:
        df = df.filter(F.col("freq").isin(list(freqs)))
    if times is not None:
        df = df.filter(F.col("t_idx").between(*times))
    return df


def read_sessions(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Many sessions in one scan; missing files are skipped, also while the scan runs. If
    none is there: an empty table of ``schema``, or an error without one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        return found is not None and len(found) > 0

    present = [p for p in paths if there(p)]
    if not present:
        if schema is None:
            raise FileNotFoundError("none of the paths is there, and no schema is given")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("ignoreMissingFiles", "true")
    return (reader.schema(schema) if schema else reader).parquet(*present)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a stated schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """JSON object {name: region, ...} to (name, region), names in lower case."""
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "region"))
    return pairs.select(F.lower("name").alias("name"), "region")


def raw_trials(spark: SparkSession, path: str, kernel, schema: str) -> DataFrame:
    """Binary recording files (one a trial) decoded by ``kernel`` (path, bytes -> pandas
    frame), a file a row, so that no file is opened on the driver."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                yield kernel(row.path, row.content)

    return files.mapInPandas(run, schema)


def channel_label(roi, channel) -> "F.Column":
    return F.format_string("%s (%d)", F.col(roi), F.col(channel))
