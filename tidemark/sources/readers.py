"""Sources: record topics (Kafka where the connector is there, files otherwise), dimensions and Parquet stores."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COMPANY, FUNDAMENTALS


def _first_start(spark: SparkSession, mark: str) -> int:
    """The milliseconds in the file `mark`; now, which is written there, if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        staged = place.suffix(f".{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(str(time.time_ns() // 1_000_000).encode()))
        out.close()
        if not fs.rename(staged, place):
            raise OSError(f"{mark} could not be written")
    return int(spark.read.text(mark).first()[0])


def read_records(spark: SparkSession, source: dict, schema: str | None = None, *, streaming: bool = False, start: str = "earliest", mark: str | None = None) -> DataFrame:
    """Records of a source: {"format": "kafka", "servers", "topics"}, or {"format": "text" | "json" | "parquet", "path"}.

    Text and Kafka give `value`, parsed to `schema` if one is given (unparseable ones are null rows). A stream resumes from its query's checkpoint; `start` counts for a new one.
    `latest` leaves out what is there at the first start. Files have no offsets, so a stream of files then needs `mark`, a path for one small file beside the checkpoint that keeps the time of
    that start: files written while the stream was down are read when it is up again. A batch has no first start, so `latest` is an error there.
    """
    if start == "latest" and (not streaming or source["format"] != "kafka" and not mark):
        raise ValueError("latest is for streams; one of files needs mark, a path that keeps its first start")
    late = streaming and start == "latest" and source["format"] != "kafka"

    def begun(df: DataFrame) -> DataFrame:
        return df.filter(F.col("_metadata.file_modification_time") > F.timestamp_millis(F.lit(_first_start(spark, mark)))) if late else df

    reader = spark.readStream if streaming else spark.read
    if source["format"] == "kafka":
        options = {"kafka.bootstrap.servers": source["servers"], "subscribe": ",".join(source["topics"]), "startingOffsets": start}
        raw = reader.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))
    elif source["format"] == "text":
        raw = begun(reader.text(source["path"]))
    else:
        return begun((reader.schema(schema) if schema else reader).format(source["format"]).options(**source.get("options", {})).load(source["path"]))
    return raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*") if schema else raw


def read_companies(spark: SparkSession, source: str | dict, active_only: bool = True) -> DataFrame:
    """The company dimension from a CSV with header (null literal `null`, blanks before values), or over JDBC from options; by ticker_id."""
    if isinstance(source, dict):
        df = spark.read.format("jdbc").options(**source).load()
    else:
        df = spark.read.schema(COMPANY).options(header=True, nullValue="null", ignoreLeadingWhiteSpace=True).csv(source)
    return (df.filter("is_active") if active_only else df).orderBy("ticker_id")


def read_fundamentals(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Fundamentals stored by symbol and calendarYear; a year prunes partitions."""
    df = spark.read.schema(FUNDAMENTALS).parquet(path).filter(F.col("calendarYear").try_cast("int").isNotNull())
    return df.filter(F.col("calendarYear") == str(year)) if year is not None else df


def read_ticker(df: DataFrame, ticker: str, order: str = "timestamp") -> DataFrame:
    """One ticker in order of time."""
    return df.filter(F.col("ticker") == ticker).orderBy(order)
