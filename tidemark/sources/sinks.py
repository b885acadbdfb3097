"""Sinks: partitioned Parquet stores, keyed upserts, record topics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from ..operators.records import dedupe, upsert_rows

#: Store -> (partition columns as SQL over the record, record key). Trades of one time are told apart by their id, and so are predictions.
STORES = {
    "trades": ({"ticker": "ticker", "date": "date_format(ts, 'yyyy-MM-dd')"}, ["ticker", "ts", "event_id"]),
    "news": ({"ticker": "ticker", "date": "date_format(ts, 'yyyy-MM-dd')"}, ["id"]),
    "posts": ({"date": "date_format(ts, 'yyyy-MM-dd')", "keyword": "keyword"}, ["id"]),
    "forum": ({"date": "date_format(ts, 'yyyy-MM-dd')", "subreddit": "coalesce(subreddit, 'unknown')"}, ["id"]),
    "macro": ({"series": "series", "year": "year(date)"}, ["series", "date"]),
    "sentiment": ({"social": "social", "ticker": "ticker", "month": "date_format(ts, 'yy-MM')"}, ["social", "ticker", "ts"]),
    "predictions": ({"ticker": "ticker", "month": "date_format(ts, 'yy-MM')"}, ["ticker", "ts", "event_id"]),
    "bars": ({"ticker": "ticker", "year": "extract(YEAROFWEEK FROM ts)", "week": "weekofyear(ts)"}, ["ticker", "ts"]),
    "fundamentals": ({"symbol": "symbol", "calendarYear": "calendarYear"}, ["symbol", "calendarYear"]),
}


def write_partitioned(df: DataFrame, path: str, by: dict[str, str], key: list[str] | None = None, order: Column | None = None) -> None:
    """Write below `path` by partition columns; of rows with one key the last in order stays; only partitions that df has are replaced.

    Rows are dealt by their partition first, rebalanced so that a hot partition is several files and a small one is one.
    """
    out = dedupe(df, key, order, last=True) if key and order is not None else df
    out = out.withColumns({c: F.expr(e) for c, e in by.items()})
    out.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*by).parquet(path)


def write_store(df: DataFrame, name: str, path: str, order: Column) -> None:
    by, key = STORES[name]
    write_partitioned(df, path, by, key, order)


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, make = _files(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(make(f"{path}/versions"))] if fs.exists(make(f"{path}/versions")) else []
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    """What a version is made of: the number of buckets, the schema, and the folder of each bucket."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/versions/v{version}.json").collect()))


def _newest(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each bucket in the newest version of an upsert store."""
    done = _versions(spark, path)
    return {int(b): f for b, f in _manifest(spark, path, done[-1])["folders"].items()} if done else {}


def stage_upsert(new: DataFrame, path: str, keys: list[str], order: str, buckets: int = 16) -> tuple[int, dict]:
    """Write the merged rows of all buckets that have new rows beside the store, and say which version with which manifest makes them count. Readers see nothing of it."""
    spark = new.sparkSession
    done = _versions(spark, path)
    before = _manifest(spark, path, done[-1]) if done else {"buckets": buckets, "folders": {}}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(before["buckets"])).cast("int")
    touched = sorted(r[0] for r in new.select(bucket).distinct().collect())
    old = [before["folders"][str(b)] for b in touched if str(b) in before["folders"]]
    merged = upsert_rows(spark.read.schema(new.schema).parquet(*[f"{path}/{f}" for f in old]), new, keys, order) if old else dedupe(new, keys, F.col(order), last=True)
    commit = uuid.uuid4().hex
    merged.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{path}/data/{commit}")
    folders = before["folders"] | {str(b): f"data/{commit}/_bucket={b}" for b in touched}
    return (done[-1] if done else -1) + 1, {"buckets": before["buckets"], "schema": new.schema.jsonValue(), "folders": folders}


def publish_upsert(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Make a staged version count, all its buckets at once, by the rename of one file. If another writer has published that version meanwhile, it is an error."""
    fs, make = _files(spark, path)
    place, staged = make(f"{path}/versions/v{version}.json"), make(f"{path}/staged-{uuid.uuid4().hex}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    fs.mkdirs(make(f"{path}/versions"))
    if fs.exists(place) or not fs.rename(staged, place):
        fs.delete(staged, False)
        raise RuntimeError(f"version {version} of {path} was written by another writer")
    # The version before stays for readers; folders that neither it nor this one names go, with the versions that named them.
    kept = set(manifest["folders"].values()) | (set(_manifest(spark, path, version - 1)["folders"].values()) if version else set())
    for old in [v for v in _versions(spark, path) if v < version - 1]:
        for folder in set(_manifest(spark, path, old)["folders"].values()) - kept:
            fs.delete(make(f"{path}/{folder}"), True)
        fs.delete(make(f"{path}/versions/v{old}.json"), False)


def upsert(new: DataFrame, path: str, keys: list[str], order: str, buckets: int = 16) -> None:
    """Insert or replace rows of a Parquet store by key, last write wins.

    Keys are dealt into buckets by hash, and only buckets that have new rows are merged and written, beside what is there. One rename of the version's manifest
    then publishes them all, so a reader sees a batch whole or not at all, and a batch that was cut off before it is as if it had not been. The number of buckets is
    kept in the manifest: it is that of the first call, whatever later ones say.
    """
    publish_upsert(new.sparkSession, path, *stage_upsert(new, path, keys, order, buckets))


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of an upsert store."""
    done = _versions(spark, path)
    if not done:
        raise FileNotFoundError(f"{path} holds no upsert store")
    manifest = _manifest(spark, path, done[-1])
    schema = StructType.fromJson(manifest["schema"])
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for _, f in sorted(manifest["folders"].items())]) if manifest["folders"] else spark.createDataFrame([], schema)


def upsert_batch(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that is run again changes nothing."""
    return lambda df, batch_id: upsert(df, path, keys, order)


def write_records(df: DataFrame, sink: dict, key: str | None = None) -> DataStreamWriter | None:
    """The rows as JSON records: to Kafka with the key, to text files, or to the console. For a stream the writer is returned, to be started."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    out = df.select(value, *([F.col(key).cast("string").alias("key")] if key and sink["format"] == "kafka" else []))
    if sink["format"] == "console" and not df.isStreaming:
        df.show(truncate=False)
        return None
    writer = out.writeStream if df.isStreaming else out.write
    if sink["format"] == "kafka":
        writer = writer.format("kafka").option("kafka.bootstrap.servers", sink["servers"]).option("topic", sink["topic"])
    elif sink["format"] == "console":
        writer = df.writeStream.format("console")
    else:
        writer = writer.format("text").option("path", sink["path"])
    if df.isStreaming:
        return writer
    writer.mode("append").save()
    return None
