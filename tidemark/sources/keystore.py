"""A growing table of keys in hash buckets, so that a batch reads only what its keys can be in.

Layout of a store::

    _manifest/00000012.json            which folders are alive, and the last batch of every stream
    <folder>/data/bucket=17/*.parquet  rows, one file a bucket
    <folder>/filter/*.parquet          a bitmap of key hashes for each bucket, about eight bits a row

A batch adds a folder of level 0. ``FAN`` folders of one level are merged into one of the next, so that there are no
more than ``FAN`` folders of a level, and levels grow with the logarithm of the number of batches. A reader takes
the newest manifest; folders that a merge has replaced are deleted by the merge after it, which leaves readers of
the manifest before the time they need. A manifest is created and never changed: of two writers with the same
number one fails, and looks its keys up again. A batch that is repeated is known by its stream and number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64  # of a new store; fixed for its life
FAN = 8
SLICE = 32768  # bits of a bitmap of Spark
BITS = 8  # of the filter for each row
ATTEMPTS = 20


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[str]:
    files, place = _files(spark, f"{path}/_manifest")
    if not files.exists(place):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest that is written to its end; that of an empty store where there is none."""
    for name in reversed(_versions(spark, path)[-3:]):
        rows = spark.read.text(f"{path}/_manifest/{name}", wholetext=True).collect()
        try:
            return json.loads(rows[0][0])
        except (IndexError, ValueError):
            continue  # somebody is writing it
    return {"version": 0, "buckets": BUCKETS, "folders": [], "retired": [], "batches": {}}


def _commit(spark: SparkSession, path: str, new: dict) -> bool:
    """Write a manifest as the next one; False where another writer was first."""
    files, place = _files(spark, f"{path}/_manifest/{new['version']:08d}.json")
    try:
        out = files.create(place, False)
    except Exception as error:
        if files.exists(place):
            return False
        raise error
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    return True


def _hash(key: str | Column = "dedup_key") -> Column:
    return F.xxhash64(key)


def _bucket(buckets: int) -> Column:
    return F.pmod(_hash(), F.lit(buckets)).cast("int")


def _place(slices: Column) -> Column:
    """Bit of a key in the filter of its bucket."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(1), "dedup_key"), 1), slices * SLICE)


def _write(spark: SparkSession, path: str, rows: DataFrame, buckets: int, level: int) -> dict | None:
    """Write rows as a folder; its entry of the manifest, none where there are no rows."""
    name = f"f{level}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "dedup_key")
    dealt.write.partitionBy("bucket").parquet(f"{path}/{name}/data")
    written = spark.read.schema(dealt.schema).parquet(f"{path}/{name}/data")
    count = written.count()
    if not count:
        return None
    slices = -(-BITS * count // (buckets * SLICE))
    place = _place(F.lit(slices))
    bits = written.groupBy("bucket", F.floor(place / SLICE).alias("slice")).agg(
        F.bitmap_construct_agg(F.pmod(place, F.lit(SLICE))).alias("bits")
    )
    bits.coalesce(1).write.parquet(f"{path}/{name}/filter")
    return {"name": name, "level": level, "rows": count, "slices": slices}


def _rows(spark: SparkSession, path: str, schema, folders: list[dict]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema).option("recursiveFileLookup", "true")
    return read.parquet(*[f"{path}/{f['name']}/data" for f in folders])


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of a store."""
    return _rows(spark, path, schema, manifest(spark, path)["folders"])


def touched(spark: SparkSession, path: str, keys: DataFrame, now: dict | None = None) -> tuple[DataFrame, list[tuple[str, int]]]:
    """Keys that the filters let through, and the (folder, bucket) pairs they may be in."""
    now = now or manifest(spark, path)
    schema = "folder string, bucket int, slice long, bits binary"
    parts = [
        spark.read.schema("bucket int, slice long, bits binary").parquet(f"{path}/{f['name']}/filter").withColumn("folder", F.lit(f["name"]))
        for f in now["folders"]
    ]
    filters = spark.createDataFrame([], schema)
    for part in parts:
        filters = filters.unionByName(part)
    folders = F.array(*[F.struct(F.lit(f["name"]).alias("folder"), F.lit(f["slices"]).cast("long").alias("slices")) for f in now["folders"]])
    asked = keys.select("dedup_key").distinct().select("dedup_key", _bucket(now["buckets"]).alias("bucket"), F.explode(folders).alias("f"))
    place = _place(F.col("f.slices"))
    asked = asked.select("dedup_key", "bucket", F.col("f.folder").alias("folder"), F.floor(place / SLICE).alias("slice"), F.pmod(place, F.lit(SLICE)).alias("bit"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)), F.lit(2)) == 1
    maybe = asked.join(filters, ["folder", "bucket", "slice"]).where(is_set).select("dedup_key", "folder", "bucket")
    return maybe, [tuple(r) for r in maybe.select("folder", "bucket").distinct().collect()]


def known_keys(spark: SparkSession, path: str, keys: DataFrame, now: dict | None = None) -> DataFrame:
    """Keys of ``keys`` (dedup_key) that the store holds. Only buckets are read that a filter lets a key into."""
    now = now or manifest(spark, path)
    if not now["folders"]:
        return spark.createDataFrame([], "dedup_key string")
    maybe, where = touched(spark, path, keys, now)
    if not where:
        return spark.createDataFrame([], "dedup_key string")
    held = spark.read.schema("dedup_key string").parquet(*[f"{path}/{folder}/data/bucket={bucket}" for folder, bucket in where])
    return held.join(maybe.select("dedup_key").distinct(), "dedup_key", "left_semi").distinct()


def append_new(
    spark: SparkSession, path: str, rows: DataFrame, stream: str, batch: int,
    prepare: Callable[[DataFrame], DataFrame] = lambda new: new,
) -> bool:
    """Add the rows whose key the store does not hold, one a key at most in ``rows``; False where the batch is in already.

    ``prepare`` makes the stored rows from the new ones.
    """
    path = path.rstrip("/")
    for _ in range(ATTEMPTS):
        now = manifest(spark, path)
        if now["batches"].get(stream, -1) >= batch:
            return False
        new = rows.join(known_keys(spark, path, rows, now), "dedup_key", "left_anti")
        entry = _write(spark, path, prepare(new), now["buckets"], 0)
        after = {**now, "version": now["version"] + 1, "batches": {**now["batches"], stream: batch}}
        after["folders"] = now["folders"] + ([entry] if entry else [])
        if _commit(spark, path, after):
            compact(spark, path, prepare(rows).schema)
            return True
    raise RuntimeError(f"{path} has other writers all the time")


def compact(spark: SparkSession, path: str, schema) -> None:
    """Merge ``FAN`` folders of a level into one of the next, for as long as there are so many."""
    while True:
        now = manifest(spark, path)
        levels: dict[int, list[dict]] = {}
        for folder in now["folders"]:
            levels.setdefault(folder["level"], []).append(folder)
        full = [level for level, own in sorted(levels.items()) if len(own) >= FAN]
        if not full:
            return
        own = levels[full[0]]
        entry = _write(spark, path, _rows(spark, path, schema, own), now["buckets"], full[0] + 1)
        gone = [f["name"] for f in own]
        after = {**now, "version": now["version"] + 1, "retired": gone}
        after["folders"] = [f for f in now["folders"] if f["name"] not in gone] + ([entry] if entry else [])
        if _commit(spark, path, after):
            for name in now["retired"]:
                files, place = _files(spark, f"{path}/{name}")
                files.delete(place, True)
