"""What changed between full deliveries of a table (problem 6).

`SnapshotIndex` keeps the last delivery as a table from key to a 64-bit hash of the normalised content, bucketed by key. A new
delivery is written as the next generation, bucketed alike, and probed against the one in force without an exchange of either; only for
keys whose hash differs are old values fetched. Then the new generation takes the place of the old one. `changes_by_index` feeds a table that
holds many deliveries through the index, one after another: the table is read once and split by delivery, so the cost of a delivery doesn't
grow with the number of those before it.

Defined cases. Rows without key or time take no part. Rows of a key within a delivery: the latest holds; of equal times, the greatest hash.
Fewer than two deliveries, or an empty table: no rows. Null differs from every value; blank equals null; case and outer or repeated spaces don't count.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.session import cut, shared_dir


def squeezed(c: Column) -> Column:
    """Lower case, outer spaces off, inner spaces single; blank becomes null."""
    s = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(s != "", s)


def content_hash(df: DataFrame, columns: list[str]) -> Column:
    """64-bit hash of the normalised columns; null differs from every value and from a null in another column."""
    parts = []
    for name in columns:
        kind = df.schema[name].dataType
        c = squeezed(F.col(name)) if isinstance(kind, T.StringType) else F.col(name)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)  # -0.0 is 0.0
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def utc_date(c: Column) -> Column:
    return F.to_date(F.to_utc_timestamp(c, F.current_timezone()))


def hashed(df: DataFrame, key: str, at: str, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(delivery, key, at, hash, ...keep) of the rows that can be followed; the delivery is the UTC date of `at`."""
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return rows.select(utc_date(F.col(at)).alias("delivery"), F.col(key).alias("key"), F.col(at).alias("at"), content_hash(df, columns).alias("hash"), *[F.col(c).alias(f"v_{c}") for c in keep])


def latest(rows: DataFrame) -> DataFrame:
    """One row (key, hash, v_...) a key of a delivery's hashed rows.

    Rows are combined before the exchange, so a key that holds a third of all rows costs one row a task.
    """
    kept = ["at", "hash", *[c for c in rows.columns if c.startswith("v_")]]
    return rows.groupBy("key").agg(F.max(F.struct(*kept)).alias("best")).select("key", *[f"best.{c}" for c in kept[1:]])


def split_deliveries(rows: DataFrame, path: str) -> tuple[DataFrame, list[dt.date]]:
    """Writes hashed rows by delivery, without an exchange, and gives the written table and its deliveries in order.

    The list is bounded by the calendar, not by the rows.
    """
    rows.write.partitionBy("delivery").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return written, sorted(r[0] for r in written.select("delivery").distinct().collect())


def probe(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change_kind) of two indexes (key, hash): a full outer join on the key they are both bucketed by."""
    o, n = old.select("key", F.col("hash").alias("oh"), F.lit(True).alias("o")), new.select("key", F.col("hash").alias("nh"), F.lit(True).alias("n"))
    j = o.join(n, "key", "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("oh") != F.col("nh"), "changed")
    return j.select("key", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())


def fetch_values(changes: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The stored rows of the changed keys only: a semi join, so that unchanged rows never travel with their values."""
    return rows.join(changes.select(F.col("key").alias(key)).distinct(), key, "left_semi")


class SnapshotIndex:
    """The index of the last delivery, kept under `path`, bucketed by key, and swapped when a new delivery was probed.

    A swap writes a pointer of the next number under a name of its own and renames it, which is one step; the pointer with the greatest number is in force,
    so a run that dies at any point leaves the former index or the new one, never none. The pointer names the generation in force and
    the one before: a delivery that is run again after its swap is probed against the generation before. Older generations are deleted.
    """

    POINTER = "CURRENT-"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(self._path())) if n.startswith(self.POINTER))

    def in_force(self) -> dict | None:
        """What the newest pointer says: number, label, generation, before, buckets, schema."""
        got = self._pointers()
        return json.loads(self.spark.read.text(f"{self.path}/{got[-1]}", wholetext=True).first()[0]) if got else None

    def generation(self, name: str, about: dict) -> DataFrame:
        """A generation as a bucketed table; one that another session wrote is made known to this one."""
        if not self.spark.catalog.tableExists(name):
            at = f"{self.path}/{name}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE `{name}` ({about['schema']}) USING parquet OPTIONS (path '{at}') CLUSTERED BY (key) SORTED BY (key) INTO {about['buckets']} BUCKETS")
        return self.spark.table(name)

    def current(self) -> DataFrame | None:
        """(key, hash) of the delivery in force."""
        now = self.in_force()
        return self.generation(now["generation"], now) if now else None

    def advance(self, delivery: DataFrame, label: str | None = None) -> DataFrame:
        """Probe `delivery` (key, hash; keys unique) against the index in force, then swap. Returns (key, change_kind); the first has none."""
        now = self.in_force()
        if now and label is not None and now["label"] == label:
            return self._changes(now["before"], now["generation"], now)
        name = f"generation_{uuid.uuid4().hex}"
        new = delivery.select("key", "hash")
        new.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        about = {"number": now["number"] + 1 if now else 1, "label": label, "generation": name, "before": now["generation"] if now else None, "buckets": self.buckets, "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.schema.fields)}
        out = self._changes(about["before"], name, about)
        self._swap(about)
        return out

    def _changes(self, old: str | None, new: str, about: dict) -> DataFrame:
        fresh = self.generation(new, about)
        if old is None:
            return fresh.select("key", F.lit(None).cast("string").alias("change_kind")).where(F.lit(False))
        return cut(probe(self.generation(old, about), fresh))

    def _swap(self, about: dict) -> None:
        fs, pointer = self._fs(), f"{self.POINTER}{about['number']:012d}"
        tmp = self._path(f"new-{uuid.uuid4().hex}")
        s = fs.create(tmp, True)
        s.write(bytearray(json.dumps(about).encode()))
        s.close()
        if not fs.rename(tmp, self._path(pointer)):
            raise OSError(f"{pointer} can't be put in force")
        self._clean(about)

    def _clean(self, about: dict) -> None:
        """Deletes what is neither in force nor the generation before it, also the leavings of runs that died."""
        fs, kept = self._fs(), {about["generation"], about["before"], f"{self.POINTER}{about['number']:012d}"}
        for f in fs.listStatus(self._path()):
            name = f.getPath().getName()
            if name not in kept:
                fs.delete(f.getPath(), True)
                if name.startswith("generation_"):
                    self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    def drop(self) -> None:
        """Deletes the index and all that belongs to it."""
        now = self.in_force()
        for name in (now["generation"], now["before"]) if now else ():
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        self._fs().delete(self._path(), True)


def _advanced(df: DataFrame, key: str, at: str, columns: list[str], keep: list[str] = ()) -> Iterator[tuple[dt.date, DataFrame, DataFrame | None, DataFrame]]:
    """(delivery, its changes, latest rows of the delivery before, latest rows of the delivery), delivery by delivery; the store is deleted at the end."""
    root = f"{shared_dir(df.sparkSession)}/snapshots-{uuid.uuid4().hex}"
    index = SnapshotIndex(df.sparkSession, f"{root}/index")
    split, days = split_deliveries(hashed(df, key, at, columns, keep), f"{root}/deliveries")
    before = None
    for day in days:
        rows = latest(split.where(F.col("delivery") == F.lit(day)))
        yield day, index.advance(rows, str(day)), before, rows
        before = rows
    index.drop()
    index._fs().delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(root), True)


def changes_by_index(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """(snapshot_date, dedup_key, change_kind) of all consecutive deliveries. No rows for fewer than two deliveries."""
    out = df.sparkSession.createDataFrame([], T.StructType([T.StructField("snapshot_date", T.StringType()), T.StructField("dedup_key", df.schema[key].dataType), T.StructField("change_kind", T.StringType())]))
    for day, changes, before, _ in _advanced(df, key, at, columns):
        if before is not None:
            out = out.unionAll(changes.select(F.lit(str(day)), "key", "change_kind"))
    return out


def as_text(c: Column, kind: T.DataType) -> Column:
    return c.cast("decimal(28,2)").cast("string") if isinstance(kind, (T.DoubleType, T.FloatType)) else c.cast("string")


def changed_values(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """(snapshot_date, dedup_key, column_name, old_value, new_value): what changed in the changed keys. Values are fetched for those only."""
    out = df.sparkSession.createDataFrame([], T.StructType([T.StructField("snapshot_date", T.StringType()), T.StructField("dedup_key", df.schema[key].dataType), *[T.StructField(c, T.StringType()) for c in ("column_name", "old_value", "new_value")]]))
    kinds = {c: df.schema[c].dataType for c in columns}
    for day, changes, before, rows in _advanced(df, key, at, columns, columns):
        if before is None:
            continue
        changed = changes.where("change_kind = 'changed'")
        old, new = (fetch_values(changed, r, "key").select("key", *[(squeezed(F.col(f"v_{c}")) if isinstance(k, T.StringType) else F.col(f"v_{c}")).alias(f"{side}_{c}") for c, k in kinds.items()]) for side, r in (("o", before), ("n", rows)))
        each = [F.when(~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.struct(F.lit(c).alias("column_name"), as_text(F.col(f"o_{c}"), k).alias("old_value"), as_text(F.col(f"n_{c}"), k).alias("new_value"))) for c, k in kinds.items()]
        met = cut(old.join(new, "key").select("key", F.explode(F.array_compact(F.array(*each))).alias("c")))
        out = out.unionAll(met.select(F.lit(str(day)), "key", "c.column_name", "c.old_value", "c.new_value"))
    return out
