"""Tables of the engine as Parquet snapshots: append, replace, replace from a day on; results made once; CSV export."""

from __future__ import annotations

import hashlib
import logging
import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
#: A table's log: a version that replaces all, all from a day on, or nothing (rows added beside).
ENTRY = "version INT, colonne STRING, depuis STRING, ajout BOOLEAN"


class Store:
    """Named tables under a folder.

    append adds files in one job; replace writes a new snapshot beside the last, replace_from one of the rows from
    a day on. Both point to what they wrote last of all, so that readers and failed jobs never see half a table.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_current"

    def _log(self, name: str) -> list:
        """A row for each version, in order."""
        try:
            return self.spark.read.schema(ENTRY).json(self._pointer(name)).where("version IS NOT NULL").orderBy("version").collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def _point(self, name: str, version: int, column: str | None = None, first: str | None = None, added: bool = False) -> None:
        row = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(column).cast("string").alias("colonne"), F.lit(first).cast("string").alias("depuis"), F.lit(added).alias("ajout"))
        row.write.mode("append").json(self._pointer(name))

    def version(self, name: str) -> int:
        return max((r["version"] for r in self._log(name)), default=0)

    def segments(self, name: str) -> list[tuple[int, str | None, str | None, str | None]]:
        """(version, column, from, to) of the versions that hold rows, and of which days: from, included, to, excluded."""
        held: list[list] = [[0, None, None, None]]
        for r in self._log(name):
            if r["depuis"] is not None:
                held = [[v, c or r["colonne"], a, min(filter(None, (b, r["depuis"])))] for v, c, a, b in held if a is None or a < r["depuis"]]
                held.append([r["version"], r["colonne"], r["depuis"], None])
            elif r["ajout"]:
                held.append([r["version"], None, None, None])
            else:
                held = [[r["version"], None, None, None]]
        return [tuple(x) for x in held]

    def exists(self, name: str) -> bool:
        """Whether the table has been written, by append or by replace."""
        return bool(self._log(name)) or self._read_path(f"{self.root}/{name}/v0") is not None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/v{self.version(name)}"

    def _read_path(self, path: str) -> DataFrame | None:
        try:
            df = self.spark.read.option("mergeSchema", True).parquet(path)
            return df if df.columns else None
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def read(self, name: str, beside: str = "") -> DataFrame:
        """The table; beside: the rows that replace_from has written beside it under that name."""
        parts = []
        for version, column, first, end in self.segments(name):
            df = self._read_path(f"{self.root}/{name}/v{version}" + (f"-{beside}" if beside else ""))
            if df is None:
                continue
            if first is not None:
                df = df.where(F.col(column) >= F.lit(first).cast(df.schema[column].dataType))
            if end is not None:  # rows without a day come before all days
                before = F.col(column) < F.lit(end).cast(df.schema[column].dataType)
                df = df.where(before | F.col(column).isNull() if first is None else before)
            parts.append(df)
        if not parts:
            return self.spark.read.option("mergeSchema", True).parquet(self.path(name))  # the store's own error
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def append(self, name: str, rows: DataFrame) -> None:
        segments = self.segments(name)
        if all(first is None and end is None for _, _, first, end in segments):
            rows.write.mode("append").parquet(self.path(name))
        else:  # the last version holds some days alone, these rows may be of any
            version = self.version(name) + 1
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")
            self._point(name, version, added=True)

    def replace(self, name: str, rows: DataFrame, beside: dict[str, DataFrame] | None = None, days: str | None = None) -> None:
        """beside: smaller tables that become current together with this one; days: a column by which files are kept apart."""
        version = self.version(name) + 1
        self._write(name, version, rows, beside, days)
        self._point(name, version)

    def replace_from(self, name: str, rows: DataFrame, days: str, first: str, beside: dict[str, DataFrame] | None = None) -> None:
        """rows take the place of all rows whose column `days` is `first` or later; earlier ones are neither read nor written. first is a date as text."""
        version = self.version(name) + 1
        self._write(name, version, rows, beside, days)
        self._point(name, version, days, first)

    def _write(self, name: str, version: int, rows: DataFrame, beside: dict[str, DataFrame] | None, days: str | None) -> None:
        for other, df in (beside or {}).items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}-{other}")
        if days:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            rows = rows.repartitionByRange(parts, days, *[c for c in rows.columns if c != days][:1])  # a busy day is several files
        (rows.write.partitionBy(days) if days else rows.write).mode("overwrite").parquet(f"{self.root}/{name}/v{version}")


class Lease:
    """The right to make a thing, held by one session at a time among all that share the store's folder.

    A marker is made only if it is absent, by the file system; its holder renews its time, and one that has not been renewed
    for `seconds` is passed over by making the marker of the next number, which again one session alone can.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 60.0) -> None:
        self.jvm, self.seconds, self.number = spark._jvm, seconds, None
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self._ended = threading.Event()

    def _marker(self, number: int):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, f"bail-{number:08d}")

    def _newest(self) -> tuple[int, float]:
        """The highest number, -1 without any, and the seconds since it was renewed."""
        if not self.files.exists(self.folder):
            return -1, 0.0
        found = [(int(x.getPath().getName().split("-")[1]), x.getModificationTime()) for x in self.files.listStatus(self.folder) if x.getPath().getName().startswith("bail-")]
        number, at = max(found, default=(-1, 0))
        return number, time.time() - at / 1000

    def _make(self, number: int) -> bool:
        self.files.mkdirs(self.folder)
        marker = self._marker(number)
        if self.files.getScheme() == "file":
            return self.jvm.java.io.File(marker.toUri().getPath()).createNewFile()
        try:
            self.files.create(marker, False).close()
            return True
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise

    def take(self) -> bool:
        """Whether this session holds the lease from now on."""
        number, age = self._newest()
        if number >= 0 and age <= self.seconds:
            return False
        if not self._make(number + 1):
            return False
        self.number = number + 1
        threading.Thread(target=self._renew, daemon=True).start()
        return True

    def _renew(self) -> None:
        while not self._ended.wait(self.seconds / 3):
            self.files.setTimes(self._marker(self.number), int(time.time() * 1000), -1)

    def give_back(self) -> None:
        self._ended.set()
        self.files.delete(self._marker(self.number), False)


class Cache:
    """Results kept under the signature of what they were made from; another signature makes them anew.

    Sessions that ask for the same result at the same time make it once: one takes a lease, the others wait for its
    table. If the one that makes it fails, its error is its own, and another takes the lease. Folders of old
    signatures are left to the store's own cleaning.
    """

    def __init__(self, store: Store, lease: float = 60.0, wait: float = 0.2) -> None:
        self.store, self.lease, self.wait = store, lease, wait
        self._pool = ThreadPoolExecutor(2)

    def name(self, result: str, signature: DataFrame) -> str:
        """signature: one row that changes with the source."""
        said = "|".join(map(str, signature.first()))
        return f"cache/{result}-{hashlib.sha256(said.encode()).hexdigest()[:24]}"

    def get(self, result: str, signature: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
        name = self.name(result, signature)
        while not self.store.exists(name):
            lease = Lease(self.store.spark, f"{self.store.root}/{name}-bail", self.lease)
            if not lease.take():
                time.sleep(self.wait)
                continue
            try:
                if not self.store.exists(name):
                    self.store.replace(name, make())
            finally:
                lease.give_back()
        return self.store.read(name)

    def warm(self, result: str, signature: DataFrame, make: Callable[[], DataFrame]) -> Future:
        """Makes the result in the background, as after an import; a failure is logged, and the next get tries again. The future tells whether it is there."""

        def run() -> bool:
            try:
                self.get(result, signature, make)
                return True
            except Exception:
                LOG.exception("%s could not be made in advance", result)
                return False

        return self._pool.submit(run)

    def known(self, result: str, signature: DataFrame) -> bool:
        return self.store.exists(self.name(result, signature))


def export_csv(rows: DataFrame, path: str, about: str | None = None) -> None:
    """A CSV folder with a header in each part, and beside it a text folder <path>-README with the columns and what `about` says."""
    rows.write.mode("overwrite").option("header", True).csv(path)
    if about is not None:
        lines = [about, "", *(f"- {f.name}: {f.dataType.simpleString()}" for f in rows.schema)]
        rows.sparkSession.createDataFrame([("\n".join(lines),)], "value string").write.mode("overwrite").text(f"{path}-README")
