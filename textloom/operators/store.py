"""A keyed table of chunks on plain Parquet: versions, upsert, delete, truncate, count.

Rows lie in buckets by the hash of their page (the key without its chunk number). A version is
a manifest that names one folder for each bucket; a change writes new folders for the buckets
it touches only and then the next manifest, so a reader never sees half a change and a path
being read is never overwritten. Manifests are numbered and created once: of two writers that
start from the same version the second fails instead of undoing the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.schemas import INDEXED
from textloom.session import cut

#: Buckets of a new store; a table of many terabytes wants more.
BUCKETS = 64


class ConcurrentChange(RuntimeError):
    """Another writer committed first; read again and repeat."""


def last_rows(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of each key the row greatest by ``order``; NULL order values come first, NULL keys go."""
    names = rows.columns
    kept = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row"))
    return kept.select("row.*")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` (one row a key) over ``old``: old rows of other keys, and all new ones."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


class ChunkStore:
    """Open or create the table at ``path``; ``schema`` and the number of buckets are fixed when it is created."""

    def __init__(self, spark: SparkSession, path: str, schema: str = INDEXED, key: str = "id", buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._new_path = hadoop.Path
        if not self._numbers():
            self._write_manifest(0, {})
        self.buckets = int(self._lines(self._numbers()[-1])[0])

    # -- manifests

    def _numbers(self) -> list[int]:
        folder = self._new_path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _lines(self, number: int) -> list[str]:
        stream = self._fs.open(self._new_path(f"{self.path}/manifests/{number}"))
        try:
            return [stream.readUTF() for _ in range(stream.readInt())]
        finally:
            stream.close()

    def _manifest(self) -> tuple[int, dict[int, str]]:
        number = self._numbers()[-1]
        return number, {int(b): f for b, f in (line.split(" ") for line in self._lines(number)[1:])}

    def _write_manifest(self, number: int, folders: dict[int, str]) -> None:
        lines = [str(self.buckets), *(f"{b} {f}" for b, f in sorted(folders.items()))]
        try:
            stream = self._fs.create(self._new_path(f"{self.path}/manifests/{number}"), False)
        except Exception as e:  # it exists already
            raise ConcurrentChange(f"{self.path}: version {number} was written by another") from e
        stream.writeInt(len(lines))
        for line in lines:
            stream.writeUTF(line)
        stream.close()

    # -- rows

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.regexp_replace(key, r"#chunk-\d+$", "")), F.lit(self.buckets)).cast("int")

    def _folders(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._folders(self._manifest()[1])

    def _change(self, touched: list[int] | None, new_rows) -> None:
        """Replace the touched buckets (all if None) by ``new_rows`` of what they hold."""
        number, folders = self._manifest()
        old = {b: f for b, f in folders.items() if touched is None or b in touched}
        rows = new_rows(self._folders(old))
        name = uuid.uuid4().hex
        # partitions of whole buckets as far as their size allows: large ones are split, small ones put together
        placed = rows.withColumn("bucket", self.bucket(F.col(self.key)))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._new_path(f"{self.path}/data/{name}"))]
        kept = {b: f for b, f in folders.items() if b not in old}
        self._write_manifest(number + 1, kept | {int(n.removeprefix("bucket=")): name for n in made if n.startswith("bucket=")})

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows; at most as many as there are buckets."""
        return [r.b for r in rows.filter(F.col(self.key).isNotNull()).select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()]

    def commit(self, rows: DataFrame) -> None:
        """Make ``rows`` the whole table in one step; they may be read from its present version."""
        self._change(None, lambda _: rows.select(*self.read().columns))

    def upsert(self, rows: DataFrame, *order: Column) -> int:
        """Insert or replace by key, the last of equal keys by ``order``; gives the rows offered."""
        rows = cut(rows)  # embedded once, read several times
        offered = rows.count()
        if not order:
            rows, order = rows.withColumn("_arrival", F.monotonically_increasing_id()), (F.col("_arrival"),)
        self._change(self._touched(rows), lambda old: upserted(old, last_rows(rows, self.key, *order), self.key))
        return offered

    def merge(self, rows: DataFrame, *order: Column) -> None:
        """Keep of each key the row greatest by ``order``, whether it is old or new."""
        self._change(self._touched(rows), lambda old: last_rows(old.unionByName(rows.select(*old.columns)), self.key, *order))

    def replace_page(self, url: str, rows: DataFrame) -> None:
        """Put a page's chunks in place of all it had, stale higher numbers included."""
        self._change(self._touched(rows.unionByName(self._of(url), allowMissingColumns=True)), lambda old: old.filter(~self._is(url)).unionByName(rows.select(*old.columns)))

    def replace_pages(self, urls: DataFrame) -> None:
        """Drop all chunks of the pages of (url), whose keys begin with the address; only their buckets are rewritten."""
        own = urls.select(F.col("url").alias(self.key)).distinct()
        self._change(self._touched(own), lambda old: old.withColumn("url", F.col("metadata.url")).join(urls.select("url").distinct(), "url", "left_anti").select(*old.columns))

    def _is(self, url: str) -> Column:
        return F.col("metadata.url").eqNullSafe(F.lit(url))

    def _of(self, url: str) -> DataFrame:
        return self.read().filter(self._is(url))

    def delete_by_url(self, url: str) -> None:
        self._change(self._touched(self._of(url)), lambda old: old.filter(~self._is(url)))

    def delete(self, condition: Column) -> None:
        """Delete the rows for which ``condition`` is true; buckets without any stay as they are."""
        gone = F.coalesce(condition, F.lit(False))
        self._change(self._touched(self.read().filter(gone)), lambda old: old.filter(~gone))

    def clear(self) -> None:
        self._write_manifest(self._manifest()[0] + 1, {})

    def count(self) -> int:
        return self.read().count()

    def vacuum(self) -> int:
        """Remove the folders and manifests of all versions but the current one; gives the number of folders."""
        number, folders = self._manifest()
        data, gone = self._new_path(f"{self.path}/data"), 0
        for status in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if status.getPath().getName() not in folders.values():
                self._fs.delete(status.getPath(), True)
                gone += 1
        for old in self._numbers():
            if old < number:
                self._fs.delete(self._new_path(f"{self.path}/manifests/{old}"), False)
        return gone
