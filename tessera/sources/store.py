"""Tables of records in Parquet that are changed by key: upserts, deletions, updates, replacement by document.

A table is files in folders by the hash of one column, the partition, and numbered manifests that say
which files count. A change reads and rewrites the partitions that it touches and no others; its files
are written beside the others, and a new manifest, put in place by one rename, makes them the table.
So a reader sees a table before a change or after it, a change that fails leaves the table as it was,
and of two changes at once the second fails. Values of the partition column never become folder
names, so nulls, blanks and slashes are values like others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

_PART = "__part"


class Conflict(RuntimeError):
    """Another change was committed since this one began."""


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def last_of(rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row of each key: the last by `order`, nulls first; of equals the greatest by all its columns."""
    whole = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
    by = ([F.col(f"`{order}`").desc_nulls_last()] if order else []) + [whole.desc()]
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__r = 1").drop("__r")


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], partition: str):
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), list(keys), partition

    # --- manifests -----------------------------------------------------------------------------

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        return at, at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the manifests that are there, rising."""
        at, fs = self._fs()
        folder = at(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> tuple[int, dict]:
        """(version, {schema, files by hash of the partition}); version 0 is the table before its first change."""
        found = self.versions()
        if not found:
            return 0, {"schema": None, "files": {}}
        version = found[-1] if version is None else version
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/manifests/{version:012d}.json").first()[0]
        return version, json.loads(text)

    def _commit(self, base: int, schema: StructType | None, files: dict[str, list[str]]) -> int:
        at, fs = self._fs()
        fs.mkdirs(at(f"{self.path}/manifests"))
        staged, place = at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), at(f"{self.path}/manifests/{base + 1:012d}.json")
        out = fs.create(staged)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue() if schema else None, "files": files}).encode()))
        out.close()
        if fs.exists(place) or not fs.rename(staged, place):
            fs.delete(staged, False)
            raise Conflict(f"version {base + 1} of {self.path} is there already")
        return base + 1

    def _load(self, manifest: dict, parts: Sequence[str] | None = None) -> DataFrame | None:
        if not manifest["schema"]:
            return None
        schema = StructType.fromJson(manifest["schema"])
        files = [f"{self.path}/{f}" for p, own in manifest["files"].items() if parts is None or p in parts for f in own]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table, now or as of a version; None where nothing has been written."""
        return self._load(self._manifest(version)[1])

    def restore(self, version: int) -> None:
        """Makes an earlier version the table again."""
        now, _ = self._manifest()
        manifest = self._manifest(version)[1] if version else {"schema": None, "files": {}}
        self._commit(now, StructType.fromJson(manifest["schema"]) if manifest["schema"] else None, manifest["files"])

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the manifests before the last `keep`, and files that none of those names; returns how many folders went.

        To be run while no change is under way.
        """
        at, fs = self._fs()
        found = self.versions()
        used = {f.split("/")[1] for v in found[-keep:] for own in self._manifest(v)[1]["files"].values() for f in own}
        for v in found[:-keep]:
            fs.delete(at(f"{self.path}/manifests/{v:012d}.json"), False)
        folder = at(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in used] if fs.exists(folder) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)

    # --- changes -------------------------------------------------------------------------------

    def _parts(self, rows: DataFrame) -> list[str]:
        """Hashes of the partitions of rows: as many as partitions are touched."""
        return [str(r[0]) for r in rows.select(F.xxhash64(self.partition)).distinct().collect()]

    def _replace(self, base: int, manifest: dict, parts: Sequence[str], content: DataFrame) -> None:
        """Commits content as all there is in the partitions `parts`."""
        at, fs = self._fs()
        folder = f"data/{uuid.uuid4().hex}"
        content.withColumn(_PART, F.xxhash64(self.partition)).repartition(_PART).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        files = {p: own for p, own in manifest["files"].items() if p not in set(parts)}
        for s in fs.listStatus(at(f"{self.path}/{folder}")):
            name = s.getPath().getName()
            if name.startswith(f"{_PART}="):
                inside = [x.getPath().getName() for x in fs.listStatus(s.getPath())]
                files[name.partition("=")[2]] = [f"{folder}/{name}/{x}" for x in inside if x.endswith(".parquet")]
        self._commit(base, content.schema, files)

    def _put(self, rows: DataFrame | None, gone: DataFrame | None, columns: Sequence[str]) -> int:
        """Takes out the rows whose values of `columns` are in `gone`, puts rows in; returns how many went. One commit."""
        base, manifest = self._manifest()
        old, n, parts = self._load(manifest), 0, set(self._parts(rows) if rows is not None else ())
        if old is not None and gone is not None:
            hit = old.join(gone, _same(old, gone, columns), "left_semi").groupBy(F.xxhash64(self.partition).alias("p")).count().collect()
            n, parts = sum(r["count"] for r in hit), parts | {str(r["p"]) for r in hit}
        if not parts:
            return 0
        kept = self._load(manifest, sorted(parts))
        if kept is not None and gone is not None:
            kept = kept.join(gone, _same(kept, gone, columns), "left_anti")
        content = rows if kept is None else kept if rows is None else rows.unionByName(kept, allowMissingColumns=True)
        self._replace(base, manifest, sorted(parts), content)
        return n

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Puts rows in place of those with the same keys, in whatever partition these are.

        Of several rows with one key the last by `order` counts, and of equals the greatest by all
        columns. A null is a key's value like others. Columns that either side lacks are null.
        """
        rows = last_of(rows, self.keys, order)
        self._put(rows, rows.select(*self.keys), self.keys)

    def delete(self, keys: DataFrame) -> int:
        """Removes the rows whose values are in `keys`, a table of some of the columns; returns how many."""
        return self._put(None, keys.distinct(), keys.columns)

    def replace_documents(self, rows: DataFrame, document: str = "doc_id") -> None:
        """Puts rows in place of all rows of the same documents, in one commit, as an index sync does."""
        rows = last_of(rows, self.keys)
        self._put(rows, rows.select(document).distinct(), [document])

    def update(self, where: Column, changes: dict[str, Column]) -> int:
        """Sets columns of the rows that meet `where`; returns how many. A null condition isn't met."""
        base, manifest = self._manifest()
        old = self._load(manifest)
        if old is None:
            return 0
        hit = old.where(where).groupBy(F.xxhash64(self.partition).alias("p")).count().collect()
        parts = [str(r["p"]) for r in hit]
        if parts:
            own = self._load(manifest, parts)
            met = F.coalesce(where, F.lit(False))
            changed = own.select(*(F.when(met, changes[c].cast(own.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c in changes else F.col(f"`{c}`") for c in own.columns))
            if self.partition in changes:  # rows that move join those of their new partition
                parts = sorted(set(parts) | set(self._parts(changed)))
                rest = self._load(manifest, [p for p in parts if p not in {str(r["p"]) for r in hit}])
                changed = changed.unionByName(rest)
            self._replace(base, manifest, parts, changed)
        return sum(r["count"] for r in hit)

    def follow(self, stream: DataFrame, checkpoint: str, order: str):
        """Upserts each micro-batch of a stream; a batch that is repeated after a failure changes nothing."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.upsert(batch, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def transaction(*stores: Store) -> Iterator[None]:
    """Changes of several stores that count together: if the block fails, each store is as it was. May be nested."""
    before = [(s, s._manifest()[0]) for s in stores]
    try:
        yield
    except BaseException:
        for s, version in before:
            if s._manifest()[0] != version:
                s.restore(version)
        raise
