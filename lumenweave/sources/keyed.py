"""Keyed tables: an upsert rewrites only the buckets that its keys fall into.

Rows lie in buckets by a hash of their key.  A commit is one small file that
names, for each bucket, the folder that holds it; a writer puts new folders
beside the old ones and then creates the next commit, which fails if another
writer was faster.  Readers follow one commit and so see all of a write or
nothing of it; folders that no commit names are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one read the table; nothing of this write counts."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _at(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the commits, ascending."""
        root, fs = self._at("commits")
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] not in "._")

    def commit(self, version: int | None = None) -> dict:
        """What a commit says: schema, keys, and each bucket's folder.  ``version`` none: the newest."""
        done = self.versions()
        if not done or version is not None and version not in done:
            raise FileNotFoundError(f"{self.path}: no commit {'' if version is None else version}")
        version = done[-1] if version is None else version
        body = self.spark.read.text(f"{self.path}/commits/{version:08d}.json", wholetext=True).first()[0]
        return json.loads(body) | {"version": version}

    def _read(self, told: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(told["folders"].items()) if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], told["schema"])
        return self.spark.read.schema(told["schema"]).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a commit."""
        return self._read(self.commit(version))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, order: list[str] | None = None) -> int:
        """Rows replace those of the same key; returns the commit's number.

        Of several rows of a key the greatest by ``order`` and then by all columns counts, whatever order they come in;
        a null in a key is a key like another.  Columns are the table's.
        """
        done = self.versions()
        told = self.commit(done[-1]) if done else {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "folders": {}, "keys": self.keys, "buckets": self.buckets, "version": -1}
        if told["keys"] != self.keys or told["buckets"] != self.buckets:
            raise ValueError(f"the table has keys {told['keys']} in {told['buckets']} buckets")
        if done:
            rows = rows.select(*[f.name for f in self._read(told, []).schema])
        fresh = self._last(rows, order or [])
        fresh = fresh.withColumn("__bucket", self.bucket())
        name = f"data/{told['version'] + 1:08d}-{uuid.uuid4().hex}"
        staged = f"{self.path}/{name}-incoming"
        fresh.write.partitionBy("__bucket").parquet(staged)
        fresh = self.spark.read.schema(f"{told['schema']}, __bucket int").parquet(staged)
        touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())
        folders = dict(told["folders"])
        if touched:
            current = self._read(told, touched).withColumn("__bucket", self.bucket())
            same = None
            for k in self.keys:
                one = current[k].eqNullSafe(fresh[k])
                same = one if same is None else same & one
            merged = current.join(fresh, same, "left_anti").unionByName(fresh)
            merged.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
            folders |= {str(b): f"{name}/__bucket={b}" for b in touched}
        self._drop(f"{name}-incoming")
        return self._commit(told["version"] + 1, told | {"folders": folders}, name)

    @staticmethod
    def _struct(names: list[str]) -> Column:
        return F.struct(*[F.col(n) for n in names])

    def _last(self, rows: DataFrame, order: list[str]) -> DataFrame:
        keys = [F.col(k).alias(f"__{i}") for i, k in enumerate(self.keys)]
        best = rows.groupBy(*keys).agg(F.max_by(self._struct(rows.columns), self._struct([*order, *rows.columns])).alias("row"))
        return best.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns])

    def _commit(self, number: int, told: dict, name: str) -> int:
        target, fs = self._at(f"commits/{number:08d}.json")
        body = json.dumps({k: told[k] for k in ("schema", "keys", "buckets", "folders")}).encode()
        try:
            out = fs.create(target, False)
        except Exception as error:
            if not fs.exists(target):
                raise
            self._drop(name)
            raise ConcurrentWrite(f"{self.path}: commit {number} is another writer's") from error
        out.write(body)
        out.close()
        return number

    def _drop(self, name: str) -> None:
        target, fs = self._at(name)
        fs.delete(target, True)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the commits before the newest ``keep`` and the folders that only they name; returns how many folders went.

        Not to be run beside a writer, whose folders no commit names yet.
        """
        done = self.versions()
        named = {f for v in done[-keep:] for f in self.commit(v)["folders"].values()}
        for v in done[:-keep]:
            self._drop(f"commits/{v:08d}.json")
        root, fs = self._at("data")
        gone = 0
        for top in fs.listStatus(root) if fs.exists(root) else []:
            inner = [f"data/{top.getPath().getName()}/{s.getPath().getName()}" for s in fs.listStatus(top.getPath()) if s.isDirectory()]
            for folder in inner:
                if folder not in named:
                    self._drop(folder)
                    gone += 1
            if not any(f in named for f in inner):
                self._drop(f"data/{top.getPath().getName()}")
        return gone
