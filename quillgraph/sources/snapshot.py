"""Published snapshots, change detection between listings, and upserts without a table format."""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame, key: str, hash_col: str) -> DataFrame:
    """``(key, change)``: added, deleted or changed, from two listings with one row for each key.

    Two null hashes are equal. Rows with a null key are ignored.
    """
    a = before.where(F.col(key).isNotNull()).select(key, F.col(hash_col).alias("_a"), F.lit(True).alias("_in_a"))
    b = after.where(F.col(key).isNotNull()).select(key, F.col(hash_col).alias("_b"), F.lit(True).alias("_in_b"))
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def upsert(old: DataFrame, new: DataFrame, key: str, deleted: DataFrame | None = None) -> DataFrame:
    """New rows replace old rows of their key; keys of ``deleted`` go."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    out = kept.unionByName(new)
    return out if deleted is None else out.join(deleted.select(key).distinct(), key, "left_anti")


class Conflict(RuntimeError):
    """Another writer holds the store, or has published meanwhile."""


class SnapshotStore:
    """Tables under one root, in numbered versions that never change.

    A version is a manifest that names a folder for each table. It comes into being by a rename that fails where
    the number is taken, so a reader sees the last whole version at any moment and of two writers one is refused.
    ``writer`` keeps a second one out from the start. The last ``keep`` versions and their folders stay.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3, lease: float = 3600.0):
        self.spark, self.root, self.keep, self.lease = spark, root.rstrip("/"), keep, lease
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _put(self, name: str, text: str) -> None:
        """Create a file with its text at once; FileAlreadyExistsException where the name is taken."""
        tmp, to = self._path(f"{self.root}/.tmp-{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(tmp)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
            self._context.rename(tmp, to, none)
        except Exception as e:
            self._fs.delete(tmp, False)
            raise Conflict(f"{name} is taken") from e

    def _read(self, name: str) -> dict | None:
        p = self._path(f"{self.root}/{name}")
        try:
            stream = self._fs.open(p)
        except Exception:  # noqa: BLE001 - gone between the listing and now
            return None
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _numbers(self) -> list[int]:
        root = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n[8:20]) for n in names if n.startswith("version-") and n.endswith(".json"))

    def state(self) -> dict:
        """The last version's manifest."""
        for n in reversed(self._numbers()):
            got = self._read(f"version-{n:012d}.json")
            if got is not None:
                return got
        return {"version": 0, "tables": {}, "config": None}

    def current(self, name: str) -> DataFrame | None:
        at = self.state()["tables"].get(name)
        return self.spark.read.parquet(f"{self.root}/{at}") if at else None

    def needs_rebuild(self, config_hash: str) -> bool:
        return self.state()["config"] != config_hash

    @contextmanager
    def writer(self):
        """Hold the store for writing; Conflict where another does. A lease that has run out is taken over."""
        now = time.time()
        held = self._read("WRITER")
        if held and held["until"] < now:
            self._fs.delete(self._path(f"{self.root}/WRITER"), False)
        me = uuid.uuid4().hex
        self._put("WRITER", json.dumps({"owner": me, "until": now + self.lease}))
        try:
            yield self
        finally:
            if (self._read("WRITER") or {}).get("owner") == me:
                self._fs.delete(self._path(f"{self.root}/WRITER"), False)

    def write(self, name: str, df: DataFrame, partition: list[str] | None = None) -> str:
        """A table's folder, written but not published; ``publish`` takes it, and the next clean-up drops it if nothing does."""
        at = f"{name}-{uuid.uuid4().hex}"
        (df.write.partitionBy(*partition) if partition else df.write).parquet(f"{self.root}/{at}")
        return at

    def read(self, at: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{at}")

    def publish(self, tables: dict[str, DataFrame | str | None], config_hash: str | None = None, partition: dict[str, list[str]] | None = None) -> int:
        """A new version with these tables (or folders from ``write``; None removes one) over the last one's; its number."""
        state = self.state()
        for name, t in tables.items():
            if t is None:
                state["tables"].pop(name, None)
            else:
                state["tables"][name] = t if isinstance(t, str) else self.write(name, t, (partition or {}).get(name))
        if config_hash is not None:
            state["config"] = config_hash
        state["version"] += 1
        self._put(f"version-{state['version']:012d}.json", json.dumps(state))
        self._clean(state["version"])
        return state["version"]

    def _clean(self, last: int) -> None:
        used = set()
        for n in self._numbers():
            if n <= last - self.keep:
                self._fs.delete(self._path(f"{self.root}/version-{n:012d}.json"), False)
            else:
                used |= set((self._read(f"version-{n:012d}.json") or {"tables": {}})["tables"].values())
        for s in self._fs.listStatus(self._path(self.root)):
            name = s.getPath().getName()
            if s.isDirectory() and name not in used and self._old(s):
                self._fs.delete(s.getPath(), True)

    def _old(self, status) -> bool:
        """Older than a lease, so no writer is still at it."""
        return status.getModificationTime() / 1000 < time.time() - self.lease
