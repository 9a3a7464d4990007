"""Stored tables whose every change is one new version, there as a whole or not at all.

A table is a folder.  ``data`` holds folders of rows that are never changed; ``versions``
holds one manifest per version, which lists the folders that belong to it.  A change writes
its rows first and its manifest last, under a name that only one writer can take.  A reader
resolves a manifest once and reads what it lists, so it sees one version whatever happens
meanwhile.  A writer that finds its version taken puts its change on top of the new one:
rows that were appended meanwhile stay.  What a stopped writer left is in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import catalogue as cat
from ..functions.validators import is_canonical_uuid
from ..operators.admission import newer_than

# Attempts to put a change on top of other writers' versions.
ATTEMPTS = 50
_PART = "_part"


@dataclass(frozen=True)
class Leaf:
    """A folder of rows of one partition value, with the times it spans (as text; None without a time)."""

    folder: str
    part: str
    rows: int
    first: str | None = None
    last: str | None = None


class Conflict(RuntimeError):
    """Another writer's version is in the way, and the change does not fit on top of it."""


class VersionedTable:
    """A table at ``path``, its rows kept apart by the text of ``part_col`` (a day, a session)."""

    def __init__(self, spark: SparkSession, path: str, part_col: str, ts_col: str | None = None):
        self.spark, self.path, self.part_col, self.ts_col = spark, path.rstrip("/"), part_col, ts_col
        jvm = spark._jvm.org.apache.hadoop.fs
        self._file = jvm.Path
        self._context = jvm.FileContext.getFileContext(jvm.Path(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._system = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---------------------------------------------------------------

    def version(self) -> int:
        """Number of the newest version, 0 before the first."""
        folder = self._file(f"{self.path}/versions")
        if not self._system.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._system.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """What belongs to a version: ``schema`` and ``leaves``."""
        at = self.version() if version is None else version
        if at == 0:
            return {"version": 0, "schema": None, "leaves": []}
        stream = self._system.open(self._file(self._name(at)))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        found = json.loads(text)
        return found | {"leaves": [Leaf(**x) for x in found["leaves"]]}

    def _name(self, version: int) -> str:
        return f"{self.path}/versions/{version:020d}.json"

    def _publish(self, version: int, schema: str, leaves: list[Leaf]) -> bool:
        """Write a manifest beside its place and move it there; False if another writer was first."""
        held = self._file(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._system.create(held, False)
        try:
            stream.write(bytearray(json.dumps({"version": version, "schema": schema, "leaves": [asdict(x) for x in leaves]}).encode()))
        finally:
            stream.close()
        return self._move(held, self._file(self._name(version)))

    def _move(self, source, target) -> bool:
        """Rename without replacing: atomic in the file systems that offer it."""
        from py4j.protocol import Py4JJavaError

        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        try:
            self._context.rename(source, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._system.delete(source, False)
            return False
        return True

    def _change(self, plan: Callable[[list[Leaf]], tuple[set[str], list[Leaf]]], schema: str | None = None) -> int:
        """Publish the next version: the leaves of the newest one without the first set, with the second list.

        ``plan`` sees the leaves and does the writing.  When another version came between,
        it is asked again only if a leaf that it takes away is gone.
        """
        now = self.manifest()
        gone, new = plan(now["leaves"])
        for _ in range(ATTEMPTS):
            if not gone and not new:
                return now["version"]
            there = {x.folder for x in now["leaves"]}
            if not gone <= there:
                gone, new = plan(now["leaves"])
                continue
            if now["schema"] and schema and json.loads(now["schema"]) != json.loads(schema):
                raise ValueError(f"{self.path} has other columns: {now['schema']}")
            kept = [x for x in now["leaves"] if x.folder not in gone]
            if self._publish(now["version"] + 1, now["schema"] or schema, kept + new):
                return now["version"] + 1
            now = self.manifest()
        raise Conflict(f"{self.path}: other writers came first {ATTEMPTS} times")

    # --- rows --------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; an error before the first."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError(f"{self.path} holds no version")
        return self._rows(found["leaves"], found["schema"])

    def _rows(self, leaves: list[Leaf], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not leaves:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{x.folder}" for x in leaves])

    def _written(self, df: DataFrame) -> list[Leaf]:
        """Rows as new leaves, one per partition value; nothing refers to them yet."""
        folder = f"data/{uuid.uuid4().hex}"
        part = F.coalesce(F.col(self.part_col).cast("string"), F.lit(""))
        named = df.withColumn(_PART, F.hex(F.encode(part, "UTF-8")))  # any text is a folder name so
        named.hint("rebalance", _PART).write.partitionBy(_PART).parquet(f"{self.path}/{folder}")
        # One row per value; only the time column is read.
        times = [F.min(self.ts_col).cast("string").alias("first"), F.max(self.ts_col).cast("string").alias("last")] if self.ts_col else []
        back = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_PART, T.StringType())])).parquet(f"{self.path}/{folder}")
        listed = back.groupBy(_PART).agg(F.count("*").alias("n"), *times).collect()
        return [
            Leaf(f"{folder}/{_PART}={r[_PART] or '__HIVE_DEFAULT_PARTITION__'}", bytes.fromhex(r[_PART] or "").decode(), r["n"], *([r["first"], r["last"]] if times else []))
            for r in sorted(listed, key=lambda r: r[_PART] or "")
        ]

    def append(self, df: DataFrame) -> int:
        """A version with the rows of ``df`` added; the number of the version."""
        leaves = self._written(df)
        first = self.version() == 0
        if not leaves and not first:
            return self.version()
        schema = df.schema.json()
        return self._change(lambda _: (set(), leaves), schema) if leaves else self._empty(schema)

    def _empty(self, schema: str) -> int:
        return 1 if self._publish(1, schema, []) else self.version()

    def remove_part(self, value: str) -> bool:
        """A version without the rows of one partition value; False, and no version, if there were none."""
        before = self.version()
        return self._change(lambda leaves: ({x.folder for x in leaves if x.part == value}, [])) > before

    def remove_session(self, session_id: str) -> bool:
        """``remove_part`` for a session; an id that is no canonical UUID removes nothing."""
        canonical = self.spark.range(1).select(is_canonical_uuid(F.lit(session_id)).alias("ok")).first()["ok"]
        return bool(canonical) and self.remove_part(session_id)

    def purge(self, now: Column, hours: int = cat.RETENTION_HOURS) -> int:
        """A version without rows older than the retention period; the number of leaves touched.

        Leaves that are too old as a whole are left out, those that the limit cuts are
        written again; no other rows are read.
        """
        if not self.ts_col:
            raise ValueError("a table without a time column has no retention")
        limit = self.spark.range(1).select(F.timestamp_add("HOUR", F.lit(-hours), now).alias("t")).first()["t"]
        touched = 0

        def plan(leaves: list[Leaf]) -> tuple[set[str], list[Leaf]]:
            nonlocal touched
            timed = [x for x in leaves if x.first is not None and datetime.fromisoformat(x.first) <= limit]
            cut = [x for x in timed if datetime.fromisoformat(x.last) > limit]
            touched = len(timed)
            schema = self.manifest()["schema"]
            kept = self._written(newer_than(self._rows(cut, schema), self.ts_col, now, hours)) if cut else []
            return {x.folder for x in timed}, kept

        self._change(plan)
        return touched

    def compact(self) -> int:
        """A version with one leaf per partition value; the number of the version."""

        def plan(leaves: list[Leaf]) -> tuple[set[str], list[Leaf]]:
            count: dict[str, int] = {}
            for x in leaves:
                count[x.part] = count.get(x.part, 0) + 1
            many = [x for x in leaves if count[x.part] > 1]
            return {x.folder for x in many}, self._written(self._rows(many, self.manifest()["schema"])) if many else []

        return self._change(plan)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` versions lists; the number deleted.

        Only while no one writes, and when no reader is at an older version any more.
        """
        newest = self.version()
        listed = {x.folder for v in range(max(1, newest - keep + 1), newest + 1) for x in self.manifest(v)["leaves"]}
        deleted = 0
        data = self._file(f"{self.path}/data")
        for batch in self._system.listStatus(data) if self._system.exists(data) else []:
            name = batch.getPath().getName()
            leaves = [s.getPath() for s in self._system.listStatus(batch.getPath()) if s.isDirectory()]
            old = [p for p in leaves if f"data/{name}/{p.getName()}" not in listed]
            for p in old:
                deleted += bool(self._system.delete(p, True))
            if len(old) == len(leaves):
                self._system.delete(batch.getPath(), True)
        return deleted
