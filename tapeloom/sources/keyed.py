"""Stored tables with atomic keyed writes on Parquet.

Rows lie in partitions by a function of their key.  A write stages Parquet files for the partitions it touches beside those in use, then
renames one small manifest into place, which names the folder of every partition: readers see the state before or after, never
one between, and a run that dies leaves the state before.  Folders that no kept manifest names are removed after a commit.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tapeloom.operators.factors import dedup_last

c = F.col
PART = "part_key"


def by_month(date: str = "trade_date") -> Column:
    """Partition key of a table whose key holds a date."""
    return F.date_format(date, "yyyy-MM")


def by_hash(*keys: str, parts: int = 16) -> Column:
    """Partition key of a table without a date in its key."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")


class ConcurrentWrite(RuntimeError):
    """Another writer committed since this one read the manifest; the write can be repeated."""


class KeyedTable:
    """A stored table: *keys* say which rows are the same (nulls equal each other), *part* must be a function of them.

    Writers are meant to come one at a time; of two that overlap, the second fails with ConcurrentWrite and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], part: Column | None = None, keep: int = 2) -> None:
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), keys, keep
        self.part = by_hash(*keys) if part is None else part
        jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(self._conf)

    # State

    def _names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """Partition folders, schema and properties of a version, by default the last; None before the first write."""
        found = self.versions()
        if not found:
            return None
        stream = self._fs.open(self._at(f"{self.path}/manifests/v{found[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def properties(self) -> dict[str, str]:
        return (self.manifest() or {}).get("properties", {})

    def _load(self, parts: dict[str, str], schema: StructType) -> DataFrame:
        """Rows of some partition folders, with the partition key."""
        full = StructType([*schema.fields]).add("stage", StringType()).add(PART, StringType())
        if not parts:
            return self.spark.createDataFrame([], full).drop("stage")
        folders = [f"{self.path}/data/stage={stage}/{part}" for part, stage in parts.items()]
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*folders).drop("stage")

    def read(self, where: Column | None = None, version: int | None = None) -> DataFrame:
        """The table; conditions on part_key in *where* choose the folders that are scanned."""
        held = self.manifest(version)
        if held is None:
            raise ValueError(f"nothing was written to {self.path}")
        df = self._load(held["parts"], StructType.fromJson(held["schema"]))
        return (df if where is None else df.where(where)).drop(PART)

    # Writes

    def _stage(self, df: DataFrame) -> dict[str, str]:
        """Write rows into new folders; returns the folder of each partition.  Large partitions go to several tasks."""
        stage = uuid.uuid4().hex
        to = f"{self.path}/data/stage={stage}"
        df.withColumn(PART, self.part).hint("rebalance", PART).write.partitionBy(PART).parquet(to)
        return {n: stage for n in self._names(f"data/stage={stage}") if n.startswith(f"{PART}=")}

    def _commit(self, held: dict | None, parts: dict[str, str], schema: StructType, properties: dict[str, str]) -> None:
        version = held["version"] + 1 if held else 0
        body = {"version": version, "schema": schema.jsonValue(), "parts": parts, "properties": {**(held or {}).get("properties", {}), **properties}}
        temporary = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(json.dumps(body).encode())
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        nothing = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        target = self._at(f"{self.path}/manifests/v{version:010d}.json")
        try:
            files.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(target), nothing)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(target):
                raise ConcurrentWrite(f"version {version} of {self.path} is there already") from e
            raise
        self._clean({*(held or {}).get("parts", {}).values(), *parts.values()})

    def _clean(self, known: set[str]) -> None:
        """Remove manifests beyond the last *keep* and the folders that only they, or this write's own stages, named."""
        found = self.versions()
        kept, gone = [self.manifest(v) for v in found[-self.keep :]], found[: -self.keep]
        old = [self.manifest(v) for v in gone]
        for v in gone:
            self._fs.delete(self._at(f"{self.path}/manifests/v{v:010d}.json"), False)
        self._drop({s for m in old for s in m["parts"].values()} | known, {(p, s) for m in kept for p, s in m["parts"].items()})

    def _drop(self, stages: set[str], used: set[tuple[str, str]]) -> None:
        live = {s for _, s in used}
        for stage in stages:
            if stage not in live:
                self._fs.delete(self._at(f"{self.path}/data/stage={stage}"), True)

    def vacuum(self) -> list[str]:
        """Remove stages that no manifest names, as dead runs leave them; only while nobody writes.  Returns their names."""
        live = {s for v in self.versions() for s in self.manifest(v)["parts"].values()}
        dead = [n for n in self._names("data") if n.removeprefix("stage=") not in live]
        for n in dead:
            self._fs.delete(self._at(f"{self.path}/data/{n}"), True)
        return dead

    def merge(self, new: DataFrame, seq: str | None = None, properties: dict[str, str] | None = None) -> None:
        """Rows of *new* replace those of equal key; of new rows with one key the last by *seq* stays.

        Only partitions that new rows fall into are read and written again.  *new* may come from this table.  An empty *new*
        still commits the properties."""
        self._write(new, seq, properties, lambda old, fresh: self._apart(old, fresh, self.keys))

    def replace_parts(self, new: DataFrame, properties: dict[str, str] | None = None) -> None:
        """Rows of *new* replace whole partitions: those they fall into; other partitions stay."""
        self._write(new, None, properties, None)

    def replace_scope(self, new: DataFrame, scope: list[str], properties: dict[str, str] | None = None) -> None:
        """Rows of *new* replace every row that agrees with one of them in the columns *scope*, in whatever partition."""
        self._write(new, None, properties, lambda old, fresh: self._apart(old, fresh, scope), lambda old, fresh: self._same(old, fresh, scope, "left_semi"))

    def delete(self, where: Column, properties: dict[str, str] | None = None) -> None:
        """Rows for which *where* holds go; partitions without one are not written again."""
        held = self.manifest()
        if held is None:
            return
        schema, parts, gone = StructType.fromJson(held["schema"]), held["parts"], F.coalesce(where, F.lit(False))
        hit = self._folders(self._load(parts, schema).where(gone))
        rest = self._stage(self._load({p: parts[p] for p in hit}, schema).where(~gone).drop(PART)) if hit else {}
        self._commit(held, {p: s for p, s in parts.items() if p not in hit} | rest, schema, properties or {})

    def _folders(self, rows: DataFrame) -> set[str]:
        """Folder names of the partitions that rows lie in: as many as there are partitions, at most."""
        names = rows.select(PART).distinct().collect()
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return {escape(PART, r[0]) for r in names}

    @staticmethod
    def _same(old: DataFrame, new: DataFrame, keys: list[str], how: str) -> DataFrame:
        marks = new.select(*[c(k).alias(f"_{k}") for k in keys]).distinct()
        return old.join(marks, reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in keys]), how)

    def _apart(self, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        return self._same(old, new, keys, "left_anti")

    def _write(self, new: DataFrame, seq: str | None, properties: dict[str, str] | None, kept=None, hit=None) -> None:
        """Stage new rows; where a partition in use is touched and *kept* says which of its rows stay, stage both together."""
        held = self.manifest()
        new = dedup_last(new, self.keys, seq).drop(seq) if seq else new
        new = new if seq or kept is None or hit else new.dropDuplicates(self.keys)
        fresh, schema = self._stage(new), new.schema
        parts = dict(held["parts"]) if held else {}
        own = set(fresh.values())
        if held and kept is not None:
            before = StructType.fromJson(held["schema"])
            rows = self._load(fresh, schema)
            touched = set(fresh) & set(parts) | (self._folders(hit(self._load(parts, before), rows)) if hit else set())
            if touched:
                old = kept(self._load({p: parts[p] for p in touched}, before), rows).drop(PART)
                both = old.unionByName(self._load({p: s for p, s in fresh.items() if p in touched}, schema).drop(PART), allowMissingColumns=True)
                again, schema = self._stage(both), both.schema
                parts = {p: s for p, s in parts.items() if p not in touched}
                fresh = {p: s for p, s in fresh.items() if p not in touched} | again
            else:
                schema = self._wider(before, schema)
        elif held:
            schema = self._wider(StructType.fromJson(held["schema"]), schema)
        self._commit(held, parts | fresh, schema, properties or {})
        self._drop(own, {(p, s) for p, s in (parts | fresh).items()})

    @staticmethod
    def _wider(old: StructType, new: StructType) -> StructType:
        names = set(old.names)
        return StructType([*old.fields, *[f for f in new.fields if f.name not in names]])
