"""Keyed stores that take small batches (I01, K02, K03, I08): folders of changes, and one manifest that names what is in force.

A batch is one Parquet folder of its own rows, so what is written follows the batch; what a key's rows
come to is found when they are read, by a rule that gives the same whatever rows were merged before.
When a level has FAN folders they are merged into one of the next level, sorted by key, so that a row is
rewritten a logarithmic number of times; Parquet's own ranges and Bloom filters let a look-up of keys
pass most of them by.

A manifest is a file that can only be created: number n + 1 follows n. It names the folders of every
store, so changes of several stores are seen all or none, and a reader that has pinned a manifest
sees one state. Two writers that follow one manifest can't both make the next. A batch is known by its
number in the manifest, so one that is merged again changes nothing.

Defined results: a store that no batch has named is empty; a batch without rows counts as merged; null keys are a
value of their own; of rows with equal keys in one batch the rule decides, in the order of pos.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docweave.operators.incremental import NOT_FETCHED
from docweave.sources.tables import written

#: Folders of a level that are merged into one of the next.
FAN = 8
#: Seconds after which a claim on a manifest counts as left behind.
STALE_CLAIM = 600


def merged_before(done: list[int], number: int) -> bool:
    """done begins with a number that all up to have been merged, others follow."""
    return bool(done) and (number <= done[0] or number in done[1:])


def with_number(done: list[int], number: int) -> list[int]:
    upto, beyond = (done[0] if done else -1), {*done[1:], number}
    while upto + 1 in beyond:
        upto += 1
        beyond.remove(upto)
    return [upto, *sorted(beyond)]


class Conflict(RuntimeError):
    """Another writer has made the manifest that this one was to make."""


@dataclass(frozen=True)
class Store:
    """A store's name, keys, columns, and its rule: feed, latest or sum.

    feed: a good row stays, the first one of them; one with an error is replaced by what comes later; a key keeps the place at
    which it came first, and rows that couldn't be fetched are left out. latest: the last row counts; a true column gone takes the key away.
    sum: the columns beside the keys are numbers that are added up; a key whose numbers are all 0 isn't there.
    """

    name: str
    keys: tuple[str, ...]
    schema: str
    rule: str = "feed"

    @property
    def columns(self) -> list[str]:
        return StructType.fromDDL(self.schema).names

    @property
    def stored(self) -> str:
        return f"{self.schema}, batch long, pos long, first_batch long, first_pos long"

    def incoming(self, rows: DataFrame, number: int, pos: str | Column) -> DataFrame:
        """A batch's rows as they are stored, one for each key."""
        fresh = rows.where(F.col("error").isNull() | ~F.startswith(F.col("error"), F.lit(NOT_FETCHED))) if self.rule == "feed" else rows
        at = (F.col(pos) if isinstance(pos, str) else pos).cast("long")
        placed = fresh.select(*self.columns, F.lit(number).cast("long").alias("batch"), at.alias("pos"))
        return self.merged(placed.withColumns({"first_batch": F.col("batch"), "first_pos": F.col("pos")}))

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row for each key, by a combinable aggregate; merging merged rows gives the same."""
        rest = [c for c in self.columns if c not in self.keys] + ["batch", "pos"]
        if self.rule == "sum":
            kinds = dict(rows.dtypes)
            ends = [F.max("batch").alias("batch"), F.max("pos").alias("pos"), F.min(F.struct("first_batch", "first_pos")).alias("__f")]
            one = rows.groupBy(*self.keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in rest[:-2]], *ends)
            return one.select(*self.columns, "batch", "pos", "__f.first_batch", "__f.first_pos")
        if self.rule == "feed":
            good = F.col("error").isNull()
            when = F.struct(~good, F.when(good, F.col("batch")).otherwise(-F.col("batch")), F.when(good, F.col("pos")).otherwise(-F.col("pos")))
            best = F.min_by(F.struct(*rest), when)
        else:
            best = F.max_by(F.struct(*rest), F.struct("batch", "pos"))
        one = rows.groupBy(*self.keys).agg(best.alias("__r"), F.min(F.struct("first_batch", "first_pos")).alias("__f"))
        return one.select(*[F.col(c) if c in self.keys else F.col(f"__r.{c}").alias(c) for c in self.columns], "__r.batch", "__r.pos", "__f.first_batch", "__f.first_pos")


class Stores:
    """Several stores under one path."""

    def __init__(self, spark: SparkSession, path: str, stores: Iterable[Store], fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.stores = {s.name: s for s in stores}
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifests(self) -> list[int]:
        return [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, number: int | None = None) -> dict:
        """The manifest of a number, or the last: its number, the batches that are merged, and each store's folders by level."""
        known = self.manifests()
        if number is None and not known:
            return {"number": 0, "batches": {}, "folders": {}}
        stream = self._fs.open(self._at(f"manifests/{known[-1] if number is None else number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The file appears under its name with all of its content, and only if there is none of that name."""
        folder, target = self._at("manifests"), self._at(f"manifests/{manifest['number']:012d}.json")
        self._fs.mkdirs(folder)
        if self._fs.exists(target):
            raise Conflict(f"manifest {manifest['number']} is there")
        claim = self._at(f"manifests/{manifest['number']:012d}.claim")
        if self._fs.exists(claim) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_CLAIM:
            self._fs.delete(claim, False)  # its writer died; the new name below still comes into being once
        try:
            self._fs.create(claim, False).close()  # of two writers one gets it
        except Exception as e:
            if self._fs.exists(claim):
                raise Conflict(f"manifest {manifest['number']} is being made") from e
            raise
        part = self._at(f"manifests/{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.exists(target) or not self._fs.rename(part, target):
                raise Conflict(f"manifest {manifest['number']} is there")
        finally:
            self._fs.delete(claim, False)

    def _write(self, store: Store, rows: DataFrame) -> str:
        name = f"{store.name}/{uuid.uuid4().hex}"
        out = rows.write.option("parquet.bloom.filter.enabled#" + store.keys[0], "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        out.parquet(f"{self.path}/{name}")
        return name

    def merge(self, number: int, batches: dict[str, tuple[DataFrame, str | Column]]) -> bool:
        """Merge batch number, (rows, place) of each store, all or none; False if it was merged before."""
        have = self.manifest()
        todo = {n: b for n, b in batches.items() if not merged_before(have["batches"].get(n, []), number)}
        if not todo:
            return False
        folders = {n: [dict(f) for f in own] for n, own in have["folders"].items()}
        for name, (rows, pos) in todo.items():
            store = self.stores[name]
            folders.setdefault(name, []).append({"name": self._write(store, store.incoming(rows, number, pos)), "level": 0})
        done = have["batches"] | {n: with_number(have["batches"].get(n, []), number) for n in todo}
        self._publish({"number": have["number"] + 1, "batches": done, "folders": folders})
        return True

    def compact(self) -> int:
        """Merge full levels; the number of folders that were merged. What readers see stays the same."""
        have, merged = self.manifest(), 0
        folders = {n: [dict(f) for f in own] for n, own in have["folders"].items()}
        for name, own in folders.items():
            store, level = self.stores[name], 0
            while level <= max((f["level"] for f in own), default=0):
                full = [f for f in own if f["level"] == level]
                if len(full) >= self.fan:
                    rows = store.merged(self._rows(store, full))
                    new = self._write(store, rows.repartitionByRange(*store.keys).sortWithinPartitions(*store.keys))
                    own[:] = [f for f in own if f not in full] + [{"name": new, "level": level + 1}]
                    merged += len(full)
                level += 1
        if merged:
            self._publish({**have, "number": have["number"] + 1, "folders": folders})
        return merged

    def _rows(self, store: Store, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], store.stored)
        return self.spark.read.schema(store.stored).parquet(*[f"{self.path}/{f['name']}" for f in folders])

    def read(self, name: str, number: int | None = None, where: Column | None = None) -> DataFrame:
        """A store's rows, with the place at which each key came first, as of a manifest; where may use keys only and goes to the scan."""
        store = self.stores[name]
        rows = self._rows(store, self.manifest(number)["folders"].get(name, []))
        out = store.merged(rows if where is None else rows.where(where))
        if store.rule == "latest" and "gone" in store.columns:
            out = out.where(~F.coalesce(F.col("gone"), F.lit(False)))
        if store.rule == "sum":
            out = out.where(reduce(or_, [F.col(c) != 0 for c in store.columns if c not in store.keys]))
        return out.select(*store.columns, "first_batch", "first_pos")

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but the last keep, and folders that none of those names and that aren't of a batch under way.

        Folders are listed before manifests are read: one that a writer publishes meanwhile is named by what is read then; one
        that is not yet named is younger than every manifest and stays until another manifest has come.
        """
        known = self.manifests()
        last = known[-keep:]
        if not last:
            return []
        found = {f"{n}/{f}": self._fs.getFileStatus(self._at(f"{n}/{f}")).getModificationTime() for n in self.stores for f in self._names(n)}
        oldest = self._fs.getFileStatus(self._at(f"manifests/{last[0]:012d}.json")).getModificationTime()
        named = {f["name"] for n in self.manifests()[-keep:] for own in self.manifest(n)["folders"].values() for f in own}
        named |= {f["name"] for n in last for own in self.manifest(n)["folders"].values() for f in own}
        gone = sorted(f for f, at in found.items() if f not in named and at < oldest)
        for n in known[:-keep]:
            self._fs.delete(self._at(f"manifests/{n:012d}.json"), False)
        for f in gone:
            self._fs.delete(self._at(f), True)
        return gone


def read_in_steps(stores: Stores, name: str, rows: DataFrame, read: Callable[[DataFrame], DataFrame], order: str, steps: int) -> int:
    """Read a run's rows step by step (a column, as operators.incremental.admitted gives it), each merged into a store before the next is begun.

    A run that is killed has lost what its present step had read and nothing else: the next one is given what is
    still due, since what was merged isn't. The number of steps that were merged.
    """
    done = 0
    rows = written(rows, "run")  # so that a step reads what it was given, whatever steps before it have merged
    for step in range(steps):
        own = rows.where(F.col("step") == step)
        if own.isEmpty():
            continue
        number = max(stores.manifest()["batches"].get(name, [-1])) + 1
        stores.merge(number, {name: (read(own), order)})
        done += 1
    stores.compact()
    return done


def merge_sink(stores: Stores, **batches: Callable[[DataFrame], tuple[DataFrame, str | Column]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each store's part of the batch, by a function from its rows to (rows, place); full levels are merged after it."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            stores.merge(number, {name: f(batch) for name, f in batches.items()})
            stores.compact()
        finally:
            batch.unpersist()

    return merge
