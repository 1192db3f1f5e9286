"""Stored answers and vectors: tables by content key, so that what was asked or encoded once is not again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import durable
from plumbline.sources.versions import VersionedTable

#: Hex digits of a key that name its partition.
PREFIX = 2


@dataclass(frozen=True)
class KeyedStore:
    """(key, value): a versioned table, partitioned by the beginning of the key so that a look-up reads the partitions of its
    own keys. Writers append side by side; of a key that several have written any one row is read, as equal keys have equal
    content."""

    table: VersionedTable
    value: str

    @classmethod
    def at(cls, spark: SparkSession, path: str, value: str, kind: str) -> KeyedStore:
        return cls(VersionedTable(spark, path, f"key string, {value} {kind}, prefix string", ("prefix",)), value)

    def found(self, keys: DataFrame) -> DataFrame:
        """(key, value) of those of ``keys`` (key) that are stored."""
        asked = keys.select("key", F.left("key", F.lit(PREFIX)).alias("prefix")).distinct()
        return self.table.read().join(asked, ["prefix", "key"], "left_semi").select("key", self.value).dropDuplicates(["key"])

    def missing(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` (key, ...) that are not stored, one a key."""
        marked = keys.dropDuplicates(["key"]).withColumn("prefix", F.left("key", F.lit(PREFIX)))
        return marked.join(self.table.read().select("prefix", "key"), ["prefix", "key"], "left_anti").drop("prefix")

    def add(self, rows: DataFrame) -> int:
        """Append (key, value); rows without a value are left out, and are asked again. A file a partition and task."""
        placed = rows.where(F.col(self.value).isNotNull()).withColumn("prefix", F.left("key", F.lit(PREFIX)))
        return self.table.append(placed.repartition("prefix").sortWithinPartitions("prefix", "key"))

    def compacted(self) -> int:
        """All appends in one, each key once."""
        base = self.table.version()
        return self.table.replace(self.table.read(base).dropDuplicates(["key"]).repartition("prefix").sortWithinPartitions("prefix", "key"), base)


def answer_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore.at(spark, path, "response", "string")


def vector_store(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore.at(spark, path, "vector", "array<float>")


def vector_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model + "\0"), text).cast("binary"), 256)


@dataclass(frozen=True)
class Lookup:
    """What a look-up through a store gave: (key, value, hit) of every key, and how many were and were not stored."""

    rows: DataFrame
    hits: int
    misses: int


def looked_up(store: KeyedStore, wanted: DataFrame, make) -> Lookup:
    """``wanted`` (key, ...) through the store: ``make`` turns the rows of missing keys into (key, value), each once. What it makes is
    written before it is used, so it is made once and kept even if a later step fails."""
    held = durable(store.found(wanted))
    fresh = durable(make(store.missing(wanted)))
    misses = fresh.count()
    if misses:
        store.add(fresh)
    rows = held.withColumn("hit", F.lit(True)).unionByName(fresh.select("key", store.value).withColumn("hit", F.lit(False)))
    return Lookup(rows, held.count(), misses)
