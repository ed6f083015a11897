"""Pipelines: a source bound to a sink by configuration, with operations between, in batch or as a stream."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tributary.operators.partitioning import partition_by_hash
from tributary.operators.transforms import Chain, Operation
from tributary.plans.envelope import valid_objects
from tributary.sources.registry import Spec, begin, sink, source


@dataclass
class Pipeline:
    """Reads a source's stored records, then its live ones; keeps JSON objects; applies operations; writes both.

    Operations get a column value with a record's JSON text and must leave one. parallelism above 1 routes records by
    their hash, so equal payloads meet in one partition.
    """

    source: Spec
    sink: Spec
    operations: Chain = field(default_factory=Chain)
    parallelism: int = 1
    validate: bool = True
    _query: object = None

    def __post_init__(self):
        source(self.source)
        sink(self.sink)

    @property
    def key(self) -> str:
        """The sink's key, or the source's; empty while the pipeline runs."""
        return "" if self.is_open else self.sink.key or self.source.key

    @property
    def is_open(self) -> bool:
        return self._query is not None and self._query.isActive

    def show(self) -> str:
        return f"{self.source.name or self.source.type} -> {self.sink.name or self.sink.type}"

    def add_operation(self, operation: Operation) -> Pipeline:
        self.operations.add(operation)
        return self

    def plan(self, df: DataFrame) -> DataFrame:
        """What happens to records between source and sink."""
        if self.validate:
            df = valid_objects(df, "value")
        df = self.operations.apply(df)
        return partition_by_hash(df, "value", self.parallelism).drop("partition_id") if self.parallelism > 1 else df

    def records(self, spark: SparkSession) -> tuple[DataFrame | None, DataFrame | None]:
        """(stored records, live records) after the operations; either may be missing."""
        spec, (load, live) = source(begin(self.source))
        first, rest = load(spark, spec), live(spark, spec)
        return first if first is None else self.plan(first), rest if rest is None else self.plan(rest)

    def run(self, spark: SparkSession, wait: bool = True):
        """Writes the stored records, then starts the stream of live ones if the source has any.

        The query's checkpoint holds what was read, so a stopped pipeline goes on where it was. With wait, the call
        ends when the query does.
        """
        first, rest = self.records(spark)
        spec, write = sink(self.sink)
        if first is not None:
            write(first, spec, False)
        if rest is not None:
            self._query = write(rest, spec, True)
            if wait:
                self._query.awaitTermination()
        return self._query

    def close(self) -> bool:
        """Stops the stream; false once nothing runs."""
        if self._query is not None:
            self._query.stop()
        return self.is_open


    def pause(self) -> None:
        """Stops the stream; its checkpoint keeps its place."""
        self.close()

    def resume(self, spark: SparkSession, wait: bool = False):
        """Goes on with the live records from the checkpoint; what was stored at the start isn't read again."""
        spec, write = sink(self.sink)
        rest = self.records(spark)[1]
        if rest is not None:
            self._query = write(rest, spec, True)
            if wait:
                self._query.awaitTermination()
        return self._query


def union_initial_and_live(initial: DataFrame, live: DataFrame) -> DataFrame:
    """Both as one, in no order; a column that one lacks is null there."""
    return initial.unionByName(live, allowMissingColumns=True)


def create_pipeline(raw: Mapping) -> Pipeline:
    """A pipeline of {"source": {...}, "sink": {...}}; an unknown type or a missing option is an error here, not later."""
    for part in ("source", "sink"):
        if not isinstance(raw.get(part), Mapping):
            raise ValueError(f"a {part} is needed")
    return Pipeline(Spec.of(raw["source"]), Spec.of(raw["sink"]), parallelism=int(raw.get("parallelism", 1)))


@dataclass
class Registry:
    """Sources and sinks by key. A key that comes again replaces what it named; each key pairs a source with a sink."""

    sources: dict[str, Spec] = field(default_factory=dict)
    sinks: dict[str, Spec] = field(default_factory=dict)
    running: dict[str, Pipeline] = field(default_factory=dict)

    @classmethod
    def parse(cls, raw: Mapping) -> Registry:
        out = cls()
        for s in raw.get("sources") or ():
            out.add_source(Spec.of(s))
        for s in raw.get("sinks") or ():
            out.add_sink(Spec.of(s))
        return out

    def add_source(self, spec: Spec) -> None:
        self.sources[spec.key] = spec

    def add_sink(self, spec: Spec) -> None:
        self.sinks[spec.key] = spec

    @property
    def keys(self) -> list[str]:
        return sorted({*self.sources, *self.sinks})

    def pairs(self) -> dict[str, tuple[Spec | None, Spec | None]]:
        """(source, sink) of every key; either may be missing."""
        return {k: (self.sources.get(k), self.sinks.get(k)) for k in self.keys}

    def pipelines(self) -> dict[str, Pipeline]:
        """A pipeline for every key that has both."""
        return {k: Pipeline(a, b) for k, (a, b) in self.pairs().items() if a and b}

    def run(self, spark: SparkSession, key: str, wait: bool = True) -> Pipeline:
        self.running[key] = self.pipelines()[key]
        self.running[key].run(spark, wait)
        return self.running[key]

    def close(self, key: str) -> bool:
        """Stops the pipeline with this key; an unknown key is an error."""
        if key not in self.running:
            raise KeyError(key)
        return self.running.pop(key).close()

    def reload(self, spark: SparkSession, raw: Mapping) -> list[str]:
        """Takes a new configuration while pipelines run: those whose source or sink changed, or went, are stopped, and
        changed ones go on from their checkpoint as they are now. Returns the keys of these."""
        new = Registry.parse(raw)
        changed = [k for k, p in self.running.items() if new.pairs().get(k) != (p.source, p.sink)]
        self.sources, self.sinks = new.sources, new.sinks
        for key in changed:
            old = self.running.pop(key)
            old.pause()
            if key in self.pipelines():
                self.running[key] = self.pipelines()[key]
                self.running[key].resume(spark)
        return sorted(changed)

    def save(self, spark: SparkSession, path: str) -> int:
        """Stores the configuration under path as a new version, and returns its number."""
        version = max(_versions(spark, path), default=0) + 1
        spec = lambda s: {"type": s.type, "name": s.name, "key": s.key, "config": dict(s.config)}
        text = json.dumps({"sources": [spec(s) for s in self.sources.values()], "sinks": [spec(s) for s in self.sinks.values()]})
        spark.createDataFrame([(version, text)], "version long, config string").coalesce(1).write.mode("append").parquet(path)
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> Registry:
        """The configuration of a version, or of the last one. A pipeline of it goes on from its checkpoint when it runs."""
        found = _versions(spark, path)
        if not found or (version is not None and version not in found):
            raise KeyError(path if version is None else version)
        return cls.parse(json.loads(found[max(found) if version is None else version]))

    def info(self) -> list[dict[str, str]]:
        return [{"key": k, "source": a.name if a else "", "sink": b.name if b else "", "open": str(k in self.running and self.running[k].is_open).lower()} for k, (a, b) in self.pairs().items()]


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    try:
        return {r.version: r.config for r in spark.read.schema("version long, config string").parquet(path).collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def status(spark: SparkSession, path: str = "") -> str:
    """The session's state as JSON, or the part of it at a path of keys: versions, settings, running queries."""
    import platform

    document = {
        "os": {"system": platform.system(), "python": platform.python_version()},
        "runtime": {"spark": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism},
        "queries": {q.name or q.id: {"active": q.isActive, "message": q.status["message"]} for q in spark.streams.active},
    }
    for key in [k for k in path.split(".") if k]:
        if not isinstance(document, dict):
            break
        document = document.get(key, {})
    return json.dumps(document)
