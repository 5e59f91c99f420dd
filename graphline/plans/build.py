"""Building one graph from what a collector exports, by a merger of choice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import SparkSession

from graphline.operators.unify import build
from graphline.sources import readers, sinks


class Collector(Protocol):
    """Exports graph documents and says where they are."""

    def collect(self, config: Any) -> Sequence[str]: ...


class Merger(Protocol):
    """Makes one document of many and says where it is."""

    def merge(self, paths: Sequence[str], output: str) -> str: ...


def build_unified_graph(config: Any, collector: Collector, merger: Merger, output: str) -> str:
    """What the merger makes of what the collector exports."""
    return merger.merge(list(collector.collect(config)), output)


@dataclass
class FolderCollector:
    """The graph files below a folder, which is the configuration; of some modules, the first ``limit``."""

    spark: SparkSession
    modules: Sequence[str] | None = None
    limit: int | None = None

    def collect(self, config: str) -> list[str]:
        found = readers.list_graph_files(self.spark, config, modules=self.modules, limit=self.limit)
        return [r["path"] for r in found.collect()]  # one row per file


@dataclass
class ComposeMerger:
    """The documents as one graph, later ones overriding."""

    spark: SparkSession

    def merge(self, paths: Sequence[str], output: str) -> str:
        sinks.write_json(readers.load_graph(self.spark, paths), output)
        return output


@dataclass
class UnifyMerger:
    """Imports resolved across the modules by the metadata below a folder, with integrity and acceptance checks."""

    spark: SparkSession
    metadata: str
    include_internal: bool = False

    def merge(self, paths: Sequence[str], output: str) -> str:
        meta = readers.metadata(self.spark, self.metadata)
        built = build(readers.with_order(readers.documents(self.spark, list(paths)), paths), meta, self.include_internal)
        sinks.write_json(built.unified.graph, output, unified=True, dlls=readers.modules(meta))
        return output
