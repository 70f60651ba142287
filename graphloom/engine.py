"""One object with the engine's tools over a graph and its files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text
from .operators import modules, ranking, traverse
from .operators.graph import PropertyGraph
from .plans.cypher import cypher
from .sources import files


@dataclass(frozen=True)
class Engine:
    """Tools over ``graph``; ``contents`` (filePath, content) serves :meth:`cat`."""

    graph: PropertyGraph
    contents: DataFrame | None = None

    def cypher(self, asked: str, **params) -> DataFrame:
        return cypher(self.graph, asked, **params)

    def query(self, asked: str, limit: int = 10, **options) -> dict[str, DataFrame]:
        return ranking.query(self.graph, asked, limit, **options)

    def symbol(self, name: str, path: str | None = None) -> DataFrame:
        """The node of an id, else of a name, else of a name in any case: one row or none.

        A file matches whole or by its end after a slash; code outside tests
        and examples goes first, then the smallest id.
        """
        n = self.graph.nodes
        rank = F.when(F.col("id") == name, 0).when(F.col("name") == name, 1).when(F.lower("name") == name.lower(), 2)
        found = n.withColumn("_rank", rank).filter("_rank is not null")
        if path:
            found = found.filter((F.col("_rank") == 0) | (F.col("filePath") == path) | F.col("filePath").endswith("/" + path))
        usage = text.is_usage_path(F.col("filePath"))
        return found.orderBy("_rank", F.coalesce(usage, F.lit(False)), "id").limit(1).drop("_rank")

    def context(self, name: str, path: str | None = None, tests: bool = False) -> DataFrame:
        """Neighbours of a symbol; those in tests and examples only if asked for."""
        return traverse.context(self.graph, self.symbol(name, path).select("id"), self._usage(tests))

    def impact(self, name: str, direction: str = "downstream", depth: int = 5, path: str | None = None, tests: bool = False) -> DataFrame:
        """What a change reaches; through tests and examples only if asked for."""
        return traverse.impact(self.graph, self.symbol(name, path).select("id"), direction, depth, self._usage(tests))

    def _usage(self, tests: bool):
        return None if tests else text.is_usage_path(F.col("filePath"))

    def schema(self) -> dict[str, DataFrame]:
        return {"labels": self.graph.label_counts(), "types": self.graph.type_counts(), "properties": self.graph.property_keys()}

    def modules(self, cap: int = 30) -> DataFrame:
        return modules.pages(self.graph, cap)

    def cat(self, paths: list[str], lines: str | None = None) -> DataFrame:
        if self.contents is None:
            raise ValueError("the engine has no file contents")
        ask = self.contents.sparkSession.createDataFrame([(p,) for p in paths], "filePath string")
        return files.cat(self.contents, lines, ask)
