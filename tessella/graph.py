"""The graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import cut


def symmetric(edges: DataFrame) -> DataFrame:
    """Each undirected edge (u, v, ...) as two rows (a, b, ...)."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(F.col("u").alias("a"), F.col("v").alias("b"), *rest).unionAll(
        edges.select(F.col("v").alias("a"), F.col("u").alias("b"), *rest)
    )


def canonical(edges: DataFrame) -> DataFrame:
    """Simple undirected edges u < v: no self-loops, no repeats."""
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v")
    return e.distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node_id")).unionAll(edges.select(F.col("v").alias("node_id"))).distinct()


@dataclass(frozen=True)
class Graph:
    """``vertices(node_id, ...)`` and ``edges(u, v, ...)`` with u < v."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(table: DataFrame, source: str = "u", target: str = "v", attrs: tuple[str, ...] = ()) -> "Graph":
        """Undirected graph of an edge list.

        Of repeated edges one row is kept: the greatest attribute tuple, so the
        choice does not depend on row order.
        """
        s, t = F.col(source), F.col(target)
        both = table.where(s.isNotNull() & t.isNotNull()).select(
            F.least(s, t).alias("u"), F.greatest(s, t).alias("v"), *[F.col(a) for a in attrs]
        )
        if len(attrs) == 1:
            # The same choice without a struct, which would sort all edges in place of hashing them.
            kept = both.groupBy("u", "v").agg(F.max(attrs[0]).alias(attrs[0]))
        elif attrs:
            kept = both.groupBy("u", "v").agg(F.max(F.struct(*attrs)).alias("_a")).select("u", "v", "_a.*")
        else:
            kept = both.distinct()
        kept = cut(kept, "edges")
        return Graph(endpoints(kept), kept)

    def without_loops(self) -> "Graph":
        return Graph(self.vertices, self.edges.where("u <> v"))

    def sym(self) -> DataFrame:
        return symmetric(self.edges.where("u <> v"))

    def pinned(self) -> "Graph":
        """The same graph with both tables written once."""
        return Graph(cut(self.vertices, "vertices"), cut(self.edges, "edges"))

    def degrees(self) -> DataFrame:
        """(node_id, deg) over all vertices, 0 where isolated."""
        d = self.sym().groupBy(F.col("a").alias("node_id")).agg(F.count("*").alias("deg"))
        return self.vertices.select("node_id").join(d, "node_id", "left").select(
            "node_id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg")
        )

    def induced(self, members: DataFrame) -> "Graph":
        """Subgraph on the nodes of ``members(node_id)``."""
        keep = members.select("node_id").distinct()
        e = self.edges.join(keep.withColumnRenamed("node_id", "u"), "u", "left_semi").join(
            keep.withColumnRenamed("node_id", "v"), "v", "left_semi"
        )
        return Graph(self.vertices.join(keep, "node_id", "left_semi"), e.select(*self.edges.columns))


def compose(graphs: list[Graph]) -> Graph:
    """All nodes and edges of ``graphs``; an attribute takes the value of the last graph that has one.

    Attributes may differ between graphs; a null is no value. All tables are read
    side by side and merged in one shuffle for nodes and one for edges.
    """

    def merged(tables: list[DataFrame], keys: list[str]) -> DataFrame:
        kinds: dict[str, str] = {}
        for t in tables:
            kinds.update({f.name: f.dataType.simpleString() for f in t.schema if f.name not in keys})
        # columns are told apart by place, so no attribute can clash with the rank
        sides = [
            t.select(*keys, F.lit(k).alias("_rank"), *[(F.col(c) if c in t.columns else F.lit(None)).cast(kind).alias(f"_a{i}") for i, (c, kind) in enumerate(kinds.items())])
            for k, t in enumerate(tables)
        ]
        every = sides[0]
        for t in sides[1:]:
            every = every.unionByName(t)
        last = [F.max_by(F.col(f"_a{i}"), F.when(F.col(f"_a{i}").isNotNull(), F.col("_rank"))).alias(c) for i, c in enumerate(kinds)]
        return every.groupBy(*keys).agg(*last) if last else every.select(*keys).distinct()

    if not graphs:
        raise ValueError("no graph to compose")
    return Graph(merged([g.vertices for g in graphs], ["node_id"]), merged([g.edges for g in graphs], ["u", "v"]))


def merge_results(origin: Graph, results: list[Graph]) -> Graph:
    """``origin`` with the attributes of those ``results`` that have as many nodes, in order."""
    n = origin.vertices.count()
    return compose([origin, *[g for g in results if g.vertices.count() == n]])
