"""tessella: attributed interaction graphs as Spark DataFrames."""

from tessella.graph import Graph

__all__ = ["Graph"]
