"""Graphs as DataFrames, vertex-centric operators, algorithms, layouts and partition analysis."""

from graphloom.operators.algorithms import bfs, pagerank, sssp
from graphloom.operators.graph import Graph

__all__ = ["Graph", "bfs", "pagerank", "sssp"]
