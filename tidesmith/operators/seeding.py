"""Seeding a graph: one check decides for the whole set, then nodes are written before edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesmith.operators import graph, validate
from tidesmith.sources import layout
from tidesmith.sources.kept import keep

NODE_KEY, EDGE_KEY = ["label", "id"], ["from_id", "rel_type", "to_id"]


def checked(entities: DataFrame, labels: list[str]) -> DataFrame:
    """(label, id, props) of all entities (label, id, name, description, metadata), once each; ValueError, with how many and a few ids, if any is not valid."""
    valid, rejected = validate.entities(entities, labels)
    n, some = keep(rejected.select("id")).agg(F.count("*"), F.slice(F.array_sort(F.collect_set(F.coalesce("id", F.lit("null")))), 1, 5)).head()
    if n:
        raise ValueError(f"{n} entities are not valid, nothing is written: {', '.join(some)}")
    return valid.groupBy(*NODE_KEY).agg(F.max_by("props", F.struct("name", F.col("props")["description"])).alias("props"))


def seed(entities: DataFrame, relationships: DataFrame, labels: list[str], nodes_path: str, edges_path: str, node_rule: Column, edge_rule: Column) -> tuple[int, int]:
    """(nodes, edges) that were written to two tables in partitions (see layout), which exist: nodes (label, id, props), edges (EDGE_KEY, props).

    If one entity is not valid, neither table changes. Nodes are overlaid property by property; then relationships (EDGE_KEY, props) both of whose ends are
    among all nodes, those of earlier seeds too, are overlaid the same way. Relationships without a safe name of their kind are left out.
    """
    spark = entities.sparkSession
    new = keep(checked(entities, labels))
    layout.rewrite(nodes_path, new, new.schema, node_rule, lambda old, came: graph.overlay(old, came, NODE_KEY))
    nodes = layout.read(spark, nodes_path, new.schema)
    rels = keep(graph.edges_between(relationships.where(validate.safe_relation(F.col("rel_type"))), nodes).select(*EDGE_KEY, "props"))
    layout.rewrite(edges_path, rels, rels.schema, edge_rule, lambda old, came: graph.overlay(old, came, EDGE_KEY))
    return new.count(), rels.count()
