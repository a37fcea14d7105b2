"""Cleaning and renumbering of graphs: entities(id, type, ord, ...) and relations(source, target, type, ord, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.sources.scratch import materialize


def first_by(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key: one aggregate with partial minima before the shuffle (by sort, as its structs vary in size)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_by(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def valid_entities(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("id").isNotNull() & F.col("type").isNotNull())


def once(relations: DataFrame) -> DataFrame:
    """Each (source, target, type) once, the first; a null type counts as empty."""
    return first_by(relations.withColumn("type", F.coalesce("type", F.lit(""))), ["source", "target", "type"])


def clean_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose ends exist, each (source, target, type) once, the first; a null type counts as empty."""
    ids = valid_entities(entities).select("id")
    # Repeats go before the joins: the rows to shuffle get fewer first.
    once_ = once(relations)
    kept = once_.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.select(*relations.columns)


def ordered_index(df: DataFrame, order: str | list[str], name: str, parts: int | None = None) -> DataFrame:
    """Number rows 1, 2, ... in the order of the columns ``order``, without one task that holds all.

    Rows are dealt by ranges of the order and numbered inside each; the rows of earlier ranges are added from their counts, of which there is one
    for each partition.  The ranges are written first, so a lost executor can't number them anew.
    """
    keys = [order] if isinstance(order, str) else order
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    rows = materialize(dealt.sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), "ordered", "zstd", free=True)
    rows = rows.withColumns({"_b": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(counts), "_b").withColumn(name, F.col("_m") + 1 + F.col("_before")).drop("_b", "_m", "_before")


def renumber(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids ``e1``, ``e2``, ... in order; relations follow the first entity of an old id, others are dropped."""
    numbered = ordered_index(valid_entities(entities), "ord", "_i").withColumn("old_id", F.col("id")).withColumn("id", F.concat(F.lit("e"), F.col("_i").cast("string")))
    ids = first_by(numbered.select("old_id", "id", "ord"), ["old_id"])
    start, end = ids.select(F.col("old_id").alias("source"), F.col("id").alias("_s")), ids.select(F.col("old_id").alias("target"), F.col("id").alias("_t"))
    rels = relations.join(start, "source").join(end, "target").drop("source", "target").withColumnsRenamed({"_s": "source", "_t": "target"})
    return numbered.drop("_i"), rels


def unique_ids(rows: DataFrame, base: str, kind: Column, order: str = "ord") -> DataFrame:
    """``unique_id``: the base id for its first row, then ``base_type_1``, ``base_type_2``, ..."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order)) - 1
    return rows.withColumn("unique_id", F.when(n == 0, F.col(base)).otherwise(F.concat_ws("_", F.col(base), kind, n.cast("string"))))


def type_distribution(entities: DataFrame) -> DataFrame:
    kind = F.coalesce(F.substring_index("type", ":", -1), F.lit("unknown"))
    return entities.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """``(id, hop)``: nodes at most ``hops`` undirected steps from ``starts(id)``, with the least number of steps.

    Edges are written once and not made distinct: a step reads them as they lie and makes distinct only what it has reached.
    """
    edges = materialize(edges.select("source", "target"), "edges")
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen.select("id")
    for hop in range(1, hops + 1):
        front = materialize(front, "front")
        there = edges.join(front, edges.source == front.id, "left_semi").select(F.col("target").alias("id"))
        back = edges.join(front, edges.target == front.id, "left_semi").select(F.col("source").alias("id"))
        front = there.unionByName(back).distinct()
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen.groupBy("id").agg(F.min("hop").alias("hop"))


def property_filter(entities: DataFrame, relations: DataFrame, node: Column | None = None, edge: Column | None = None) -> DataFrame:
    """Ids of entities that ``node`` holds for, or of both ends of relations that ``edge`` holds for."""
    if node is not None:
        return entities.where(node).select("id").distinct()
    ends = relations.where(edge)
    return ends.select(F.explode(F.array("source", "target")).alias("id")).distinct()
