"""Export: entities and relations to meta, node and link records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import category_from_type, clean_link_type, composite_id, format_attribute, safe_filename, strip_prefix
from kgloom.operators.graph import ordered_index

#: Attributes that may label an entity of a type, in order; other types use name, then id.
LABELS = {
    "Company": ("name", "alias"),
    "GovernmentBody": ("name",),
    "Person": ("fullName", "name"),
    "Position": ("titleName", "name"),
    "ProductOrService": ("name",),
    "Product": ("name", "alias"),
    "Technology": ("name",),
    "MarketContext": ("segmentName",),
    "UseCaseOrIndustry": ("name",),
    "UseCase": ("name",),
    "FinancialMetric": ("metricName", "name"),
    "OperationalKPI": ("kpiName", "name"),
    "Headcount": ("headcountName",),
    "Shareholder": ("name",),
    "Advisor": ("name",),
    "TransactionContext": ("contextName",),
    "HistoricalEvent": ("eventName", "name"),
    "CorporateEvent": ("name",),
    "Location": ("locationName", "name", "officeSpecificInfo", "address"),
    "LegalEntity": ("name",),
    "PolicyDocument": ("name",),
    "OwnershipStake": ("name",),
    "Award": ("name",),
    "Department": ("name",),
}
#: Labels of entities without any.
UNKNOWN = {"FinancialMetric": "Unknown Financial Metric", "OperationalKPI": "Unnamed KPI", "MarketMetric": "Unknown Market Metric"}


def label_key(df: DataFrame) -> Column:
    """The attribute that labels the entity, or null."""
    kind = F.substring_index("type", ":", -1)
    filled = lambda f: F.when(F.length(F.trim(F.col(f).cast("string"))) > 0, F.lit(f))
    pick = lambda fields: F.coalesce(*[filled(f) for f in fields if f in df.columns], F.lit(None).cast("string"))
    out = pick(("name", "id"))
    for fields in sorted(set(LABELS.values())):
        out = F.when(kind.isin([k for k, v in LABELS.items() if v == fields]), pick(fields)).otherwise(out)
    return out


def with_labels(entities: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Entities with ``label_key``, ``label`` and ``node_id``; an entity without id gets a digest of its attributes."""
    cols = [F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes]
    rows = entities.withColumn("id", F.coalesce("id", F.md5(F.concat_ws("#", F.coalesce("type", F.lit("")), *cols))))
    rows = rows.withColumn("label_key", label_key(rows))
    value = F.coalesce(*[F.when(F.col("label_key") == a, F.trim(F.col(a).cast("string"))) for a in ("id", *attributes)])
    kind, unknown = F.substring_index("type", ":", -1), F.create_map(*[F.lit(x) for p in UNKNOWN.items() for x in p])
    rows = rows.withColumn("label", F.coalesce(value, unknown[kind], F.lit("Unknown Entity")))
    return rows.withColumn("node_id", composite_id(F.col("id"), F.col("label")))


def description(attributes: tuple[str, ...], prefix: str) -> Column:
    parts = [F.when(F.coalesce(F.col("label_key"), F.lit("")) != a, format_attribute(a, F.col(a))) for a in attributes]
    joined = F.concat_ws(". ", *parts)
    return F.when(joined != "", F.concat(joined, F.lit("."))).otherwise(F.concat(F.col("label"), F.lit(" (Type: "), strip_prefix(F.col("type"), prefix), F.lit(").")))


def nodes(entities: DataFrame, attributes: tuple[str, ...], request_id: int, file_id: str, title: str, prefix: str = "kg:", categories: dict[str, str] | None = None) -> DataFrame:
    """``categories``: an ontology's own categories by bare type; other types get the snake case of theirs."""
    rows = with_labels(entities, attributes)
    category = F.when(category_from_type(F.col("type")) == "unknown", F.col("type")).otherwise(category_from_type(F.col("type")))
    if categories:
        category = F.coalesce(F.create_map(*[F.lit(x) for p in categories.items() for x in p])[F.substring_index("type", ":", -1)], category)
    sources = F.array(F.struct(F.lit(file_id).alias("FileId"), F.lit(f"{file_id}.meta.json").alias("FileName"), F.lit(title).alias("Title"), F.lit(request_id).alias("sourceint1")))
    return rows.select(F.lit(request_id).alias("request_id"), F.col("node_id").alias("id"), "label", strip_prefix(category, prefix).alias("category"), description(attributes, prefix).alias("description"), sources.alias("sources"))


def links(entities: DataFrame, relations: DataFrame, attributes: tuple[str, ...], request_id: int, file_id: str, title: str) -> DataFrame:
    """Links with the composite ids of their ends; an end without an entity keeps its id.  Keys are digests, so reruns agree."""
    ids = with_labels(entities, attributes).groupBy("id").agg(F.max_by("node_id", "ord").alias("node_id"))
    rows = relations.join(ids.toDF("source", "sourceId"), "source", "left").join(ids.toDF("target", "targetId"), "target", "left")
    key = F.md5(F.concat_ws("#", "source", "target", "type", F.col("ord").cast("string")))
    sources = F.array(F.struct(F.lit(file_id).alias("FileId"), F.lit(title).alias("Title"), F.lit(request_id).alias("sourceint1"), F.lit(f"{file_id}.meta.json").alias("FileName")))
    return rows.select(F.lit(request_id).alias("request_id"), key.alias("key"), F.coalesce("sourceId", "source").alias("sourceId"), F.coalesce("targetId", "target").alias("targetId"), clean_link_type(F.col("type")).alias("type"), sources.alias("sources"))


def meta(node_rows: DataFrame, link_rows: DataFrame, request_id: int, file_id: str, title: str, path: str) -> DataFrame:
    """One row for a graph.  The record holds a reference to each node and link by its format: use it for graphs that are one file, and ``meta_parts`` for others."""
    a = node_rows.agg(F.array_sort(F.collect_list(F.struct("label", "id"))).alias("actor_references"))
    b = link_rows.agg(F.array_sort(F.collect_list(F.struct(F.col("type").alias("label"), "key"))).alias("link_references"))
    head = [F.lit(request_id).alias("request_id"), F.lit(title).alias("title"), F.lit(file_id).alias("id"), F.lit(path).alias("file_local_path")]
    return a.crossJoin(b).select(*head, "actor_references", "link_references")


def meta_parts(node_rows: DataFrame, link_rows: DataFrame, request_id: int, file_id: str, title: str, path: str, part_rows: int = 10_000) -> DataFrame:
    """``meta`` of a graph of any size in parts: ``(request_id, title, id, file_local_path, part, actor_references, link_references)``.

    Parts are numbered from 1 and hold at most ``part_rows`` references, of nodes by label and id, then of links by type and key; joined in their order they are the
    record's lists.  So no task holds more than a few parts.  A graph without any has one part.
    """
    a = node_rows.select(F.lit(0).alias("side"), "label", F.col("id").alias("ref"))
    b = link_rows.select(F.lit(1).alias("side"), F.col("type").alias("label"), F.col("key").alias("ref"))
    rows = ordered_index(a.unionByName(b), ["side", "label", "ref"], "n").withColumn("part", F.floor((F.col("n") - 1) / part_rows) + 1)
    # The part that is always there, so a graph without references has its record.
    rows = rows.select("part", "side", "label", "ref", "n").unionByName(node_rows.sparkSession.sql("SELECT 1L AS part, -1 AS side, '' AS label, '' AS ref, 0L AS n"))
    listed = lambda side, key: F.transform(F.filter(F.col("refs"), lambda x: x["side"] == side), lambda x: F.struct(x["label"].alias("label"), x["ref"].alias(key)))
    parts = rows.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("n", "side", "label", "ref"))).alias("refs"))
    head = [F.lit(request_id).alias("request_id"), F.lit(title).alias("title"), F.lit(file_id).alias("id"), F.lit(path).alias("file_local_path")]
    return parts.select(*head, "part", listed(0, "id").alias("actor_references"), listed(1, "key").alias("link_references"))


def file_records(node_rows: DataFrame, link_rows: DataFrame) -> DataFrame:
    """``(folder, name, body)``: one file for each node and link; records without an id are skipped."""
    n = node_rows.where(F.length("id") > 0).select(F.lit("index2").alias("folder"), F.concat(F.lit("actor-"), safe_filename(F.col("id")), F.lit(".node.json")).alias("name"), F.to_json(F.struct("*")).alias("body"))
    k = link_rows.where(F.length("key") > 0).select(F.lit("index3").alias("folder"), F.concat(safe_filename(F.col("key")), F.lit(".link.json")).alias("name"), F.to_json(F.struct("*")).alias("body"))
    return n.unionByName(k)
