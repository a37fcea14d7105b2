"""Frames for drawing graphs, and a page that draws them."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A colour for each type.
COLORS = {
    "Company": "#1f77b4", "LegalEntity": "#aec7e8", "Client": "#9edae5", "GovernmentBody": "#10ac1a", "Person": "#2ca02c", "Position": "#98df8a",
    "Shareholder": "#d62728", "FinancialValue": "#ffbf7f", "FinancialMetric": "#ff7f0e", "OperationalKPI": "#ffbb78", "Headcount": "#fdd0a2",
    "RevenueStream": "#ffd700", "ProductOrService": "#9467bd", "Technology": "#8c564b", "MarketContext": "#e377c2", "MarketMetric": "#f7b6d2",
    "UseCaseOrIndustry": "#ce6dbd", "TransactionContext": "#d62728", "HistoricalEvent": "#e7969c", "Advisor": "#7f7f7f", "Location": "#c7c7c7",
}
DEFAULT_COLOR = "#cccccc"
#: What may label a node, by type.
LABELS = {
    "FinancialMetric": ("metricName", "name"), "OperationalKPI": ("kpiName", "name"), "Headcount": ("headcountName", "name"), "TransactionContext": ("contextName", "name"),
    "Person": ("fullName", "name"), "Position": ("titleName", "name"), "Location": ("locationName", "name"), "Shareholder": ("shareholderName", "name"),
    "HistoricalEvent": ("eventName", "name"), "MarketContext": ("segmentName", "name"), "ProductOrService": ("productName", "name"),
}
#: Which attributes hold values and periods, what tooltips show, and the colours of documents.
VALUES = ("valueString", "kpiValueString", "metricValue", "headcountValue")
PERIODS = ("DateOrPeriod", "kpiDateOrPeriod", "dateOrYear", "fiscalPeriod")
TOOLTIP = ("name", "fullName", "metricName", "kpiName", "contextName", "valueString", "metricValue", "description")
PALETTE = ("#FF6B6B", "#4ECDC4", "#45B7D1", "#96CEB4", "#FFEAA7", "#DDA0DD", "#98D8C8")
SHARED_COLOR = "#FFD700"


def _kind() -> Column:
    return F.substring_index("type", ":", -1)


def preferred_value(values: Column, doc: str | None = None) -> Column:
    """The value of a provenance list from ``doc`` where it has one, or else its first."""
    first = F.element_at(values, 1)["value"]
    if doc is None:
        return F.when(F.size(values) > 0, first)
    own = F.filter(values, lambda x: x["source_doc_id"] == doc)
    return F.when(F.size(own) > 0, F.element_at(own, 1)["value"]).when(F.size(values) > 0, first)


def source_documents(docs: Column, provenances: list[Column]) -> Column:
    """The documents of an entity: its own list, or else those of its values."""
    found = F.array_distinct(F.flatten(F.array(*[F.transform(F.coalesce(p, F.array().cast("array<struct<value:string,source_doc_id:string>>")), lambda x: x["source_doc_id"]) for p in provenances])))
    return F.when(F.size(F.coalesce(docs, F.array().cast("array<string>"))) > 0, docs).otherwise(found)


def is_multi_document(entities: DataFrame, docs: str = "docs", first: int = 5) -> DataFrame:
    """``(multi)``: whether any of the first entities names documents."""
    return entities.orderBy("ord").limit(first).agg(F.coalesce(F.bool_or(F.size(F.coalesce(docs, F.array().cast("array<string>"))) > 0), F.lit(False)).alias("multi"))


def node_label(df: DataFrame) -> Column:
    filled = lambda f: F.nullif(F.col(f).cast("string"), F.lit(""))
    pick = lambda fields: F.coalesce(*[filled(f) for f in (*fields, *VALUES) if f in df.columns], F.col("id"), F.lit("Unknown"))
    label = pick(("name",))
    for fields in sorted(set(LABELS.values())):
        label = F.when(_kind().isin([k for k, v in LABELS.items() if v == fields]), pick(fields)).otherwise(label)
    period = F.coalesce(*[filled(f) for f in PERIODS if f in df.columns], F.lit(None).cast("string"))
    dated = F.when(_kind().isin("FinancialMetric", "OperationalKPI", "Headcount") & period.isNotNull(), F.concat(label, F.lit(" ("), period, F.lit(")"))).otherwise(label)
    return F.substring(dated, 1, 50)


def tooltip(df: DataFrame) -> Column:
    """Lines of a node: id, type, documents (``docs``), short attributes, and where values come from (``provenance``: attribute to a list of value and document)."""
    parts = [F.concat(F.lit("<b>ID:</b> "), F.col("id")), F.concat(F.lit("<b>Type:</b> "), F.col("type"))]
    if "docs" in df.columns:
        parts.append(F.when(F.size("docs") > 0, F.concat(F.lit("<b>Sources:</b> "), F.array_join("docs", ", "))))
    for f in TOOLTIP:
        if f in df.columns:
            v = F.nullif(F.col(f).cast("string"), F.lit(""))
            parts.append(F.when(F.length(v) < 100, F.concat(F.lit(f"<b>{f}:</b> "), v)))
    if "provenance" in df.columns:
        line = lambda k, v: F.concat(F.lit("<b>"), k, F.lit("</b> from "), F.array_join(F.array_distinct(F.transform(v, lambda x: x["source_doc_id"])), ", "))
        parts.append(F.array_join(F.transform(F.array_sort(F.map_keys("provenance")), lambda k: line(k, F.col("provenance")[k])), "<br>"))
    return F.concat_ws("<br>", *[F.nullif(p, F.lit("")) for p in parts])


def color(col: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in COLORS.items() for x in p])[col], F.lit(DEFAULT_COLOR))


def vis_nodes(entities: DataFrame) -> DataFrame:
    docs = F.size(F.coalesce("docs", F.array().cast("array<string>"))) if "docs" in entities.columns else F.lit(0)
    return entities.select("id", node_label(entities).alias("label"), color(_kind()).alias("color"), F.least(F.lit(25), 15 + 2 * docs).alias("size"), tooltip(entities).alias("title"))


def vis_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations whose ends are both drawn."""
    ids = entities.select("id").distinct()
    rows = relations.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return rows.select(F.col("source").alias("from"), F.col("target").alias("to"), _kind().alias("label"))


def comparison_nodes(entities: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes coloured by document: ``members(id, doc)``; a node of other than one document is gold."""
    docs = members.select("doc").distinct().withColumn("n", (F.dense_rank().over(Window.orderBy("doc")) - 1) % len(PALETTE))  # a row for each document
    per = members.distinct().groupBy("id").agg(F.count("*").alias("docs"), F.min("doc").alias("doc"))
    rows = entities.select("id", "type").join(per, "id", "left").join(docs, "doc", "left")
    own = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), F.coalesce("n", F.lit(0)) + 1)
    count = F.coalesce("docs", F.lit(0)).cast("int")
    return rows.select("id", F.when(count == 1, own).otherwise(SHARED_COLOR).alias("color"), (15 + 3 * count).alias("size"))


def comparison_legend(members: DataFrame) -> list[tuple[str, str]]:
    """``(document, colour)`` as ``comparison_nodes`` colours, for a page that people read: a row for each document of ``members``."""
    docs = [r["doc"] for r in members.select("doc").distinct().orderBy("doc").collect()]
    return [*((d, PALETTE[i % len(PALETTE)]) for i, d in enumerate(docs)), ("several documents", SHARED_COLOR)]


#: Edges of a page for each of its nodes' limit.
EDGES = 10


def drawable(nodes: DataFrame, edges: DataFrame, limit: int = 5000) -> bool:
    """Whether a page takes the graph: ``limit`` nodes and EDGES times as many edges at most."""
    return nodes.limit(limit + 1).count() <= limit and edges.limit(EDGES * limit + 1).count() <= EDGES * limit


def html_page(nodes: DataFrame, edges: DataFrame, title: str, limit: int = 5000, legend: list[tuple[str, str]] | None = None) -> str:
    """A page that draws the graph on a canvas without other files.  A page is for people: more than ``limit`` nodes, or ten times as many edges, are refused."""
    rows = nodes.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a page of over {limit} nodes can't be drawn")
    lines = edges.limit(EDGES * limit + 1).collect()
    if len(lines) > EDGES * limit:
        raise ValueError(f"a page of over {EDGES * limit} edges can't be drawn")
    data = json.dumps({"nodes": [r.asDict() for r in rows], "edges": [r.asDict() for r in lines]}, ensure_ascii=False).replace("</", "<\\/")
    draw = """
const c=document.querySelector('canvas'),x=c.getContext('2d'),p={};c.width=innerWidth;c.height=innerHeight;
G.nodes.forEach((n,i)=>{const a=i*2.39996,r=14*Math.sqrt(i);p[n.id]=[c.width/2+r*Math.cos(a),c.height/2+r*Math.sin(a)]});
x.strokeStyle='#bbb';G.edges.forEach(e=>{if(p[e.from]&&p[e.to]){x.beginPath();x.moveTo(...p[e.from]);x.lineTo(...p[e.to]);x.stroke()}});
G.nodes.forEach(n=>{x.fillStyle=n.color;x.beginPath();x.arc(...p[n.id],n.size/3,0,7);x.fill();x.fillStyle='#222';x.fillText(n.label||n.id,p[n.id][0]+8,p[n.id][1])});
"""
    key = "".join(f"<li><b style='color:{c}'>&#9679;</b> {html.escape(d)}</li>" for d, c in legend or [])
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{key and f'<ul>{key}</ul>'}<canvas></canvas><script>const G={data};{draw}</script>"
