"""A whole project: documents to page graphs, document graphs, one project graph, its scores and its files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import chunk as C
from kgloom.operators import diagnose as D
from kgloom.operators import evaluate as E
from kgloom.operators import export as EXP
from kgloom.operators import extract as X
from kgloom.operators import graph as G
from kgloom.operators import merge as ME
from kgloom.operators import viz as V
from kgloom.operators.match import Rules, page_rules, project_rules, strategy_rules
from kgloom.operators.ontology import Ontology, bare_type
from kgloom.operators.settle import merged_across, merged_into
from kgloom.sources import files
from kgloom.sources.scratch import materialize


@dataclass
class Project:
    """``units``: pages or chunks.  ``rules``: ``threshold`` or ``strategy`` for the page merge.  ``construction``: ``parallel``, or ``iterative``,
    where each unit's prompt holds the graph that the units before have made.  ``diagnostics``, ``export`` and ``dumps``
    add the merge report, the export files and the graph of each unit to what ``run`` writes.
    """

    client: str = "rules"
    categories: tuple[str, ...] = ("report", "contract", "financial_teaser")
    ontology: Ontology | None = None
    units: str = "pages"
    chunks: C.ChunkConfig = field(default_factory=C.ChunkConfig)
    rules: str = "threshold"
    construction: str = "parallel"
    diagnostics: bool = False
    export: bool = False
    dumps: bool = False
    model: str = "rules"
    provider: str = "local"

    def __post_init__(self):
        for name, known in (("units", ("pages", "chunks")), ("rules", ("threshold", "strategy")), ("construction", ("parallel", "iterative"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} are {' or '.join(known)}, not {getattr(self, name)!r}")

    def page_rules(self) -> Rules:
        return page_rules() if self.rules == "threshold" else strategy_rules()


def page_graphs(pages: DataFrame, project: Project, contents: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Graphs of all units of ``pages(doc, page, text)``; model calls of all documents run side by side, each once.

    Documents are classified by their table of contents (``contents(doc, ord, level, title, page)``), if that names no category by their first
    pages, and then by the images of those (``images(doc, page, image)``).  Pages with an image are sent with it.
    """
    categories = list(project.categories)
    steps = [] if contents is None else [X.toc_text(contents)]
    steps.append(X.first_pages_text(pages, 4))
    if images is not None:
        steps.append(files.first_images(images, 4).join(X.first_pages_text(pages, 4), "doc", "left"))
    kinds = X.classify(steps, project.client, categories)
    sums = X.ask(X.first_pages_text(pages, 10).select("doc", X.summary_prompt(F.col("text")).alias("prompt")), project.client)
    sums = sums.select("doc", X.parse_summary(F.col("reply")).alias("s")).select("doc", "s.summary", "s.main_entity")
    context = materialize(X.with_context(sums.join(kinds, "doc", "full_outer"), project.ontology.prompt() if project.ontology else None), "context")
    none = F.lit(None)
    if project.units == "chunks":
        found = C.chunk_documents(pages, project.chunks)
        units = found.select("doc", F.regexp_extract("id", r"\d+", 0).cast("int").alias("page"), "text", F.col("section_context").alias("section"), F.col("previous_chunk_summary").alias("before"), F.col("document_position").alias("position"))
    else:
        units = pages.select("doc", "page", "text", none.cast("string").alias("section"), none.cast("string").alias("before"), none.cast("double").alias("position"))
    rows = units.join(context, "doc", "left")

    def prompt(previous: str | None = None, image: bool = False):
        return X.extraction_prompt(
            F.col("text"), F.coalesce("ontology", F.lit("")), F.col("category"), F.col("main_entity"), None if previous is None else F.lit(previous), F.col("section"), F.col("before"), F.col("position"), image
        )

    seen = images is not None and project.units == "pages"
    if seen:
        rows = rows.join(images.select("doc", "page", "image"), ["doc", "page"], "left")
    if project.construction == "iterative":
        return X.iterative_graphs(rows, project.client, prompt(X.PREVIOUS), project.page_rules(), *(("image", prompt(X.PREVIOUS, image=True)) if seen else ()))
    return X.extract_graphs(rows, project.client, prompt(), *(("image", prompt(image=True)) if seen else ()))


def unit_entities(graphs: DataFrame) -> DataFrame:
    """``(id, type, ord, page, attributes ...)`` of the entities of units, as ``diagnose`` takes them."""
    rows = X.graph_entities(graphs)
    return rows.select("id", "type", F.struct("doc", "ord").alias("ord"), F.concat_ws("/", "doc", F.col("page").cast("string")).alias("page"), *[F.get_json_object("attrs_json", f"$.{f}").alias(f) for f in D.FIELDS])


def project_entities(ents: DataFrame) -> DataFrame:
    """The same of a project graph, whose attributes are provenance lists: their first values."""
    return ents.select("id", "type", "ord", *[F.get_json_object("attrs_json", f"$.{f}[0].value").alias(f) for f in D.FIELDS])


def export_files(ents: DataFrame, links: DataFrame, out: str, project: Project, max_keys: int = 1000) -> None:
    """Meta, nodes and links of a project graph, each as one JSON array.  Every attribute becomes a column here: over ``max_keys`` of them are refused."""
    values = F.map_filter(F.from_json("attrs_json", "map<string,string>"), lambda k, v: ~k.startswith("_"))
    keys = [r["k"] for r in ents.select(F.explode(F.map_keys(values)).alias("k")).distinct().limit(max_keys + 1).collect()]
    if len(keys) > max_keys:
        raise ValueError(f"over {max_keys} attributes can't be exported")
    keys = tuple(sorted(k for k in keys if k not in ("id", "type", "ord")))
    flat = ents.select("id", "type", "ord", *[F.get_json_object(values[k], "$[0].value").alias(k) for k in keys])
    rels = links.withColumn("ord", F.xxhash64("source", "target", "type"))
    base, onto = files.file_base("project", project.model, project.provider, project.construction), project.ontology
    node_rows = materialize(EXP.nodes(flat, keys, 1, base, "Project graph", onto.prefix if onto else "kg:", onto.categories if onto else None), "nodes")
    link_rows = materialize(EXP.links(flat, rels, keys, 1, base, "Project graph"), "links")
    files.write_json_array(node_rows, f"{out}/{base}_nodes.json", ["id"])
    files.write_json_array(link_rows, f"{out}/{base}_links.json", ["key"])
    files.write_json_array(EXP.meta(node_rows, link_rows, 1, base, "Project graph", f"{base}.json"), f"{out}/{base}_meta.json", ["id"])


def document_graphs(graphs: DataFrame, project: Project) -> tuple[DataFrame, DataFrame]:
    """Merged entities ``(doc, ord, id, type, n, attrs_json)`` of each document, and its relations, cleaned and renumbered.

    The fold says where each id of each page went, and relations follow it.  An end that the page doesn't have is an id of the merged graph of the pages up to it, as prompts
    show it in iterative construction; relations without both ends, and repeated ones, are left out.
    """
    found = X.graph_entities(graphs).withColumn("page", F.col("page").cast("string"))
    rows = materialize(ME.folded(found, "doc", project.page_rules(), "page", renumber=True), "documents")
    ids = rows.where("old_id is not null and at is not null").select("doc", F.col("at").alias("page"), "old_id", "id")
    whole = rows.where("old_id is not null and at is null").select("doc", "old_id", "id", "first_ord")
    rels = X.graph_relations(graphs).withColumn("page", F.col("page").cast("string"))
    for end in ("source", "target"):
        rels = rels.join(ids.withColumnsRenamed({"old_id": end, "id": f"new_{end}"}), ["doc", "page", end], "left")
        # The merged graph is asked for ends that the page doesn't have only.
        rels = rels.join(whole.withColumnsRenamed({"old_id": end, "id": f"whole_{end}", "first_ord": f"first_{end}"}), ["doc", end], "left")
        earlier = F.when(F.expr(f"first_{end} div {X.PAGE_STEP} <= ord div {X.PAGE_STEP}"), F.col(f"whole_{end}"))
        rels = rels.withColumn(f"new_{end}", F.coalesce(f"new_{end}", earlier))
    rels = rels.where("new_source is not null and new_target is not null").select("doc", "ord", F.col("new_source").alias("source"), F.col("new_target").alias("target"), "type")
    return rows.where("old_id is null").select("doc", "ord", "id", "type", "n", "attrs_json"), G.first_by(rels, ["doc", "source", "target", "type"])


def project_graph(merged: DataFrame, rels: DataFrame, rules: Rules | None = None, base: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """One graph with provenance from all documents, in the order of their names: entities and relations, cleaned and renumbered.

    ``base``: a project graph that this function has returned before, into which the documents are merged; its entities keep their ids.

    Where types must match, as they do by default, the merge is settled across tasks (``merged_across``), so no task holds a type.  Where they need not, it is one ordered fold in a task.
    """
    rules = rules or project_rules()
    rows = merged.withColumn("project", F.lit("project"))
    if base is not None and not rules.same_type:
        raise ValueError("a stored graph takes new documents where types must match")
    if base is not None:
        kept, went = merged_into(base[0], rows, "project", rules, "doc", order=("doc", "ord"))
        kept, ids = kept.select("project", "ord", "id", "type", "n", "attrs_json"), went.select(F.col("at").alias("doc"), "old_id", F.col("id").alias("new_id"))
    elif rules.same_type:
        kept, went = merged_across(rows, "project", rules, "doc", order=("doc", "ord"), documents=True)
        kept, ids = kept.select("project", "ord", "id", "type", "n", "attrs_json"), went.select(F.col("at").alias("doc"), "old_id", F.col("id").alias("new_id"))
    else:
        found = materialize(ME.folded(rows, "project", rules, "doc", documents=True, order=("doc", "ord"), renumber=True), "project")
        kept = found.where("old_id is null").select("project", "ord", "id", "type", "n", "attrs_json")
        ids = found.where("old_id is not null and at is not null").select(F.col("at").alias("doc"), "old_id", F.col("id").alias("new_id"))
    for end in ("source", "target"):
        rels = rels.join(ids.withColumnsRenamed({"old_id": end, "new_id": f"new_{end}"}), ["doc", end])
    moved = rels.select(F.col("new_source").alias("source"), F.col("new_target").alias("target"), "type", "doc", F.struct("doc", "ord").alias("ord"))
    if base is not None:  # the base's documents come first
        before = base[1].select("source", "target", "type", F.posexplode("docs").alias("ord", "doc"))
        moved = before.select("source", "target", "type", "doc", F.struct(F.lit("").alias("doc"), F.col("ord").cast("long").alias("ord")).alias("ord")).unionByName(moved)
    return kept, ME.relation_documents(moved)


def run(spark: SparkSession, pages: DataFrame, out: str, project: Project | None = None, page_limit: int = 5000, contents: DataFrame | None = None, images: DataFrame | None = None, base: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Everything for ``pages(doc, page, text)``: frames by name, and files below ``out``; the graph of each document is a file below ``out/documents``.

    Drawn pages are HTML files for people, made by the driver: above ``page_limit`` entities, or ten times as many relations, none is written, and ``page`` and ``comparison`` are
    missing among the frames.  ``base``: entities and relations of a project graph, as read from its files, which the documents are added to; ``out`` is another folder.  ``comparison``, of several documents only, colours nodes by document.
    """
    project = project or Project()
    graphs = page_graphs(pages, project, contents, images)
    if project.dumps:
        files.dump_graphs(graphs, f"{out}/units", "chunk" if project.units == "chunks" else "page")
    merged, rels = document_graphs(graphs, project)
    ents, links = project_graph(merged, rels, base=base)
    ents.write.mode("overwrite").json(f"{out}/entities")
    links.write.mode("overwrite").json(f"{out}/relations")
    result = {"graphs": graphs, "documents": merged, "entities": ents, "relations": links}
    files.write_document_graphs(merged, rels, f"{out}/documents")
    if project.ontology and ents.limit(1).count():
        onto = project.ontology.frames(spark)
        keys = ents.select("id", bare_type("type").alias("type"), F.explode(F.from_json("attrs_json", "map<string,string>")).alias("key", "value")).where(~F.col("key").startswith("_"))
        scores = E.evaluate(ents.select("id", "type", "ord"), links.withColumn("ord", F.lit(0)), keys, onto)
        result |= {f"metric_{k}" if k != "score" else k: v for k, v in scores.items()}
        result["score"].write.mode("overwrite").json(f"{out}/evaluation")
    if project.diagnostics:
        result["report"] = materialize(D.report(unit_entities(graphs), project_entities(ents)), "report")
        result["report"].coalesce(1).write.mode("overwrite").json(f"{out}/diagnostics")
        D.print_report(result["report"])
    if project.export:
        export_files(ents, links, files.url(f"{out}/export"), project)
    if V.drawable(ents, links, page_limit):
        docs = F.from_json(F.get_json_object("attrs_json", "$._source_document_ids"), "array<string>")
        values = F.map_filter(F.from_json("attrs_json", "map<string,string>"), lambda k, v: ~k.startswith("_"))
        provenance = F.transform_values(values, lambda k, v: F.from_json(v, "array<struct<value:string,source_doc_id:string>>"))
        drawn = ents.select("id", "type", *[F.get_json_object("attrs_json", f"$.{f}[0].value").alias(f) for f in D.NAME_FIELDS], docs.alias("docs"), provenance.alias("provenance"))
        nodes, edges, members = V.vis_nodes(drawn), V.vis_edges(drawn, links), drawn.select("id", F.explode("docs").alias("doc"))
        html = {"page": V.html_page(nodes, edges, "Project graph", page_limit)}
        legend = V.comparison_legend(members)
        if len(legend) > 2:
            by_document = nodes.drop("color", "size").join(V.comparison_nodes(drawn, members), "id")
            html["comparison"] = V.html_page(by_document, edges, "Documents of the project", page_limit, legend)
        for name, body in html.items():
            result[name] = spark.createDataFrame([(body,)], "value string")
            result[name].coalesce(1).write.mode("overwrite").text(f"{out}/{name}")
    return result


def run_folder(spark: SparkSession, folder: str, out: str, project: Project | None = None, pattern: str = "*.pdf", reader: files.PageReader = files.text_pages) -> dict[str, DataFrame]:
    """``run`` over the files of a folder."""
    pages = materialize(files.read_pages(files.discover(spark, folder, pattern), reader).select("doc", "page", "text"), "pages")
    return run(spark, pages, out, project)
