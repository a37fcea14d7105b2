"""Model calls as DataFrame steps: classification, summaries, context, and graph extraction, with pluggable clients."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.match import Rules, page_rules
from kgloom.operators.merge import Accumulated
from kgloom.sources.scratch import materialize

UNKNOWN_TYPE = "unknown_document_type"
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
#: How much text goes into a prompt.
CLASSIFY_CHARS, CLASSIFY_IMAGE_CHARS, SUMMARY_CHARS = 15000, 8000, 20000


class Client(Protocol):
    """A language model: null for a failed call.  Images are only passed where a row has some."""

    def complete(self, prompt: str, temperature: float = 0.1, images: list[bytes] | tuple[bytes, ...] = ()) -> str | None: ...


class RuleClient:
    """A deterministic client without a network: capitalised words as entities of one graph, joined in a chain."""

    def complete(self, prompt: str, temperature: float = 0.1, images: list[bytes] | tuple[bytes, ...] = ()) -> str | None:
        import re

        text = prompt.rsplit("TEXT:", 1)[-1]
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{3,}\b", text)))
        entities = [{"id": f"e{i}", "type": "kg:Company", "name": n} for i, n in enumerate(names, 1)]
        rels = [{"source": f"e{i}", "target": f"e{i + 1}", "type": "kg:mentionedWith"} for i in range(1, len(names))]
        return "```json\n" + json.dumps({"entities": entities, "relationships": rels}) + "\n```"


class KeywordClient:
    """A deterministic client for classification prompts: the category that the text names first, in any case; null for none."""

    def complete(self, prompt: str, temperature: float = 0.1, images: list[bytes] | tuple[bytes, ...] = ()) -> str | None:
        import re

        head, _, text = prompt.partition("TEXT:")
        categories = re.search(r"Categories: (.*?)\. Answer", head).group(1).split(", ")
        found = re.search(r"\b(?:" + "|".join(map(re.escape, categories)) + r")\b", text, re.IGNORECASE)
        return found and found.group(0).lower()


CLIENTS: dict[str, Callable[[], Client]] = {"rules": RuleClient, "keywords": KeywordClient}


def register_client(name: str, make: Callable[[], Client]) -> None:
    """Let ``client(name)`` make this one; it is made once in each task."""
    CLIENTS[name] = make


def maker(name: str) -> Callable[[], Client]:
    if name not in CLIENTS:
        raise ValueError(f"no client {name!r}; there are {sorted(CLIENTS)}")
    return CLIENTS[name]


def client(name: str) -> Client:
    return maker(name)()


def first_pages_text(pages: DataFrame, n: int = 4) -> DataFrame:
    """``(doc, text)``: the first n pages that aren't empty, joined by a page break; no row for none."""
    rows = pages.where((F.col("page") <= n) & (F.length("text") > 0))
    return rows.groupBy("doc").agg(ordered_text("page", "text", PAGE_BREAK).alias("text"))


def ordered_text(order: str, text: str, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), sep)


def toc_text(entries: DataFrame, max_depth: int = 6) -> DataFrame:
    """``(doc, text)`` of ``entries(doc, ord, level, title, page)``: indented lines."""
    line = F.concat(F.expr("repeat('  ', level - 1)"), F.lit("- "), F.col("title"), F.lit(" (Page "), F.col("page").cast("string"), F.lit(")"))
    return entries.where(F.col("level") <= max_depth).withColumn("line", line).groupBy("doc").agg(ordered_text("ord", "line", "\n").alias("text"))


def classification_prompt(text: Column, categories: list[str], source: str = "text", limit: int = CLASSIFY_CHARS) -> Column:
    head = "Choose the one category that fits this document best. Categories: " + ", ".join(categories) + f". Answer with the category alone.\nTaken from: {source}\nTEXT:"
    return F.concat(F.lit(head), F.substring(F.coalesce(text, F.lit("")), 1, limit))


def image_classification_prompt(text: Column, categories: list[str]) -> Column:
    """The prompt that goes with images of first pages; texts are shorter here."""
    return F.concat(F.lit("The first pages are attached as images.\n"), classification_prompt(text, categories, "images", CLASSIFY_IMAGE_CHARS))


def summary_prompt(text: Column, limit: int = SUMMARY_CHARS) -> Column:
    head = 'Summarise this document and name its main entity. Answer with JSON: {"summary": "...", "main_entity": "..."}\nTEXT:'
    return F.concat(F.lit(head), F.substring(F.coalesce(text, F.lit("")), 1, limit))


def parse_category(reply: Column, categories: list[str], default: str = UNKNOWN_TYPE) -> Column:
    """The category that a reply's first line names, or the first that it contains, or the default."""
    line = F.trim(F.lower(F.split(F.trim(F.coalesce(reply, F.lit(""))), "\n")[0]))
    line = F.trim(F.regexp_replace(line, "^[\"'`]+|[\"'`.]+$", ""))
    known = F.array(*[F.lit(c.lower()) for c in categories])
    inside = F.filter(known, lambda c: line.contains(c))
    return F.when(F.array_contains(known, line), line).when(F.size(inside) > 0, F.element_at(inside, 1)).otherwise(default)


def unfence(reply: Column) -> Column:
    """A reply without the fence around its JSON."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), "^```(?:json|JSON)?\\s*", ""), "\\s*```$", ""))


def parse_summary(reply: Column) -> Column:
    """(summary, main_entity); a reply that isn't such JSON is the summary itself."""
    got = F.from_json(unfence(reply), "summary string, main_entity string")
    return F.when(got["summary"].isNotNull(), got).otherwise(F.struct(reply.alias("summary"), F.lit(None).cast("string").alias("main_entity")))


def _reply(model: Client, prompt: str | None, temperature: float, images: list[bytes] | None) -> tuple[str | None, str | None]:
    """(reply, error): a failed call is data, not a failed job."""
    try:
        if not prompt:
            return None, None
        images = [i for i in images or () if i]
        return (model.complete(prompt, temperature, images=images) if images else model.complete(prompt, temperature)), None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"


def ask(rows: DataFrame, name: str, prompt: str = "prompt", reply: str = "reply", temperature: float = 0.1, images: str | None = None) -> DataFrame:
    """Each row with the reply to its prompt and an ``error``; the client is made once in each task.  ``images``: a column of arrays of binaries."""
    names, make = rows.columns, maker(name)  # the maker itself goes to the tasks; their processes know no registry

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            prompts = b.column(names.index(prompt)).to_pylist()
            pictures = b.column(names.index(images)).to_pylist() if images else [None] * len(prompts)
            got = [_reply(model, p, temperature, i) for p, i in zip(prompts, pictures, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], [*names, reply, "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{reply} string", "error string"])
    return rows.mapInArrow(call, schema)


def classify(steps: list[DataFrame], name: str, categories: list[str]) -> DataFrame:
    """``(doc, category, step)``: documents go to the next step only while they have no category.

    ``steps``: frames ``(doc, text)``, such as contents and first pages, or with ``images`` too.  Each is written once, so no call is repeated.
    """
    done = None
    for i, step in enumerate(steps):
        todo = step if done is None else step.join(done.where(F.col("category") != UNKNOWN_TYPE).select("doc"), "doc", "left_anti")
        if "images" in step.columns:
            got = ask(todo.select("doc", "images", image_classification_prompt(F.col("text"), categories).alias("prompt")), name, images="images")
        else:
            got = ask(todo.select("doc", classification_prompt(F.col("text"), categories).alias("prompt")), name)
        got = materialize(got.select("doc", parse_category(F.col("reply"), categories).alias("category"), F.lit(i).alias("step")), "classified")
        done = got if done is None else done.unionByName(got)
    return done.groupBy("doc").agg(F.min_by("category", F.struct(F.col("category") == UNKNOWN_TYPE, "step")).alias("category"), F.min_by("step", F.struct(F.col("category") == UNKNOWN_TYPE, "step")).alias("step"))


def with_context(docs: DataFrame, ontology_text: str | None) -> DataFrame:
    """Documents ``(doc, category, summary, main_entity)`` with the ontology's text, if it is used."""
    return docs.withColumn("ontology", F.lit(ontology_text or ""))


def extraction_prompt(
    text: Column, ontology: Column, category: Column, main_entity: Column, previous: Column | None = None, section: Column | None = None, before: Column | None = None, position: Column | None = None, image: bool = False
) -> Column:
    """``before`` and ``position``: the summary of the chunk before, and the share of the document that lies before the chunk."""
    parts = [
        F.lit('Extract a knowledge graph as JSON {"entities": [{"id", "type", ...}], "relationships": [{"source", "target", "type"}]}.\n'),
        F.lit("The page is attached as an image; read tables, charts and logos in it too.\n" if image else ""),
        F.when(F.length(ontology) > 0, F.concat(F.lit("Ontology:\n"), ontology, F.lit("\n"))).otherwise(""),
        F.when(category == "financial_teaser", F.lit("Keep every figure with its currency, unit and period.\n")).otherwise(""),
    ]
    shown = None if position is None else F.concat(F.round(100 * position).cast("int").cast("string"), F.lit(" % of the document"))
    for title, value in (("Main entity", main_entity), ("Section", section), ("Text before", before), ("Position", shown), ("Graph so far", previous)):
        if value is not None:
            parts.append(F.when(F.length(value) > 0, F.concat(F.lit(f"{title}: "), value, F.lit("\n"))).otherwise(""))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts], F.lit("TEXT:"), F.coalesce(text, F.lit("")))


GRAPH = "struct<entities:array<map<string,string>>,relationships:array<map<string,string>>>"
#: A place in a document is its page times this and the place in the page.
PAGE_STEP = 1_000_000
#: Stands in a prompt where the graph of the units before goes.
PREVIOUS = "\0graph\0"


def counted(graphs: DataFrame) -> DataFrame:
    """``(doc, page, graph_json, n_entities, n_relationships, error)``, written once, so calls aren't repeated."""
    got = graphs.withColumn("parsed", F.from_json("graph_json", GRAPH))
    return materialize(
        got.select("doc", "page", "graph_json", F.coalesce(F.size("parsed.entities"), F.lit(0)).alias("n_entities"), F.coalesce(F.size("parsed.relationships"), F.lit(0)).alias("n_relationships"), "error"),
        "graphs",
    )


def extract_graphs(units: DataFrame, name: str, prompt: Column, image: str | None = None, image_prompt: Column | None = None) -> DataFrame:
    """``(doc, page, graph_json, n_entities, n_relationships, error)`` for units with a text; written once, so calls aren't repeated.

    A blank unit, a failed call or a reply without JSON is an empty graph.  ``image``: a binary column, sent with ``image_prompt``, for blank
    texts too; units without an image fall back to ``prompt``.
    """
    filled = F.length(F.trim("text")) > 0
    if image is None:
        got = ask(units.where(filled).select("doc", "page", prompt.alias("prompt")), name)
    else:
        seen = F.col(image).isNotNull()
        rows = units.where(filled | seen).select("doc", "page", F.when(seen, F.array(image)).alias("images"), F.when(seen, prompt if image_prompt is None else image_prompt).otherwise(prompt).alias("prompt"))
        got = ask(rows, name, images="images")
    return counted(got.select("doc", "page", unfence(F.col("reply")).alias("graph_json"), "error"))


def unit_graph(reply: str | None) -> dict:
    """The graph in a reply without its fence; an empty one where it holds none."""
    try:
        found = json.loads(reply) if reply else {}
    except ValueError:
        return {}
    found = found if isinstance(found, dict) else {}
    return {k: v for k in ("entities", "relationships") if isinstance(v := found.get(k), list)}


def with_previous(prompt: str, graph: str) -> str:
    """A prompt with ``graph`` where ``PREVIOUS`` stands, or without that line where there is none."""
    line = f"Graph so far: {PREVIOUS}\n"
    return prompt.replace(line, line.replace(PREVIOUS, graph) if graph else "", 1)


def iterative_graphs(units: DataFrame, name: str, prompt: Column, rules: Rules | None = None, image: str | None = None, image_prompt: Column | None = None, temperature: float = 0.1) -> DataFrame:
    """The rows of ``extract_graphs``, where ``PREVIOUS`` in a prompt becomes the graph that the document's units before have made.

    Each reply is merged into that graph by ``rules`` (those of the page merge by default), so a reply need not repeat it; it may name ids of that graph as
    ends of relations.  The graphs of all units, merged in order, are the document's, as in ``extract_graphs``.  A failed call and a reply without a graph change nothing.  Of
    rows with one (doc, page) the first by its prompt is taken.

    Units of a document wait for each other by nature; documents run side by side.  Rows stream through a task in the order of their document and page, so a task
    holds one document's graph and one batch of units, however many pages or images a document has.
    """
    make, rules = maker(name), rules or page_rules()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, doc, page, graph = make(), None, None, Accumulated(rules)
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.doc != doc:
                    doc, page, graph = row.doc, None, Accumulated(rules)
                elif row.page == page:
                    continue
                page = row.page
                reply, error = _reply(model, with_previous(row.prompt, graph.shown()), temperature, [row.image] if image else None)
                reply = _bare_reply(reply)
                found = unit_graph(reply)
                graph.add(page, found.get("entities", []), found.get("relationships", []))
                out.append((doc, page, reply, error))
            yield pd.DataFrame(out, columns=["doc", "page", "graph_json", "error"])

    filled = F.length(F.trim("text")) > 0
    if image is None:
        rows = units.where(filled).select("doc", "page", prompt.alias("prompt"))
    else:
        seen = F.col(image).isNotNull()
        rows = units.where(filled | seen).select("doc", "page", F.when(seen, prompt if image_prompt is None else image_prompt).otherwise(prompt).alias("prompt"), F.col(image).alias("image"))
    ordered = rows.repartition("doc").sortWithinPartitions("doc", "page", "prompt")
    return counted(ordered.mapInPandas(run, "doc string, page int, graph_json string, error string"))


def _bare_reply(reply: str | None) -> str | None:
    """``unfence`` of one reply."""
    import re

    return reply and re.sub(r"\s*```$", "", re.sub(r"^```(?:json|JSON)?\s*", "", reply.strip())).strip()


def graph_entities(graphs: DataFrame) -> DataFrame:
    """``(doc, page, ord, id, type, attrs_json)`` of graphs; attributes keep their JSON types."""
    raw = F.from_json("graph_json", "struct<entities:array<string>>")["entities"]
    rows = graphs.select("doc", "page", F.posexplode(raw).alias("i", "attrs_json"))
    one = F.from_json("attrs_json", "struct<id:string,type:string>")
    return rows.select("doc", "page", (F.col("page").cast("long") * PAGE_STEP + F.col("i")).alias("ord"), one["id"].alias("id"), one["type"].alias("type"), "attrs_json").where("id is not null and type is not null")


def graph_relations(graphs: DataFrame) -> DataFrame:
    """``(doc, page, ord, source, target, type)`` of graphs; incomplete ones are left out."""
    raw = F.from_json("graph_json", "struct<relationships:array<struct<source:string,target:string,type:string>>>")["relationships"]
    rows = graphs.select("doc", "page", F.posexplode(raw).alias("i", "r"))
    return rows.select("doc", "page", (F.col("page").cast("long") * PAGE_STEP + F.col("i")).alias("ord"), "r.source", "r.target", "r.type").where("source is not null and target is not null and type is not null")
