"""Merging of graphs: exact keys by aggregation, fuzzy keys by an ordered fold, provenance by documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import normalize_text
from kgloom.operators.graph import first_by
from kgloom.operators.match import MatchIndex, Rules, find_match

#: Names, of which the longer one wins, and numbers, which only replace nothing or zero.
NAMES = ("name", "metricName", "kpiName", "productName", "fullName", "shareholderName", "contextName", "eventName", "locationName")
NUMBERS = ("metricValue", "percentageValue", "headcountValue", "amount", "parsedValue", "parsedPercentage")


def longest(value: Column, order: Column) -> Column:
    """The longest text of a group that isn't blank, the first of equals: the fold of the string rule in one aggregate."""
    return F.max_by(F.when(F.trim(value) != "", value), F.when(F.trim(value) != "", F.struct(F.length(value), -order)))


def first_number(value: Column, order: Column) -> Column:
    """The first value that is neither null nor zero, or else the first that isn't null."""
    real = F.when(value.isNotNull(), F.struct((value == 0).alias("zero"), order.alias("o"), value.alias("v")))
    return F.min(real)["v"]


def merge_exact(entities: DataFrame, keys: list[Column], attributes: list[str], graph: list[str] | None = None) -> DataFrame:
    """Entities of one key as one: the first id and order, ``n`` merged, and each attribute by its rule."""
    order = F.col("ord")
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = entities.select("*", *named)
    aggs = [F.min_by("id", order).alias("id"), F.min(order).alias("first_ord"), F.count("*").alias("n")]
    for a in attributes:
        aggs.append((first_number(F.col(a).cast("double"), order) if a in NUMBERS else longest(F.col(a), order)).alias(a))
    return rows.groupBy(*(graph or []), *(f"_k{i}" for i in range(len(keys)))).agg(*aggs).drop(*(f"_k{i}" for i in range(len(keys))))


def merge_relations(relations: DataFrame, id_map: DataFrame, valid: DataFrame) -> DataFrame:
    """Relations moved to merged entities by ``id_map(id, new_id)``, both ends valid, each (source, target, type) once."""
    start, end = id_map.toDF("source", "_s"), id_map.toDF("target", "_t")
    rels = relations.join(start, "source", "left").join(end, "target", "left")
    rels = rels.withColumns({"source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")}).drop("_s", "_t")
    once = first_by(rels, ["source", "target", "type"])
    ids = valid.select("id")
    kept = once.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.select(*relations.columns)


def provenance(attributes: DataFrame, entity: str, doc: str = "doc") -> DataFrame:
    """``(entity, key, values)``: the distinct (value, document) pairs in order, of ``attributes(entity, key, value, doc, ord)``.

    A null value is a value.  Pairs are made distinct before lists are built, so a list is as long as its distinct pairs.
    """
    pairs = attributes.groupBy(entity, "key", "value", doc).agg(F.min("ord").alias("ord"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("value"), F.col(doc).alias("source_doc_id")))), lambda x: F.struct(x["value"].alias("value"), x["source_doc_id"].alias("source_doc_id")))
    return pairs.groupBy(entity, "key").agg(listed.alias("values"))


def relation_documents(relations: DataFrame, default: str = "aggregated") -> DataFrame:
    """``(source, target, type, docs)``: the documents of each relation in the order of their first mention."""
    docs = relations.groupBy("source", "target", "type", F.coalesce("doc", F.lit(default)).alias("doc")).agg(F.min("ord").alias("ord"))
    return docs.groupBy("source", "target", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc"))), lambda x: x["doc"]).alias("docs"))


def merge_statistics(entities: DataFrame, key: Column, strategies: dict[str, str], default: str = "moderate") -> DataFrame:
    """``(type, strategy, total, kept, merged, rate)`` of an exact merge."""
    kind = F.lower(F.substring_index("type", ":", -1))
    rows = entities.select(kind.alias("type"), key.alias("key")).groupBy("type", "key").agg(F.count("*").alias("n"))
    out = rows.groupBy("type").agg(F.sum("n").alias("total"), F.count("*").alias("kept"))
    strategy = F.coalesce(F.create_map(*[F.lit(x) for p in strategies.items() for x in p])[F.col("type")], F.lit(default))
    merged = F.col("total") - F.col("kept")
    return out.select("type", strategy.alias("strategy"), "total", "kept", merged.alias("merged"), F.round(100.0 * merged / F.col("total"), 1).alias("rate"))


def key_of(type_: Column, name: Column) -> list[Column]:
    return [type_, normalize_text(name)]


# ---- the ordered fold -------------------------------------------------------------------------------------------


def _blank(v: Any) -> bool:
    return v is None or (isinstance(v, str) and not v.strip())


def merged_value(key: str, old: Any, new: Any) -> Any:
    """The value that an entity keeps when another with ``new`` joins it."""
    if _blank(new) or old == new:
        return old
    if _blank(old):
        return new
    if key in NAMES:
        return new if len(str(new)) > len(str(old)) else old
    if key in NUMBERS:
        return new if old == 0 else old
    if isinstance(old, list) and isinstance(new, list):
        return old + [x for i, x in enumerate(new) if x not in old and x not in new[:i]]
    if isinstance(old, dict) and isinstance(new, dict):
        return old | new
    if isinstance(old, bool) and isinstance(new, bool):
        return new
    return new if isinstance(old, str) and isinstance(new, str) and len(new) > len(old) else old


class Fold:
    """Entities merged in order, each into the first earlier one that it matches.

    ``start``: entities merged before.  With ``provenance_of`` values become lists of {value, source_doc_id}, and ids of newcomers get ``_projdup``.
    """

    def __init__(self, rules: Rules, provenance_of: Callable[[dict], str] | None = None, start: list[dict] | None = None):
        self.rules, self.provenance_of = rules, provenance_of
        self.entities: list[dict] = []
        #: Id -> place.
        self.place: dict[str, int] = {}
        # Where types must match, only entities of the type are looked at; a merged entity keeps its kind.
        self.by_kind: dict[str, MatchIndex] = {}
        self.at: dict[str, int] = {}
        for e in start or []:
            self._found(e)

    def _index(self, entity: dict) -> MatchIndex:
        kind = self.rules.kind(entity)
        if kind not in self.by_kind:
            self.by_kind[kind] = MatchIndex(kind, self.rules)
        return self.by_kind[kind]

    def _found(self, entity: dict) -> None:
        self.place[entity["id"]] = len(self.entities)
        self.entities.append(entity)
        if self.rules.same_type:
            self.at[entity["id"]] = self._index(entity).add(entity)

    def _match(self, row: dict) -> dict | None:
        if not self.rules.same_type:
            return find_match(row, self.entities, self.rules)
        index = self._index(row)
        at = index.find(row)
        return None if at is None else index.entities[at]

    def put(self, row: dict) -> dict:
        """The entity that a row has founded or joined."""
        where = row.pop("_at", None)
        match = self._match(row)
        founds = match is None
        if founds:
            old = new = str(row["id"])
            n = 0
            while new in self.place:
                n += 1
                new = f"{old}_projdup{n}" if self.provenance_of else f"{old}_{self.rules.kind(row)}_{n}"
            match = {"id": new, "type": row["type"], "_n": 0}
            if not self.provenance_of:
                match |= {k: v for k, v in row.items() if k not in ("id", "type")}
                if where is not None:
                    match["_source_page"] = str(where)
        elif not self.provenance_of:
            match |= {k: merged_value(k, match.get(k), v) for k, v in row.items() if k != "id"}
        elif len(row["type"]) > len(match["type"]):
            match["type"] = row["type"]
        if self.provenance_of:
            doc = self.provenance_of(row | {"_at": where})
            for k, v in row.items():
                if k not in ("id", "type", "_source_document_ids"):
                    pair = {"value": v, "source_doc_id": doc}
                    if pair not in match.setdefault(k, []):
                        match[k].append(pair)
            if doc not in match.setdefault("_source_document_ids", []):
                match["_source_document_ids"].append(doc)
        match["_n"] += 1
        if founds:
            self._found(match)
        elif self.rules.same_type:
            self._index(match).changed(self.at[match["id"]])
        return match


def fold_entities(rows: list[dict], rules: Rules, provenance_of: Callable[[dict], str] | None = None, start: list[dict] | None = None) -> tuple[list[dict], dict[tuple, str]]:
    """The entities of a ``Fold`` of all rows, and (document or page, old id) -> new id."""
    fold = Fold(rules, provenance_of, start)
    ids: dict[tuple, str] = {}
    for row in rows:
        where = row.get("_at")
        ids[(where, str(row["id"]))] = fold.put(row)["id"]
    return fold.entities, ids


class Accumulated:
    """A document's graph as it grows: the graph of one unit after the other is merged into it, by the rules of the page merge.

    ``entities``: as ``fold_entities`` keeps them.  ``relations``: (source, target, type) by their ends in the merged graph, in order.
    """

    def __init__(self, rules: Rules, entities: list[dict] | None = None, relations: list[tuple] | None = None):
        self.fold, self.relations = Fold(rules, start=entities), dict.fromkeys(map(tuple, relations or []))
        #: The graph's parts as JSON, those of entities that were touched since being None.
        self._entities: list[str | None] = [None] * len(self.entities)
        self._relations: list[str] = []

    @property
    def entities(self) -> list[dict]:
        return self.fold.entities

    def add(self, page: Any, entities: list, relations: list) -> tuple[list[dict], list[tuple]]:
        """The entities that the unit's graph has touched and the relations that it has added.

        What isn't an object with its required keys is left out.  An end is an id of the unit, or else of the graph so far; relations without both ends are left out.
        """
        rows = [{**e, "id": str(e["id"]), "type": str(e["type"]), "_at": page} for e in entities if isinstance(e, dict) and e.get("id") is not None and e.get("type")]
        ids = {row["id"]: self.fold.put(row)["id"] for row in rows}
        known = self.fold.place
        end = lambda x: ids.get(str(x), str(x))
        found = [r for r in relations if isinstance(r, dict) and all(r.get(k) is not None for k in ("source", "target", "type"))]
        new = [t for r in found if (t := (end(r["source"]), end(r["target"]), str(r["type"])))[0] in known and t[1] in known and t not in self.relations]
        self.relations.update(dict.fromkeys(new))
        touched = sorted({known[i] for i in ids.values()})
        self._entities += [None] * (len(self.entities) - len(self._entities))
        for at in touched:
            self._entities[at] = None
        return [self.entities[at] for at in touched], list(dict.fromkeys(new))

    def shown(self) -> str:
        """The graph as JSON, as prompts show it; empty for none."""
        if not self.entities:
            return ""
        for at, part in enumerate(self._entities):
            if part is None:
                self._entities[at] = json.dumps({k: v for k, v in self.entities[at].items() if not k.startswith("_")}, ensure_ascii=False)
        for r in islice(self.relations, len(self._relations), None):
            self._relations.append(json.dumps(dict(zip(("source", "target", "type"), r, strict=True)), ensure_ascii=False))
        return f'{{"entities": [{", ".join(self._entities)}], "relationships": [{", ".join(self._relations)}]}}'


#: A fold's rows: merged entities, whose ``old_id`` is null, and (at, old_id) -> id of each row that went in, whose ``ord`` is null.  Where ids are renumbered,
#: a null ``at`` beside an ``old_id`` has the id before, and the first row's place.
FOLDED = "ord long, id string, type string, n long, attrs_json string, at string, old_id string, first_at string, first_ord long"


def folded(entities: DataFrame, group: str, rules: Rules, at: str, attrs: str = "attrs_json", documents: bool = False, order: tuple[str, ...] = ("ord",), renumber: bool = False) -> DataFrame:
    """``(group, FOLDED)``: the entities of each group merged in ``order``, and where each id of each ``at`` went.

    ``documents``: with provenance, ``at`` being the document.  ``renumber``: ids of merged entities are e1, e2, ... within the group.  ``first_at`` and
    ``first_ord`` are those of an entity's first row.  Rows without a type are left out.
    """

    columns = list(dict.fromkeys([group, *order, "ord", at, "id", "type", attrs]))
    fields = [group, *(c.split(" ")[0] for c in FOLDED.split(", "))]

    def fold(key: str, found: list[dict]) -> list[tuple]:
        rows = [{**json.loads(r[attrs] or "{}"), "id": r["id"], "type": r["type"], "_at": r[at]} for r in found]
        kept, ids = fold_entities(rows, rules, (lambda row: row["_at"]) if documents else None)
        new = {e["id"]: f"e{n}" if renumber else e["id"] for n, e in enumerate(kept, 1)}
        first: dict[str, tuple] = {}
        for r in found:
            first.setdefault(ids[(r[at], str(r["id"]))], (str(r[at]), int(r["ord"])))
        out = []
        for n, e in enumerate(kept):
            i, t, count = e.pop("id"), e.pop("type"), e.pop("_n")
            out.append((key, n, new[i], t, count, json.dumps(e, ensure_ascii=False, sort_keys=True), None, None, *first.get(i, (None, None))))
        out += [(key, None, new[i], None, None, None, str(p), old, None, None) for (p, old), i in ids.items()]
        if renumber:
            out += [(key, None, n, None, None, None, None, i, *first.get(i, (None, None))) for i, n in new.items()]
        return out

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in out], schema)

    types = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(group, pa.string()), *((c.split(" ")[0], types[c.split(" ")[1]]) for c in FOLDED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Groups come one after the other: a call for each would cost more than most folds.
        held: list[dict] = []
        for b in batches:
            out: list[tuple] = []
            for row in b.to_pylist():
                if held and row[group] != held[0][group]:
                    out += fold(held[0][group], held)
                    held = []
                held.append(row)
            yield batch(out)
        if held:
            yield batch(fold(held[0][group], held))

    rows = entities.select(*columns).where("type <> ''").withColumn(group, F.col(group).cast("string"))
    ordered = rows.repartition(group).sortWithinPartitions(group, *(F.col(o).asc_nulls_last() for o in order))
    return ordered.mapInArrow(run, f"{group} string, {FOLDED}")


def merge_fold(entities: DataFrame, group: str, rules: Rules, at: str = "page", attrs: str = "attrs_json") -> DataFrame:
    """The exact fold: ``entities(group, ord, page, id, type, attrs_json)`` to merged rows ``(group, ord, id, type, n, attrs_json)``.

    Names grow while merging, so the order matters and a group (a document) is folded in one task; documents are
    folded side by side.  Use ``merge_exact`` where groups are too large for one task, and ``folded`` to know where each id went.
    """
    return folded(entities, group, rules, at, attrs).where("old_id is null").select(group, "ord", "id", "type", "n", "attrs_json")


def merge_documents_fold(entities: DataFrame, project: str, rules: Rules, doc: str = "doc", attrs: str = "attrs_json") -> DataFrame:
    """The fold over documents with provenance: rows ``(project, ord, id, type, n, attrs_json)``."""
    return folded(entities, project, rules, doc, attrs, documents=True).where("old_id is null").select(project, "ord", "id", "type", "n", "attrs_json")
