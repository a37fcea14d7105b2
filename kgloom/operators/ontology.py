"""Ontologies as small tables, and checks of graphs against them."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bare(name: str) -> str:
    return name.rsplit(":", 1)[-1]


@dataclass
class Ontology:
    """Entity types with attribute types, and relations with domains and ranges; names are unprefixed."""

    entities: dict[str, dict[str, str]] = field(default_factory=dict)
    relations: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)
    categories: dict[str, str] = field(default_factory=dict)
    prefix: str = "kg:"

    @classmethod
    def from_dict(cls, raw: dict) -> Ontology:
        """``entities``: names or {name: {description, attributes: [{name: type}]}}; ``relations``: "name (A|B -> C|D)"."""
        out = cls()
        for item in raw.get("entities") or []:
            for name, body in (item.items() if isinstance(item, dict) else [(item, None)]):
                attrs: dict[str, str] = {}
                for a in (body or {}).get("attributes") or []:
                    attrs.update(a if isinstance(a, dict) else {a: "string"})
                out.entities[bare(name)] = {k: str(v) for k, v in attrs.items()}
                if (body or {}).get("description"):
                    out.descriptions[bare(name)] = body["description"]
                if (body or {}).get("category"):
                    out.categories[bare(name)] = body["category"]
                if ":" in name:
                    out.prefix = name.rsplit(":", 1)[0] + ":"
        for item in raw.get("relations") or []:
            name, ends = parse_relation(item if isinstance(item, str) else next(iter(item)))
            out.relations[name] = ends
        return out

    @classmethod
    def load(cls, path: str) -> Ontology:
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        if "relationships" in raw and "relations" not in raw:
            raise ValueError(f"{path} is a graph, not an ontology")
        return cls.from_dict(raw)

    def attributes_of(self, entity: str) -> list[str]:
        return list(self.entities.get(bare(entity), {}))

    def constraints(self, relation: str) -> dict[str, list[str]]:
        domain, range_ = self.relations.get(bare(relation), ([], []))
        return {"domain": domain, "range": range_}

    def entity_types(self) -> list[str]:
        return list(self.entities)

    def relation_types(self) -> list[str]:
        return list(self.relations)

    def to_json(self) -> str:
        rels = {r: {"domain": d, "range": g} for r, (d, g) in self.relations.items()}
        return json.dumps({"entities": list(self.entities), "relations": rels, "attributes": {e: list(a) for e, a in self.entities.items()}}, ensure_ascii=False)

    def prompt(self, include_attributes: bool = True) -> str:
        """The ontology as text for a model's prompt."""
        lines = ["Entity types:"]
        for name, attrs in self.entities.items():
            about = f": {self.descriptions[name]}" if name in self.descriptions else ""
            lines.append(f"- {self.prefix}{name}{about}")
            if include_attributes:
                lines += [f"    {a} ({t})" for a, t in attrs.items()]
        lines.append("Relations:")
        lines += [f"- {self.prefix}{r} ({'|'.join(d)} -> {'|'.join(g)})" for r, (d, g) in self.relations.items()]
        return "\n".join(lines)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The tables ``entity(name, ord)``, ``attribute(entity, attr, type)``, ``relation(name, ord)``, ``domain(relation, type)`` and ``range(relation, type)``."""
        make = spark.createDataFrame
        return {
            "entity": make([(e, i) for i, e in enumerate(self.entities)], "name string, ord int"),
            "attribute": make([(e, a, t) for e, attrs in self.entities.items() for a, t in attrs.items()], "entity string, attr string, type string"),
            "relation": make([(r, i) for i, r in enumerate(self.relations)], "name string, ord int"),
            "domain": make([(r, t) for r, (d, _) in self.relations.items() for t in d], "relation string, type string"),
            "range": make([(r, t) for r, (_, g) in self.relations.items() for t in g], "relation string, type string"),
        }


def parse_relation(text: str) -> tuple[str, tuple[list[str], list[str]]]:
    """Name, domain and range of "name (A|B -> C|D)"; both arrows are taken."""
    m = re.match(r"^\s*([^\s(]+)\s*(?:\(\s*(.*?)\s*(?:→|->)\s*(.*?)\s*\))?\s*$", text)
    if not m:
        return bare(text.strip()), ([], [])
    ends = [[bare(t.strip()) for t in (m[i] or "").split("|") if t.strip()] for i in (2, 3)]
    return bare(m[1]), (ends[0], ends[1])


def parse_relations(lines: DataFrame, col: str = "line") -> DataFrame:
    """The same over a column: ``(name, side, type)`` rows, a side being ``domain`` or ``range``."""
    name = F.substring_index(F.regexp_extract(col, r"^\s*([^\s(]+)", 1), ":", -1)
    sides = F.create_map(F.lit("domain"), F.regexp_extract(col, r"\(\s*(.*?)\s*(?:→|->)", 1), F.lit("range"), F.regexp_extract(col, r"(?:→|->)\s*(.*?)\s*\)", 1))
    rows = lines.select(name.alias("name"), F.explode(sides).alias("side", "types"))
    rows = rows.select("name", "side", F.explode(F.split("types", r"\|")).alias("type"))
    return rows.select("name", "side", F.substring_index(F.trim("type"), ":", -1).alias("type")).where("type <> ''")


def bare_type(col: str) -> Column:
    return F.substring_index(F.coalesce(F.col(col), F.lit("")), ":", -1)


def invalid_entities(entities: DataFrame, onto: dict[str, DataFrame]) -> DataFrame:
    """``(id, type)`` of entities whose type isn't declared.  The ontology is a few rows, so it is sent to the rows."""
    rows = entities.select("id", bare_type("type").alias("type"))
    return rows.join(F.broadcast(onto["entity"].select(F.col("name").alias("type"))), "type", "left_anti").select("id", "type")


def invalid_relations(relations: DataFrame, onto: dict[str, DataFrame]) -> DataFrame:
    rows = relations.select("source", "target", bare_type("type").alias("type"))
    return rows.join(F.broadcast(onto["relation"].select(F.col("name").alias("type"))), "type", "left_anti").select("source", "target", "type")


def missing_types(entities: DataFrame, relations: DataFrame, onto: dict[str, DataFrame]) -> DataFrame:
    """``(kind, name)`` of declared entity and relation types that the graph doesn't use."""
    parts = []
    for kind, rows, names in (("entity", entities, onto["entity"]), ("relation", relations, onto["relation"])):
        used = rows.select(bare_type("type").alias("name")).distinct()
        parts.append(names.select("name").join(used, "name", "left_anti").select(F.lit(kind).alias("kind"), "name"))
    return parts[0].unionByName(parts[1])
