"""The ontology of the star graph, and the same as SQL."""

from __future__ import annotations

from kgloom.operators.ontology import Ontology

RAW = {
    "entities": [
        {"kg:Location": {"description": "A place", "attributes": [{"locationName": "string"}]}},
        {"kg:Company": {"description": "A business", "attributes": [{"name": "string"}, {"segment": "string"}]}},
        {"kg:ProductOrService": {"attributes": [{"name": "string"}, {"brand": "string"}]}},
        {"kg:TransactionContext": {"attributes": [{"contextName": "string"}, {"status": "string"}]}},
        {"kg:FinancialMetric": {"attributes": [{"metricName": "string"}, {"metricValue": "float"}]}},
        {"kg:Person": {"attributes": [{"fullName": "string"}]}},
    ],
    "relations": [
        "kg:locatedIn (Location -> Location)",
        "kg:hasHeadquartersIn (Company -> Location)",
        "kg:involvesCompany (TransactionContext -> Person)",
        "kg:reportsMetric (Company → FinancialMetric)",
        "kg:offersProduct (Company|Person -> ProductOrService|Technology)",
        "kg:employs (Company -> Person)",
    ],
}
ONTOLOGY = Ontology.from_dict(RAW)


def _values(name: str, cols: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({cols}))"


#: Common table expressions to follow those of the star graph.
SQL = ", " + ", ".join(
    [
        _values("oe", "name", [(e,) for e in ONTOLOGY.entities]),
        _values("oa", "entity, attr", [(e, a) for e, attrs in ONTOLOGY.entities.items() for a in attrs]),
        _values("orl", "name", [(r,) for r in ONTOLOGY.relations]),
        _values("od", "relation, type", [(r, t) for r, (d, _) in ONTOLOGY.relations.items() for t in d]),
        _values("og", "relation, type", [(r, t) for r, (_, g) in ONTOLOGY.relations.items() for t in g]),
    ]
)
