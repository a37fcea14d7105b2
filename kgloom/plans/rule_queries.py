"""A query for each matching rule over all orders, seen as entities of its type, and its SQL.

Names are order priorities in several spellings, some missing: they are either equal once they are normalised or far below any threshold, so SQL can say what similar is (the tests hold that to the
rule itself). Periods, states and scopes come from the orders too; each of them is missing in some.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kgloom.operators import match as M
from kgloom.sources.tables import table

_NAME = "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN lower(o_orderpriority) WHEN o_orderkey % 4 = 2 THEN concat(' ', o_orderpriority, '!') ELSE o_orderpriority END"
_PERIOD = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN concat('FY ', CAST(year(o_orderdate) AS {text})) ELSE concat('fy ', CAST(year(o_orderdate) AS {text}), '!') END"
_STATE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END"
_SCOPE = "CASE WHEN o_orderkey % 11 < 4 THEN NULL WHEN o_orderkey % 11 < 6 THEN 'Group' WHEN o_orderkey % 11 < 8 THEN 'group' ELSE 'segment' END"
_AMOUNT = "CASE WHEN o_orderkey % 13 = 0 THEN 0.0 WHEN o_orderkey % 2 = 0 THEN 1.5 WHEN o_orderkey % 5 = 0 THEN 2.5 END"
_STATE_WORD = "CASE o_orderstatus WHEN 'F' THEN 'fulfilled' WHEN 'O' THEN 'outstanding' ELSE 'part shipped' END"
_NORM = r"nullif(trim(regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s.-]', ' ', 'g'), '\s+', ' ', 'g')), '')"
#: Where a type's first name is missing in a third of the rows, another one stands in.
_SOME, _OTHER = f"CASE WHEN o_orderkey % 3 <> 1 THEN {_NAME} END", f"CASE WHEN o_orderkey % 3 = 1 THEN {_NAME} END"


@dataclass(frozen=True)
class Case:
    """``columns``: attributes by name.  ``name``: SQL of the normalised name.  ``equal``: SQL of values that agree where both are there; ``keys``: of those that agree or are missing in both.

    ``on``: how names meet, ``more``: further conditions, for rows a and b.
    """

    type: str
    columns: dict[str, str]
    match: str = "page"
    name: str = ""
    equal: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    on: str = "a.n = b.n"
    more: str = ""
    features: tuple[str, ...] = ()


def _case(kind: str, field: str, columns: dict[str, str], match: str = "page", **more) -> Case:
    return Case(f"'kg:{kind}'", {field: _NAME} | columns, match, **({"name": _NORM.format(field)} | more))


_norm = _NORM.format
_ALIAS = {"alias": f"CASE WHEN o_orderkey % 6 = 0 THEN array({_STATE_WORD}) END"}
_NAMES = f"list_distinct(list_filter([{_norm('name')}] || coalesce([{_norm('x')} FOR x IN alias], []), lambda x: x IS NOT NULL))"
_CASES = {
    "match_financial_metric": _case("FinancialMetric", "metricName", {"DateOrPeriod": _PERIOD, "scope": _SCOPE}, equal=(_norm("DateOrPeriod"), _norm("scope"))),
    "match_transaction_context": _case("TransactionContext", "contextName", {"typeSought": _STATE, "status": _SCOPE}, equal=("typeSought", _norm("status"))),
    "match_company": _case("Company", "name", _ALIAS, name=_NAMES, on="list_has_any(a.n, b.n)"),
    "match_operational_kpi": _case("OperationalKPI", "kpiName", {"kpiDateOrPeriod": _PERIOD}, equal=(_norm("kpiDateOrPeriod"),)),
    "match_headcount": _case("Headcount", "headcountName", {"dateOrYear": _PERIOD}, equal=(_norm("dateOrYear"),)),
    "match_historical_event": _case("HistoricalEvent", "eventName", {"eventType": _STATE, "dateOrYear": _PERIOD}, equal=("eventType", _norm("dateOrYear"))),
    "match_advisor": Case(
        "CASE o_orderkey % 3 WHEN 0 THEN 'kg:Advisor' WHEN 1 THEN 'firm:Advisor' ELSE 'organisation unit:Advisor' END", {"name": _NAME}, name=_norm("name"), features=("type",),
        more="AND (a.f0 = b.f0 OR (a.f0 IN ('kg:Advisor', 'firm:Advisor') AND b.f0 IN ('kg:Advisor', 'firm:Advisor')))",
    ),
    "match_shareholder": Case("CASE o_orderkey % 3 WHEN 0 THEN 'kg:Shareholder' ELSE 'firm:Shareholder' END", {"name": _NAME}, name=_norm("name"), features=("type",), more="AND a.f0 = b.f0"),
    "match_person": _case(
        "Person", "fullName", {"fullName": f"concat(substr(repeat(lower(replace(substr(o_orderpriority, 3), ' ', '')), 6), 1, 12), CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat(' x', CAST(o_orderkey % 8 AS {{text}})) END, ' ', repeat(lower(o_orderstatus), 12))"},
        on="split_part(a.n, ' ', 1) = split_part(b.n, ' ', 1) AND split_part(a.n, ' ', -1) = split_part(b.n, ' ', -1)",
    ),
    "match_general": _case("ProductOrService", "name", {}),
    "match_preserve_distinct": _case(
        "TransactionContext", "contextName", {"typeSought": _STATE, "status": _SCOPE, "dateOrYear": _PERIOD, "amount": _AMOUNT}, "strategy", keys=(_norm("typeSought"), _norm("status")), equal=(_norm("dateOrYear"), "nullif(amount, 0)"),
    ),
    "match_strict_temporal": Case(
        "'kg:FinancialMetric'", {"metricName": _SOME, "kpiName": f"CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN {_NAME} END", "name": _OTHER, "kpiDateOrPeriod": _PERIOD, "scope": _SCOPE, "amount": _AMOUNT}, "strategy",
        name="coalesce(" + ", ".join(map(_norm, ("metricName", "kpiName", "name"))) + ")", equal=(_norm("kpiDateOrPeriod"), _norm("scope")),
    ),
    "match_liberal": _case("Company", "name", _ALIAS, "strategy", name=f"CASE WHEN {_norm('name')} IS NOT NULL THEN {_NAMES} ELSE [] END", on="list_has_any(a.n, b.n)"),
    "match_moderate": Case("'kg:ProductOrService'", {"name": _SOME, "metricName": _OTHER, "dateOrYear": _PERIOD, "amount": _AMOUNT}, "strategy", name=f"coalesce({_norm('name')}, {_norm('metricName')})", equal=(_norm("dateOrYear"),)),
    "match_strict": Case("'kg:Position'", {"titleName": _SOME, "name": _OTHER, "DateOrPeriod": _PERIOD, "amount": _AMOUNT}, "strategy", name=f"coalesce({_norm('titleName')}, {_norm('name')})", equal=(_norm("DateOrPeriod"), "nullif(amount, 0)")),
    "match_temporal_context": _case("HistoricalEvent", "eventName", {"eventType": _STATE, "dateOrYear": _PERIOD}, "strategy", equal=("eventType", _norm("dateOrYear"))),
}


def _entities(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    columns = ", ".join(f"{sql.format(text='STRING')} AS {name}" for name, sql in case.columns.items())
    return lambda spark, sf: spark.sql(f"SELECT concat('o', o_orderkey) AS id, {case.type} AS type, o_orderkey AS ord, {columns} FROM {{orders}}", orders=table(spark, sf, "orders"))


def _query(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    rules = M.strategy_rules() if case.match == "strategy" else M.project_rules()
    kind = case.type.rsplit(":", 1)[-1].split("'")[0].lower()

    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = _entities(case)(spark, sf)
        return M.first_rule_match(rows, rows, rules, [kind])

    return query


def _sql(case: Case) -> str:
    """The first order of each distinct set of features, then for each such set the first of all that agree."""
    columns = ", ".join(f"{sql.format(text='VARCHAR').replace('array(', 'list_value(')} AS {name}" for name, sql in case.columns.items())
    parts = {f"f{i}": sql for i, sql in enumerate(case.features)} | {f"e{i}": sql for i, sql in enumerate(case.equal)} | {f"k{i}": sql for i, sql in enumerate(case.keys)}
    features = ["n", *parts]
    agree = "".join(f" AND (a.{p} IS NULL OR b.{p} IS NULL OR a.{p} = b.{p})" for p in parts if p[0] == "e") + "".join(f" AND a.{p} IS NOT DISTINCT FROM b.{p}" for p in parts if p[0] == "k")
    selected = ", ".join(f"{sql} AS {p}" for p, sql in {"n": case.name, **parts}.items())
    same = " AND ".join(f"e.{p} IS NOT DISTINCT FROM m.{p}" for p in features)
    return f"""WITH o AS (SELECT concat('o', o_orderkey) AS id, {case.type} AS type, o_orderkey AS ord, {columns} FROM orders),
e AS (SELECT id, ord, {selected} FROM o),
f AS (SELECT {', '.join(features)}, min(ord) AS ord FROM e WHERE n IS NOT NULL GROUP BY ALL),
m AS (SELECT {', '.join(f'a.{p}' for p in features)}, min(b.ord) AS first FROM f AS a JOIN f AS b ON {case.on}{agree} {case.more} GROUP BY ALL)
SELECT e.id, concat('o', m.first) AS match_id FROM e JOIN m ON {same}"""


QUERIES = {name: _query(case) for name, case in _CASES.items()}
ORACLES = {name: _sql(case) for name, case in _CASES.items()}
#: For tests: each query's entities, rules and kind of match.
CASES = {name: (_entities(case), _query(case), case.match) for name, case in _CASES.items()}
