"""The merge across tasks against plain folds: the settling of a component alone, and whole graphs."""

import json
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions.text import ratio
from kgloom.operators import match as M
from kgloom.operators.settle import Settling, merged_across, merged_into, settle, signature
from kgloom.plans import registry, star
from tests.plain import BOTH_RULES, page_match, plain_fold

WORDS = ["acme", "acmes", "acme holding", "acme holdings", "acme holdings of old", "zeta", "zetas", "zeta bank", "beta bank", "", "ann lee", "ann b lee", "ann c. lee jones"]
KINDS = ["Company", "Person", "ProductOrService", "FinancialMetric", "Advisor", "Shareholder", "HistoricalEvent"]


def entity(draw_kind, name, more, period, flag):
    kind = KINDS[draw_kind]
    title = {"Person": "fullName", "FinancialMetric": "metricName", "HistoricalEvent": "eventName"}.get(kind, "name")
    body = {"type": f"{'kg' if flag else 'longer'}:{kind}", title: name or None}
    if kind == "Company" and more:
        body["alias"] = more
    if period:
        body |= {"DateOrPeriod": period, "eventType": period, "note": f"n{len(period)}{name}"}
    if flag:
        body |= {"amount": len(name) - 4, "seen": bool(period), "extra": {name[:1]: period or "x"}}
    return body


ROWS = st.lists(
    st.builds(entity, st.integers(0, len(KINDS) - 1), st.sampled_from(WORDS), st.lists(st.sampled_from(WORDS), max_size=2), st.sampled_from(["", "FY21", "fy21", "FY22 long"]), st.booleans()),
    max_size=40,
)


def settled_alone(rows, rules, documents, look):
    """The settling of one component that holds all rows, in rounds, on the driver."""
    signed = [signature(r, rules) for r in rows]
    first, of = {}, {}
    for pos, (sig, names) in enumerate(signed):
        if names:
            of[pos] = first.setdefault(sig, pos)
    sigs = {s: json.loads(signed[s][0]) for s in set(of.values())}
    names = {n for s in sigs for n in signed[s][1]}
    near = defaultdict(set)
    for a in names:
        for b in names:
            if a != b and max(ratio(a, b), ratio(b, a)) >= 0.7:
                near[a].add(b)
    state, position, spans = None, -1, defaultdict(list)
    for _ in range(200):
        rest = {s: [p for p in range(len(rows)) if of.get(p) == s and p > position] for s in sigs}
        process = Settling(rules, documents, sigs, near, state)
        decided, position = settle(process, {s: r[:look] for s, r in rest.items()}, {s: len(r) <= look for s, r in rest.items()}, position)
        for s, start, founder in decided:
            spans[s].append((start, founder))
        if position is None:
            return [next(f for start, f in sorted(spans[of[p]], reverse=True) if start <= p) if p in of else p for p in range(len(rows))]
        state = json.loads(json.dumps(process.state()))
    raise AssertionError("it doesn't end")


def founders(rows, match, documents):
    where = plain_fold([{**r, "id": f"i{p}", "_at": p} for p, r in enumerate(rows)], match, documents)[1]
    first = {}
    return [first.setdefault(where[p, f"i{p}"], p) for p in range(len(rows))]


@settings(max_examples=300, deadline=None)
@given(ROWS, st.sampled_from([1, 2, 64]), st.sampled_from(sorted(BOTH_RULES)))
def test_settling_is_the_fold(rows, look, name):
    rules, match, documents = BOTH_RULES[name]
    assert settled_alone(rows, rules, documents, look) == founders(rows, match, documents)


@pytest.mark.parametrize(("name", "seed"), [("pages", 1), ("project", 2)])
def test_merge_across_is_the_fold(spark, name, seed):
    """Several groups, repeated rows and ids, small rounds: merged entities, their values, and where each id went."""
    rules, match, documents = BOTH_RULES[name]
    rng = random.Random(seed)
    rows = []
    for i in range(700):
        body = entity(rng.randrange(len(KINDS)), rng.choice(WORDS), rng.choices(WORDS, k=rng.randrange(3)), rng.choice(["", "FY21", "fy21", "FY22 long"]), rng.random() < 0.5)
        kind = body.pop("type")
        rows.append((f"g{i % 2}", i, f"d{i // 40}", f"x{i % 40}", kind, json.dumps(body)))
    df = spark.createDataFrame([*rows, ("g1", 999, "d", "y", None, "{}"), ("g1", 1000, "d", "y", "", None), ("g1", 1001, "d99", "y", "kg:Company", None)], "project string, ord long, doc string, id string, type string, attrs_json string")
    kept, went = merged_across(df.repartition(5), "project", rules, "doc", documents=documents, look_ahead=3)
    got = {g: [] for g in ("g0", "g1")}
    for r in kept.orderBy("ord").collect():
        got[r.project].append((r.ord, r.id, r.type, r.n, json.loads(r.attrs_json)))
    goes = {(r.project, r.at, r.old_id): r.id for r in went.collect()}
    for g in got:
        own = [{**json.loads(a), "id": i, "type": t, "_at": d} for p, _, d, i, t, a in rows if p == g] + ([{"id": "y", "type": "kg:Company", "_at": "d99"}] if g == "g1" else [])
        plain, where = plain_fold(own, match, documents)
        new = {e["id"]: f"e{n}" for n, e in enumerate(plain, 1)}
        assert {k[1:]: v for k, v in goes.items() if k[0] == g} == {k: new[v] for k, v in where.items()}
        expected = [(n, new[e.pop("id")], e.pop("type"), e.pop("_n"), e) for n, e in enumerate(plain)]
        assert got[g] == expected
    assert merged_across(df.where("false"), "project", rules, "doc")[0].collect() == []


@pytest.mark.parametrize("name", ["merge_star_project", "merge_sales_later"])
def test_merge_across_star_graph(spark, name):
    """The whole star graph as one project: types in one group, at once or with one document later, equal to the plain fold."""
    sf = "/root/testdata/sf0.001"
    ents = star.entities(spark, sf)
    rows = ents.select("id", "type", "doc", F.to_json(F.struct(*star.ATTRIBUTES)).alias("attrs_json")).orderBy("ord").collect()
    if name == "merge_sales_later":
        rows.sort(key=lambda r: r.doc == "sales")
    own = [{**json.loads(r.attrs_json), "id": r.id, "type": r.type, "_at": r.doc} for r in rows]
    plain = plain_fold(own, lambda a, b: page_match(a, b, {}, 0.8), True)[0]
    found = registry.QUERIES[name](spark, sf).orderBy("ord").collect()
    got = [(r.ord, r.id, r.type, r.n, json.loads(r.attrs_json)) for r in found]
    assert got == [(n, f"e{n + 1}", e.pop("type"), e.pop("_n"), {k: v for k, v in e.items() if k != "id"}) for n, e in enumerate(plain)] and len(got) > 2000
    if name == "merge_sales_later":
        assert all(r.touched == ("sales" in e["_source_document_ids"]) for r, (*_, e) in zip(found, got, strict=True)) and sum(not r.touched for r in found) > 50


def test_new_documents_into_a_stored_graph(spark, tmp_path):
    """Base plus new equals all at once; untouched entities pass as they are; scalars without provenance get a document."""
    rng = random.Random(7)
    rows = []
    for i in range(500):
        body = entity(rng.randrange(len(KINDS)), rng.choice(WORDS), rng.choices(WORDS, k=rng.randrange(3)), rng.choice(["", "FY21", "fy21", "FY22 long"]), rng.random() < 0.5)
        kind = body.pop("type")
        rows.append((f"g{i % 2}", i, f"d{i // 50}", f"x{i % 50}", kind, json.dumps(body)))
    new = [r for r in rows[400:] if r[4].endswith(("Company", "Person"))] + [("g9", 900, "d99", "y", "kg:Person", json.dumps({"fullName": "ann lee"}))]
    frame = lambda x: spark.createDataFrame(x, "project string, ord long, doc string, id string, type string, attrs_json string")
    rules = M.project_rules()
    shape = lambda df: {(r.project, r.ord, r.id, r.type, r.n, r.attrs_json) for r in df.collect()}
    base, _ = merged_across(frame(rows[:400]), "project", rules, "doc", documents=True)
    base.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base")).drop("first_at")
    whole, went = merged_across(frame(rows[:400] + new), "project", rules, "doc", documents=True)
    got, goes = merged_into(base, frame(new), "project", rules, "doc", look_ahead=4)
    assert shape(got) == shape(whole)
    new_docs = {r[2] for r in new}
    assert {(r.project, r.at, r.old_id, r.id) for r in goes.collect()} == {(r.project, r.at, r.old_id, r.id) for r in went.collect() if r.at in new_docs and any(x[0] == r.project and x[2] == r.at and x[3] == r.old_id for x in new)}
    same = got.where("not touched")
    assert same.count() > 20 and same.select(*base.columns).exceptAll(base).count() == 0
    legacy = spark.createDataFrame([("p", 0, "e1", "kg:Company", 1, json.dumps({"name": "acme", "_source_document_ids": ["d0"]})), ("p", 1, "e2", "kg:Company", 2, json.dumps({"name": "zeta", "_source_document_ids": ["d0", "d1"]}))], base.schema)
    got, _ = merged_into(legacy, frame([("p", 5, "d7", "a", "kg:Company", json.dumps({"name": "ACME"})), ("p", 6, "d7", "b", "kg:Company", json.dumps({"name": "zeta"}))]), "project", rules, "doc")
    assert {r.id: json.loads(r.attrs_json) for r in got.collect()} == {
        "e1": {"name": [{"value": "acme", "source_doc_id": "d0"}, {"value": "ACME", "source_doc_id": "d7"}], "_source_document_ids": ["d0", "d7"]},
        "e2": {"name": [{"value": "zeta", "source_doc_id": "aggregated"}, {"value": "zeta", "source_doc_id": "d7"}], "_source_document_ids": ["d0", "d1", "d7"]},
    }
