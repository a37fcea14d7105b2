import json
import random

import pytest

from kgloom.operators import match as M
from kgloom.operators import merge as ME


@pytest.mark.parametrize("rules", [M.page_rules(), M.project_rules(), M.strategy_rules(), M.page_rules(same_type=False)])
def test_index_finds_what_a_look_at_all_finds(rules):
    rng = random.Random(3)
    kinds = ("kg:Company", "x:company", "kg:Person", "kg:FinancialMetric", "kg:Shareholder", "kg:Other")

    def entity(i):
        name = " ".join("".join(rng.choice("abÄé") for _ in range(rng.choice((2, 3, 9)))) for _ in range(rng.choice((0, 1, 2, 3))))
        kind = rng.choice(kinds)
        return {"id": f"i{i % 40}", "type": kind, M.NAME_FIELD.get(M.Rules().kind({"type": kind}), "name"): name, "DateOrPeriod": rng.choice((None, "2021", "2022")), "alias": rng.choice((None, [name[:3]], "ab aé"))}

    index = ME.Fold(rules)
    for i in range(600):
        row = entity(i)
        assert index._match(row) is M.find_match(row, index.entities, rules)
        index.put({**row, "_at": i // 60})


def test_names_that_come_again_are_not_compared_with_all(monkeypatch):
    calls = []
    real = M.matches
    monkeypatch.setattr(M, "matches", lambda *a: calls.append(1) or real(*a))
    graph = ME.Accumulated(M.page_rules())
    names = [f"{a}{b}{a}{a}" for a in "abcdefghij" for b in "klmnopqrst"]
    for page in range(5):
        graph.add(page, [{"id": f"e{i}", "type": "kg:Company", "name": n} for i, n in enumerate(names)], [{"source": "e0", "target": "e1", "type": "kg:r"}])
        shown = json.loads(graph.shown())
        assert [e["name"] for e in shown["entities"]] == names and shown["relationships"] == [{"source": "e0", "target": "e1", "type": "kg:r"}]
        assert graph.shown() == json.dumps(shown, ensure_ascii=False)
    assert len(calls) <= 5 * len(names)
    assert [e["_n"] for e in graph.entities] == [5] * 100


def test_fold_of_groups_that_span_batches(spark):
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"d{i % 3}", i, i % 4 if i % 5 else None, f"p{i}", "kg:Company", json.dumps({"name": f"{'abcd'[i % 4] * 5}"})) for i in range(60)]
        frame = spark.createDataFrame(rows, "doc string, ord long, page int, id string, type string, attrs_json string")
        got = ME.folded(frame, "doc", M.page_rules(), "page", renumber=True)
        kept = sorted((r.doc, r.id, r.n) for r in got.where("old_id is null").collect())
        assert kept == [(f"d{d}", f"e{e}", 5) for d in range(3) for e in range(1, 5)]
        assert got.where("old_id is not null and (at is not null or first_at is not null)").count() == 60 + 12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
