import json
import random
import re

import pytest
from pyspark.sql import functions as F

from kgloom.functions.text import ratio
from kgloom.operators import chunk as C
from kgloom.operators import evaluate as E
from kgloom.operators import extract as X
from kgloom.operators import graph as G
from kgloom.operators import match as M
from kgloom.operators import merge as ME
from kgloom.operators import viz as V
from kgloom.operators.components import connected_components
from kgloom.plans.ontology_demo import ONTOLOGY
from kgloom.sources import files
from kgloom.streaming.fold import fold_stream


def test_clean_and_renumber(spark):
    e = spark.createDataFrame([("b", "t", 2), ("a", "t", 1), ("a", "u", 3), ("c", None, 4)], "id string, type string, ord long")
    r = spark.createDataFrame([("a", "b", "x", 1), ("a", "b", "x", 2), ("a", "z", "x", 3), ("b", "a", None, 4)], "source string, target string, type string, ord long")
    clean = G.clean_relations(e, r)
    assert sorted(tuple(x) for x in clean.collect()) == [("a", "b", "x", 1), ("b", "a", "", 4)]
    ents, rels = G.renumber(e, clean)
    assert {x.id: x.old_id for x in ents.collect()} == {"e1": "a", "e2": "b", "e3": "a"}
    assert sorted((x.source, x.target) for x in rels.collect()) == [("e1", "e2"), ("e2", "e1")]


def test_ordered_index_over_buckets(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(500)], "ord long").distinct()
    got = sorted((r.ord, r.n) for r in G.ordered_index(df, "ord", "n", parts=7).collect())
    assert [n for _, n in got] == list(range(1, len(got) + 1))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_components_write_less_each_round(spark, monkeypatch):
    """Edges within a tree are dropped, so later rounds hold only the edges between the trees of the rounds before."""
    from kgloom.operators import components

    kept, write = [], components.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "edges":
            kept.append(out.count())
        return out

    monkeypatch.setattr(components, "materialize", counted)
    edges = [(f"c{i // 10}", f"o{i}") for i in range(400)] + [(f"c{i}", f"n{i % 4}") for i in range(40)] + [(f"n{i}", "r") for i in range(4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert set(got.values()) == {"c0"} and len(got) == 445
    assert kept[0] == 444 and kept[1] <= 44 and kept[-1] == 0


def test_star_metrics(spark):
    e = spark.createDataFrame([(f"e{i}", "p:Company" if i == 1 else "p:Product", i) for i in range(1, 62)], "id string, type string, ord long")
    r = spark.createDataFrame([("e1", f"e{i}", "p:x", i) for i in range(2, 62)], "source string, target string, type string, ord long")
    v, ed = E.simple_graph(e, r)
    b = E.basic_metrics(v, ed).first()
    assert (b.nodes, b.edges) == (61, 60) and b.density == pytest.approx(0.016393, abs=1e-6) and b.avg_degree == pytest.approx(1.967213, abs=1e-6) and b.isolated_ratio == 0
    assert E.diameter(v, ed).first()[0] == 2
    att = spark.createDataFrame([], "id string, type string, key string, value string")
    assert E.compliance(v, ed, att, ONTOLOGY.frames(spark)).first().attribute_validity == 1.0
    assert E.company_metrics(v, ed, att).first().avg_company_relations == 60
    with pytest.raises(ValueError, match="empty"):
        E.evaluate(e.where("false"), r, att, ONTOLOGY.frames(spark))


def test_diameter_against_all_pairs(spark):
    """A tree, whose core is one node, and a ring with trees, whose longest path may lie in a tree or between two."""
    rng = random.Random(7)
    tree = [(rng.randrange(i), i) for i in range(1, 12)]
    ring = [(i, (i + 1) % 7) for i in range(7)] + [(rng.randrange(i), i) for i in range(7, 20)]
    for edges in (tree, ring):
        near = {}
        for x, y in edges:
            if x != y:
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
        worst, sizes = {}, {}
        for x in near:
            d, level = {x: 0}, [x]
            while level:
                level = [z for y in level for z in near[y] if z not in d and d.setdefault(z, d[y] + 1)]
            worst[x], sizes[x] = max(d.values()), len(d)
        best = max(sizes.values())
        names = sorted({f"n{x:02}" for e in edges for x in e})
        v = spark.createDataFrame([(n,) for n in names], "id string")
        ed = spark.createDataFrame([(f"n{x:02}", f"n{y:02}") for x, y in edges], "source string, target string")
        assert best > len(names) / 2  # so the largest component is the only one of its size
        assert E.diameter(v, ed).first()[0] == max(w for x, w in worst.items() if sizes[x] == best)


def _all_pairs(edges):
    """The diameter of the largest component, the first by id of equals."""
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    found = []
    for x in sorted(near):
        d, level = {x: 0}, [x]
        while level:
            level = [z for y in level for z in near[y] if z not in d and d.setdefault(z, d[y] + 1)]
        found.append((-len(d), min(d), max(d.values())))
    best = min(f[:2] for f in found)
    return max(f[2] for f in found if f[:2] == best)


@pytest.mark.parametrize("kind", ["ring", "grid", "equal", "many"])
def test_diameter_by_bits(spark, monkeypatch, kind):
    """Roots are bits of a row, not rows: a ring is searched from all of its nodes in batches of 70, and no front has more rows than nodes; components may be equal, or none hold half of the nodes."""
    rng = random.Random(5)
    ring = lambda k, n: [(f"{k}{i:03}", f"{k}{(i + 1) % n:03}") for i in range(n)]
    tree = lambda k, n: [(f"{k}{i:03}", f"{k}{rng.randrange(i):03}") for i in range(1, n)]
    edges = {
        "ring": ring("a", 91),
        "grid": [(f"{i}-{k}", f"{i + x}-{k + 1 - x}") for i in range(5) for k in range(5) for x in (0, 1)] + [(f"{i}-{i}", f"t{i}") for i in range(6)],
        "equal": ring("c", 8) + ring("b", 8)[:-1] + tree("d", 5),
        "many": tree("e", 6) + ring("f", 7) + tree("g", 7) + [("g000", "h0"), ("h0", "h1")],
    }[kind]
    fronts, write = [], E.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "front":
            fronts.append(out.count())
        return out

    monkeypatch.setattr(E, "materialize", counted)
    names = sorted({x for e in edges for x in e} | {"alone"})
    v = spark.createDataFrame([(n,) for n in names], "id string")
    ed = spark.createDataFrame([*edges, *((y, x) for x, y in edges[::2]), ("alone", "alone"), (None, "x")], "source string, target string")
    assert E.diameter(v, ed, roots=70).first()[0] == _all_pairs(edges)
    assert max(fronts, default=0) <= len(names)


def test_last_edge_wins(spark):
    e = spark.createDataFrame([("a", "p:A", 1)], "id string, type string, ord long")
    r = spark.createDataFrame([("a", "b", "p:x", 1), ("a", "b", "p:y", 2)], "source string, target string, type string, ord long")
    v, ed = E.simple_graph(e, r)
    assert [(x.source, x.type) for x in ed.collect()] == [("a", "y")] and {x.id: x.type for x in v.collect()} == {"a": "A", "b": None}


def test_match_rules():
    rules = M.page_rules()
    ent = lambda t, **k: {"id": "x", "type": f"p:{t}", **k}
    assert not M.matches(ent("FinancialMetric", metricName="FY21A revenue"), ent("FinancialMetric", metricName="FY22A revenue"), rules)
    assert not M.matches(ent("Company", name="Customer 000000000"), ent("Company", name="Customer 000000001"), rules)
    assert M.matches(ent("Person", fullName="Customer 000000000"), ent("Person", fullName="Customer 000000001"), rules)
    assert M.matches(ent("Person", fullName="John Smith"), ent("Person", fullName="John Andrew Michael Peter Smith"), rules)
    assert M.matches(ent("Company", name="x", alias=["Acme"]), ent("Company", name="acme"), rules)
    assert not M.matches(ent("FinancialMetric", metricName="revenue", DateOrPeriod="2021"), ent("FinancialMetric", metricName="revenue", DateOrPeriod="2022"), rules)
    assert M.matches(ent("FinancialMetric", metricName="revenue", DateOrPeriod="2021"), ent("FinancialMetric", metricName="revenue", DateOrPeriod=[{"value": "2021", "source_doc_id": "d"}]), rules)
    assert not M.matches(ent("Company", name="acme"), ent("Shareholder", name="acme"), rules) and M.matches(ent("Company", name="acme"), ent("Shareholder", name="acme"), M.page_rules(same_type=False))
    assert M.strategy_rules().rule("company").aliases and not M.matches(ent("TransactionContext", contextName="deal", status="open"), ent("TransactionContext", contextName="deal"), M.strategy_rules())


def test_merged_values():
    m = ME.merged_value
    assert m("name", "ab", "abc") == "abc" and m("name", "abc", "xyz") == "abc" and m("amount", 0, 5) == 5 and m("amount", 3, 5) == 3
    assert m("l", [1, 2], [2, 3, 3]) == [1, 2, 3] and m("d", {"a": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3} and m("f", True, False) is False
    assert m("x", None, "v") == "v" and m("x", "v", " ") == "v" and m("x", "v", None) == "v"


def test_fold_ids_and_provenance():
    rows = [{"id": "e1", "type": "p:Company", "name": "Acme", "_at": 1}, {"id": "e1", "type": "p:Person", "fullName": "Ann Lee", "_at": 1}, {"id": "e9", "type": "p:Company", "name": "acme", "alias": ["AC"], "_at": 2}]
    kept, ids = ME.fold_entities([dict(r) for r in rows], M.page_rules())
    assert [k["id"] for k in kept] == ["e1", "e1_person_1"] and ids[(2, "e9")] == "e1" and kept[0]["alias"] == ["AC"] and kept[0]["_source_page"] == "1"
    kept, _ = ME.fold_entities([dict(r) for r in rows], M.project_rules(), lambda r: f"d{r['_at']}")
    assert kept[0]["_source_document_ids"] == ["d1", "d2"] and kept[0]["name"] == [{"value": "Acme", "source_doc_id": "d1"}, {"value": "acme", "source_doc_id": "d2"}] and kept[1]["id"] == "e1_projdup1"


def test_fold_equals_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"d{i % 3}", str(i // 10), i, f"e{i}", "p:Company", json.dumps({"name": rng.choice(["acme corp", "acme corp.", "zeta", "omega ltd"])})) for i in range(60)]
    schema = "doc string, page string, ord long, id string, type string, attrs_json string"
    df = spark.createDataFrame(rows, schema)
    whole = {r.doc: r["count"] for r in ME.merge_fold(df, "doc", M.page_rules()).groupBy("doc").count().collect()}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    query = fold_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.doc: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()} == whole


def test_provenance_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([("e", "k", "b", "d1", 1), ("e", "k", "a", "d2", 2), ("e", "k", "b", "d1", 3), ("e", "k", None, "d2", 4)], "entity string, key string, value string, doc string, ord long")
    row = ME.provenance(df, "entity").first()
    assert [(x.value, x.source_doc_id) for x in row["values"]] == [("b", "d1"), ("a", "d2"), (None, "d2")]
    assert spark.createDataFrame([(row["values"],)], "v array<struct<value:string,source_doc_id:string>>").select(V.preferred_value(F.col("v"), "d2")).first()[0] == "a"


def test_first_match_is_first(spark):
    new = spark.createDataFrame([("n", "red widget", 1)], "id string, name string, ord long")
    cand = spark.createDataFrame([("c2", "red widget", 2), ("c1", "red widgets", 1), ("c3", "blue", 0)], "id string, name string, ord long")
    got = M.fuzzy_first_match(new, cand, 0.9).first()
    assert (got.match_id, round(got.score, 4)) == ("c1", 0.9524)


TEXT = "\n".join(f"{i}. PART {chr(65 + i)}\n\n" + "This is a plain sentence about things. However, it goes on for a while. " * 12 for i in range(1, 7))


def test_chunks(spark):
    lines = TEXT.split("\n")
    third = len(lines) // 3
    pages = spark.createDataFrame([("d", p + 1, "\n".join(lines[p * third : (p + 1) * third if p < 2 else None])) for p in range(3)], "doc string, page int, text string")
    config = C.ChunkConfig(max_size=2000, min_size=300, overlap=150)
    rows = sorted(C.chunk_documents(pages, config).collect(), key=lambda r: r.id)
    assert rows and [r.id for r in rows] == [f"chunk_{i:03d}" for i in range(1, len(rows) + 1)]
    assert all(len(r.text) <= 2000 + 150 + 2 and 0 <= r.document_position <= 1 for r in rows) and all(len(r.text) >= 300 for r in rows[:-1])
    stats = C.chunk_statistics(C.chunk_documents(pages, config)).first()
    assert len(stats) == 8 and stats.total_chunks == len(rows)
    one = C.chunk_documents(pages.where("page = 1").withColumn("text", F.lit("short")), config).first()
    assert one.document_position == 0.0 and one.section_context == "Document Content" and one.chunk_type == "text"
    assert C.chunk_statistics(C.chunk_documents(pages.where("false"), config)).count() == 0


def test_sections(spark):
    pages = spark.createDataFrame([("d", 1, "nothing here."), ("d", 2, "INTRODUCTION\nText."), ("d", 3, "more.")], "doc string, page int, text string")
    assert [(r.title, r.start_page, r.end_page) for r in C.sections(pages).collect()] == [("INTRODUCTION", 2, 3)]
    assert len(C.sections(pages, lossless=True).collect()) == 2


def test_split_at_boundaries(spark):
    cut = lambda text, at, least: spark.createDataFrame([(text, at)], "t string, b array<int>").select(C.split_at_boundaries(F.col("t"), F.col("b"), least)).first()[0]
    assert cut("aaaa bbbb cc", [5, 10], 3) == ["aaaa", "bbbb cc"] and cut("aaaa b cccc", [5, 7], 3) == ["aaaa", "cccc"] and cut("aaaa", [], 3) == ["aaaa"]


def test_extraction(spark):
    pages = spark.createDataFrame([("d", 1, "Acme buys Zeta."), ("d", 2, "  ")], "doc string, page int, text string")
    graphs = X.extract_graphs(pages, "rules", X.extraction_prompt(F.col("text"), F.lit(""), F.lit("financial_teaser"), F.lit("Acme")))
    assert [(r.page, r.n_entities, r.n_relationships, r.error) for r in graphs.collect()] == [(1, 2, 1, None)]
    assert sorted(json.loads(r.attrs_json)["name"] for r in X.graph_entities(graphs).collect()) == ["Acme", "Zeta"] and X.graph_relations(graphs).count() == 1

    class Broken:
        def complete(self, prompt, temperature=0.1):
            raise TimeoutError("slow")

    X.register_client("broken", Broken)
    try:
        assert X.ask(pages.select("doc", F.col("text").alias("prompt")), "broken").where("error is not null").count() == 2
    finally:
        del X.CLIENTS["broken"]
    with pytest.raises(ValueError, match="no client"):
        X.client("none")


def test_clients_read_whole_texts(spark):
    names = [f"Name{c}{d}" for c in "abcdef" for d in "abcdef"]
    reply = json.loads(X.RuleClient().complete("TEXT:" + " ".join(names)).removeprefix("```json\n").removesuffix("\n```"))
    assert [e["name"] for e in reply["entities"]] == names and len(reply["relationships"]) == len(names) - 1
    first = [("1", "The Annual Report of 2024"), ("2", "Title"), ("3", "Nothing")]
    whole = [("1", "a company"), ("2", "Title\n" + "x " * 100 + "by the company."), ("3", "Nothing at all")]
    got = X.classify([spark.createDataFrame(x, "doc string, text string") for x in (first, whole)], "keywords", ["company", "report"])
    assert {r.doc: (r.category, r.step) for r in got.collect()} == {"1": ("report", 0), "2": ("company", 1), "3": (X.UNKNOWN_TYPE, 0)}


def test_replies(spark):
    df = spark.createDataFrame([('"Report"\nbecause',), ("a long contract here",), (None,), ("?",)], "r string")
    assert [r[0] for r in df.select(X.parse_category(F.col("r"), ["report", "contract"])).collect()] == ["report", "contract", "unknown_document_type", "unknown_document_type"]
    s = spark.createDataFrame([('```json\n{"summary": "s", "main_entity": "m"}\n```',), ("plain",)], "r string").select(X.parse_summary(F.col("r")).alias("s")).collect()
    assert [(r.s.summary, r.s.main_entity) for r in s] == [("s", "m"), ("plain", None)]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "y.txt").write_bytes(b"no")
    found = files.discover(spark, str(tmp_path))
    assert [(r.doc, r.page, r.text) for r in files.read_pages(found).orderBy("page").collect()] == [("x", 1, "one"), ("x", 2, "two")]
    files.write_text_pages(files.read_pages(found), f"{tmp_path}/pages")
    assert spark.read.text(f"{tmp_path}/pages").count() == 2
    e = spark.createDataFrame([("g", "b", "t", 2, None), ("g", "a", "t", 1, "n")], "doc string, id string, type string, ord long, name string")
    r = spark.createDataFrame([("g", "a", "b", "x", 1)], "doc string, source string, target string, type string, ord long")
    graph = files.graph_documents(e, r, "doc", ("name",))
    assert json.loads(graph.first()["value"]) == {"entities": [{"id": "a", "type": "t", "name": "n"}, {"id": "b", "type": "t"}], "relationships": [{"source": "a", "target": "b", "type": "x"}]}
    files.write_documents(graph, f"{tmp_path}/graphs", "doc")
    assert X.graph_entities(files.read_graphs(spark, f"{tmp_path}/graphs/*")).count() == 2
    files.write_records(spark.createDataFrame([("index2", "n.json", "{}")], "folder string, name string, body string"), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "index2" / "n.json").read_text() == "{}"
    assert files.first_of(spark, f"{tmp_path}/out/index2", ".json").first()["value"] == "{}"


def test_document_parts_are_the_whole_text(spark):
    e = spark.createDataFrame([("a", i, f"e{i}", "t", f"n{i}") for i in range(7)] + [("b", 0, "x", "t", None)], "doc string, ord long, id string, type string, name string")
    r = spark.createDataFrame([("a", i, f"e{i}", "e0", "r") for i in range(4)] + [("c", 0, "x", "e0", "r")], "doc string, ord long, source string, target string, type string")
    whole = {x.doc: x.value for x in files.graph_documents(e, r, "doc", ("name",)).collect()}
    parts = files.graph_document_parts(e, r, "doc", ("name",), part_rows=3).collect()
    assert {d: "".join(x.value for x in sorted((x for x in parts if x.doc == d), key=lambda x: x.part)) for d in whole} == whole
    assert sorted((x.doc, x.part) for x in parts) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 1), ("c", 1)]
    assert all(json.loads(x) for x in whole.values())


def test_meta_parts_are_the_whole_record(spark):
    from kgloom.operators import export

    nodes = spark.createDataFrame([(f"l{i % 3}", f"n{i}") for i in range(8)], "label string, id string")
    links = spark.createDataFrame([(f"t{i % 2}", f"k{i}") for i in range(5)], "type string, key string")
    head = (1, "m", "T", "p.json")
    whole = export.meta(nodes, links, *head).first()
    parts = sorted(export.meta_parts(nodes, links, *head, part_rows=4).collect(), key=lambda x: x.part)
    assert [x.part for x in parts] == [1, 2, 3, 4] and all(len(x.actor_references) + len(x.link_references) <= 4 for x in parts)
    assert [y for x in parts for y in x.actor_references] == whole.actor_references and [y for x in parts for y in x.link_references] == whole.link_references
    empty = export.meta_parts(nodes.where("false"), links.where("false"), *head).collect()
    assert [(x.part, x.actor_references, x.link_references) for x in empty] == [(1, [], [])]


def test_page(spark):
    e = spark.createDataFrame([("a", "p:Company", "</script>Acme", 1)], "id string, type string, name string, ord long")
    page = V.html_page(V.vis_nodes(e), V.vis_edges(e, spark.createDataFrame([], "source string, target string, type string, ord long")), "t")
    assert "<\\/script>Acme" in page


def test_fuzzy_match_tells_no_cases_apart(spark):
    """Against brute force over names in mixed case: no pair is lost by the bounds, and the first match wins."""
    rng = random.Random(7)
    base = ["Acme Corp", "acme corp", "Zeta Group", "Omega Holding AG", "Omega Holdings"]
    names = base + ["".join(rng.choice((c.upper(), c.lower(), c + "s")) for c in rng.choice(base)) for _ in range(60)]
    a = spark.createDataFrame([(f"a{i}", n, i) for i, n in enumerate(names)], "id string, name string, ord long")
    b = spark.createDataFrame([(f"b{i}", n, i) for i, n in enumerate(names[::-1])], "id string, name string, ord long")
    got = {r.id: r.match_id for r in M.fuzzy_first_match(a, b, 0.8).collect()}
    assert got == {f"a{i}": next(f"b{j}" for j, y in enumerate(names[::-1]) if ratio(x, y) >= 0.8 - 1e-12) for i, x in enumerate(names)}


def test_headers_by_position(spark):
    """Against the same patterns in Python: whole titles in the order of the text, and the last one opens a page's section."""
    text = "Opening\n1.2 Title Case here. more\nINTRODUCTION\nbody of words.\n2 Second part\nNext Heading\nlast line of text, no header\n"
    df = spark.createDataFrame([("d", 1, text), ("d", 2, "no header, here"), ("d", 3, "CLOSING WORDS\n3. Three! x")], "doc string, page int, text string")
    for r in df.select("text", C.header_titles(F.col("text")).alias("all"), C.last_header(F.col("text")).alias("last")).collect():
        found = sorted((m.start(), n, m.group().strip()) for n, p in enumerate(C.HEADERS, 1) for m in re.finditer(p, r.text, re.MULTILINE))
        assert [(h.level, h.title) for h in r["all"]] == [(n, t) for _, n, t in found]
        assert (r["last"] and (r["last"].level, r["last"].title)) == (found[-1][1:] if found else None)
    assert [(r.title, r.start_page, r.end_page) for r in C.sections(df).orderBy("start_page").collect()][0][1:] == (1, 2)
