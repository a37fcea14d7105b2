import json

import pytest
from pyspark.sql import functions as F

from kgloom.__main__ import main, parser
from kgloom.plans.ontology_demo import ONTOLOGY
from kgloom.functions.text import attribute_text
from kgloom.operators.clients import Blocked, ChatClient, PartsClient, from_data_url
from kgloom.operators.export import nodes
from kgloom.operators.extract import classify, first_pages_text, register_client, toc_text
from kgloom.operators.match import project_rules
from kgloom.operators.merge import fold_entities
from kgloom.operators.ontology import Ontology
from kgloom.plans.project import Project, document_graphs, page_graphs, project_graph, run
from kgloom.sources import files
from kgloom.sources.files import first_images


@pytest.mark.parametrize("units", ["pages", "chunks"])
def test_project(spark, tmp_path, units):
    pages = spark.createDataFrame([("d1", 1, "Acme buys Zeta."), ("d1", 2, "Acme sells."), ("d2", 1, "Zeta pays Acme."), ("d3", 1, " ")], "doc string, page int, text string")
    got = run(spark, pages, str(tmp_path / "out"), Project(ontology=ONTOLOGY, units=units))
    ents = {json.loads(r.attrs_json)["name"][0]["value"]: json.loads(r.attrs_json) for r in got["entities"].collect()}
    assert set(ents) == {"Acme", "Zeta"} and sorted(ents["Acme"]["_source_document_ids"]) == ["d1", "d2"]
    assert sorted((r.type, sorted(r.docs)) for r in got["relations"].collect()) == [("kg:mentionedWith", ["d1"]), ("kg:mentionedWith", ["d2"])]
    assert got["score"].first().score > 0
    assert spark.read.json(f"{tmp_path}/out/entities").count() == 2 and "Acme" in spark.read.text(f"{tmp_path}/out/page", wholetext=True).first()[0]


def page_of(*entities, relations=()):
    return json.dumps({"entities": [dict(zip(("id", "type", field), (i, f"kg:{t}", v), strict=True)) for i, t, field, v in entities], "relationships": [dict(zip(("source", "target", "type"), r, strict=True)) for r in relations]})


def test_relations_follow_merged_entities(spark):
    """Ends keep their relation where a variant of a name wins and where a type isn't named by ``name``; all is renumbered."""

    class PeopleClient:
        """Each page's graph stands in its text."""

        def complete(self, prompt, temperature=0.1):
            text = prompt.rsplit("TEXT:", 1)[-1].strip()
            return text[text.find("{") : text.rfind("}") + 1]

    register_client("people", PeopleClient)
    pages = [
        ("d1", 1, page_of(("a", "Company", "name", "Acme Holding"), ("p", "Person", "fullName", "Ann Lee"), relations=[("a", "p", "kg:employs"), ("a", "zz", "kg:employs")])),
        ("d1", 2, page_of(("a", "Company", "name", "Acme Holdings"), ("b", "Person", "fullName", "Bob Ray"), relations=[("a", "b", "kg:employs"), ("a", "b", "kg:employs")])),
        ("d2", 1, page_of(("x", "Company", "name", "ACME Holdings"), ("y", "Person", "fullName", "Ann Lee"), ("z", "Company", "name", "Zeta"), relations=[("x", "y", "kg:employs"), ("z", "x", "kg:owns")])),
    ]
    graphs = page_graphs(spark.createDataFrame(pages, "doc string, page int, text string"), Project(client="people"))
    merged, rels = document_graphs(graphs, Project(client="people"))
    assert sorted((r.doc, r.id) for r in merged.collect()) == [("d1", "e1"), ("d1", "e2"), ("d1", "e3"), ("d2", "e1"), ("d2", "e2"), ("d2", "e3")]
    assert sorted((r.doc, r.source, r.target) for r in rels.collect()) == [("d1", "e1", "e2"), ("d1", "e1", "e3"), ("d2", "e1", "e2"), ("d2", "e3", "e1")]
    ents, links = project_graph(merged, rels)
    name = {r.id: next(v[0]["value"] for k, v in json.loads(r.attrs_json).items() if k in ("name", "fullName")) for r in ents.collect()}
    assert name == {"e1": "Acme Holdings", "e2": "Ann Lee", "e3": "Bob Ray", "e4": "Zeta"}
    assert sorted((name[r.source], name[r.target], r.type, list(r.docs)) for r in links.collect()) == [
        ("Acme Holdings", "Ann Lee", "kg:employs", ["d1", "d2"]), ("Acme Holdings", "Bob Ray", "kg:employs", ["d1"]), ("Zeta", "Acme Holdings", "kg:owns", ["d2"]),
    ]


def test_project_graph_against_one_fold(spark):
    """Types folded side by side give what one fold over everything gives."""
    names = ["Acme Holding", "Acme Holdings", "ACME HOLDING", "Zeta", "Zetta", "Omega One", "Omega", "Omega Two"]
    rows = [(f"d{i % 5}", i, f"e{i}", f"kg:{'Company' if i % 3 else 'Location'}", 1, json.dumps({"name": names[i * 7 % 8]})) for i in range(60)]
    merged = spark.createDataFrame(rows, "doc string, ord long, id string, type string, n long, attrs_json string")
    ents, _ = project_graph(merged, spark.createDataFrame([], "doc string, ord long, source string, target string, type string"))
    ordered = [{**json.loads(r[5]), "id": r[2], "type": r[3], "_at": r[0]} for r in sorted(rows, key=lambda r: (r[0], r[1]))]
    kept, _ = fold_entities(ordered, project_rules(), lambda row: row["_at"])
    want = [{k: v for k, v in e.items() if k not in ("id", "_n")} for e in kept]
    got = [{**json.loads(r.attrs_json), "type": r.type} for r in ents.orderBy("ord").collect()]
    assert got == want and len(want) > 4


def test_documents_added_to_a_stored_project(spark, tmp_path):
    """Documents added later give what all at once gives: entities, values, and relations with their documents."""
    pages = [(f"d{i}", 1, t) for i, t in enumerate(["Acme buys Zeta.", "Zeta pays Omega.", "Acme sells Zeta.", "Omega buys Alpha."])]
    frame = lambda rows: spark.createDataFrame(rows, "doc string, page int, text string")
    whole = run(spark, frame(pages), str(tmp_path / "all"))
    first = run(spark, frame(pages[:2]), str(tmp_path / "first"))
    schema = {k: first[k].schema for k in ("entities", "relations")}
    base = tuple(spark.read.schema(schema[k]).json(f"{tmp_path}/first/{k}") for k in ("entities", "relations"))
    got = run(spark, frame(pages[2:]), str(tmp_path / "more"), base=base)
    for k in ("entities", "relations"):
        assert sorted(map(str, got[k].collect())) == sorted(map(str, whole[k].select(*got[k].columns).collect())) and got[k].count() >= 3


def test_rules_are_checked():
    with pytest.raises(ValueError, match="threshold or strategy"):
        Project(rules="no").page_rules()
    with pytest.raises(ValueError, match="parallel or iterative"):
        Project(construction="no")


def test_hooks_cascade_and_images(spark, tmp_path):
    """The category comes from the contents, else the pages, else the images; images go with their pages; report, export and dumps are written."""

    class SeeingClient:
        """Names the kind that it sees; an image's bytes are a name."""

        def complete(self, prompt, temperature=0.1, images=()):
            text = prompt.rsplit("TEXT:", 1)[-1]
            if "Categories:" in prompt:
                return "contract" if "Terms" in text else "report" if images else "no idea"
            if "Summarise" in prompt:
                return '{"summary": "s", "main_entity": "Acme"}'
            names = [w for w in ("Acme", "Zeta") if w in text] + [i.decode() for i in images]
            return json.dumps({"entities": [{"id": n, "type": "kg:Company", "name": n, "tags": ["x", "y"]} for n in names], "relationships": []})

    register_client("seeing", SeeingClient)
    pages = spark.createDataFrame([("d1", 1, "Acme"), ("d1", 2, "Zeta"), ("d2", 1, ""), ("d2", 2, "Acme")], "doc string, page int, text string")
    contents = spark.createDataFrame([("d1", 1, 1, "Terms", 1)], "doc string, ord int, level int, title string, page int")
    images = spark.createDataFrame([("d2", 1, bytearray(b"Logo"))], "doc string, page int, image binary")
    project = Project(client="seeing", diagnostics=True, export=True, dumps=True, model="a/b:c")
    got = run(spark, pages, str(tmp_path / "o"), project, contents=contents, images=images)
    names = {json.loads(r.attrs_json)["name"][0]["value"] for r in got["entities"].collect()}
    assert names == {"Acme", "Zeta", "Logo"}
    report = {(r.section, r.line) for r in got["report"].collect()}
    assert ("1 total", "4 -> 3") in report and ("2 types", "company: 4 -> 3") in report
    base = tmp_path / "o" / "export" / "project_a_b_c_local_parallel"
    nodes = json.loads((base.parent / f"{base.name}_nodes.json").read_text())
    assert sorted(n["label"] for n in nodes) == ["Acme", "Logo", "Zeta"] and json.loads((base.parent / f"{base.name}_links.json").read_text()) == []
    assert len(json.loads((base.parent / f"{base.name}_meta.json").read_text())[0]["actor_references"]) == 3
    assert (tmp_path / "o" / "units" / "doc=d1" / "page=2").exists()
    page = got["comparison"].first().value
    assert "several documents" in page and "d2</li>" in page and "from d1, d2" in got["page"].first().value
    steps = classify([toc_text(contents), first_pages_text(pages), first_images(images).withColumn("text", F.lit(""))], "seeing", ["contract", "report"])
    assert {(r.doc, r.category, r.step) for r in steps.collect()} == {("d1", "contract", 0), ("d2", "report", 2)}


def test_iterative_construction(spark):
    """A client that answers for its own page: prompts hold the graph so far, nothing of earlier pages is lost, and a failed page changes nothing."""

    class OwnPageClient:
        def complete(self, prompt, temperature=0.1, images=()):
            if "Extract" not in prompt:
                return None
            if "broken" in prompt:
                raise RuntimeError("no")
            head, text = prompt.rsplit("TEXT:", 1)
            before = json.loads(head.split("Graph so far: ")[1].split("\n")[0])["entities"] if "Graph so far" in head else []
            seen = ",".join(f"{e['id']}={e['name']}" for e in before)
            own = {"id": f"i{text}", "type": "kg:Company", "name": text.strip() or "pictured", "seen": seen, "images": len(images)}
            # The page's entity is tied to the first of the graph so far, which the reply doesn't repeat.
            rels = [{"source": own["id"], "target": before[0]["id"], "type": "kg:after"}] if before else []
            return "```json\n" + json.dumps({"entities": [own, "no object", {"id": "y"}], "relationships": [*rels, {"source": own["id"], "target": "nobody", "type": "kg:after"}]}) + "\n```"

    register_client("own page", OwnPageClient)
    rows = [("d1", 10, "Gamma"), ("d1", 2, "Alpha"), ("d1", 3, "Beta"), ("d1", 11, "broken"), ("d1", 12, " "), ("d1", 3, "Beta again"), ("d2", 1, "Omega"), ("d3", 1, "Alpha"), ("d3", 2, "alpha")]
    pages = spark.createDataFrame(rows, "doc string, page int, text string")
    images = spark.createDataFrame([("d1", 3, b"png"), ("d1", 12, b"png")], "doc string, page int, image binary")
    project = Project(client="own page", construction="iterative")
    for given, pictured in ((None, []), (images, [("d1", "pictured", "iAlpha=Alpha,iBeta=Beta,iGamma=Gamma", 1)])):
        graphs = page_graphs(pages, project, images=given)
        got = {(r.doc, r.page, r.error) for r in graphs.collect()}
        assert got - {("d1", 12, None)} == {("d1", 2, None), ("d1", 3, None), ("d1", 10, None), ("d1", 11, "RuntimeError: no"), ("d2", 1, None), ("d3", 1, None), ("d3", 2, None)} and len(got) == 7 + len(pictured)
        merged, rels = document_graphs(graphs, project)
        found = [(r.doc, r.id, json.loads(r.attrs_json)) for r in merged.collect()]
        assert sorted((d, e["name"], e["seen"], e["images"]) for d, _, e in found) == sorted(
            [("d1", "Alpha", "", 0), ("d1", "Beta", "iAlpha=Alpha", int(given is not None)), ("d1", "Gamma", "iAlpha=Alpha,iBeta=Beta", 0), ("d2", "Omega", "", 0), ("d3", "Alpha", "iAlpha=Alpha", 0), *pictured]
        )
        name = {(d, i): e["name"] for d, i, e in found}
        assert sorted((name[r.doc, r.source], name[r.doc, r.target]) for r in rels.collect()) == sorted([("Beta", "Alpha"), ("Gamma", "Alpha"), ("Alpha", "Alpha"), *((n, "Alpha") for _, n, *_ in pictured)])


def test_dense_graphs_and_document_files(spark, tmp_path):
    """A graph with too many relations to draw fails nothing, and each document's graph is written."""

    class DenseClient:
        def complete(self, prompt, temperature=0.1):
            names = ["Alpha}", "Beta", "Gamma"]
            ents = [{"id": f"{n}", "type": "kg:Company", "name": n, "n": [i]} for i, n in enumerate(names)]
            return json.dumps({"entities": ents, "relationships": [{"source": a, "target": b, "type": f"kg:t{i}"} for a in names for b in names for i in range(4)]}) if "Extract" in prompt else None

    register_client("dense", DenseClient)
    pages = spark.createDataFrame([("d1", 1, "x"), ("d2", 1, "y")], "doc string, page int, text string")
    got = run(spark, pages, str(tmp_path / "out"), Project(client="dense"), page_limit=3)
    assert got["relations"].count() == 36 and "page" not in got and not (tmp_path / "out" / "page").exists()
    for doc in ("d1", "d2"):
        lines = [json.loads(x) for f in sorted((tmp_path / "out" / "documents" / f"doc={doc}").glob("*.txt")) for x in f.read_text().splitlines()]
        assert sum("relationship" in x for x in lines) == 36
        ents = [x["entity"] for x in lines if "entity" in x]
        assert [(e["id"], e["name"], e["n"]) for e in ents] == [("e1", "Alpha}", [0]), ("e2", "Beta", [1]), ("e3", "Gamma", [2])]
    assert "page" in run(spark, pages, str(tmp_path / "again"), Project(client="dense"), page_limit=4)


def test_relations_to_later_pages_are_left_out(spark):
    """An end that its page doesn't have is an id of the pages up to it, in parallel construction as well."""
    rows = [("d", p, json.dumps({"entities": [{"id": f"i{p}", "type": "kg:Company", "name": "abc"[p - 1] * 9}], "relationships": [{"source": f"i{p}", "target": f"i{q}", "type": "t"} for q in (1, 2, 3)]})) for p in (1, 2, 3)]
    merged, rels = document_graphs(spark.createDataFrame(rows, "doc string, page int, graph_json string"), Project())
    assert merged.count() == 3 and sorted((r.source, r.target) for r in rels.collect()) == [("e1", "e1"), ("e2", "e1"), ("e2", "e2"), ("e3", "e1"), ("e3", "e2"), ("e3", "e3")]


def test_stream_of_pages(spark, tmp_path):
    """Late and repeated pages, state between batches, and a client's prompts with the graph so far."""
    from kgloom.operators.extract import PREVIOUS
    from kgloom.streaming.fold import fold_stream, use_map_states

    class Echo:
        def complete(self, prompt, temperature=0.1):
            before, text = prompt.split("TEXT:")
            return json.dumps({"entities": [{"id": "x", "type": "kg:Company", "name": text, "before": before.count('"id"')}]})

    register_client("echo", Echo)
    use_map_states(spark)
    source = tmp_path / "in"
    batches = [[("d1", 1, "Alpha"), ("d1", 3, "Gamma"), ("d2", 1, "Omega")], [("d1", 2, "Beta"), ("d1", 3, "Gamma changed")], [("d1", 4, "Alpha"), ("d2", 2, "")]]
    for batch in batches:
        rows = [(d, p, f"Graph so far: {PREVIOUS}\nTEXT:{t}" if t else "") for d, p, t in batch]
        spark.createDataFrame(rows, "doc string, page int, body string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("doc string, page int, body string").parquet(str(source))
        fold_stream(stream, client="echo").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    shown = sorted((r.doc, r.version, r.page, r.late, r.place, r.id, r.n, r.attrs_json and json.loads(r.attrs_json)["name"], r.attrs_json and json.loads(r.attrs_json)["before"]) for r in got)
    assert shown == [
        ("d1", 1, 1, False, 0, "x", 1, "Alpha", 0), ("d1", 2, 3, False, 1, "x_company_1", 1, "Gamma", 1), ("d1", 3, 2, True, 2, "x_company_2", 1, "Beta", 2), ("d1", 4, 4, False, 0, "x", 2, "Alpha", 0),
        ("d2", 1, 1, False, 0, "x", 1, "Omega", 0), ("d2", 2, 2, False, None, None, None, None, None),
    ]


def test_clients_of_services():
    sent = []
    chat = ChatClient(lambda m, t: sent.append(m) or "{}", json_mode=True)
    assert chat.complete("hi", images=[b"png"]) == "{}" and [m["role"] for m in sent[0]] == ["system", "user"]
    assert chat.chat([{"role": "system", "content": "old"}, {"role": "user", "content": "x"}]) == "{}" and "JSON" in sent[1][0]["content"] and len(sent[1]) == 2
    parts = PartsClient(lambda p, t, mime: repr((p, mime)), json_mode=True)
    assert parts.complete("hi", images=[b"png"]) == repr((["hi", ("image/png", b"png")], "application/json"))

    def refuse(*_):
        raise Blocked

    assert PartsClient(refuse).complete("hi") == ""
    with pytest.raises(ValueError, match="data URL"):
        from_data_url("https://example.org/x.png")


def test_rendered_pages(spark, tmp_path):
    with pytest.raises(ValueError, match="PDF"):
        files.text_pages(b"%PDF-1.7 ...")
    docs = spark.createDataFrame([("a", "p/a", bytearray(b"x|y")), ("b", "p/b", bytearray(b"z"))], "doc string, path string, content binary")
    images = files.render_pages(docs, lambda content, dpi: [(p, dpi, 2) for p in content.split(b"|")], 100)
    assert [tuple(r) for r in images.orderBy("doc", "page").collect()] == [("a", 1, b"x", 100, 2), ("a", 2, b"y", 100, 2), ("b", 1, b"z", 100, 2)]
    assert {tuple(r) for r in files.page_image(docs, images, 2).collect()} == {("a", "eQ=="), ("b", None)}
    assert {r.doc: [bytes(i) for i in r.images] for r in files.first_images(images, 2).collect()} == {"a": [b"x", b"y"], "b": [b"z"]}
    files.write_records(files.split_files(docs, lambda content: content.split(b"|")), files.url(str(tmp_path / "out")))
    assert (tmp_path / "out" / "a" / "page_2.pdf").read_bytes() == b"y"
    pages = spark.createDataFrame([("a", 2, "u"), ("a", 1, "t")], "doc string, page int, text string")
    assert files.page_texts(pages).first().texts == ["t", "u"]


def test_attributes_as_text(spark):
    df = spark.createDataFrame([(["a", "b"], [], {"k": "v"}, [("v1", "d")], 5)], "l array<string>, e array<string>, m map<string,string>, p array<struct<value:string,source_doc_id:string>>, n int")
    assert tuple(df.select(*[attribute_text(df, c).alias(c) for c in df.columns]).first()) == ("a, b", None, None, "v1", "5")
    onto = Ontology.from_dict({"entities": [{"kg:Company": {"category": "actor"}}]})
    ents = spark.createDataFrame([("e1", "kg:Company", "Acme", 1), ("e2", "kg:LegalEntity", "B", 2)], "id string, type string, name string, ord int")
    assert {r.label: r.category for r in nodes(ents, ("name",), 1, "f", "t", categories=onto.categories).collect()} == {"Acme": "actor", "B": "legal_entity"}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Acme buys Zeta.\fOmega waits.")
    main(["build", str(tmp_path / "in"), str(tmp_path / "out")])
    assert spark.read.json(f"{tmp_path}/out/entities").count() == 3
    main(["query", "onto_attributes", "/root/testdata/sf0.001", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 9
    main(["export", str(tmp_path / "e")])
    assert sorted(n["label"] for n in json.loads((tmp_path / "e" / "project_rules_local_parallel_nodes.json").read_text())) == ["Acme", "Ann Lee"]
    with pytest.raises(SystemExit):
        parser().parse_args(["build"])
