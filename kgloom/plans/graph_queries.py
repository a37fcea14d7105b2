"""Queries over the star graph: cleaning, ontology, metrics, merging, diagnostics, export and drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import display_name, normalize_text, unprefixed
from kgloom.operators import diagnose as D
from kgloom.operators import evaluate as E
from kgloom.operators import export as X
from kgloom.operators import extract as EX
from kgloom.operators import graph as G
from kgloom.operators import match as M
from kgloom.operators import merge as ME
from kgloom.operators import ontology as O
from kgloom.operators import viz as V
from kgloom.operators.overlap import scored_pairs
from kgloom.operators.settle import merged_across, merged_into
from kgloom.plans import star
from kgloom.plans.ontology_demo import ONTOLOGY
from kgloom.plans.ontology_demo import SQL as ONTO_SQL
from kgloom.plans.project import Project, document_graphs
from kgloom.sources.files import graph_document_parts, split_pages
from kgloom.sources.scratch import materialize, scratch_path
from kgloom.sources.tables import table
from kgloom.streaming.fold import fold_stream, use_map_states

ATTRS = star.ATTRIBUTES


def _ent(spark, sf):
    return star.entities(spark, sf)


def _rel(spark, sf):
    return star.relations(spark, sf)


def attributes(entities: DataFrame) -> DataFrame:
    """``(id, type, key, value, doc, ord)``: attributes that aren't null, in rows; types unprefixed."""
    pairs = F.array(*[F.struct(F.lit(a).alias("key"), F.col(a).cast("string").alias("value")) for a in ATTRS if a in entities.columns])
    rows = entities.select("id", O.bare_type("type").alias("type"), "doc", "ord", F.explode(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("p"))
    return rows.select("id", "type", "p.key", "p.value", "doc", "ord")


def kg_clean(spark, sf):
    return G.clean_relations(_ent(spark, sf), _rel(spark, sf)).select("source", "target", "type", "ord")


def kg_renumber(spark, sf):
    e, r = _ent(spark, sf).select("id", "type", "ord"), _rel(spark, sf).select("source", "target", "type", "ord")
    # Relations without both ends are dropped where ends get their new ids.
    return G.renumber(e, G.once(r))[1].select("source", "target", "type")


def kg_renumber_entities(spark, sf):
    return G.renumber(_ent(spark, sf), _rel(spark, sf))[0].select("id", "old_id", "type")


def kg_type_distribution(spark, sf):
    e, r = _ent(spark, sf), _rel(spark, sf)
    return G.type_distribution(G.renumber(e, G.clean_relations(e, r))[0])


def unique_ids(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("b"), F.col("p_brand")).alias("base"), F.lit("part").alias("kind"))
    return G.unique_ids(p, "base", F.col("kind")).select("ord", "unique_id")


def onto_invalid_entities(spark, sf):
    return O.invalid_entities(_ent(spark, sf), ONTOLOGY.frames(spark))


def onto_invalid_relations(spark, sf):
    return O.invalid_relations(_rel(spark, sf), ONTOLOGY.frames(spark))


def onto_missing_types(spark, sf):
    return O.missing_types(_ent(spark, sf), _rel(spark, sf), ONTOLOGY.frames(spark))


def onto_constraints(spark, sf):
    """The declared ends of every relation type that the graph uses, empty for undeclared ones, and how many relations have it."""
    f = ONTOLOGY.frames(spark)
    lists = [f[side].groupBy("relation").agg(F.array_join(F.array_sort(F.collect_list("type")), "|").alias(side)) for side in ("domain", "range")]
    used = _rel(spark, sf).groupBy(O.bare_type("type").alias("relation")).agg(F.count("*").alias("n"))
    rows = used.join(F.broadcast(lists[0]), "relation", "left").join(F.broadcast(lists[1]), "relation", "left")
    return rows.select("relation", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("range", F.lit("")).alias("range"), "n")


def onto_attributes(spark, sf):
    """Every declared attribute of the graph's entity types, and how many entities have it."""
    declared = ONTOLOGY.frames(spark)["attribute"].select(F.col("entity").alias("type"), "attr", F.col("type").alias("value_type"))
    ents = _ent(spark, sf)
    found = attributes(ents).groupBy("type", F.col("key").alias("attr")).agg(F.countDistinct("id").alias("n"))
    used = ents.select(O.bare_type("type").alias("type")).distinct()
    return used.join(F.broadcast(declared), "type").join(found, ["type", "attr"], "left").select("type", "attr", "value_type", F.coalesce("n", F.lit(0)).alias("n"))


def _graph(spark, sf):
    return E.simple_graph(_ent(spark, sf), _rel(spark, sf))


def graph_basic_metrics(spark, sf):
    b = E.basic_metrics(*_graph(spark, sf))
    return b.select("nodes", "edges", F.round("density", 9).alias("density"), F.round("avg_degree", 6).alias("avg_degree"), F.round("isolated_ratio", 6).alias("isolated_ratio"))


def graph_wcc(spark, sf):
    return E.weak_components(*_graph(spark, sf))


def graph_diameter(spark, sf):
    return E.diameter(_graph(spark, sf)[0], _rel(spark, sf))  # pairs are made distinct there


def graph_node_types(spark, sf):
    v, _ = _graph(spark, sf)
    return v.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def relation_distribution(spark, sf):
    return E.relation_distribution(_graph(spark, sf)[1]).select("type", "n", F.round("share", 6).alias("share"))


def compliance(spark, sf):
    v, e = (materialize(x, "graph") for x in _graph(spark, sf))  # each is read several times
    c = E.compliance(v, e, attributes(_ent(spark, sf)), ONTOLOGY.frames(spark))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


def domain_range_violations(spark, sf):
    v, e = _graph(spark, sf)
    return E.compliance_parts(v, e, attributes(_ent(spark, sf)), ONTOLOGY.frames(spark))["ends"].where("not ok").select("source", "target", "type")


def attribute_completeness(spark, sf):
    v, _ = _graph(spark, sf)
    return E.attribute_completeness(v, attributes(_ent(spark, sf)), ONTOLOGY.frames(spark)).select(F.round("completeness", 6).alias("completeness"))


def company_metrics(spark, sf):
    v, e = _graph(spark, sf)
    return E.company_metrics(v, e, attributes(_ent(spark, sf))).select("financial_available", F.round("avg_company_relations", 6).alias("avg_company_relations"))


def entity_coverage(spark, sf):
    return E.entity_coverage(_graph(spark, sf)[0], ONTOLOGY.frames(spark))


def overall_score(spark, sf):
    e, r = _ent(spark, sf), _rel(spark, sf)
    s = E.evaluate(e, r, attributes(e), ONTOLOGY.frames(spark))["score"]
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _parts(spark, sf) -> DataFrame:
    """Parts as entities of pages, a page for each brand."""
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("kg:ProductOrService").alias("type"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("page"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_retailprice").alias("amount"), (F.col("p_size") % 3).cast("string").alias("fiscalPeriod"))


def _merged(spark, sf) -> DataFrame:
    return ME.merge_exact(_parts(spark, sf), [F.col("type"), normalize_text(F.col("name"))], ["type", "name", "kind", "amount", "fiscalPeriod"])


def merge_exact_parts(spark, sf):
    return _merged(spark, sf).select("id", "first_ord", "n", "type", "name", "kind", "amount")


def merge_relations(spark, sf):
    """Offers moved to the parts that others of their name became."""
    p = _parts(spark, sf)
    merged = G.first_by(p.select(normalize_text(F.col("name")).alias("k"), F.col("id").alias("new_id"), "ord"), ["k"])
    ids = p.select("id", normalize_text(F.col("name")).alias("k")).join(merged, "k").select("id", "new_id")
    r = _rel(spark, sf).where("type = 'kg:offersProduct'")
    return ME.merge_relations(r, ids, _ent(spark, sf)).select("source", "target", "type")


def merge_statistics(spark, sf):
    p = _parts(spark, sf)
    return ME.merge_statistics(p, normalize_text(F.col("name")), {k: s for k, (s, _) in M.STRATEGIES.items()})


def match_strategies(spark, sf):
    """The strategy and threshold that each type of the graph is merged by, and how many entities it has."""
    known = spark.createDataFrame([(k, s, t) for k, (s, t) in M.STRATEGIES.items()], "type string, strategy string, threshold double")
    kinds = _ent(spark, sf).groupBy(unprefixed(F.col("type")).alias("type")).agg(F.count("*").alias("n"))
    return kinds.join(F.broadcast(known), "type", "left").select("type", F.coalesce("strategy", F.lit("moderate")).alias("strategy"), F.coalesce("threshold", F.lit(0.75)).alias("threshold"), "n")


def provenance_attributes(spark, sf):
    """Attributes of parts that share a name, by brand as the document."""
    p = _parts(spark, sf)
    long = p.select(normalize_text(F.col("name")).alias("entity"), F.col("page").alias("doc"), "ord", F.explode(F.create_map(F.lit("kind"), "kind", F.lit("fiscalPeriod"), "fiscalPeriod")).alias("key", "value"))
    out = ME.provenance(long, "entity")
    return out.select("entity", "key", F.array_join(F.transform("values", lambda x: F.concat(x["value"], F.lit("@"), x["source_doc_id"])), ";").alias("value_list"))


def provenance_relations(spark, sf):
    return ME.relation_documents(_rel(spark, sf)).select("source", "target", "type", F.array_join("docs", ",").alias("docs"))


def metric_company_lookup(spark, sf):
    return M.metric_company(_rel(spark, sf), _ent(spark, sf))


def match_person_tokens(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return M.person_token_match(p, p)


def fuzzy_match_first(spark, sf):
    p = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return M.fuzzy_first_match(p, p, 0.8).select("id", "match_id", F.round("score", 6).alias("score"))


def similar_names(spark, sf):
    """Pairs of similar names of customers, suppliers and parts."""
    names = table(spark, sf, "customer").select(F.col("c_name").alias("a")).union(table(spark, sf, "supplier").select("s_name")).union(table(spark, sf, "part").select("p_name"))
    return scored_pairs(names, 0.9).select("a", "b", F.round("score", 6).alias("score"))


def merge_star_project(spark, sf):
    """The whole star graph as one project, whose three parts are its documents: merged entities with provenance."""
    rows = _ent(spark, sf).select(F.lit("star").alias("project"), "ord", "doc", "id", "type", F.to_json(F.struct(*ATTRS)).alias("attrs_json"))
    kept, _ = merged_across(rows, "project", M.project_rules(), "doc", documents=True)
    return kept.select("ord", "id", "type", "n", "attrs_json")


def merge_sales_later(spark, sf):
    """The star graph's other documents as a stored project graph, into which its sales are merged later: merged entities, and whether the sales touched them."""
    rows = _ent(spark, sf).select(F.lit("star").alias("project"), "ord", "doc", "id", "type", F.to_json(F.struct(*ATTRS)).alias("attrs_json"))
    base, _ = merged_across(rows.where("doc <> 'sales'"), "project", M.project_rules(), "doc", documents=True)
    kept, _ = merged_into(base, rows.where("doc = 'sales'"), "project", M.project_rules(), "doc")
    return kept.select("ord", "id", "type", "n", "attrs_json", "touched")


def _json_parts(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    body = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("amount")))
    return p.select(F.col("p_brand").alias("doc"), F.col("p_size").alias("page"), F.col("p_partkey").alias("ord"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("kg:ProductOrService").alias("type"), body.alias("attrs_json"))


def merge_fuzzy_fold(spark, sf):
    return ME.merge_fold(_json_parts(spark, sf), "doc", M.page_rules())


def merge_strategy_fold(spark, sf):
    return ME.merge_fold(_json_parts(spark, sf), "doc", M.strategy_rules())


def merge_project_fold(spark, sf):
    """Parts of each size as a project, brands as its documents."""
    p = _json_parts(spark, sf).withColumn("project", F.col("page").cast("string"))
    return ME.merge_documents_fold(p, "project", M.project_rules())


def _unit_graphs(spark, sf) -> DataFrame:
    """``(doc, page, body)``: the parts of each brand and size as the graph of a page."""
    one = F.to_json(F.struct(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("kg:ProductOrService").alias("type"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").alias("amount")))
    p = table(spark, sf, "part").select(F.col("p_brand").alias("doc"), F.col("p_size").cast("int").alias("page"), F.col("p_partkey").alias("ord"), one.alias("one"))
    return p.groupBy("doc", "page").agg(F.concat(F.lit('{"entities": ['), EX.ordered_text("ord", "one", ","), F.lit("]}")).alias("body"))


def stream_fold(spark, sf):
    """The same parts as a stream of page graphs: the graph of each document in the end."""
    rows = _unit_graphs(spark, sf)
    source, sink, state = (scratch_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    rows.write.parquet(source)
    use_map_states(spark)
    pages = spark.readStream.schema(rows.schema).parquet(source)
    fold_stream(pages).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return G.last_by(spark.read.parquet(sink).where("place is not null"), ["doc", "place"], "version").select("doc", "place", "id", "n", "attrs_json")


def iterative_construction(spark, sf):
    """Graphs of all documents, each line's prompt holding the graph of the lines before: merged entities, and how many relations each is the source of."""
    pages = split_pages(table(spark, sf, "documents"), "doc_id", "text")
    none = F.lit("")
    prompt = EX.extraction_prompt(F.col("text"), none, none, none, F.lit(EX.PREVIOUS))
    ents, rels = document_graphs(EX.iterative_graphs(pages, "rules", prompt), Project(construction="iterative"))
    degree = rels.groupBy("doc", F.col("source").alias("id")).agg(F.count("*").alias("relations"))
    name = F.get_json_object("attrs_json", "$.name").alias("name")
    return ents.join(degree, ["doc", "id"], "left").select("doc", "id", name, "n", F.coalesce("relations", F.lit(0)).alias("relations"))


def _before_after(spark, sf) -> tuple[DataFrame, DataFrame]:
    before = _parts(spark, sf)
    after = _merged(spark, sf).where("first_ord % 7 <> 0").select("id", "type", F.col("first_ord").alias("ord"), "name")
    return before, after


def diag_summary(spark, sf):
    return D.summary(*_before_after(spark, sf))


def diag_by_type(spark, sf):
    return D.by_type(*_before_after(spark, sf))


def diag_patterns(spark, sf):
    return D.merge_patterns(*_before_after(spark, sf))


def diag_unexpected(spark, sf):
    return D.unexpected_merges(*_before_after(spark, sf))


def diag_lost(spark, sf):
    return D.lost_entities(*_before_after(spark, sf))


def diag_recommendations(spark, sf):
    b, a = _before_after(spark, sf)
    return D.recommendations(D.summary(b, a), D.by_type(b, a), D.unexpected_merges(b, a))


def diag_report(spark, sf):
    return D.report(*_before_after(spark, sf))


def diag_key_details(spark, sf):
    b = _parts(spark, sf)
    return b.select("id", F.array_join(F.array_sort(F.map_keys(D.key_details(b))), ",").alias("details"))


def export_nodes(spark, sf):
    n = X.nodes(_ent(spark, sf), ATTRS, 1, "meta1", "Star")
    return n.select("request_id", "id", "label", "category", "description", F.col("sources")[0]["FileName"].alias("file_name"))


def export_links(spark, sf):
    k = X.links(_ent(spark, sf), _rel(spark, sf), ATTRS, 1, "meta1", "Star")
    return k.select("request_id", "key", "sourceId", "targetId", "type")


def export_meta(spark, sf):
    e, r = _ent(spark, sf), _rel(spark, sf)
    m = X.meta_parts(X.nodes(e, ATTRS, 1, "meta1", "Star"), X.links(e, r, ATTRS, 1, "meta1", "Star"), 1, "meta1", "Star", "star.json")
    sizes = [F.sum(F.size(f"{x}_references").cast("long")).alias(f"{x}s") for x in ("actor", "link")]
    return m.groupBy("request_id", "title", "id", "file_local_path").agg(*sizes)


def export_files(spark, sf):
    e, r = _ent(spark, sf), _rel(spark, sf)
    f = X.file_records(X.nodes(e, ATTRS, 1, "meta1", "Star"), X.links(e, r, ATTRS, 1, "meta1", "Star"))
    return f.select("folder", "name")


def vis_nodes(spark, sf):
    return V.vis_nodes(_ent(spark, sf).select("id", "type", *ATTRS))


def vis_edges(spark, sf):
    return V.vis_edges(_ent(spark, sf), _rel(spark, sf))


def vis_comparison(spark, sf):
    e = _ent(spark, sf)
    ends = _rel(spark, sf).select(F.explode(F.array("source", "target")).alias("id"), "doc").distinct()
    return V.comparison_nodes(e, ends.join(e.select("id"), "id", "left_semi"))


def two_hop(spark, sf):
    return G.neighbourhood(_rel(spark, sf), _ent(spark, sf).where("id = 's1'"), 2)


def property_filter(spark, sf):
    return G.property_filter(_ent(spark, sf), _rel(spark, sf), edge=F.col("type") == "kg:soldIn")


def select_nodes(spark, sf):
    return G.property_filter(_ent(spark, sf), _rel(spark, sf), node=F.col("segment") == "BUILDING")


def extract_graphs(spark, sf):
    """Graphs that the rule client finds in the pages of documents, as entities."""
    pages = split_pages(table(spark, sf, "documents"), "doc_id", "text")
    prompt = EX.extraction_prompt(F.col("text"), F.lit(ONTOLOGY.prompt()), F.lit(""), F.lit(""))
    got = EX.graph_entities(EX.extract_graphs(pages, "rules", prompt))
    return got.select("doc", "page", "id", "type", F.get_json_object("attrs_json", "$.name").alias("name"))


#: Frequent words of the documents' languages stand for categories, as no text names a kind of report.
CATEGORIES = ["the", "und", "les", "los"]


def classify_cascade(spark, sf):
    """Documents by the category that their first lines name, or else the text as far as a prompt takes it."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    return EX.classify([docs.select("doc", F.substring_index("text", "\n", 1).alias("text")), docs], "keywords", CATEGORIES)


def graph_json(spark, sf):
    e, r = _ent(spark, sf), _rel(spark, sf)
    kept = materialize(G.clean_relations(e, r), "clean", "zstd", free=True)  # so the joins' shuffle files aren't kept beside those of the sort
    out = graph_document_parts(e, kept, "doc", ("name", "locationName"))
    return out.groupBy("doc").agg(F.sum(F.length("value").cast("long")).alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        kg_clean, kg_renumber, kg_renumber_entities, kg_type_distribution, unique_ids, onto_invalid_entities, onto_invalid_relations, onto_missing_types, onto_constraints, onto_attributes,
        graph_basic_metrics, graph_wcc, graph_diameter, graph_node_types, relation_distribution, compliance, domain_range_violations, attribute_completeness, company_metrics,
        entity_coverage, overall_score, merge_exact_parts, merge_relations, merge_statistics, match_strategies, provenance_attributes, provenance_relations, metric_company_lookup,
        match_person_tokens, fuzzy_match_first, similar_names, merge_star_project, merge_sales_later, merge_fuzzy_fold, merge_strategy_fold, merge_project_fold, stream_fold, iterative_construction, diag_summary, diag_by_type, diag_patterns, diag_unexpected, diag_lost,
        diag_recommendations, diag_key_details, export_nodes, export_links, export_meta, export_files, vis_nodes, vis_edges, vis_comparison, two_hop, property_filter, select_nodes,
        extract_graphs, classify_cascade, graph_json, diag_report,
    )
}

# ---- the same in DuckDB's SQL -----------------------------------------------------------------------------------

_S = star.SQL
_BARE = "split_part(type, ':', -1)"
_CLEAN = ", cr AS (SELECT source, target, type, min(ord) AS ord FROM rel WHERE source IN (SELECT id FROM ent) AND target IN (SELECT id FROM ent) GROUP BY source, target, type)"
_NUM = ", ne AS (SELECT id AS old_id, 'e' || row_number() OVER (ORDER BY ord) AS id, type FROM ent)"
_GR = f", eg AS (SELECT source, target, max_by({_BARE}, ord) AS type FROM rel GROUP BY source, target), vx AS (SELECT coalesce(e.id, x.id) AS id, {_BARE.replace('type', 'e.type')} AS type FROM (SELECT source AS id FROM eg UNION SELECT target FROM eg) x FULL JOIN ent e ON e.id = x.id)"
_ATT = ", att AS (" + " UNION ALL ".join(f"SELECT id, {_BARE} AS type, '{a}' AS key, {a}::VARCHAR AS value FROM ent WHERE {a} IS NOT NULL" for a in ATTRS) + ")"
_COMP = """, c1 AS (SELECT avg((type IS NOT NULL AND type IN (SELECT name FROM oe))::INT) AS x FROM vx), c2 AS (SELECT avg((type IN (SELECT name FROM orl))::INT) AS x FROM eg),
ends AS (SELECT eg.*, (EXISTS (SELECT 1 FROM od WHERE relation = eg.type AND od.type = a.type) AND EXISTS (SELECT 1 FROM og WHERE relation = eg.type AND og.type = b.type)) AS ok
  FROM eg JOIN vx a ON a.id = source JOIN vx b ON b.id = target WHERE eg.type IN (SELECT name FROM orl)),
c3 AS (SELECT (SELECT count(*) FROM ends WHERE ok) / (SELECT greatest(count(*), 1) FROM eg) AS x), c4 AS (SELECT avg((EXISTS (SELECT 1 FROM oa WHERE entity = att.type AND attr = key))::INT) AS x FROM att)"""
_COMPLETE = """, want AS (SELECT entity, count(*) AS n FROM oa GROUP BY entity), have AS (SELECT id, count(DISTINCT key) AS n FROM att JOIN oa ON entity = att.type AND attr = key GROUP BY id),
cm AS (SELECT avg((coalesce(have.n, 0) >= coalesce(want.n, 0))::INT) AS x FROM vx LEFT JOIN want ON entity = type LEFT JOIN have ON have.id = vx.id)"""
_COMPANY = ", co AS (SELECT id FROM vx WHERE type = 'Company'), ca AS (SELECT (SELECT count(*) FROM (SELECT source AS id FROM eg UNION ALL SELECT target FROM eg) e WHERE id IN (SELECT id FROM co)) / (SELECT greatest(count(*), 1) FROM co) AS x)"
#: Least labels go one step a round: enough for components whose nodes are at most that far from their least one.
_ROUNDS = 16
_WCC = (
    ", und AS MATERIALIZED (SELECT source AS a, target AS b FROM eg UNION SELECT target, source FROM eg), l0 AS MATERIALIZED (SELECT id, id AS other FROM vx)"
    + "".join(f", l{i + 1} AS MATERIALIZED (SELECT id, min(other) AS other FROM (SELECT * FROM l{i} UNION ALL SELECT b, other FROM und JOIN l{i} ON a = id) GROUP BY id)" for i in range(_ROUNDS))
    + f", reach AS (SELECT * FROM l{_ROUNDS})"
)
_BASIC = """, bs AS (SELECT (SELECT count(*) FROM vx) AS nodes, (SELECT count(*) FROM eg) AS edges, (SELECT count(*) FROM vx WHERE id NOT IN (SELECT source FROM eg) AND id NOT IN (SELECT target FROM eg)) AS iso)"""
_NORM = r"trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}_\s.-]', ' ', 'g'), '\s+', ' ', 'g'))"
_PARTS = f"WITH pt AS (SELECT 'p' || p_partkey AS id, p_partkey AS ord, p_brand AS page, p_name AS name, p_type AS kind, p_retailprice AS amount, (p_size % 3)::VARCHAR AS fp, {_NORM} AS k FROM part), mg AS (SELECT k, min_by(id, ord) AS id, min(ord) AS first_ord, count(*) AS n, max_by(name, (length(name), -ord)) AS name, max_by(kind, (length(kind), -ord)) AS kind, coalesce(min_by(amount, ord) FILTER (WHERE amount <> 0), min_by(amount, ord)) AS amount FROM pt GROUP BY k)"
_DIAG = _PARTS + ", af AS (SELECT * FROM mg WHERE first_ord % 7 <> 0), b AS (SELECT *, trim(lower(name)) AS label FROM pt), a AS (SELECT *, trim(lower(name)) AS label FROM af)"
_GROUPS = _DIAG + """, f AS (SELECT *, first_value(amount) OVER (PARTITION BY label ORDER BY ord) AS fa, first_value(fp) OVER (PARTITION BY label ORDER BY ord) AS ff FROM b),
g AS (SELECT label, count(*) AS original, count(DISTINCT page) AS pages, bool_and(fa = amount AND ff = fp) AS alike, count(DISTINCT amount) AS da, count(DISTINCT fp) AS df FROM f GROUP BY label HAVING count(*) > 1),
h AS (SELECT g.*, (SELECT count(*) FROM a WHERE a.label = g.label) AS final FROM g), m AS (SELECT * FROM h WHERE final < original)"""
_LABEL = "coalesce(CASE split_part(type, ':', -1) WHEN 'Location' THEN coalesce(locationName, name) WHEN 'TransactionContext' THEN contextName WHEN 'FinancialMetric' THEN coalesce(metricName, name) WHEN 'Company' THEN name WHEN 'ProductOrService' THEN name ELSE coalesce(name, id) END, 'Unknown Entity')"
_LKEY = "CASE split_part(type, ':', -1) WHEN 'Location' THEN 'locationName' WHEN 'TransactionContext' THEN 'contextName' WHEN 'FinancialMetric' THEN 'metricName' ELSE 'name' END"
_CID = r"id || '_' || regexp_replace(regexp_replace(label, '\s+', '_', 'g'), '[^\p{L}\p{N}_-]', '', 'g')"
_LAB = f", lb0 AS (SELECT *, {_LABEL} AS label, {_LKEY} AS lkey FROM ent), lb AS (SELECT *, {_CID} AS node_id FROM lb0)"
_DESC = "concat_ws('. ', " + ", ".join(f"CASE WHEN lkey <> '{a}' THEN '{display_name(a)}: ' || trim({a}::VARCHAR) END" for a in ATTRS) + ")"
_LINKS = f"""SELECT 1 AS request_id, md5(concat_ws('#', source, target, rel.type, rel.ord::VARCHAR)) AS key, coalesce(a.node_id, source) AS "sourceId", coalesce(b.node_id, target) AS "targetId",
  lower(regexp_replace(regexp_replace(split_part(rel.type, ':', -1), '(.)([A-Z][a-z]+)', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS type
FROM rel LEFT JOIN lb a ON a.id = source LEFT JOIN lb b ON b.id = target"""
_COLOR = "CASE split_part(type, ':', -1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.COLORS.items()) + f" ELSE '{V.DEFAULT_COLOR}' END"
_VLABEL = "CASE split_part(type, ':', -1) WHEN 'Location' THEN coalesce(locationName, id) WHEN 'TransactionContext' THEN coalesce(contextName, id) WHEN 'FinancialMetric' THEN metricName || coalesce(' (' || DateOrPeriod || ')', '') ELSE coalesce(name, id) END"
_CMP = "['" + "', '".join(V.PALETTE) + "']"

ORACLES = {
    "kg_clean": f"{_S}{_CLEAN} SELECT * FROM cr",
    "kg_renumber": f"{_S}{_CLEAN}{_NUM} SELECT a.id AS source, b.id AS target, cr.type FROM cr JOIN ne a ON a.old_id = source JOIN ne b ON b.old_id = target",
    "kg_renumber_entities": f"{_S}{_NUM} SELECT id, old_id, type FROM ne",
    "kg_type_distribution": f"{_S} SELECT {_BARE} AS type, count(*) AS n FROM ent GROUP BY ALL",
    "unique_ids": "WITH a AS (SELECT p_partkey AS ord, 'b' || p_brand AS base, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part) SELECT ord, CASE WHEN n = 0 THEN base ELSE base || '_part_' || n END AS unique_id FROM a",
    "onto_invalid_entities": f"{_S}{ONTO_SQL} SELECT id, {_BARE} AS type FROM ent WHERE {_BARE} NOT IN (SELECT name FROM oe)",
    "onto_invalid_relations": f"{_S}{ONTO_SQL} SELECT source, target, {_BARE} AS type FROM rel WHERE {_BARE} NOT IN (SELECT name FROM orl)",
    "onto_missing_types": f"{_S}{ONTO_SQL} SELECT 'entity' AS kind, name FROM oe WHERE name NOT IN (SELECT {_BARE} FROM ent) UNION ALL SELECT 'relation', name FROM orl WHERE name NOT IN (SELECT {_BARE} FROM rel)",
    "onto_constraints": f"{_S}{ONTO_SQL}, u AS (SELECT {_BARE} AS relation, count(*) AS n FROM rel GROUP BY ALL) SELECT relation, coalesce((SELECT string_agg(type, '|' ORDER BY type) FROM od WHERE od.relation = u.relation), '') AS domain, coalesce((SELECT string_agg(type, '|' ORDER BY type) FROM og WHERE og.relation = u.relation), '') AS range, n FROM u",
    "onto_attributes": f"{_S}{ONTO_SQL}{_ATT}, w AS (SELECT type, key AS attr, count(DISTINCT id) AS n FROM att GROUP BY ALL) SELECT oa.entity AS type, oa.attr, CASE WHEN oa.attr = 'metricValue' THEN 'float' ELSE 'string' END AS value_type, coalesce(n, 0) AS n FROM oa LEFT JOIN w ON w.type = oa.entity AND w.attr = oa.attr WHERE oa.entity IN (SELECT {_BARE} FROM ent)",
    "graph_basic_metrics": f"{_S}{_GR}{_BASIC} SELECT nodes, edges, round(edges / (nodes::DOUBLE * (nodes - 1)), 9) AS density, round(2.0::DOUBLE * edges / nodes, 6) AS avg_degree, round(iso / nodes, 6) AS isolated_ratio FROM bs",
    "graph_wcc": f"{_S}{_GR}{_WCC} SELECT id, min(other) AS component FROM reach GROUP BY id",
    "graph_node_types": f"{_S}{_GR} SELECT coalesce(type, 'unknown') AS type, count(*) AS n FROM vx GROUP BY ALL",
    "relation_distribution": f"{_S}{_GR} SELECT type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM eg GROUP BY type",
    "compliance": f"{_S}{ONTO_SQL}{_GR}{_ATT}{_COMP} SELECT round(c1.x, 6) AS entity_validity, round(c2.x, 6) AS relation_validity, round(c3.x, 6) AS domain_range_validity, round(c4.x, 6) AS attribute_validity, round((c1.x + c2.x + c3.x + c4.x) / 4, 6) AS overall_compliance FROM c1, c2, c3, c4",
    "domain_range_violations": f"{_S}{ONTO_SQL}{_GR}{_ATT}{_COMP} SELECT source, target, type FROM ends WHERE NOT ok",
    "attribute_completeness": f"{_S}{ONTO_SQL}{_GR}{_ATT}{_COMPLETE} SELECT round(x, 6) AS completeness FROM cm",
    "company_metrics": f"{_S}{_GR}{_COMPANY} SELECT false AS financial_available, round(x, 6) AS avg_company_relations FROM ca",
    "entity_coverage": f"{_S}{ONTO_SQL}{_GR} SELECT name AS type, (SELECT count(*) FROM vx WHERE vx.type = name) > 0 AS present, (SELECT count(*) FROM vx WHERE vx.type = name) AS n FROM oe",
    "overall_score": f"""{_S}{ONTO_SQL}{_GR}{_ATT}{_COMP}{_COMPLETE}{_COMPANY}{_BASIC}{_WCC}, cc AS (SELECT count(DISTINCT c) AS n FROM (SELECT id, min(other) AS c FROM reach GROUP BY id)),
p AS (SELECT (c1.x + c2.x + c3.x + c4.x) / 4 AS overall_compliance, 0.3::DOUBLE * (1 - iso / nodes) + 0.3::DOUBLE * cm.x + 0.2::DOUBLE * least(1.0::DOUBLE, ca.x / 10) AS quality,
  (SELECT avg((name IN (SELECT type FROM vx WHERE type IS NOT NULL))::INT) FROM oe) AS coverage, 0.3::DOUBLE * least(1.0::DOUBLE, 100 * edges / (nodes::DOUBLE * (nodes - 1))) + 0.4::DOUBLE * least(1.0::DOUBLE, 2.0::DOUBLE * edges / nodes / 5) + 0.3::DOUBLE / n AS shape, n AS components
  FROM c1, c2, c3, c4, cm, ca, bs, cc)
SELECT round(overall_compliance, 6) AS overall_compliance, round(quality, 6) AS quality, round(coverage, 6) AS coverage, round(shape, 6) AS shape, components,
  round(0.4::DOUBLE * overall_compliance + 0.3::DOUBLE * quality + 0.2::DOUBLE * coverage + 0.1::DOUBLE * shape, 6) AS score FROM p""",
    "merge_exact_parts": f"{_PARTS} SELECT id, first_ord, n, 'kg:ProductOrService' AS type, name, kind, amount FROM mg",
    "merge_relations": f"{_S}, pk AS (SELECT 'p' || p_partkey AS id, p_partkey AS o, {_NORM} AS k FROM part), pm AS (SELECT id, first_value(id) OVER (PARTITION BY k ORDER BY o) AS new_id FROM pk) SELECT DISTINCT source, coalesce(new_id, target) AS target, type FROM rel LEFT JOIN pm ON pm.id = target WHERE type = 'kg:offersProduct'",
    "merge_statistics": f"{_PARTS}, t AS (SELECT sum(n)::BIGINT AS total, count(*) AS kept FROM mg) SELECT 'productorservice' AS type, 'moderate' AS strategy, total, kept, total - kept AS merged, round(100.0::DOUBLE * (total - kept) / total, 1) AS rate FROM t",
    "match_strategies": f"{_S}, k AS (SELECT lower({_BARE}) AS type, count(*) AS n FROM ent GROUP BY ALL) SELECT type, CASE type WHEN 'transactioncontext' THEN 'preserve' WHEN 'financialmetric' THEN 'strict' WHEN 'company' THEN 'liberal' WHEN 'location' THEN 'liberal' ELSE 'moderate' END AS strategy, CASE type WHEN 'transactioncontext' THEN 0.98 WHEN 'financialmetric' THEN 0.95 WHEN 'company' THEN 0.70 WHEN 'location' THEN 0.75 WHEN 'productorservice' THEN 0.80 ELSE 0.75 END::DOUBLE AS threshold, n FROM k",
    "provenance_attributes": f"{_PARTS}, l AS (SELECT k, page, ord, 'kind' AS key, kind AS value FROM pt UNION ALL SELECT k, page, ord, 'fiscalPeriod', fp FROM pt), d AS (SELECT k, key, value, page, min(ord) AS ord FROM l GROUP BY ALL) SELECT k AS entity, key, string_agg(value || '@' || page, ';' ORDER BY ord) AS value_list FROM d GROUP BY k, key",
    "provenance_relations": f"{_S}, d AS (SELECT source, target, type, doc, min(ord) AS ord FROM rel GROUP BY ALL) SELECT source, target, type, string_agg(doc, ',' ORDER BY ord) AS docs FROM d GROUP BY source, target, type",
    "metric_company_lookup": f"{_S} SELECT target AS metric_id, min_by(source, ord) AS company_id FROM rel WHERE type = 'kg:reportsMetric' AND source IN (SELECT id FROM ent WHERE type = 'kg:Company') GROUP BY target",
    "match_person_tokens": "WITH t AS (SELECT 'p' || p_partkey AS id, p_partkey AS o, string_split(p_name, ' ') AS w FROM part) SELECT id, first_value(id) OVER (PARTITION BY w[1], w[-1] ORDER BY o) AS match_id FROM t WHERE len(w) >= 2",
    "diag_summary": f"{_DIAG}, c AS (SELECT (SELECT count(*) FROM b) AS original, (SELECT count(*) FROM a) AS final, (SELECT count(DISTINCT page) FROM b) AS pages) SELECT original, final, original - final AS lost, round(100.0::DOUBLE * (original - final) / original, 1) AS loss_percentage, pages FROM c",
    "diag_by_type": f"{_DIAG}, s AS (SELECT string_agg(label, '|' ORDER BY ord) AS samples FROM (SELECT * FROM b ORDER BY ord LIMIT 3)), c AS (SELECT (SELECT count(*) FROM b) AS original, (SELECT count(*) FROM a) AS final) SELECT 'productorservice' AS type, original, final, original - final AS lost, round(100.0::DOUBLE * (original - final) / original, 1) AS loss_percentage, samples FROM s, c",
    "diag_patterns": f"{_GROUPS} SELECT label AS name, 'productorservice' AS type, original, final, CASE WHEN alike THEN 'high' ELSE 'low' END AS similarity FROM m",
    "diag_unexpected": f"{_GROUPS}, x AS (SELECT *, concat_ws(',', CASE WHEN da > 1 THEN 'amount' END, CASE WHEN df > 1 THEN 'fiscalPeriod' END, CASE WHEN pages > 1 THEN 'page' END) AS differences FROM m) SELECT label AS name, 'productorservice' AS type, original, final, differences FROM x WHERE differences <> ''",
    "diag_lost": f"{_DIAG}, g AS (SELECT * FROM b WHERE label NOT IN (SELECT label FROM a)) SELECT id, label AS name, 'productorservice' AS type, page, CASE WHEN EXISTS (SELECT 1 FROM a WHERE contains(a.label, g.label) OR contains(g.label, a.label)) THEN 'Merged with similar name entity' ELSE 'Unknown - possibly filtered during validation' END AS reason FROM g",
    "diag_recommendations": f"{_GROUPS}, t AS (SELECT 100.0::DOUBLE * ((SELECT count(*) FROM b) - (SELECT count(*) FROM a)) / (SELECT count(*) FROM b) AS loss) SELECT 'overall_loss' AS code, '' AS subject FROM t WHERE loss > 50 UNION ALL SELECT 'type_loss', 'productorservice' FROM t WHERE loss > 70 UNION ALL (SELECT 'unexpected_merges', '' FROM m WHERE da > 1 OR df > 1 OR pages > 1 LIMIT 1)",
    "diag_report": f"""{_GROUPS}, c AS (SELECT (SELECT count(*) FROM b) AS original, (SELECT count(*) FROM a) AS final),
x AS (SELECT *, concat_ws(',', CASE WHEN da > 1 THEN 'amount' END, CASE WHEN df > 1 THEN 'fiscalPeriod' END, CASE WHEN pages > 1 THEN 'page' END) AS differences FROM m),
un AS (SELECT *, row_number() OVER (ORDER BY original - final DESC, label) AS n FROM x WHERE differences <> ''), gone AS (SELECT *, row_number() OVER (ORDER BY ord, id) AS n FROM b WHERE label NOT IN (SELECT label FROM a))
SELECT '1 total' AS section, 1::BIGINT AS n, original || ' -> ' || final AS line FROM c UNION ALL SELECT '2 types', 1, 'productorservice: ' || original || ' -> ' || final FROM c
UNION ALL SELECT '3 lost', n, label || ' (productorservice, page ' || page || '): ' || CASE WHEN EXISTS (SELECT 1 FROM a WHERE contains(a.label, gone.label) OR contains(gone.label, a.label)) THEN 'Merged with similar name entity' ELSE 'Unknown - possibly filtered during validation' END FROM gone WHERE n <= 10
UNION ALL SELECT '4 unexpected', n, label || ' (productorservice): ' || original || ' -> ' || final || ', differs in ' || differences FROM un WHERE n <= 5""",
    "diag_key_details": "SELECT 'p' || p_partkey AS id, CASE WHEN p_retailprice IS NULL THEN '' ELSE 'amount,' END || 'fiscalPeriod' AS details FROM part",
    "export_nodes": rf"""{_S}{_LAB}, d AS (SELECT *, {_DESC} AS de, split_part(type, ':', -1) AS b FROM lb)
SELECT 1 AS request_id, node_id AS id, label, lower(b[1] || regexp_replace(b[2:], '([A-Z])', '_\1', 'g')) AS category, CASE WHEN de <> '' THEN de || '.' ELSE label || ' (Type: ' || b || ').' END AS description, 'meta1.meta.json' AS file_name FROM d""",
    "export_links": f"{_S}{_LAB} {_LINKS}",
    "export_meta": f"{_S} SELECT 1 AS request_id, 'Star' AS title, 'meta1' AS id, 'star.json' AS file_local_path, (SELECT count(*) FROM ent) AS actors, (SELECT count(*) FROM rel) AS links",
    "export_files": f"""{_S}{_LAB}, k AS ({_LINKS}) SELECT 'index2' AS folder, 'actor-' || regexp_replace(node_id, '[<>:"/\\\\|?*]', '_', 'g') || '.node.json' AS name FROM lb UNION ALL SELECT 'index3', key || '.link.json' FROM k""",
    "vis_nodes": f"""{_S} SELECT id, substr({_VLABEL}, 1, 50) AS label, {_COLOR} AS color, 15 AS size,
  concat_ws('<br>', '<b>ID:</b> ' || id, '<b>Type:</b> ' || type, '<b>name:</b> ' || name, '<b>metricName:</b> ' || metricName, '<b>contextName:</b> ' || contextName, '<b>metricValue:</b> ' || metricValue) AS title FROM ent""",
    "vis_edges": f'{_S} SELECT source AS "from", target AS "to", {_BARE} AS label FROM rel WHERE source IN (SELECT id FROM ent) AND target IN (SELECT id FROM ent)',
    "vis_comparison": f"""{_S}, me AS (SELECT DISTINCT id, doc FROM (SELECT source AS id, doc FROM rel UNION SELECT target, doc FROM rel)), mf AS (SELECT me.* FROM me JOIN ent USING (id)),
dn AS (SELECT doc, (row_number() OVER (ORDER BY doc) - 1) % 7 AS n FROM (SELECT DISTINCT doc FROM mf)), pr AS (SELECT id, count(*) AS k, min(doc) AS doc FROM mf GROUP BY id)
SELECT e.id, CASE WHEN k = 1 THEN {_CMP}[n + 1] ELSE '{V.SHARED_COLOR}' END AS color, (15 + 3 * coalesce(k, 0))::INT AS size FROM (SELECT id FROM ent) e LEFT JOIN pr USING (id) LEFT JOIN dn ON dn.doc = pr.doc""",
    "two_hop": f"""{_S}, u AS (SELECT source AS a, target AS b FROM rel UNION SELECT target, source FROM rel), h1 AS (SELECT DISTINCT b AS id FROM u WHERE a = 's1'), h2 AS (SELECT DISTINCT b AS id FROM u WHERE a IN (SELECT id FROM h1))
SELECT id, min(hop)::INT AS hop FROM (SELECT 's1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""",
    "property_filter": f"{_S} SELECT source AS id FROM rel WHERE type = 'kg:soldIn' UNION SELECT target FROM rel WHERE type = 'kg:soldIn'",
    "select_nodes": f"{_S} SELECT DISTINCT id FROM ent WHERE segment = 'BUILDING'",
}
