"""Quality metrics of a graph: one-row frames that join to a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.operators.components import connected_components
from kgloom.operators.ontology import bare_type
from kgloom.sources.scratch import materialize

COMPANY = "Company"
#: Attributes of a company that count as financial data.
FINANCIAL = ("annualRevenue", "EBITDA", "headcount")


def simple_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(id, type)``, ends of relations without an entity included, and one edge ``(source, target, type)`` for each pair, the last."""
    edges = relations.groupBy("source", "target").agg(F.max_by(bare_type("type"), F.col("ord")).alias("type"))
    typed = entities.groupBy("id").agg(F.max_by(bare_type("type"), F.col("ord")).alias("type"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.join(typed, "id", "full_outer").select("id", "type"), edges


def basic_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = vertices.agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    touched = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    isolated = vertices.join(touched, "id", "left_anti").agg(F.count("*").alias("isolated"))
    one = n.crossJoin(m).crossJoin(isolated)  # a row each
    return one.select(
        "nodes",
        "edges",
        F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes").cast("double") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"),
        (2.0 * F.col("edges") / F.greatest("nodes", F.lit(1))).alias("avg_degree"),
        (F.col("isolated") / F.greatest("nodes", F.lit(1))).alias("isolated_ratio"),
    )


def weak_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least id of its weakly connected component, of isolated vertices too."""
    found = connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b")))
    return vertices.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Roots that are searched from side by side, a bit each; neighbours in one list.
ROOTS, LIST = 512, 4096


def _hashed(edges: DataFrame) -> DataFrame:
    """``(a, b)``: each pair of joined nodes once, by a number for each id that no other id has (a hash, under another seed should two ids share one)."""
    edges = edges.select("source", "target").where("source <> target")
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    for seed in range(64):
        number = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: B023, E731
        if not ids.groupBy(number("id").alias("n")).count().where("count > 1").limit(1).count():
            ends = number("source"), number("target")
            return materialize(edges.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct(), "pairs")
    raise RuntimeError("ids share hashes under 64 seeds")


def _strip_trees(pairs: DataFrame) -> DataFrame:
    """``(id, n, h, low, size)`` of the nodes that are left when trees are taken off: neighbours left, and of the trees that hung there the height, the longest path and the nodes.

    Leaves are taken off round by round until none is left.  A node keeps the number of its neighbours and their exclusive or, which is a leaf's only neighbour, so rounds
    don't read the pairs.  A leaf of round r has height r - 1, as the round before took its last child.  Of two nodes that are left the lesser stays.
    """
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    nodes = both.groupBy(F.col("p.a").alias("id")).agg(F.count("*").alias("n"), F.bit_xor("p.b").alias("x"))
    nodes = materialize(nodes.withColumns({"h": F.lit(0), "low": F.lit(0), "size": F.lit(1).cast("long")}), "nodes")
    height = 0
    while nodes.where("n = 1").limit(1).count():
        height += 1
        leaves = nodes.where("n = 1").select(F.col("x").alias("at"), F.col("id").alias("leaf"), F.col("low").alias("under"), F.col("size").alias("more"))
        grown = leaves.groupBy(F.col("at").alias("id")).agg(F.count("*").alias("k"), F.bit_xor("leaf").alias("gone"), F.max("under").alias("under"), F.sum("more").alias("more"))
        step = nodes.join(grown, "id", "left").where("n <> 1 OR (k IS NOT NULL AND id < x)")
        path = F.when(F.col("k") > 1, 2 * height).when(F.col("k") == 1, F.col("h") + height)
        none = F.lit(0).cast("long")
        step = step.select(
            "id",
            (F.col("n") - F.coalesce("k", none)).alias("n"),
            F.col("x").bitwiseXOR(F.coalesce("gone", none)).alias("x"),
            F.when(F.col("k").isNull(), F.col("h")).otherwise(height).alias("h"),
            F.greatest("low", "under", path).alias("low"),
            (F.col("size") + F.coalesce("more", none)).alias("size"),
        )
        nodes = materialize(step, "nodes")
    return nodes.drop("x")


def _neighbours(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, near)``: the neighbours of each of ``nodes(id, n)`` that are left, in lists of about ``LIST``, so a hub has many."""
    left = nodes.where("n > 1").select("id", "n")
    for end in ("a", "b"):
        pairs = pairs.join(left.toDF(end, f"n{end}").hint("shuffle_hash"), end)
    ways = [F.struct(F.col(x).alias("id"), F.col(f"n{x}").alias("n"), F.col(y).alias("to")) for x, y in ("ab", "ba")]
    rows = pairs.select(F.explode(F.array(*ways)).alias("p")).select("p.*")
    part = F.pmod(F.col("to"), F.ceil(F.col("n") / LIST))
    return materialize(rows.groupBy("id", part.alias("part")).agg(F.collect_list("to").alias("near")).drop("part"), "near")


def _search(roots: list, lists: DataFrame, heights: DataFrame) -> tuple[list[int], DataFrame]:
    """From all ``roots(id, h)`` at once, a level at a time: the longest path from each, heights at both ends included, and ``(id, h, d)`` of what is reached.

    A node holds a bit for each root, and an edge passes them on together.  Neighbours of a level are in it, the one before or the next, so only two levels are looked at.
    """
    spark = lists.sparkSession
    bits = [f"w{i}" for i in range(-(-len(roots) // 64))]
    word = lambda j, i: (1 << j % 64) - (1 << 64 if j % 64 == 63 else 0) if j // 64 == i else 0
    rows = [(r["id"], r["h"], *(word(j, i) for i in range(len(bits)))) for j, r in enumerate(roots)]
    front = spark.createDataFrame(rows, "id long, h int, " + ", ".join(f"{w} long" for w in bits))
    seen, known, size = front.select("id", "h", F.lit(0).alias("d")), front, len(rows)
    heights = heights.select("id", "h", F.lit(True).alias("old"), *(F.lit(0).cast("long").alias(w) for w in bits))
    longest, step = [r["h"] for r in roots], 0
    while size:
        step += 1
        # Built from few rows only, whatever their files' size.
        by = F.broadcast(front) if size * len(bits) <= 50_000 else front.hint("shuffle_hash")
        sent = lists.join(by, "id").select(F.explode("near").alias("id"), F.lit(None).cast("int").alias("h"), F.lit(False).alias("old"), *bits)
        rows = sent.unionByName(known.select("id", "h", F.lit(True).alias("old"), *bits)).unionByName(heights)
        of = lambda w, old: F.coalesce(F.bit_or(F.when(F.col("old") == old, F.col(w))), F.lit(0).cast("long"))
        new = rows.groupBy("id").agg(F.coalesce(F.max("h"), F.lit(0)).alias("h"), *(of(w, False).bitwiseAND(F.bitwise_not(of(w, True))).alias(w) for w in bits))
        new = materialize(new.where(" OR ".join(f"{w} <> 0" for w in bits)), "front")
        found = new.groupBy("h").agg(F.count("*").alias("n"), *(F.bit_or(w).alias(w) for w in bits)).collect()
        for row in found:
            for j, r in enumerate(roots):
                if row[f"w{j // 64}"] >> j % 64 & 1:
                    longest[j] = max(longest[j], r["h"] + step + row["h"])
        seen, known, front, size = seen.unionByName(new.select("id", "h", F.lit(step).alias("d"))), front.unionByName(new), new, sum(r["n"] for r in found)
    return longest, seen


def _longest(pairs: DataFrame, roots: int) -> int | None:
    """The diameter of the component that holds more than half of all nodes; None if there is no such component."""
    nodes = _strip_trees(pairs)
    row = nodes.agg(F.sum("size").alias("all"), F.max_by(F.struct("id", "h"), F.struct("size", "id")).alias("at")).first()
    if row["all"] is None:
        return 0
    lists, heights = _neighbours(nodes, pairs), materialize(nodes.where("h > 0").select("id", "h"), "heights")

    def levels(root) -> DataFrame:
        seen = _search([root], lists, heights)[1]
        return materialize(seen.select("id", "h", "d", (F.col("d") + F.col("h")).alias("out")), "levels")

    def narrow(around: DataFrame, low: int, at_once: int, batches: int | None = None) -> tuple[int, bool]:
        """The bound after searches from the outermost nodes inwards, and whether no node is left that could raise it."""
        rest = around
        while True:
            batch = rest.where(F.col("out") * 2 > low).orderBy(F.desc("out"), "id").limit(at_once).collect()
            if not batch or batches == 0:
                return low, not batch
            low = max(low, *_search(batch, lists, heights)[0])
            last, batches = batch[-1], None if batches is None else batches - 1
            rest = around.where((F.col("out") < last["out"]) | ((F.col("out") == last["out"]) & (F.col("id") > last["id"])))

    farthest = lambda around: around.orderBy(F.desc("out"), "id").first()
    around = levels(row["at"])
    within = nodes.join(around.select("id"), "id", "left_semi").agg(F.sum("size").alias("n"), F.max("low").alias("low")).first()
    if 2 * within["n"] <= row["all"]:
        return None
    if not within["n"] or around.limit(2).count() == 1:
        return within["low"]
    low, met = narrow(around, within["low"], min(roots, 64), 1)
    if met:
        return low
    start = farthest(around)
    from_a = levels(start)
    end = farthest(from_a.where(F.col("id") != start["id"]))
    low = max(low, start["h"] + end["out"])
    at = min(max((start["h"] + end["out"]) // 2 - start["h"], 0), end["d"])
    middle = from_a.where(F.col("d") == at).select("id", "h").join(levels(end).where(F.col("d") == end["d"] - at).select("id"), "id").orderBy("id").first()
    return narrow(levels(middle), low, roots)[0]


def diameter(vertices: DataFrame, edges: DataFrame, roots: int = ROOTS) -> DataFrame:
    """``(diameter)`` of the largest weak component (the first by id of equals), exact at any size; 0 for no vertices.

    Trees that hang at the rest are stripped first and count by their height, so a path is long by its steps in the core and the heights at
    both ends.  Twice a node's distance from another, height included, bounds all paths between nodes no farther out, so searches go
    from the outermost nodes inwards until the bounds meet: at first around the node that the largest trees hang at, and if one batch isn't enough, around a node in the middle
    of a long path.  ``roots`` are searched from at once, which bounds memory, not the work: a core whose bounds meet late costs up to all pairs.
    """
    found = _longest(_hashed(edges), roots)
    if found is None:
        labels = materialize(weak_components(vertices, edges), "components")
        row = labels.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
        inside = labels.where(F.col("component") == row["component"]).select(F.col("id").alias("source"))
        found = _longest(_hashed(edges.join(inside, "source", "left_semi")), roots)
    return vertices.sparkSession.createDataFrame([(found,)], "diameter int")


def compliance_parts(vertices: DataFrame, edges: DataFrame, attributes: DataFrame, onto: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Flags to average: for entities, relations, ends of declared relations, and attributes ``(id, type, key)``."""
    names = F.broadcast(onto["entity"].select(F.col("name").alias("type"), F.lit(True).alias("known")))
    rels = F.broadcast(onto["relation"].select(F.col("name").alias("type"), F.lit(True).alias("known")))
    flag = F.coalesce(F.col("known"), F.lit(False)).alias("ok")
    declared = edges.join(rels, "type", "left_semi")
    kinds = vertices.select("id", F.col("type").alias("kind"))
    ends = declared.join(kinds.withColumnsRenamed({"id": "source", "kind": "from"}), "source").join(kinds.withColumnsRenamed({"id": "target", "kind": "to"}), "target")
    d = F.broadcast(onto["domain"].select(F.col("relation").alias("type"), F.col("type").alias("from"), F.lit(True).alias("in_domain")))
    r = F.broadcast(onto["range"].select(F.col("relation").alias("type"), F.col("type").alias("to"), F.lit(True).alias("in_range")))
    ends = ends.join(d, ["type", "from"], "left").join(r, ["type", "to"], "left")
    ends = ends.select("source", "target", "type", "from", "to", (F.col("in_domain").isNotNull() & F.col("in_range").isNotNull()).alias("ok"))
    known = F.broadcast(onto["attribute"].select(F.col("entity").alias("type"), F.col("attr").alias("key"), F.lit(True).alias("known")))
    return {
        "entity": vertices.join(names, "type", "left").select("id", "type", flag),
        "relation": edges.join(rels, "type", "left").select("source", "target", "type", flag),
        "ends": ends,
        "attribute": attributes.join(known, ["type", "key"], "left").select("id", "type", "key", flag),
    }


def _share(ok: DataFrame, name: str, total: DataFrame | None = None, empty: float = 0.0) -> DataFrame:
    n = F.sum(F.col("ok").cast("int"))
    if total is None:
        return ok.agg(F.when(F.count("*") == 0, empty).otherwise(n / F.count("*")).alias(name))
    return ok.agg(F.coalesce(n, F.lit(0)).alias("n")).crossJoin(total.agg(F.count("*").alias("t"))).select((F.col("n") / F.greatest("t", F.lit(1))).alias(name))


def compliance(vertices: DataFrame, edges: DataFrame, attributes: DataFrame, onto: dict[str, DataFrame]) -> DataFrame:
    p = compliance_parts(vertices, edges, attributes, onto)
    row = _share(p["entity"], "entity_validity").crossJoin(_share(p["relation"], "relation_validity"))
    row = row.crossJoin(_share(p["ends"], "domain_range_validity", edges)).crossJoin(_share(p["attribute"], "attribute_validity", empty=1.0))
    four = ("entity_validity", "relation_validity", "domain_range_validity", "attribute_validity")
    return row.withColumn("overall_compliance", sum(F.col(c) for c in four) / 4.0)


def attribute_completeness(vertices: DataFrame, attributes: DataFrame, onto: dict[str, DataFrame]) -> DataFrame:
    """``(completeness)``: nodes that have every attribute that their type declares; a type without any is complete."""
    expected = F.broadcast(onto["attribute"].groupBy(F.col("entity").alias("type")).agg(F.count("*").alias("want")))
    known = F.broadcast(onto["attribute"].select(F.col("entity").alias("type"), F.col("attr").alias("key")))
    have = attributes.join(known, ["type", "key"]).select("id", "key").distinct().groupBy("id").agg(F.count("*").alias("have"))
    rows = vertices.join(expected, "type", "left").join(have, "id", "left")
    return rows.agg(F.avg((F.coalesce("have", F.lit(0)) >= F.coalesce("want", F.lit(0))).cast("double")).alias("completeness"))


def company_metrics(vertices: DataFrame, edges: DataFrame, attributes: DataFrame) -> DataFrame:
    """``(financial_available, avg_company_relations)``."""
    companies = vertices.where(F.col("type") == COMPANY).select("id")
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).join(companies, "id", "left_semi")
    n = ends.agg(F.count("*").alias("ends")).crossJoin(companies.agg(F.count("*").alias("companies")))
    fin = attributes.where((F.col("type") == COMPANY) & F.col("key").isin(*FINANCIAL)).agg((F.count("*") > 0).alias("financial_available"))
    return fin.crossJoin(n).select("financial_available", (F.col("ends") / F.greatest("companies", F.lit(1))).alias("avg_company_relations"))


def relation_distribution(edges: DataFrame) -> DataFrame:
    rows = edges.groupBy("type").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each relation type


def entity_coverage(vertices: DataFrame, onto: dict[str, DataFrame]) -> DataFrame:
    """``(type, present, n)`` for every declared type."""
    counts = vertices.groupBy("type").agg(F.count("*").alias("n"))
    rows = onto["entity"].select(F.col("name").alias("type")).join(counts, "type", "left")
    return rows.select("type", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def overall_score(basic: DataFrame, comp: DataFrame, completeness: DataFrame, company: DataFrame, coverage: DataFrame, components: DataFrame) -> DataFrame:
    """One row with the weighted score and its parts."""
    cover = coverage.agg(F.avg(F.col("present").cast("double")).alias("coverage"))
    row = basic.crossJoin(comp.select("overall_compliance")).crossJoin(completeness).crossJoin(company).crossJoin(cover)
    row = row.crossJoin(components.agg(F.countDistinct("component").alias("components")))
    quality = (
        0.3 * (1 - F.col("isolated_ratio"))
        + 0.3 * F.col("completeness")
        + 0.2 * F.col("financial_available").cast("double")
        + 0.2 * F.least(F.lit(1.0), F.col("avg_company_relations") / 10)
    )
    shape = 0.3 * F.least(F.lit(1.0), 100 * F.col("density")) + 0.4 * F.least(F.lit(1.0), F.col("avg_degree") / 5) + 0.3 / F.greatest("components", F.lit(1))
    row = row.withColumns({"quality": quality, "shape": shape})
    score = 0.4 * F.col("overall_compliance") + 0.3 * F.col("quality") + 0.2 * F.col("coverage") + 0.1 * F.col("shape")
    return row.select("overall_compliance", "quality", "coverage", "shape", "components", score.alias("score"))


def evaluate(entities: DataFrame, relations: DataFrame, attributes: DataFrame, onto: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All metrics; an empty graph raises ValueError."""
    if not entities.limit(1).count():
        raise ValueError("the graph is empty")
    vertices, edges = simple_graph(entities, relations)
    vertices, edges = materialize(vertices, "vertices"), materialize(edges, "edges")
    out = {
        "basic": basic_metrics(vertices, edges),
        "compliance": compliance(vertices, edges, attributes, onto),
        "completeness": attribute_completeness(vertices, attributes, onto),
        "company": company_metrics(vertices, edges, attributes),
        "relations": relation_distribution(edges),
        "coverage": entity_coverage(vertices, onto),
        "components": weak_components(vertices, edges),
    }
    out["score"] = overall_score(*(out[k] for k in ("basic", "compliance", "completeness", "company", "coverage", "components")))
    return out
