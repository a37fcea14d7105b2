"""Diagnostics of a merge: entities before (with pages) against entities after.

Frames have ``id, type, ord`` and attribute columns; ``before`` also ``page``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a name may be, and which attributes tell entities apart.
NAME_FIELDS = ("name", "metricName", "kpiName", "productName", "fullName", "contextName")
NUMERIC = ("metricValue", "percentageValue", "amount", "headcountValue")
TEMPORAL = ("fiscalPeriod", "dateOrYear", "kpiDateOrPeriod")
OTHER = ("metricUnit", "currency", "location", "contextType")
DIFFERING = ("metricValue", "percentageValue", "amount", "fiscalPeriod", "dateOrYear")

#: All attributes that a diagnosis looks at.
FIELDS = (*NAME_FIELDS, *NUMERIC, *TEMPORAL, *OTHER)


def entity_name(df: DataFrame) -> Column:
    fields = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in NAME_FIELDS if f in df.columns]
    return F.trim(F.lower(F.coalesce(*fields, F.col("id"), F.lit("unnamed"))))


def entity_type() -> Column:
    return F.coalesce(F.lower(F.substring_index("type", ":", -1)), F.lit("unknown"))


def key_details(df: DataFrame) -> Column:
    """The telling attributes that aren't null, as a map of texts."""
    pairs = [F.struct(F.lit(f).alias("k"), F.col(f).cast("string").alias("v")) for f in (*NUMERIC, *TEMPORAL, *OTHER) if f in df.columns]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))


def summary(before: DataFrame, after: DataFrame) -> DataFrame:
    row = before.agg(F.count("*").alias("original"), F.countDistinct("page").alias("pages")).crossJoin(after.agg(F.count("*").alias("final")))
    lost = F.col("original") - F.col("final")
    return row.select("original", "final", lost.alias("lost"), F.round(F.when(F.col("original") > 0, 100.0 * lost / F.col("original")).otherwise(0.0), 1).alias("loss_percentage"), "pages")


def by_type(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(type, original, final, lost, loss_percentage, samples)``: the samples are the names of the first three."""
    rows = before.select(entity_type().alias("kind"), entity_name(before).alias("label"), "ord")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("ord"))).where("n <= 3")
    samples = first.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), "|").alias("samples"))
    counts = rows.groupBy("kind").agg(F.count("*").alias("original")).join(after.groupBy(entity_type().alias("kind")).agg(F.count("*").alias("final")), "kind", "left")
    final = F.coalesce("final", F.lit(0)).cast("long")
    out = counts.join(samples, "kind").select(F.col("kind").alias("type"), "original", final.alias("final"), (F.col("original") - final).alias("lost"), F.round(100.0 * (F.col("original") - final) / F.col("original"), 1).alias("loss_percentage"), "samples")
    return out


def _groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names with several entities, of which fewer are left: counts, kinds and distinct telling values."""
    rows = before.withColumns({"label": entity_name(before), "kind": entity_type()})
    distinct = [F.countDistinct(F.col(f).cast("string")).alias(f"d_{f}") for f in DIFFERING if f in before.columns]
    alike = F.lit(True)
    for f in (*NUMERIC, *TEMPORAL, *OTHER):
        if f in before.columns:
            # Only what the first entity has counts: others may differ from each other in the rest.
            first = F.col(f"first_{f}")
            rows = rows.withColumn(f"first_{f}", F.first(F.col(f).cast("string")).over(Window.partitionBy("label").orderBy("ord")))
            alike = alike & (first.isNull() | F.col(f).isNull() | (first == F.col(f).cast("string")))
    rows = rows.withColumn("alike", alike)
    grouped = rows.groupBy("label").agg(
        F.count("*").alias("original"), F.countDistinct("kind").alias("kinds"), F.min_by("kind", "ord").alias("kind"), F.countDistinct("page").alias("pages"), F.bool_and("alike").alias("alike"), *distinct
    )
    left = after.withColumns({"label": entity_name(after), "kind": entity_type()}).groupBy("label", "kind").agg(F.count("*").alias("final"))
    out = grouped.where("original > 1").join(left, ["label", "kind"], "left").withColumn("final", F.coalesce("final", F.lit(0)).cast("long"))
    return out.where("final < original")


def merge_patterns(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(name, type, original, final, similarity)`` of merged names with one type; high if the telling attributes agree with the first's."""
    rows = _groups(before, after).where("kinds = 1")
    return rows.select(F.col("label").alias("name"), F.col("kind").alias("type"), "original", "final", F.when(F.col("alike"), "high").otherwise("low").alias("similarity"))


def unexpected_merges(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(name, type, original, final, differences)`` of merged names whose telling attributes or pages differ."""
    rows = _groups(before, after)
    flags = [F.when(F.col(f"d_{f}") > 1, F.lit(f)) for f in DIFFERING if f in before.columns] + [F.when(F.col("pages") > 1, F.lit("page"))]
    differences = F.concat_ws(",", *flags)
    return rows.where(differences != "").select(F.col("label").alias("name"), F.col("kind").alias("type"), "original", "final", differences.alias("differences"))


def _grams(x: Column, n: int) -> Column:
    return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contained_names(short: DataFrame, long: DataFrame, block: str = "type") -> DataFrame:
    """``(block, name, other)``: every pair of ``short(block, name)`` and ``long(block, other)`` where the name lies in the other, within words too.

    Each name is listed under one of its runs of three characters, the one that the fewest others have (a shorter name under itself), so a word that most names share is no
    one's list but its own; the others are looked up by all their runs, and what meets is verified.  The empty name lies in all.
    """
    short, long = short.select(block, "name").distinct(), long.select(block, "other").distinct()
    other = F.col("other")
    runs = long.select(block, "other", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), _grams(other, 1), _grams(other, 2), _grams(other, 3)))).alias("run"))
    counts = runs.groupBy(block, "run").agg(F.count("*").alias("n"))
    own = short.select(block, "name", F.explode(F.when(F.length("name") < 3, F.array("name")).otherwise(F.array_distinct(_grams(F.col("name"), 3)))).alias("run"))
    picked = own.join(counts, [block, "run"]).groupBy(block, "name").agg(F.min_by("run", F.struct("n", "run")).alias("run"))
    return picked.join(runs, [block, "run"]).where(other.contains(F.col("name"))).select(block, "name", "other")


def lost_entities(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, name, type, page, reason)`` of entities whose name and type are gone.

    A name that holds another, or is held by it, gives the reason (``contained_names``).
    """
    a = before.select("id", entity_name(before).alias("name"), entity_type().alias("type"), "page", "ord")
    b = after.select(entity_name(after).alias("name"), entity_type().alias("type")).distinct()
    gone = a.join(b, ["name", "type"], "left_anti")
    names = gone.select("name", "type").distinct()
    held = contained_names(names, b.withColumnRenamed("name", "other")).select("name", "type")
    holds = contained_names(b, names.withColumnRenamed("name", "other")).select(F.col("other").alias("name"), "type")
    near = held.unionByName(holds).distinct().withColumn("near", F.lit(True))
    # The texts of reasons.
    reason = (
        F.when(F.col("near"), "Merged with similar name entity")
        .when(F.col("type").contains("context"), "Context entity inappropriately merged or filtered")
        .otherwise("Unknown - possibly filtered during validation")
    )
    return gone.join(near, ["name", "type"], "left").select("id", "name", "type", "page", reason.alias("reason"))


def recommendations(total: DataFrame, types: DataFrame, unexpected: DataFrame) -> DataFrame:
    """``(code, subject)``: loss over half; context types losing over 20 %; unexpected merges; types losing over 70 %."""
    rows = total.where("loss_percentage > 50").select(F.lit("overall_loss").alias("code"), F.lit("").alias("subject"))
    rows = rows.unionByName(types.where(F.col("type").contains("context") & (F.col("loss_percentage") > 20)).select(F.lit("context_loss").alias("code"), F.col("type").alias("subject")))
    rows = rows.unionByName(unexpected.limit(1).select(F.lit("unexpected_merges").alias("code"), F.lit("").alias("subject")))
    return rows.unionByName(types.where("loss_percentage > 70").select(F.lit("type_loss").alias("code"), F.col("type").alias("subject")))


def report(before: DataFrame, after: DataFrame, lost: int = 10, unexpected: int = 5) -> DataFrame:
    """``(section, n, line)``, a report to read: totals, types by loss, the first ``lost`` lost entities and the ``unexpected`` merges that took most."""

    def numbered(rows: DataFrame, section: str, order: list, limit: int | None, line: Column) -> DataFrame:
        if limit is not None:
            rows = rows.orderBy(*order).limit(limit)  # the top rows of each task meet, not all
        rows = rows.withColumn("n", F.row_number().over(Window.orderBy(*order)))  # a row a type, or ``limit`` rows
        return rows.select(F.lit(section).alias("section"), F.col("n").cast("long").alias("n"), line.alias("line"))

    change = F.concat(F.col("original").cast("string"), F.lit(" -> "), F.col("final").cast("string"))
    gone = lost_entities(before, after).join(before.groupBy("id").agg(F.min("ord").alias("ord")), "id")
    parts = [
        summary(before, after).select(F.lit("1 total").alias("section"), F.lit(1).cast("long").alias("n"), change.alias("line")),
        numbered(by_type(before, after), "2 types", [F.desc("lost"), "type"], None, F.concat("type", F.lit(": "), change)),
        numbered(gone, "3 lost", ["ord", "id"], lost, F.concat("name", F.lit(" ("), "type", F.lit(", page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("): "), "reason")),
        numbered(unexpected_merges(before, after), "4 unexpected", [F.desc(F.col("original") - F.col("final")), "name", "type"], unexpected, F.concat("name", F.lit(" ("), "type", F.lit("): "), change, F.lit(", differs in "), "differences")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def print_report(rows: DataFrame) -> str:
    """The report as text, printed.  It has a line for each type and at most ``lost + unexpected + 1`` others, so the driver may hold it."""
    text, last = [], None
    for r in rows.orderBy("section", "n").collect():
        if r["section"] != last:
            last = r["section"]
            text.append(last.split(" ", 1)[1].upper())
        text.append(f"  {r['n']}. {r['line']}")
    out = "\n".join(text)
    print(out)
    return out
