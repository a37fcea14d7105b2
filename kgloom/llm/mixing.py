"""Operator 4: mixing sources to target weights by systematic sampling, with DataFrame functions only.

Targets: the sources share ``share`` times all words by weight, but none gets more than ``cap`` times its own; what
is over goes to the others by weight until none is above.  The end of that process is the level
``L`` with target = least(cap * size, L * weight), found by one pass over the sources in the order in which they fill.

Sampling: every document of a source is expected target / size times.  The expected copies are summed along the
source, one random offset (a digest of seed and source) is added, and a document is emitted once for
each integer that its interval crosses.  The order goes by size class, then by size, so a source's words stay
near its target; the sum itself is taken per cell (source, size class, salt), and cells
are small however large the source is.  Documents of a size class that may hold over 1/LARGE of a target are
sampled first; the expected copies of the others then make up for what whole large documents came to, so that
a source with a few very long texts keeps near its target as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import materialize, md5_fraction

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Expected documents of a cell at most; more documents make more salts, of which there are at least MIN_SALTS.
CELL_ROWS = 100_000
MIN_SALTS = 16
#: Size classes with documents of more than 1/LARGE of the target are sampled before the others.
LARGE = 100
_WS = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Runs of other characters than ASCII white space; 0 for null."""
    text = text.cast("string")
    runs = F.length(F.regexp_replace(text, f"[{_WS}]*+[^{_WS}]++[{_WS}]*+", "x"))
    return F.when(text.rlike(f"[^{_WS}]"), runs.cast("long")).otherwise(F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the sources do, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes(_key, source_size)``, a row for each source, with its target."""
    # Windows over one row for each source: the only single-partition step, on as many rows as there are sources.
    place = (F.row_number().over(Window.orderBy("_key")) - 1) % len(weights)
    table = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    table = table.withColumn("_cap", F.col("source_size") * cap)
    fills = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * share
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    table = table.withColumn("_level", level).withColumn("_rank", F.row_number().over(fills))
    held = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct("_rank", "_level"))
    table = table.withColumn("_found", F.min(held).over(every)["_level"])
    return table.withColumn("target", F.least("_cap", F.coalesce(F.col("_found") * F.col("_w"), F.col("_cap")))).select("_key", "source_size", "target")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 17,
) -> DataFrame:
    """All columns of ``docs`` and ``size``, ``source_size``, ``target``, ``copies``, ``taken``, a row for each row.

    Null texts have size 0; null sources are one source; a source without words has target 0 and no
    copies.  Repeated rows are documents of their own and reruns agree up to which of two equal rows is which.  Existing
    columns of the new names are replaced.
    """
    return _mixed(docs, id_col, text_col, source_col, weights, share, cap, seed, whole=True)


def mix_sizes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: int = 17,
) -> DataFrame:
    """What ``mix_sources`` decides, with ``id_col`` and the new columns only: texts are read once."""
    return _mixed(docs, id_col, text_col, source_col, weights, share, cap, seed, whole=False)


NEW = ("size", "source_size", "target", "copies", "taken")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, cap: float, seed: int, whole: bool) -> DataFrame:
    salts = max(MIN_SALTS, -(-docs.count() // CELL_ROWS))
    # The columns of ``docs`` travel in one struct, so none of their names can clash with those used here.
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.drop(*NEW).columns if whole else [id_col])]).alias("_own")
    rows = (
        docs.select(own, F.col(id_col).alias("_id"), source_key(F.col(source_col)).alias("_key"), word_count(F.col(text_col)).alias("size"))
        .withColumn("_order", md5_fraction(F.coalesce(F.col("_id").cast("string"), F.lit(""))))
        .withColumns({"_class": F.length(F.bin("size")), "_salt": F.col("_order") % salts})
    )
    cell = ["_key", "_class", "_salt"]
    inside = Window.partitionBy(*cell).orderBy("size", "_order", "_id")
    narrow = materialize(rows.select(*([] if whole else ["_own"]), "_id", *cell, "size", "_order"), "sizes")
    ranked = narrow.withColumn("_rank", F.row_number().over(inside))
    cells = narrow.groupBy(*cell).agg(F.count("*").alias("_n"), F.sum("size").alias("_words"))
    targets = source_targets(cells.groupBy("_key").agg(F.sum("_words").alias("source_size")), weights, share, cap)
    along = Window.partitionBy("_key", "_large").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.join(targets, "_key")
        .withColumn("_large", F.pow(F.lit(2.0), F.col("_class")) * LARGE > F.col("target"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(along), F.lit(0)))
        .withColumn("_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("_offset", md5_fraction(F.concat(F.lit(f"{seed}|"), F.col("_key")), 20) / float(1 << 20))
    )

    def copies(each: Column) -> Column:
        return (F.floor(F.col("_offset") + (F.col("_base") + F.col("_rank")) * each) - F.floor(F.col("_offset") + (F.col("_base") + F.col("_rank") - 1) * each)).cast("long")

    large = ranked.select(*cell, "size", "_rank").join(cells.where("_large"), cell).groupBy("_key").agg(F.sum(copies(F.col("_each")) * F.col("size")).alias("_got"))
    small = cells.where("not _large").groupBy("_key").agg(F.sum("_words").alias("_left"))
    rest = small.join(large, "_key", "left").join(targets.select("_key", "target"), "_key")
    owed = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (F.col("target") - F.coalesce("_got", F.lit(0))) / F.greatest("_left", F.lit(1))))
    rest = rest.select("_key", F.lit(False).alias("_large"), owed.alias("_owed"))
    cells = cells.join(rest, ["_key", "_large"], "left").withColumn("_each", F.coalesce("_owed", "_each"))
    rows = rows.withColumn("_rank", F.row_number().over(inside)) if whole else ranked
    rows = rows.join(cells.select(*cell, "source_size", "target", "_base", "_each", "_offset"), cell)
    rows = rows.withColumn("copies", copies(F.col("_each"))).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("_own.*", *NEW)


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix_sources`` as often as the mix takes it, with the columns of the input only."""
    rows = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.drop("_copy", "size", "source_size", "target", "copies", "taken")


#: The same rows in DuckDB's SQL.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS ord
  FROM documents),
n AS (SELECT greatest(16, ceil(count(*) / 100000.0))::BIGINT AS salts FROM d),
r AS (SELECT d.*, length(bin(size)) AS class, ord % salts AS salt FROM d, n),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, key) AS rk,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
t AS (
  SELECT key, source_size, least(cap, coalesce((SELECT min_by(level, rk) FROM l AS x WHERE x.level <= x.cap / x.w) * w, cap)) AS target FROM l),
cl AS (
  SELECT key, class, salt, count(*) AS n, sum(size) AS words, any_value(source_size) AS source_size, any_value(target) AS target,
    any_value(pow(2.0::DOUBLE, class) * 100 > target) AS large
  FROM r JOIN t USING (key) GROUP BY key, class, salt),
c AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY key, large ORDER BY class, salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e1,
    ('0x' || substr(md5('17|' || key), 1, 5))::BIGINT / 1048576.0::DOUBLE AS off
  FROM cl),
k AS (
  SELECT r.*, c.source_size, c.target, large, e1, off, base + row_number() OVER (PARTITION BY key, class, salt ORDER BY size, ord, doc_id NULLS FIRST) AS pos
  FROM r JOIN c USING (key, class, salt)),
g AS (SELECT key, sum((floor(off + pos * e1) - floor(off + (pos - 1) * e1))::BIGINT * size) AS got FROM k WHERE large GROUP BY key),
o AS (
  SELECT c.key, greatest(0.0::DOUBLE, least(2.0::DOUBLE, (any_value(target) - coalesce(any_value(got), 0)::BIGINT) / greatest(sum(words)::BIGINT, 1))) AS e2
  FROM c LEFT JOIN g USING (key) WHERE NOT large GROUP BY c.key),
f AS (SELECT k.*, CASE WHEN large THEN e1 ELSE e2 END AS each FROM k LEFT JOIN o USING (key))
SELECT doc_id, size, source_size, target,
  (floor(off + pos * each) - floor(off + (pos - 1) * each))::BIGINT * size AS taken
FROM f
"""
