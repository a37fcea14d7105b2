"""The pairs of names that may be similar: an overlap join over numbered characters that loses no pair.

A similarity of t leaves at most d = (1 - t) * (la + lb) characters of two names unmatched, and its matched characters are in order, so one name
becomes the other by at most d insertions and deletions, and the names share at least (la + lb - d) / 2 characters, counted with their multiplicity.

* Of two names the longer has e characters more and floor((d - e) / 2) of the shorter are left over at most. Where that is one at most and the longer has two at most, names meet by what is left
  when just so many are deleted from each. Keys hold both lengths and which side is the shorter, so only names that are to meet do.
* Elsewhere names meet by pairs of rare characters.  A character is numbered within its name (the first ``a`` is ``a0``, the next ``a1``), and all are put into one order, rarest
  first.  Names that share n of them share two among the first l - n + 2, so each name is listed under the pairs of its first ones only.

What the lists propose is then held to the bounds by length, by characters and by neighbouring characters, all on the JVM's side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import SHORT, length_bound, multiset_bound, numbered, runs_bound, similarity
from kgloom.sources.scratch import materialize

#: Numbered characters with a rank by their frequency; all others count as rarer.
RANKED = 256
#: Names whose pairs share a partition.
PART_NAMES = 8192
_EPS = 1e-9


def _left_over(threshold: Column, letters: Column) -> Column:
    """Characters that may stay unmatched in two names of so many letters."""
    return F.floor((1 - threshold) * letters + _EPS)


def frequent(names: DataFrame, column: str, most: int = RANKED) -> list[str]:
    """The most frequent numbered characters, the most frequent first; ``most`` of them at most reach the driver."""
    counts = names.select(F.explode(numbered(F.split(F.lower(column), ""))).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return [r["c"] for r in counts.orderBy(F.desc("n"), "c").limit(most).collect()]


def _without(x: Column, length: Column, i: Column) -> Column:
    return F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, length))


def _deleted(x: Column, length: Column, n: Column) -> Column:
    """What is left of the name without ``n`` of its characters, 0, 1 or 2, wherever they are."""
    one = F.transform(F.sequence(F.lit(1), length), lambda i: _without(x, length, i))
    two = F.flatten(F.transform(F.sequence(F.lit(1), length - 1), lambda i: F.transform(F.sequence(i, length - 1), lambda k: _without(_without(x, length, i), length, k))))
    return F.when(n == 0, F.array(x)).when(n == 1, F.array_distinct(one)).when(length > 1, F.array_distinct(two)).otherwise(F.array(F.lit("")))


def _pairs_of_rare(x: Column, length: Column, threshold: Column, ranks: list[str]) -> Column:
    rank = lambda c: F.lit(len(ranks) + 1) - F.when(F.array_position(F.lit(ranks), c) > 0, F.array_position(F.lit(ranks), c)).otherwise(F.lit(len(ranks) + 1))
    # One more character that all names have, the most frequent of all: names that must share a single one share it as well.
    rows = F.array_append(F.transform(numbered(F.split(x, "")), lambda c: F.struct(rank(c).cast("int").alias("r"), c.alias("c"))), F.struct(F.lit(1 << 30).alias("r"), F.lit("").alias("c")))
    shared = F.ceil(length * threshold / (2 - threshold) - _EPS)
    first = F.transform(F.slice(F.sort_array(rows), F.lit(1), (length - shared + 2).cast("int")), lambda s: s["c"])
    pairs = F.element_at(
        F.transform(F.array(first), lambda p: F.flatten(F.transform(p, lambda c, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda e: F.concat(F.lit("p"), c, F.lit("\0"), e))))), 1
    )
    return pairs


def _spared(threshold: Column, short: Column, long: Column) -> Column:
    """Characters of the shorter of two names that may be left over; below 0 the names can't be similar."""
    return F.floor((_left_over(threshold, short + long) - (long - short)) / 2)


def _by_deleting(threshold: Column, short: Column, long: Column) -> Column:
    """Whether names of these lengths meet by what is left of them."""
    spared = _spared(threshold, short, long)
    return (spared <= 1) & (spared + long - short <= 2)


def listed(names: DataFrame, column: str, threshold: Column, ranks: list[str], lengths: list[int], left: bool) -> DataFrame:
    """``names`` with a row for each ``_key`` that it is listed under among names of the given lengths, and its ``_len``."""
    x, rows = F.lower(F.col(column)), names.withColumn("_len", F.length(F.lower(F.col(column))))
    n = F.col("_len")
    none = F.array().cast("array<string>")
    rare = _pairs_of_rare(x, n, threshold, ranks)

    def met(m: Column) -> Column:
        """Keys for names of m letters; those whose own length meets by deleting must not meet each other in the lists of rare pairs, which are many."""
        short, long = F.least(n, m), F.greatest(n, m)
        spared, role = _spared(threshold, short, long), F.when(n == m, "=").when((n < m) == F.lit(left), "<").otherwise(">")
        head = F.concat_ws(":", short.cast("string"), long.cast("string"), role, F.lit(""))
        gone = F.when(n <= m, spared).otherwise(spared + long - short)
        keys = F.when(_by_deleting(threshold, short, long), F.transform(_deleted(x, n, gone), lambda k: F.concat(F.lit("d"), head, k)))
        return keys.when(_by_deleting(threshold, short, short), F.transform(rare, lambda k: F.concat(head, k))).otherwise(none)

    partners = F.filter(F.lit(lengths).cast("array<int>"), lambda m: _spared(threshold, F.least(n, m), F.greatest(n, m)) >= 0)
    plain = F.exists(partners, lambda m: ~_by_deleting(threshold, F.least(n, m), F.greatest(n, m)) & ~_by_deleting(threshold, F.least(n, m), F.least(n, m)))
    return rows.where(n > 0).withColumn("_key", F.explode(F.array_distinct(F.concat(F.flatten(F.transform(partners, met)), F.when(plain, rare).otherwise(none)))))


def with_partners(names: DataFrame, column: str, threshold: Column, block: list[str]) -> DataFrame:
    """Those of distinct lower-case ``names`` that another one in the block could be similar to, as far as the lengths of all names tell; ``threshold`` is as in ``similar_pairs``."""
    names = names.withColumn("_n", F.length(F.lower(column)))
    sizes = names.groupBy(*block, "_n").agg(F.count("*").alias("_c"))
    spared = _spared(threshold, F.least("_n", "_m"), F.greatest("_n", "_m"))
    met = sizes.join(sizes.select(*block, F.col("_n").alias("_m")), block).where((spared >= F.when(F.col("_n") == F.col("_m"), 1).otherwise(0)) & ((F.col("_n") != F.col("_m")) | (F.col("_c") > 1)))
    return names.join(F.broadcast(met.select(*block, "_n").distinct()), [*block, "_n"], "left_semi").drop("_n")


def met_pairs(new: DataFrame, old: DataFrame, threshold: float | Column, block: list[str] | None = None, only: Column | None = None) -> DataFrame:
    """``(block..., a, b)``: the distinct pairs of ``similar_pairs`` before its bounds; of ``only`` those that it holds for, which leaves the others out where they meet."""
    block = block or []
    least = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    a, b = new.select(*block, "a").where("a <> ''").distinct(), old.select(*block, "b").where("b <> ''").distinct()
    ranks = frequent(b.select("b"), "b")
    sizes = lambda names, c: {r["n"]: r["count"] for r in names.groupBy(F.length(F.lower(F.col(c))).alias("n")).count().collect()}  # noqa: E731  a row for each length
    in_a, in_b = sizes(a, "a"), sizes(b, "b")
    parts = max(int(new.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(in_a.values()) // PART_NAMES))
    # Names are few bytes and their lists many, so they keep their partitions too, and lists are never broadcast by the names' size.
    left = listed(a.repartition(parts, "a"), "a", least, ranks, list(in_b), True).withColumnRenamed("_len", "_la")
    right = listed(b.repartition(parts, "b"), "b", least, ranks, list(in_a), False).withColumnRenamed("_len", "_lb").hint("merge")
    near = 2.0 * F.least("_la", "_lb") >= (least - _EPS) * (F.col("_la") + F.col("_lb"))
    met = left.join(right, [*block, "_key"]).where(near if only is None else near & only).select(*block, "a", "b")
    # Pairs are few bytes and much work, so they keep their partitions, which make them distinct as well and are more for more names.
    return met.repartition(parts, "a", "b").distinct()


def similar_pairs(new: DataFrame, old: DataFrame, threshold: float | Column, block: list[str] | None = None) -> DataFrame:
    """``(block..., a, b)``: the distinct pairs of ``new(block..., a)`` and ``old(block..., b)`` whose bounds allow ``threshold`` (above 0).

    ``threshold`` may be an expression of the block's columns.  Cases don't count.  A list's pairs are joined where it lies and may be split by adaptive execution; each
    pair is checked once, however many lists it is in.
    """
    least = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    # They are written, as the optimizer would move the bounds below ``distinct``, into the join, to be computed once for each list that a pair is in.
    met = materialize(met_pairs(new, old, threshold, block), "met")
    a, b = F.col("a"), F.col("b")
    bounds = [length_bound(a, b), multiset_bound(a, b), runs_bound(a, b)]
    return met.where((F.lower(a) == F.lower(b)) | ((bounds[0] >= least - _EPS) & (bounds[1] >= least - _EPS) & (bounds[2] >= least - _EPS)))


def scored_pairs(names: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, score)``: the pairs ``a < b`` of ``names(a)`` whose similarity is ``threshold`` at least.

    Short names' similarity costs less than its bounds, so pairs are compared as they meet, and aren't written.
    """
    met = met_pairs(names, names.withColumnRenamed("a", "b"), threshold, only=F.col("a") < F.col("b"))
    a, b, least = F.col("a"), F.col("b"), threshold - _EPS
    long = F.greatest(F.length(F.lower(a)), F.length(F.lower(b))) > SHORT
    bounds = [length_bound(a, b) >= least, multiset_bound(a, b) >= least, runs_bound(a, b) >= least]
    # Not deterministic to the optimizer, so that it doesn't compare below ``distinct``, once for each list.
    score = F.pandas_udf(similarity.func, "double").asNondeterministic()
    return met.withColumn("_may", F.when(long & (F.lower(a) != F.lower(b)), bounds[0] & bounds[1] & bounds[2]).otherwise(True)).where("_may").select("a", "b", score("a", "b").alias("score")).where(F.col("score") >= threshold)
