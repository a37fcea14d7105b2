"""Entity matching: rules by type, as predicates for single entities and as a blocked join for frames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions.text import NAME_FIELD, alike, normalize_text, similarity, unprefixed
from kgloom.operators.overlap import similar_pairs
from kgloom.sources.scratch import materialize


@dataclass(frozen=True)
class Rule:
    """Names at least ``threshold`` alike; ``same`` attributes equal, ``same_text`` equal after normalising, ``alike`` similar, wherever both have one.

    ``aliases``: any name or alias may match, and with ``named`` only where both have a name; ``ends``: equal first and last words of two-word names match as well.
    ``keys`` must be equal after normalising, or missing in both.  ``names``: the first of these attributes that isn't empty is the name, in place of the type's own.
    """

    threshold: float
    same: tuple[str, ...] = ()
    same_text: tuple[str, ...] = ()
    alike: tuple[tuple[str, float], ...] = ()
    aliases: bool = False
    ends: bool = False
    keys: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    named: bool = False


#: How alike entities of a type must be.
BY_TYPE = {
    "financialmetric": Rule(0.95, same_text=("DateOrPeriod", "scope")),
    "transactioncontext": Rule(0.98, same=("typeSought",), same_text=("status",)),
    "company": Rule(0.95, aliases=True),
    "operationalkpi": Rule(0.90, same_text=("kpiDateOrPeriod",)),
    "headcount": Rule(0.90, same_text=("dateOrYear",)),
    "historicalevent": Rule(0.85, same=("eventType",), same_text=("dateOrYear",)),
    "advisor": Rule(0.80, alike=(("type", 0.70),)),
    "shareholder": Rule(0.85, same=("type",)),
    "person": Rule(0.75, ends=True),
}
#: Strategies and thresholds of the page merge.
STRATEGIES = {
    "transactioncontext": ("preserve", 0.98),
    "financialmetric": ("strict", 0.95),
    "operationalkpi": ("strict", 0.90),
    "headcount": ("strict", 0.90),
    "position": ("strict", 0.90),
    "company": ("liberal", 0.70),
    "person": ("liberal", 0.75),
    "technology": ("liberal", 0.75),
    "location": ("liberal", 0.75),
    "usecaseorindustry": ("liberal", 0.75),
    "governmentbody": ("liberal", 0.80),
    "advisor": ("moderate", 0.80),
    "productorservice": ("moderate", 0.80),
    "marketcontext": ("moderate", 0.80),
    "shareholder": ("moderate", 0.85),
    "historicalevent": ("moderate", 0.85),
}
#: The attributes that hold periods and figures, and the names that metrics may go by.
PERIODS = ("DateOrPeriod", "kpiDateOrPeriod", "dateOrYear")
FIGURES = ("metricValue", "percentageValue", "headcountValue", "amount")
METRIC_NAMES = ("metricName", "kpiName", "headcountName", "name")
#: Strategy, threshold and telling attributes of each type in the stricter rule set.
KEYED = {
    "transactioncontext": ("preserve_distinct", 0.95, ("contextName", "typeSought", "status")),
    "financialmetric": ("strict_temporal_match", 0.95, ("metricName", "DateOrPeriod", "scope")),
    "operationalkpi": ("strict_temporal_match", 0.90, ("kpiName", "kpiDateOrPeriod")),
    "headcount": ("strict_temporal_match", 0.90, ("headcountName", "dateOrYear")),
    "company": ("liberal_merge", 0.70, ("name", "alias")),
    "person": ("liberal_merge", 0.75, ("fullName",)),
    "advisor": ("moderate_merge", 0.80, ("name", "type", "roleInContext")),
    "shareholder": ("moderate_merge", 0.85, ("name", "type")),
    "productorservice": ("moderate_merge", 0.80, ("name", "category")),
    "technology": ("liberal_merge", 0.75, ("name",)),
    "historicalevent": ("preserve_with_temporal_context", 0.90, ("eventName", "eventType", "dateOrYear")),
    "marketcontext": ("moderate_merge", 0.80, ("segmentName", "geography")),
    "location": ("liberal_merge", 0.75, ("locationName", "locationType")),
    "usecaseorindustry": ("liberal_merge", 0.75, ("name",)),
    "position": ("strict_merge", 0.90, ("titleName", "department")),
    "governmentbody": ("liberal_merge", 0.80, ("name", "type")),
}


def keyed_rule(kind: str) -> Rule:
    """What a type's strategy asks for."""
    how, least, keys = KEYED[kind]
    own = tuple(dict.fromkeys((NAME_FIELD.get(kind, "name"), *METRIC_NAMES)))
    return {
        "preserve_distinct": Rule(least, keys=keys, same_text=(*PERIODS, *FIGURES)),
        "strict_temporal_match": Rule(least, names=METRIC_NAMES, same_text=(*PERIODS, "scope")),
        "liberal_merge": Rule(least, names=keys[:1], aliases=True, named=True),
        "moderate_merge": Rule(least, names=own, same_text=PERIODS),
        "strict_merge": Rule(least, names=own, same_text=(*PERIODS, *FIGURES)),
        "preserve_with_temporal_context": Rule(least, names=("eventName",), same=("eventType",), same_text=("dateOrYear",)),
    }[how]


#: The stricter rule set, in which a type's strategy decides what else must agree.
BY_STRATEGY = {kind: keyed_rule(kind) for kind in KEYED}


@dataclass
class Rules:
    """``by_type`` and a rule for other types (``thresholds`` by type, or ``default``).

    ``same_type``: entities of different types never match; the literal behaviour that lets them is False.
    """

    by_type: dict[str, Rule] = field(default_factory=lambda: dict(BY_TYPE))
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.75
    same_type: bool = True

    def kind(self, entity: dict) -> str:
        return str(entity.get("type") or "").rsplit(":", 1)[-1].lower()

    def rule(self, kind: str) -> Rule:
        return self.by_type.get(kind) or Rule(self.thresholds.get(kind, self.default))


def page_rules(**options) -> Rules:
    return Rules(thresholds={k: t for k, (_, t) in STRATEGIES.items()}, default=0.75, **options)


def project_rules(**options) -> Rules:
    return Rules(default=0.8, **options)


def strategy_rules() -> Rules:
    return Rules(by_type=dict(BY_STRATEGY), default=0.80)


def plain(value: Any) -> Any:
    """The first value of a provenance list, or the value itself."""
    return value[0]["value"] if isinstance(value, list) and value and isinstance(value[0], dict) and "value" in value[0] else value


@lru_cache(maxsize=1 << 16)
def _normal(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s.-]", " ", text.lower())).strip()


def normal(value: Any) -> str:
    return _normal(str(value)) if value not in (None, "") else ""


def entity_name(entity: dict, kind: str, rule: Rule | None = None) -> str:
    if rule and rule.names:
        return normal(next((v for f in rule.names if (v := plain(entity.get(f)))), None))
    return normal(plain(entity.get(NAME_FIELD.get(kind, "name"))))


def _aliases(entity: dict) -> list[str]:
    got = plain(entity.get("alias")) or []
    return [n for n in map(normal, got if isinstance(got, list) else [got]) if n]


def entity_names(entity: dict, kind: str, rule: Rule) -> list[str]:
    """All names that an entity may be matched by."""
    name = entity_name(entity, kind, rule)
    if rule.named and not name:
        return []
    return [n for n in dict.fromkeys([name, *(_aliases(entity) if rule.aliases else [])]) if n]


def matches(new: dict, old: dict, rules: Rules) -> bool:
    """Whether a new entity is the old one; similarities take the new one's name first."""
    kind = rules.kind(new)
    if rules.same_type and kind != rules.kind(old):
        return False
    rule = rules.rule(kind)
    a, b = entity_name(new, kind, rule), entity_name(old, kind, rule)
    for k in rule.same:
        x, y = plain(new.get(k)), plain(old.get(k))
        if x and y and x != y:
            return False
    for k in rule.same_text:
        x, y = plain(new.get(k)), plain(old.get(k))
        if x and y and normal(x) != normal(y):
            return False
    for k, least in rule.alike:
        x, y = plain(new.get(k)), plain(old.get(k))
        if x and y and not alike(str(x), str(y), least):
            return False
    for k in rule.keys:
        if normal(plain(new.get(k)) or None) != normal(plain(old.get(k)) or None):
            return False
    if rule.aliases:
        return any(alike(x, y, rule.threshold) for x in entity_names(new, kind, rule) for y in entity_names(old, kind, rule))
    if not a or not b:
        return False
    p, q = a.split(), b.split()
    if rule.ends and len(p) > 1 and len(q) > 1 and p[0] == q[0] and p[-1] == q[-1]:
        return True
    return alike(a, b, rule.threshold)


def find_match(new: dict, candidates: list[dict], rules: Rules) -> dict | None:
    """The first candidate in order that matches."""
    return next((c for c in candidates if matches(new, c, rules)), None)


class MatchIndex:
    """Entities of one kind in order, by the names that they have now: finds what ``find_match`` finds among them all.

    Only entities whose names or ends could match are looked at, and a name is compared once with each other name that is long enough to be similar, however many entities have it.
    """

    #: Similar names that are kept at most, to be looked up again; they are found anew beyond.
    KEPT = 1 << 20

    def __init__(self, kind: str, rules: Rules):
        self.kind, self.rules, self.rule = kind, rules, rules.rule(kind)
        self.entities: list[dict] = []
        self.names: list[list[str]] = []
        self.ends: list[tuple | None] = []
        self.at_name: dict[str, set[int]] = {}
        self.at_ends: dict[tuple, set[int]] = {}
        self.by_length: dict[int, list[str]] = {}
        #: Name -> length -> how many names of that length it was compared with, and the similar ones.
        self.near: dict[str, dict[int, tuple[int, list[str]]]] = {}
        self.kept = 0

    def _read(self, entity: dict) -> tuple[list[str], tuple | None]:
        names = entity_names(entity, self.kind, self.rule)
        words = names[0].split() if names and self.rule.ends else []
        return [n.lower() for n in names], (words[0], words[-1]) if len(words) > 1 else None

    def _enter(self, at: int) -> None:
        for n in self.names[at]:
            if n not in self.at_name:
                self.at_name[n] = set()
                self.by_length.setdefault(len(n), []).append(n)
            self.at_name[n].add(at)
        if self.ends[at]:
            self.at_ends.setdefault(self.ends[at], set()).add(at)

    def add(self, entity: dict) -> int:
        """The place of a new last entity."""
        names, ends = self._read(entity)
        self.entities.append(entity)
        self.names.append(names)
        self.ends.append(ends)
        self._enter(len(self.entities) - 1)
        return len(self.entities) - 1

    def changed(self, at: int) -> None:
        """The entity at a place may have other names now."""
        names, ends = self._read(self.entities[at])
        if (names, ends) != (self.names[at], self.ends[at]):
            for n in self.names[at]:
                self.at_name[n].discard(at)
            if self.ends[at]:
                self.at_ends[self.ends[at]].discard(at)
            self.names[at], self.ends[at] = names, ends
            self._enter(at)

    def _similar(self, name: str) -> list[str]:
        own, least, found = len(name), self.rule.threshold, [name]
        for length, others in self.by_length.items():
            # Other names of the same length lack a character each, at least.
            if (1 - 1 / own if length == own else 2.0 * min(own, length) / (own + length)) < least - 1e-9:
                continue
            seen, near = self.near.setdefault(name, {}).get(length, (0, []))
            if seen < len(others):
                new = [n for n in others[seen:] if n != name and alike(name, n, least)]
                self.kept += len(new) + 1
                near = near + new
                self.near[name][length] = len(others), near
            found += near
        if self.kept > self.KEPT:
            self.near, self.kept = {}, 0
        return found

    def find(self, new: dict) -> int | None:
        """The place of the first entity that a new one matches."""
        if self.rule.threshold <= 0:
            places = range(len(self.entities))
        else:
            names, ends = self._read(new)
            places = {at for n in names for m in self._similar(n) for at in self.at_name.get(m, ())}
            places = sorted(places | self.at_ends.get(ends, set()))
        return next((at for at in places if matches(new, self.entities[at], self.rules)), None)


def fuzzy_first_match(new: DataFrame, candidates: DataFrame, threshold: float, block: list[str] | None = None) -> DataFrame:
    """``(id, match_id, score)``: for each of ``new(id, name, ord)`` the first of ``candidates(id, name, ord)`` at least ``threshold`` alike.

    Names meet in the lists of an overlap join (``similar_pairs``) and in the given block columns; its bounds, which as the similarity don't tell cases apart, drop pairs on the JVM's side
    before the similarity is computed.  Each distinct pair of names is compared once.
    """
    block = block or []
    pairs = similar_pairs(new.select(*block, F.col("name").alias("a")), candidates.select(*block, F.col("name").alias("b")), threshold, block)
    pairs = pairs.withColumn("score", similarity("a", "b")).where(F.col("score") >= threshold - 1e-12)
    first = candidates.groupBy(*block, F.col("name").alias("b")).agg(F.min_by("id", "ord").alias("match_id"), F.min("ord").alias("match_ord"))
    best = pairs.join(first, [*block, "b"]).groupBy(*block, F.col("a").alias("name")).agg(F.min_by(F.struct("match_id", "score"), "match_ord").alias("m"))
    return new.join(best, [*block, "name"]).select("id", "m.match_id", "m.score")


# ---- rules as columns -------------------------------------------------------------------------------------------


def _present(rows: DataFrame, name: str) -> Column:
    """An attribute as text, null where it is missing, empty or 0."""
    if name not in rows.columns:
        return F.lit(None).cast("string")
    col = F.col(f"`{name}`")
    empty = (col == 0) if isinstance(rows.schema[name].dataType, T.NumericType) else (col.cast("string") == "")
    return F.when(~empty, col.cast("string"))


def rule_features(rows: DataFrame, rules: Rules, kinds: list[str]) -> DataFrame:
    """``rows(id, type, ord, attributes...)`` as ``(id, ord, kind, f)``: what the rule of each of ``kinds`` reads, as columns; other kinds are left out.

    ``f``: the names to match by, the first and last word of the name, and lists of the attributes to be equal, equal after normalising, equal or both missing, and similar.
    """
    kind = unprefixed(F.col("type"))
    normal_text = lambda c: F.when(c.isNotNull(), normalize_text(c))
    array = lambda cols: F.array(*cols).cast("array<string>")

    def features(k: str) -> Column:
        rule = rules.rule(k)
        own = F.coalesce(*[_present(rows, n) for n in rule.names or (NAME_FIELD.get(k, "name"),)])
        name = F.nullif(normalize_text(own), F.lit(""))
        more = F.array().cast("array<string>")
        if rule.aliases and "alias" in rows.columns:
            more = F.coalesce(F.transform(F.col("alias").cast("array<string>"), normalize_text), more)
        names = F.array_distinct(F.filter(F.concat(F.array(name), more), lambda x: F.coalesce(x != "", F.lit(False))))
        words = F.split(name, " ")
        return F.struct(
            (F.when(name.isNotNull(), names).otherwise(F.array().cast("array<string>")) if rule.named else names).alias("names"),
            (F.when(F.size(words) > 1, F.array(words[0], F.element_at(words, -1))) if rule.ends else F.lit(None).cast("array<string>")).alias("ends"),
            array([_present(rows, a) for a in rule.same]).alias("same"),
            array([normal_text(_present(rows, a)) for a in rule.same_text]).alias("text"),
            array([F.coalesce(normal_text(_present(rows, a)), F.lit("")) for a in rule.keys]).alias("keys"),
            array([_present(rows, a) for a, _ in rule.alike]).alias("near"),
        )

    chosen = F.lit(None)
    for k in kinds:
        chosen = F.when(kind == k, features(k)).otherwise(chosen)
    return rows.where(kind.isin(kinds)).select("id", "ord", kind.alias("kind"), chosen.alias("f"))


def features_agree(new: Column, old: Column) -> Column:
    """Whether two rows of ``rule_features`` agree in all but the names and what must be similar."""
    both = lambda k: F.forall(F.zip_with(new[k], old[k], lambda x, y: x.isNull() | y.isNull() | (x == y)), lambda z: z)
    return both("same") & both("text") & (new["keys"] == old["keys"])


def first_rule_match(new: DataFrame, old: DataFrame, rules: Rules, kinds: list[str]) -> DataFrame:
    """``(id, match_id)``: for each of ``new(id, type, ord, attributes...)`` the first of ``old`` by ``ord`` that its type's rule matches.

    Attributes are columns, ``alias`` an array of texts.  Rows with the same features are decided once.  Names meet by an overlap join, or by their ends; all else is
    compared on the JVM's side, and Python computes similarities only.
    """
    a, b = rule_features(new, rules, kinds), rule_features(old, rules, kinds)
    key = F.md5(F.to_json(F.struct("kind", "f"))).alias("k")
    a = materialize(a.select("id", "kind", "f", key), "features")
    seen = materialize(b.select("id", "ord", "kind", "f", key).groupBy("k").agg(F.first("kind").alias("kind"), F.first("f").alias("f"), F.min_by("id", "ord").alias("match_id"), F.min("ord").alias("match_ord")), "features")
    asked = materialize(a.groupBy("k").agg(F.first("kind").alias("kind"), F.first("f").alias("f")), "features")
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(rules.rule(k).threshold)) for k in kinds])
    names = lambda df, k, n: df.select(F.col("k").alias(k), "kind", F.explode("f.names").alias(n))
    p, q = names(asked, "p", "a"), names(seen, "q", "b")
    pairs = similar_pairs(p.select("kind", "a"), q.select("kind", "b"), least, ["kind"])
    pairs = pairs.where((F.col("a") == F.col("b")) | (similarity("a", "b") >= least))
    met = p.join(pairs, ["kind", "a"]).join(q, ["kind", "b"]).select("p", "q")
    ended = [k for k in kinds if rules.rule(k).ends]
    if ended:
        ends = lambda df, k: df.where(F.col("kind").isin(ended)).where("f.ends is not null").select(F.col("k").alias(k), "kind", F.col("f.ends").alias("ends"))
        met = met.unionByName(ends(asked, "p").join(ends(seen, "q"), ["kind", "ends"]).select("p", "q"))
    left, right = asked.select(F.col("k").alias("p"), "kind", F.col("f").alias("x")), seen.select(F.col("k").alias("q"), F.col("f").alias("y"), "match_id", "match_ord")
    fits = met.distinct().join(left, "p").join(right, "q").where(features_agree(F.col("x"), F.col("y")))
    for k in kinds:
        for i, (_, thr) in enumerate(rules.rule(k).alike):
            u, v = F.col("x.near")[i], F.col("y.near")[i]
            score = similarity(F.when((F.col("kind") == k) & v.isNotNull(), u), F.when(F.col("kind") == k, v))
            fits = fits.withColumn("_s", score).where((F.col("kind") != k) | u.isNull() | v.isNull() | (F.col("_s") >= thr)).drop("_s")
    best = fits.groupBy("p").agg(F.min_by("match_id", "match_ord").alias("match_id"))
    return a.select("id", F.col("k").alias("p")).join(best, "p").select("id", "match_id")


def metric_company(relations: DataFrame, entities: DataFrame, types: tuple[str, ...] = ("reportsMetric", "reportsHeadcount", "reportsOperationalKPI", "reportsFinancialMetric")) -> DataFrame:
    """``(metric_id, company_id)``: the source of the first reporting relation of each metric that is a company."""
    kind = F.substring_index("type", ":", -1)
    rels = relations.where(kind.isin(*types)).select("source", "target", "ord")
    companies = entities.where(F.lower(F.substring_index("type", ":", -1)) == "company").select(F.col("id").alias("source"))
    return rels.join(companies, "source", "left_semi").groupBy(F.col("target").alias("metric_id")).agg(F.min_by("source", "ord").alias("company_id"))


def person_token_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(id, match_id)``: names of two words or more with equal first and last words, the first match by order."""
    ends = lambda df, i, o: df.where(F.size(F.split("name", " ")) >= 2).select(F.col("id").alias(i), F.col("ord").alias(o), F.split("name", " ")[0].alias("head"), F.element_at(F.split("name", " "), -1).alias("tail"))
    firsts = ends(b, "match_id", "o2").groupBy("head", "tail").agg(F.min_by("match_id", "o2").alias("match_id"))
    return ends(a, "id", "o1").join(firsts, ["head", "tail"]).select("id", "match_id")


