"""The ordered first-match merge across tasks: the result of ``fold_entities`` without a task that holds a group.

The fold takes entities in order and puts each into the first earlier one that it matches; names grow while it goes on, so what an entity matches is known only when
its turn comes.  But it can only ever match an entity whose name is that of one of its members, and a decision depends on the few attributes that its rule
reads.  So:

1. Rows with the same such attributes (a *signature*) are decided alike as long as nothing changes.  Signatures whose names could match, by an overlap join, are linked, and
   connected components of these links never meet.  A component with one signature needs no decision at all.
2. A component is settled on its signatures, not on its rows.  Between two *events* (an entity is founded, or what a rule reads of one changes) every signature goes to the same
   entity, so the next event is the next row of a signature that would cause one.  A task therefore needs only the next LOOK_AHEAD rows of each signature; where an
   event depends on a row beyond them, the component goes on in the next round from where it stopped, until all are settled.
3. The outcome is, for each signature, from which row on it goes where: a few intervals, to which all rows are joined.  Values are made distinct by (entity, key) before they are
   merged, in the order of their first and last rows.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions.text import NAME_FIELD, ratio
from kgloom.operators.components import connected_components
from kgloom.operators.graph import ordered_index
from kgloom.operators.match import Rules, entity_names, matches, plain
from kgloom.operators.merge import merged_value
from kgloom.operators.overlap import similar_pairs, with_partners
from kgloom.sources.scratch import materialize

#: Rows of each signature that a round looks ahead.
LOOK_AHEAD = 64
#: JSON as ``attrs_json`` and signatures have it.
_text = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


def read_by(rules: Rules, kind: str) -> set[str]:
    """The attributes that the rule of a type reads, and ``type``."""
    rule = rules.rule(kind)
    fields = {*(rule.names or (NAME_FIELD.get(kind, "name"),)), *rule.same, *rule.same_text, *rule.keys, *(k for k, _ in rule.alike)} - {"type"}
    return fields | ({"alias"} if rule.aliases else set())


def signature(entity: dict, rules: Rules, read: dict[str, set[str]] | None = None) -> tuple[str, list[str]]:
    """What decides an entity's matches, as JSON, and the names that it can be matched by.  ``read`` keeps ``read_by`` from entity to entity."""
    kind, read = rules.kind(entity), {} if read is None else read
    if kind not in read:
        read[kind] = read_by(rules, kind)
    own = {k: entity[k] for k in read[kind] if k in entity} | {"type": entity["type"]}
    return _text(own), entity_names(entity, kind, rules.rule(kind))


class Settling:
    """The entities of one component as far as they are settled: what a rule reads of them, by their founding rows.

    ``near``: names that each name could match, itself left out.
    """

    def __init__(self, rules: Rules, documents: bool, signatures: dict[int, dict], near: dict[str, set[str]], state: list | None = None):
        self.rules, self.documents, self.signatures, self.near = rules, documents, signatures, near
        self.named: dict[str, set[int]] = defaultdict(set)
        self.ended: dict[tuple, set[int]] = defaultdict(set)
        self.names = {s: self._names(body) for s, body in signatures.items()}
        for s, names in self.names.items():
            for n in names:
                self.named[n].add(s)
            self.ended[self._ends(signatures[s], names)].add(s)
        self.founders: list[int] = []
        self.bodies: list[dict] = []
        #: Places of entities by the names and the ends that they have now.
        self.at_name: dict[str, set[int]] = defaultdict(set)
        self.at_ends: dict[tuple, set[int]] = defaultdict(set)
        #: Signature -> place of the entity it goes to now (missing where it would found one), and the other way.
        self.goes: dict[int, int] = {}
        self.comes: dict[int, set[int]] = defaultdict(set)
        for founder, body in state or []:
            self._place(len(self.founders), body, founder)
        for s in signatures:
            self._decide(s, 0)

    def state(self) -> list:
        return [list(x) for x in zip(self.founders, self.bodies, strict=True)]

    def _names(self, body: dict) -> list[str]:
        kind = self.rules.kind(body)
        return entity_names(body, kind, self.rules.rule(kind))

    def _ends(self, body: dict, names: list[str]) -> tuple | None:
        words = names[0].split() if names and self.rules.rule(self.rules.kind(body)).ends else []
        return (words[0], words[-1]) if len(words) > 1 else None

    def _place(self, at: int, body: dict, founder: int | None = None) -> None:
        if founder is None:
            old = self._names(self.bodies[at])
            for n in old:
                self.at_name[n].discard(at)
            self.at_ends[self._ends(self.bodies[at], old)].discard(at)
            self.bodies[at] = body
        else:
            self.founders.append(founder)
            self.bodies.append(body)
        names = self._names(body)
        for n in names:
            self.at_name[n].add(at)
        self.at_ends[self._ends(body, names)].add(at)

    def _decide(self, s: int, start: int) -> None:
        """The first entity from place ``start`` on that the signature matches."""
        own, names = self.signatures[s], self.names[s]
        places = {at for n in names for m in {n} | self.near.get(n, set()) for at in self.at_name.get(m, ())}
        if (ends := self._ends(own, names)) is not None:
            places |= self.at_ends.get(ends, set())
        found = next((at for at in sorted(places) if at >= start and matches(own, self.bodies[at], self.rules)), None)
        if s in self.goes:
            self.comes[self.goes.pop(s)].discard(s)
        if found is not None:
            self.goes[s] = found
            self.comes[found].add(s)

    def _after(self, s: int) -> dict:
        """What is read of the signature's entity after it has joined."""
        body, own = self.bodies[self.goes[s]], self.signatures[s]
        if not self.documents:
            return body | {k: merged_value(k, body.get(k), v) for k, v in own.items()}
        first = {k: [{"value": v}] for k, v in own.items() if k != "type" and k not in body}
        return body | first | ({"type": own["type"]} if len(own["type"]) > len(body["type"]) else {})

    def eventful(self, s: int) -> bool:
        """Whether a row of the signature would change anything that a match reads."""
        return s not in self.goes or self._after(s) != self.bodies[self.goes[s]]

    def happen(self, s: int, row: int) -> set[int]:
        """A row of an eventful signature; the signatures that may be decided otherwise from now on."""
        if s in self.goes:
            at = self.goes[s]
            self._place(at, self._after(s))
        else:
            at = len(self.founders)
            self._place(at, {k: [{"value": v}] if self.documents and k != "type" else v for k, v in self.signatures[s].items()}, row)
        names = self._names(self.bodies[at])
        touched = {s} | self.comes[at] | {x for n in names for m in {n} | self.near.get(n, set()) for x in self.named.get(m, ())}
        if (ends := self._ends(self.bodies[at], names)) is not None:
            touched |= self.ended.get(ends, set())
        for x in touched:
            if self.goes.get(x, at) >= at:
                self._decide(x, at)
        return touched


def settle(process: Settling, ahead: dict[int, list[int]], whole: dict[int, bool], position: int) -> tuple[list[tuple[int, int, int]], int | None]:
    """``(signature, from row, founding row)`` of all that is decided after ``position``, and the row to go on after, or None at the end.

    ``ahead``: the next rows of each signature in order; ``whole``: whether those are all that are left.
    """
    out: list[tuple[int, int, int]] = []
    said: dict[int, int] = {}
    place = dict.fromkeys(ahead, 0)
    queue: list[tuple[int, int]] = []
    #: Eventful signatures whose next row is beyond what is known.
    blind: set[int] = set()

    def say(s: int, row: int) -> None:
        if s in process.goes and said.get(s) != (founder := process.founders[process.goes[s]]):
            said[s] = founder
            out.append((s, row, founder))

    def plan(s: int) -> None:
        """Put the next row of a signature into the queue if it would be an event."""
        blind.discard(s)
        if process.eventful(s):
            rows = ahead[s]
            while place[s] < len(rows) and rows[place[s]] <= position:
                place[s] += 1
            if place[s] < len(rows):
                heapq.heappush(queue, (rows[place[s]], s))
            elif not whole[s]:
                blind.add(s)

    for s in ahead:
        say(s, position + 1)
        plan(s)
    while True:
        while queue and (queue[0][0] <= position or not process.eventful(queue[0][1])):
            plan(heapq.heappop(queue)[1])
        # A blind signature may have a row right after the last that is known of it.
        stop = min((max(position, ahead[s][-1] if ahead[s] else position) for s in blind), default=None)
        if stop is not None and (not queue or queue[0][0] > stop):
            return out, stop
        if not queue:
            return out, None
        position, s = heapq.heappop(queue)
        founds = s not in process.goes
        touched = process.happen(s, position)
        if founds:
            said[s] = position
            out.append((s, position, position))
        for x in touched:
            say(x, position + 1)
            plan(x)


def _signed(entities: DataFrame, rules: Rules) -> DataFrame:
    """``entities(..., id, type, attrs_json)`` with their signatures ``sig`` and ``names``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, set[str]] = {}
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("id", "type", "attrs_json")), strict=True)
            found = [signature({**json.loads(a or "{}"), "id": i, "type": t}, rules, read) for i, t, a in rows]
            more = [pa.array([s for s, _ in found], pa.string()), pa.array([n for _, n in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "sig", "names"])

    return entities.mapInArrow(sign, T.StructType([*entities.schema.fields, T.StructField("sig", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))]))


def _threshold(rules: Rules, kinds: list[str]):
    least = F.lit(rules.default)
    for k in kinds:
        least = F.when(F.col("kind") == k, F.lit(rules.rule(k).threshold)).otherwise(least)
    return least


def linked_signatures(signatures: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` between ``signatures(sid, grp, kind, names)`` that could match, and the pairs of their names ``(least, a, b)``.

    A signature is linked with the least one of each of its names and of its ends, and the least ones of similar names with each other, so links are as many as names and pairs
    of names.
    """
    kinds = sorted({*rules.by_type, *rules.thresholds})
    named = signatures.select("sid", "grp", "kind", F.explode("names").alias("name"))
    least = materialize(named.groupBy("grp", "kind", "name").agg(F.min("sid").alias("least"), F.count("*").alias("n")), "names")
    own = named.join(least.where("n > 1"), ["grp", "kind", "name"]).select(F.col("sid").alias("a"), F.col("least").alias("b"))

    @F.pandas_udf("double")
    def either_way(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max(ratio(x, y), ratio(y, x)) for x, y in zip(a, b, strict=True)])

    block = ["grp", "kind"]
    # Most names are numbers and the like, which only equal ones are similar to: those meet above.
    least = materialize(with_partners(least, "name", _threshold(rules, kinds), ["kind"]), "partners")
    pairs = similar_pairs(least.select(*block, F.col("name").alias("a")), least.select(*block, F.col("name").alias("b")), _threshold(rules, kinds), block).where("a < b")
    pairs = materialize(pairs.where(either_way("a", "b") >= _threshold(rules, kinds) - 1e-12), "pairs")
    ids = lambda c: least.select(*block, F.col("name").alias(c), F.col("least").alias(f"{c}_id"))
    close = pairs.join(ids("a"), [*block, "a"]).join(ids("b"), [*block, "b"]).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    links = own.unionByName(close)
    by_ends = [k for k in kinds if rules.rule(k).ends]
    if by_ends:
        words = F.split("name", " ")
        ends = named.where(F.col("kind").isin(by_ends) & (F.size(words) > 1)).select("sid", *block, F.get(words, F.lit(0)).alias("head"), F.element_at(words, -1).alias("tail"))
        first = ends.groupBy(*block, "head", "tail").agg(F.min("sid").alias("b"))
        links = links.unionByName(ends.join(first, [*block, "head", "tail"]).select(F.col("sid").alias("a"), "b"))
    return materialize(links.where("a <> b").distinct(), "links"), pairs.join(ids("a"), [*block, "a"]).select(F.col("a_id").alias("least"), "a", "b")


def _round(sigs: DataFrame, ahead: DataFrame, pairs: DataFrame, state: DataFrame, rules: Rules, documents: bool, look: int) -> DataFrame:
    """One round of all components that are open: rows of ``(component, sid, start, founder, state, position)``, where those with a state are the components' own."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        signatures, rows, whole = {}, {}, {}
        for sid, sig, known, left_over in left[["sid", "sig", "known", "left_over"]].itertuples(index=False):
            signatures[sid], rows[sid] = json.loads(sig), sorted(map(int, known)) if known is not None else []
            whole[sid] = len(rows[sid]) < look or int(left_over) <= look
        before = right[right["state"].notna()]
        near = defaultdict(set)
        for a, b in right.loc[right["state"].isna(), ["a", "b"]].itertuples(index=False):
            near[a].add(b)
            near[b].add(a)
        position, state = (int(before["position"].iloc[0]), json.loads(before["state"].iloc[0])) if len(before) else (-1, None)
        process = Settling(rules, documents, signatures, near, state)
        decided, stopped = settle(process, rows, whole, position)
        out = [(key[0], s, start, founder, None, None) for s, start, founder in decided]
        out.append((key[0], None, None, None, json.dumps(process.state(), ensure_ascii=False), stopped))
        frame = pd.DataFrame(out, columns=["component", "sid", "start", "founder", "state", "position"])
        return frame.astype({c: "Int64" for c in ("sid", "start", "founder", "position")})

    left = sigs.join(ahead, "sid", "left").select("component", "sid", "sig", "known", F.coalesce("left_over", F.lit(0)).alias("left_over"))
    right = pairs.select("component", "a", "b", F.lit(None).cast("string").alias("state"), F.lit(None).cast("long").alias("position"))
    right = right.unionByName(state.select("component", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "state", "position"))
    return left.groupBy("component").cogroup(right.groupBy("component")).applyInPandas(run, "component long, sid long, start long, founder long, state string, position long")


def settled(rows: DataFrame, rules: Rules, documents: bool = False, look_ahead: int = LOOK_AHEAD, base: DataFrame | None = None) -> DataFrame:
    """``rows`` (of ``_signed``, with ``pos``) with the founding row of the entity that each is merged into, as ``founder``; ``single``: the row is known to be its entity's only one.

    ``base(sid, grp, kind, sig, names)``: entities that are there already, what their rules read as JSON, numbered before all rows.
    """
    if not rules.same_type:
        raise ValueError("entities of different types meet: use folded")
    key = ["grp", "kind", "sig"]
    bare = rows.where(F.size("names") == 0).withColumns({"founder": F.col("pos"), "single": F.lit(True)})  # without a name nothing matches
    rows = rows.where(F.size("names") > 0)
    sigs = materialize(rows.groupBy(*key, "names").agg(F.min("pos").alias("sid"), F.count("*").alias("times")), "signatures")
    known = sigs.drop("times")
    known = known if base is None else known.unionByName(base.where(F.size("names") > 0).select(*known.columns))
    links, pairs = linked_signatures(known, rules)
    parts = connected_components(links)
    open_ = materialize(sigs.select(*key, "sid").join(parts.withColumnRenamed("node", "sid"), "sid"), "open")
    pairs = materialize(pairs.join(parts.withColumnRenamed("node", "least"), "least").select("component", "a", "b"), "pairs")
    # Rows of other signatures need no decision.
    narrow = materialize(rows.select(*key, "pos").join(open_, key).select("sid", "pos"), "rows")
    spark = rows.sparkSession
    state = spark.createDataFrame([], "component long, state string, position long")
    if base is not None:
        there = base.select("sid", "sig").join(parts.withColumnRenamed("node", "sid"), "sid").join(open_.select("component").distinct(), "component", "left_semi")
        listed = F.transform(F.array_sort(F.collect_list(F.struct("sid", "sig"))), lambda x: F.concat(F.lit("["), x["sid"].cast("string"), F.lit(","), x["sig"], F.lit("]")))
        state = there.groupBy("component").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("state"), F.max("sid").alias("position"))
        state = materialize(state, "state")
    decided = None
    while True:
        after = narrow.join(open_.select("sid", "component"), "sid").join(state.select("component", "position"), "component", "left").where(F.col("pos") > F.coalesce("position", F.lit(-1)))
        next_ = Window.partitionBy("sid").orderBy("pos")
        known = after.withColumn("k", F.row_number().over(next_)).where(F.col("k") <= look_ahead).groupBy("sid").agg(F.collect_list("pos").alias("known"))
        ahead = known.join(after.groupBy("sid").agg(F.count("*").alias("left_over")), "sid")
        got = materialize(_round(open_, ahead, pairs, state, rules, documents, look_ahead), "settled")
        new = got.where("state is null").select("sid", "start", "founder")
        decided = new if decided is None else decided.unionByName(new)
        state = got.where("state is not null and position is not null").select("component", "state", "position")
        if state.isEmpty():
            break
        open_, pairs = (materialize(x.join(state.select("component"), "component", "left_semi"), "open") for x in (open_, pairs))
    spans = decided.groupBy("sid", "start").agg(F.max("founder").alias("founder")).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("start", "founder"))).alias("spans"))
    spans = materialize(spans, "spans")
    found = rows.drop("names").join(sigs.select(*key, "sid", "times"), key).join(spans, "sid", "left")
    founder = F.element_at(F.filter("spans", lambda x: x["start"] <= F.col("pos")), -1)["founder"]
    found = found.withColumn("founder", F.when(F.col("spans").isNull(), F.col("sid")).otherwise(founder)).withColumn("single", F.col("spans").isNull() & (F.col("times") == 1))
    return found.drop("sid", "times", "spans", "sig").unionByName(bare.drop("names", "sig"))


#: Places of values within one row.
STEP = 1 << 20


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    for b in batches:
        yield list(zip(*(c.to_pylist() for c in b.columns), strict=True))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _own(attrs: str | None, documents: bool) -> dict[str, str]:
    """A row's attributes, each as JSON."""
    return {k: _text(v) for k, v in json.loads(attrs or "{}").items() if k not in ("id", "type") and not (documents and k == "_source_document_ids")}


def _values(documents: bool):
    """``(founder, key, value, first, last, at)`` of rows: each attribute as JSON; ``type`` and the row's own document come under keys that no attribute has.

    What repeats within a batch comes once, with its first and last place.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            seen: dict[tuple, list[int]] = {}
            for founder, pos, at, kind, attrs in rows:
                pos *= STEP
                for key, value in [*_own(attrs, documents).items(), ("\0type", _text(kind)), ("\0at", _text(at))]:
                    place = seen.setdefault((founder * STEP, key, value, at if documents and key[:1] != "\0" else None), [pos, pos])
                    place[0], place[1] = min(place[0], pos), max(place[1], pos)
            yield _batch([(f, k, v, first, last, at) for (f, k, v, at), (first, last) in seen.items()], _VALUES)

    return explode


def _object(kind: str, parts: dict[str, str]) -> tuple[str, str]:
    return kind, "{" + ", ".join(f"{_text(k)}: {parts[k]}" for k in sorted(parts)) + "}"


def _with_document(value: str, at: str | None) -> str:
    return f'{{"source_doc_id": {_text(at)}, "value": {value}}}'


def _sole(documents: bool):
    """The entities ``_BODY`` that have one row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _rows(batches):
            out = []
            for founder, at, kind, attrs in rows:
                parts = _own(attrs, documents)
                if documents:
                    parts = {k: f"[{_with_document(v, at)}]" for k, v in parts.items()} | {"_source_document_ids": f"[{_text(at)}]"}
                else:
                    parts["_source_page"] = _text(str(at))
                out.append((founder, *_object(kind, parts)))
            yield _batch(out, _BODIES)

    return build


def _merged(founder: int, found: dict[str, dict[tuple, list[int]]], documents: bool) -> tuple[str, str]:
    """Type and attributes of an entity, of the distinct (value, document) of each key with their first and last places."""
    parts: dict[str, str] = {}
    kind = ""
    for key, places in found.items():
        rows = sorted((first, *x) for x, (first, _) in places.items())
        if key == "\0at":
            docs = list(dict.fromkeys(v for _, v, _ in rows))
            parts["_source_document_ids" if documents else "_source_page"] = f"[{', '.join(docs)}]" if documents else _text(str(json.loads(docs[0])))
        elif key == "\0type" and documents:
            kind = max((json.loads(v) for _, v, _ in rows), key=len)
        elif documents:
            parts[key] = f"[{', '.join(_with_document(v, at) for _, v, at in rows)}]"
        else:
            # Each distinct value where it comes first and where it comes last: those between change nothing that the last doesn't.
            steps = sorted({(p, v) for (v, _), ends in places.items() for p in ends})
            name = key.removeprefix("\0")
            merged = json.loads(steps[0][1]) if steps[0][0] == founder else merged_value(name, None, json.loads(steps[0][1]))
            for _, v in steps[1:]:
                merged = merged_value(name, merged, json.loads(v))
            if key == "\0type":
                kind = merged
            else:
                parts[key] = _text(merged)
    return _object(kind, parts)


def _merge_values(documents: bool):
    """``_BODY`` of values that come founder by founder; one entity's distinct values are held at a time."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[tuple, list[int]]] = defaultdict(dict)
        whose = None
        for rows in _rows(batches):
            out = []
            for founder, key, value, first, last, at in rows:
                if founder != whose:
                    if held:
                        out.append((whose // STEP, *_merged(whose, held, documents)))
                    held, whose = defaultdict(dict), founder
                place = held[key].setdefault((value, at), [first, last])
                place[0], place[1] = min(place[0], first), max(place[1], last)
            yield _batch(out, _BODIES)
        if held:
            yield _batch([(whose // STEP, *_merged(whose, held, documents))], _BODIES)

    return merge


def _stored_values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same of entities with provenance: a value for each item of their lists; values without provenance get the entity's only document, or ``aggregated``."""
    for f in frames:
        out = []
        for founder, kind, attrs in f[["founder", "type", "attrs_json"]].itertuples(index=False):
            body = json.loads(attrs or "{}")
            docs = body.pop("_source_document_ids", None) or []
            sole, pos = docs[0] if len(docs) == 1 else "aggregated", founder * STEP
            for key, value in body.items():
                listed = isinstance(value, list) and all(isinstance(x, dict) and "value" in x for x in value)
                for i, x in enumerate(value if listed else [{"value": value}]):
                    out.append((pos, key, json.dumps(x["value"], ensure_ascii=False, sort_keys=True), pos + i, x.get("source_doc_id", sole)))
            out.append((pos, "\0type", json.dumps(kind, ensure_ascii=False), pos, None))
            out += [(pos, "\0at", json.dumps(d, ensure_ascii=False), pos + i, None) for i, d in enumerate(docs)]
        yield pd.DataFrame([(f, k, v, p, p, at) for f, k, v, p, at in out], columns=["founder", "key", "value", "first", "last", "at"])


def _stored_signatures(rules: Rules):
    """What rules read of entities with provenance: of each attribute its first value."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for sid, grp, kind, type_, attrs in f[["sid", "grp", "kind", "type", "attrs_json"]].itertuples(index=False):
                body = json.loads(attrs or "{}") | {"type": type_}
                _, names = signature(body, rules)
                read = {k: [{"value": plain(body[k])}] for k in read_by(rules, kind) if k in body}
                out.append((sid, grp, kind, json.dumps(read | {"type": type_}, ensure_ascii=False, sort_keys=True), names))
            yield pd.DataFrame(out, columns=["sid", "grp", "kind", "sig", "names"])

    return sign


def merged_into(base: DataFrame, entities: DataFrame, group: str, rules: Rules, at: str, order: tuple[str, ...] = ("ord",), look_ahead: int = LOOK_AHEAD) -> tuple[DataFrame, DataFrame]:
    """New documents merged into a graph with provenance: what ``merged_across`` gives for all at once, the base's documents first.

    ``base(group, ord, id, type, n, attrs_json)`` is such a graph, with ids e1, e2, ... in its order; entities keep their ids and new ones go on from there.  Of the base only the types that the new
    entities have take part in the matching, and only entities that a new one joins are made anew (``touched`` is true); all others pass as they are.  Returns
    ``(group, ord, id, type, n, attrs_json, touched)`` and ``(group, at, old_id, id)`` of the new rows.  Values of the base without provenance get its entity's only document, or ``aggregated``.
    """
    kind = F.lower(F.substring_index("type", ":", -1))
    old = ordered_index(base.select(F.col(group).cast("string").alias("grp"), F.col("ord").alias("_o"), "id", "type", "n", "attrs_json", kind.alias("kind")), ["grp", "_o"], "sid")
    shift = old.count()
    rows = entities.where("type <> ''").select(F.col(group).cast("string").alias("grp"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(at).cast("string").alias("at"), F.col("id").cast("string").alias("id"), "type", "attrs_json", kind.alias("kind"))
    signed = _numbered(rows, rules, len(order)).withColumn("pos", F.col("pos") + shift)
    used = old.join(signed.select("grp", "kind").distinct(), ["grp", "kind"], "left_semi")
    known = materialize(used.mapInPandas(_stored_signatures(rules), "sid long, grp string, kind string, sig string, names array<string>"), "known")
    rows = materialize(settled(signed, rules, True, look_ahead, known), "founders")
    joined = materialize(_heads(rows).withColumnRenamed("n", "more"), "joined")
    touched = materialize(old.join(joined.select(F.col("founder").alias("sid"), "more"), "sid"), "touched")
    stored = touched.select(F.col("sid").alias("founder"), "type", "attrs_json").mapInPandas(_stored_values, _VALUE)
    bodies = materialize(_bodies(rows, True, stored), "bodies")
    again = touched.join(bodies.withColumnsRenamed({"founder": "sid", "type": "t", "attrs_json": "a"}), "sid").select("grp", F.col("_o").alias("ord"), "id", F.col("t").alias("type"), (F.col("n") + F.col("more")).alias("n"), F.col("a").alias("attrs_json"), F.lit(True).alias("touched"))
    same = old.join(touched.select("sid"), "sid", "left_anti").select("grp", F.col("_o").alias("ord"), "id", "type", "n", "attrs_json", F.lit(False).alias("touched"))
    fresh = ordered_index(joined.where(F.col("founder") > shift), ["grp", "founder"], "_i")
    first = fresh.groupBy("grp").agg((F.min("_i") - 1).alias("_before")).join(old.groupBy("grp").agg(F.count("*").alias("_base")), "grp", "left")
    fresh = fresh.join(first, "grp").withColumn("ord", F.col("_i") - F.col("_before") - 1 + F.coalesce("_base", F.lit(0)))
    fresh = materialize(fresh.join(bodies, "founder").select("grp", "ord", F.concat(F.lit("e"), (F.col("ord") + 1).cast("string")).alias("id"), "type", F.col("more").alias("n"), "attrs_json", "founder"), "fresh")
    ids = fresh.select("founder", F.col("id").alias("new_id")).unionByName(touched.select(F.col("sid").alias("founder"), F.col("id").alias("new_id")))
    went = rows.groupBy("grp", "at", F.col("id").alias("old_id")).agg(F.max_by("founder", "pos").alias("founder")).join(ids, "founder")
    kept = again.unionByName(same).unionByName(fresh.drop("founder").withColumn("touched", F.lit(True)))
    return kept.withColumnRenamed("grp", group), went.select(F.col("grp").alias(group), "at", "old_id", F.col("new_id").alias("id"))


_VALUE = "founder long, key string, value string, first long, last long, at string"
_VALUES = pa.schema([("founder", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("at", pa.string())])
_BODY = "founder long, type string, attrs_json string"
_BODIES = pa.schema([("founder", pa.int64()), ("type", pa.string()), ("attrs_json", pa.string())])


def _numbered(rows: DataFrame, rules: Rules, orders: int) -> DataFrame:
    """Signed rows, ``pos`` being their place in the order of ``grp`` and ``_o0``, ``_o1``, ...  They are signed first: dealing by ranges reads its rows twice."""
    return ordered_index(materialize(_signed(rows, rules), "signed"), ["grp", *(f"_o{i}" for i in range(orders))], "pos").drop(*(f"_o{i}" for i in range(orders)))


def _heads(rows: DataFrame) -> DataFrame:
    """``(founder, n, grp, first_at)`` of the entities of ``settled`` rows."""
    alone = rows.where("single").select("founder", F.lit(1).cast("long").alias("n"), "grp", F.col("at").alias("first_at"))
    return alone.unionByName(rows.where("not single").groupBy("founder").agg(F.count("*").alias("n"), F.min("grp").alias("grp"), F.min_by("at", "pos").alias("first_at")))


def _bodies(rows: DataFrame, documents: bool, more: DataFrame | None = None) -> DataFrame:
    """``_BODY`` of ``settled`` rows and of ``more`` values (``_VALUE``): an entity's only row is made into it where it lies, and only values of other rows are brought together."""
    values = rows.where("not single").select("founder", "pos", "at", "type", "attrs_json").mapInArrow(_values(documents), _VALUE)
    values = values if more is None else values.unionByName(more)
    merged = values.repartition("founder").sortWithinPartitions("founder").mapInArrow(_merge_values(documents), _BODY)
    return rows.where("single").select("founder", "at", "type", "attrs_json").mapInArrow(_sole(documents), _BODY).unionByName(merged)


def merged_across(entities: DataFrame, group: str, rules: Rules, at: str, order: tuple[str, ...] = ("ord",), documents: bool = False, look_ahead: int = LOOK_AHEAD) -> tuple[DataFrame, DataFrame]:
    """What ``folded`` gives with ``renumber``, for groups of any size: merged entities and where each id went.

    ``entities(group, order..., at, id, type, attrs_json)`` to ``(group, ord, id, type, n, attrs_json, first_at)``, ids being e1, e2, ... within the group in the order of the founding rows, and to
    ``(group, at, old_id, id)``.  ``order`` is an order of all rows of a group; of rows that tie the order is fixed once.  Rows without a type are left out; those without a name merge with none.
    Where one ``at`` has an id twice, it went where its last row went.  A task holds the signatures of a component of similar names, and the distinct values of one entity.
    """
    kind = F.lower(F.substring_index("type", ":", -1))
    rows = entities.where("type <> ''").select(F.col(group).cast("string").alias("grp"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.col(at).cast("string").alias("at"), F.col("id").cast("string").alias("id"), "type", "attrs_json", kind.alias("kind"))
    rows = materialize(settled(_numbered(rows, rules, len(order)), rules, documents, look_ahead), "founders")
    heads = ordered_index(_heads(rows).withColumnRenamed("grp", group), [group, "founder"], "_i")
    before = heads.groupBy(group).agg((F.min("_i") - 1).alias("_before"))
    heads = heads.join(before, group).withColumn("ord", F.col("_i") - F.col("_before") - 1).withColumn("id", F.concat(F.lit("e"), (F.col("ord") + 1).cast("string")))
    kept = materialize(heads.join(_bodies(rows, documents), "founder").select(group, "ord", "id", "type", "n", "attrs_json", "first_at"), "merged")
    went = rows.groupBy("grp", "at", F.col("id").alias("old_id")).agg(F.max_by("founder", "pos").alias("founder"))
    went = went.join(heads.select("founder", F.col("id").alias("new_id")), "founder").select(F.col("grp").alias(group), "at", "old_id", F.col("new_id").alias("id"))
    return kept, went
