"""Graphs of units that arrive as a stream, merged into one graph for each document."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kgloom.operators.extract import _bare_reply, _reply, maker, unit_graph, with_previous
from kgloom.operators.match import Rules, page_rules
from kgloom.operators.merge import Accumulated

#: The state store that map states need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
TOUCHED = "doc string, page int, late boolean, version long, place int, id string, type string, n long, attrs_json string, error string"


class _Builder(StatefulProcessor):
    """State of a document: its merged entities and relations by place, a row each, the pages that it has seen, and a version."""

    def __init__(self, rules: Rules, make):
        self.rules, self.make = rules, make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entities = handle.getMapState("entities", "place int", "body string")
        self.relations = handle.getMapState("relations", "place int", "body string")
        self.pages = handle.getMapState("pages", "page int", "version long")
        self.version = handle.getValueState("version", "version long, last int")
        self.model = self.make() if self.make else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        def stored(state) -> list:
            return [json.loads(body) for _, body in sorted((k[0], v[0]) for k, v in state.iterator())]

        frame = pd.concat(list(rows)).sort_values(["page", "body"], kind="stable")
        graph = Accumulated(self.rules, stored(self.entities), stored(self.relations))
        place = {e["id"]: i for i, e in enumerate(graph.entities)}
        version, last = self.version.get() if self.version.exists() else (0, None)
        out = []
        for page, body in frame[["page", "body"]].itertuples(index=False):
            page = int(page)
            if self.pages.containsKey((page,)):
                continue
            error = None
            if self.model is not None:
                body, error = _reply(self.model, with_previous(body, graph.shown()), 0.1, None)
                body = _bare_reply(body)
            found, version, late = unit_graph(body), version + 1, last is not None and page < last
            touched, new = graph.add(page, found.get("entities", []), found.get("relationships", []))
            for e in touched:
                at = place.setdefault(e["id"], len(place))
                self.entities.updateValue((at,), (json.dumps(e, ensure_ascii=False),))
                shown = {k: v for k, v in e.items() if k not in ("id", "type", "_n")}
                out.append((key[0], page, late, version, at, e["id"], e["type"], e["_n"], json.dumps(shown, ensure_ascii=False, sort_keys=True), error))
            for i, r in enumerate(new, len(graph.relations) - len(new)):
                self.relations.updateValue((i,), (json.dumps(r, ensure_ascii=False),))
            if not touched:
                out.append((key[0], page, late, version, None, None, None, None, None, error))
            self.pages.updateValue((page,), (version,))
            last = page if last is None else max(last, page)
            self.version.update((version, last))
        done = pd.DataFrame(out, columns=[c.split(" ")[0] for c in TOUCHED.split(", ")])
        yield done.astype({"place": "Int32", "n": "Int64"})

    def close(self) -> None:
        pass


def use_map_states(spark: SparkSession) -> None:
    """Set the session's state store to the one that has map states."""
    spark.conf.set(*STORE)


def fold_stream(units: DataFrame, rules: Rules | None = None, client: str | None = None) -> DataFrame:
    """``units(doc, page, body)`` of a stream to ``TOUCHED``: the entities that each unit has touched, as they are after it.

    ``body`` is the unit's graph as JSON, or with a ``client`` the prompt for it, in which ``PREVIOUS`` becomes the document's graph so far.  ``place`` is
    an entity's place in its document; the last version of each (doc, place) is the document's graph.  A unit that touches none gives one row without an entity.

    Units of a batch are merged in the order of their pages.  A page that comes in a later batch than a higher one is merged when it comes, and marked ``late``; a page number that has
    been seen is passed over, so a repeated file changes nothing.  Each entity is a row of the state, and only those touched are written again; a task reads
    the state of a document once for each batch.  The session needs ``use_map_states``.
    """
    builder = _Builder(rules or page_rules(), maker(client) if client else None)
    rows = units.select("doc", "page", "body").groupBy("doc")
    return rows.transformWithStateInPandas(builder, TOUCHED, "append", "none")
