"""Plain versions of matching and merging, written from their description alone; nothing of the library's own folds is used."""

import difflib
import re

from kgloom.operators import match as M

PERIODS = ("DateOrPeriod", "kpiDateOrPeriod", "dateOrYear")
FIGURES = ("metricValue", "percentageValue", "headcountValue", "amount")
TITLES = {"person": "fullName", "financialmetric": "metricName", "operationalkpi": "kpiName", "headcount": "headcountName", "transactioncontext": "contextName", "historicalevent": "eventName", "location": "locationName", "marketcontext": "segmentName", "position": "titleName"}
LONGER = {"name", "metricName", "kpiName", "productName", "fullName", "shareholderName", "contextName", "eventName", "locationName"}
ONLY_NOTHING = {"metricValue", "percentageValue", "headcountValue", "amount", "parsedValue", "parsedPercentage"}


def tidy(x):
    return " ".join(re.sub(r"[^\w\s.-]", " ", str(x).lower()).split()) if x not in (None, "") else ""


def first_value(x):
    if isinstance(x, list) and x and isinstance(x[0], dict) and "value" in x[0]:
        return x[0]["value"]
    return x


_RATIOS = {}


def close(a, b, least):
    if (a, b) not in _RATIOS:
        _RATIOS[a, b] = difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0
    return _RATIOS[a, b] >= least


def kind_of(e):
    return e["type"].split(":")[-1].lower()


def both_same(a, b, fields, how=lambda x: x):
    pairs = [(first_value(a.get(f)), first_value(b.get(f))) for f in fields]
    return all(how(x) == how(y) for x, y in pairs if x and y)


def all_names(e, title):
    more = first_value(e.get("alias")) or []
    return [n for n in [title, *map(tidy, more if isinstance(more, list) else [more])] if n]


def page_match(new, old, thresholds, default):
    """Rules by type; other types by name alone."""
    kind = kind_of(new)
    if kind != kind_of(old):
        return False
    a, b = (tidy(first_value(e.get(TITLES.get(kind, "name")))) for e in (new, old))
    if kind == "company":
        return any(close(x, y, 0.95) for x in all_names(new, a) for y in all_names(old, b))
    if not (a and b):
        return False
    if kind == "financialmetric":
        return close(a, b, 0.95) and both_same(new, old, ("DateOrPeriod", "scope"), tidy)
    if kind == "transactioncontext":
        return close(a, b, 0.98) and both_same(new, old, ("typeSought",)) and both_same(new, old, ("status",), tidy)
    if kind == "operationalkpi":
        return close(a, b, 0.90) and both_same(new, old, ("kpiDateOrPeriod",), tidy)
    if kind == "headcount":
        return close(a, b, 0.90) and both_same(new, old, ("dateOrYear",), tidy)
    if kind == "historicalevent":
        return close(a, b, 0.85) and both_same(new, old, ("eventType",)) and both_same(new, old, ("dateOrYear",), tidy)
    if kind == "advisor":
        return close(a, b, 0.80) and close(new["type"], old["type"], 0.70)
    if kind == "shareholder":
        return close(a, b, 0.85) and new["type"] == old["type"]
    if kind == "person":
        p, q = a.split(), b.split()
        return close(a, b, 0.75) or (min(len(p), len(q)) > 1 and (p[0], p[-1]) == (q[0], q[-1]))
    return close(a, b, thresholds.get(kind, default))


def strategy_match(new, old):
    """The stricter rule set."""
    kind = kind_of(new)
    if kind != kind_of(old):
        return False
    value = lambda e, f: first_value(e.get(f)) or None
    first = lambda e, fields: tidy(next((v for f in fields if (v := value(e, f))), None))
    metrics = ("metricName", "kpiName", "headcountName", "name")
    title = TITLES.get(kind, "name")
    if kind == "transactioncontext":
        keys = [(tidy(value(new, f)), tidy(value(old, f))) for f in ("contextName", "typeSought", "status")]
        return all(x == y for x, y in keys) and close(tidy(value(new, title)), tidy(value(old, title)), 0.95) and both_same(new, old, PERIODS + FIGURES, tidy)
    if kind in ("financialmetric", "operationalkpi", "headcount"):
        return close(first(new, metrics), first(old, metrics), 0.95 if kind == "financialmetric" else 0.90) and both_same(new, old, (*PERIODS, "scope"), tidy)
    if kind in ("company", "person", "technology", "location", "usecaseorindustry", "governmentbody"):
        least = {"company": 0.70, "governmentbody": 0.80}.get(kind, 0.75)
        a, b = tidy(value(new, title)), tidy(value(old, title))
        return bool(a and b) and any(close(x, y, least) for x in all_names(new, a) for y in all_names(old, b))
    if kind == "historicalevent":
        return close(tidy(value(new, title)), tidy(value(old, title)), 0.90) and both_same(new, old, ("eventType",)) and both_same(new, old, ("dateOrYear",), tidy)
    least = {"shareholder": 0.85, "position": 0.90}.get(kind, 0.80)
    return close(first(new, (title, *metrics)), first(old, (title, *metrics)), least) and both_same(new, old, PERIODS + (FIGURES if kind == "position" else ()), tidy)


def joined(key, old, new):
    nothing = lambda x: x is None or (isinstance(x, str) and x.strip() == "")
    if nothing(new) or old == new:
        return old
    if nothing(old):
        return new
    if key in LONGER:
        return max(old, new, key=lambda x: len(str(x)))
    if key in ONLY_NOTHING:
        return old or new
    if type(old) is type(new) is list:
        return old + [x for n, x in enumerate(new) if x not in old + new[:n]]
    if type(old) is type(new) is dict:
        return {**old, **new}
    if type(old) is type(new) is bool:
        return new
    if type(old) is type(new) is str:
        return max(old, new, key=len)
    return old


def plain_fold(rows, match, documents=False):
    """Merged entities in order, and (at, old id) -> id; ``rows``: dicts with id, type, _at and attributes, in order."""
    kept, where = [], {}
    for row in rows:
        at, values = row["_at"], {k: v for k, v in row.items() if k not in ("_at", "id")}
        target = next((e for e in kept if match(row, e)), None)
        if target is None:
            ids = {e["id"] for e in kept}
            trials = [row["id"], *((f"{row['id']}_projdup{n}" if documents else f"{row['id']}_{kind_of(row)}_{n}") for n in range(1, len(kept) + 2))]
            target = {"id": next(t for t in trials if t not in ids), "type": row["type"], "_n": 0}
            if not documents:
                target.update(values, _source_page=str(at))
            kept.append(target)
        elif not documents:
            target.update({k: joined(k, target.get(k), v) for k, v in values.items()})
        elif len(row["type"]) > len(target["type"]):
            target["type"] = row["type"]
        if documents:
            for k, v in values.items():
                if k != "type" and {"value": v, "source_doc_id": at} not in target.setdefault(k, []):
                    target[k].append({"value": v, "source_doc_id": at})
            if at not in target.setdefault("_source_document_ids", []):
                target["_source_document_ids"].append(at)
        target["_n"] += 1
        where[at, str(row["id"])] = target["id"]
    return kept, where


def _rule_sets():
    thresholds = {k: t for k, (_, t) in M.STRATEGIES.items()}
    return {
        "pages": (M.page_rules(), lambda new, old: page_match(new, old, thresholds, 0.75), False),
        "strategies": (M.strategy_rules(), strategy_match, False),
        "project": (M.project_rules(), lambda new, old: page_match(new, old, {}, 0.8), True),
    }


#: The library's rules, the plain match that they stand for, and whether values are lists by document.
BOTH_RULES = _rule_sets()
