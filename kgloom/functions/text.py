"""Text functions of the graph engine: columns in, columns out, JVM-side but for the similarity."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "\\p{L}\\p{N}_"
#: The attribute that names an entity of each (lower-case, unprefixed) type; others use ``name``.
NAME_FIELD = {
    "person": "fullName",
    "financialmetric": "metricName",
    "operationalkpi": "kpiName",
    "headcount": "headcountName",
    "transactioncontext": "contextName",
    "historicalevent": "eventName",
    "location": "locationName",
    "marketcontext": "segmentName",
    "position": "titleName",
}


BLANKS = " \t\n\x0b\x0c\r"


def strip(x: Column) -> Column:
    """Without white space at either end (Spark's ``trim`` takes blanks only)."""
    return F.btrim(x, F.lit(BLANKS))


def normalize_text(x: Column) -> Column:
    """Lower case, other signs than word characters, ``.`` and ``-`` to blanks, blanks collapsed; null to empty."""
    x = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), f"[^{WORD}\\s.-]", " ")
    return F.trim(F.regexp_replace(x, "\\s+", " "))


def unprefixed(type_: Column) -> Column:
    """The type after its last colon, in lower case."""
    return F.lower(F.substring_index(F.coalesce(type_, F.lit("")), ":", -1))


def primary_name(type_: Column, fields: dict[str, Column]) -> Column:
    """The normalised name of an entity, from the attribute that its type is named by."""
    kind, default = unprefixed(type_), fields.get("name", F.lit(None).cast("string"))
    picked = F.lit(None).cast("string")
    for name in sorted(set(NAME_FIELD.values()) & set(fields)):
        picked = F.when(kind.isin([k for k, f in NAME_FIELD.items() if f == name]), fields[name]).otherwise(picked)
    return normalize_text(F.when(kind.isin(list(NAME_FIELD)), picked).otherwise(default))


def clean_link_type(type_: Column) -> Column:
    """``p:camelCaseType`` as lower-case words."""
    bare = F.substring_index(type_, ":", -1)
    spaced = F.regexp_replace(F.regexp_replace(bare, "(.)([A-Z][a-z]+)", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.when(type_.contains(":"), F.lower(spaced)).otherwise("unknown link type")


def category_from_type(type_: Column) -> Column:
    """``p:CamelCase`` as snake case."""
    snake = F.lower(F.regexp_replace(F.substring_index(type_, ":", -1), "(?<!^)(?=[A-Z])", "_"))
    return F.when(type_.contains(":"), snake).otherwise("unknown")


def strip_prefix(x: Column, prefix: str) -> Column:
    return F.when(x.startswith(prefix), F.substr(x, F.lit(len(prefix) + 1))).otherwise(x)


def display_name(key: str) -> str:
    """An attribute's key as a title: words split at capitals, each with one capital, ``_`` to blank."""
    import re

    return re.sub(r"(?<!^)(?=[A-Z])", " ", key).title().replace("_", " ")


def format_attribute(key: str, value: Column) -> Column:
    """``Title: value``, or null for a null or blank value."""
    text = strip(value.cast("string"))
    return F.when(F.length(text) > 0, F.concat(F.lit(f"{display_name(key)}: "), text))


def attribute_text(df: DataFrame, name: str) -> Column:
    """An attribute as text: of a provenance list the first value, other lists joined, null for an empty list, a map or a struct."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            if "value" not in kind.elementType.names:
                return F.lit(None).cast("string")
            return F.get(col, F.lit(0))["value"].cast("string")
        return F.when(F.size(col) > 0, F.array_join(col.cast("array<string>"), ", "))
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.lit(None).cast("string")
    return col.cast("string")


def composite_id(id_: Column, label: Column) -> Column:
    part = F.regexp_replace(F.regexp_replace(label, "\\s+", "_"), f"[^{WORD}-]", "")
    return F.concat(id_, F.lit("_"), F.when(part == "", "nolabel").otherwise(part))


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(x, '[<>:"/\\\\|?*]', "_")


def base64_line(x: Column) -> Column:
    """A text's UTF-8 as base64 without line breaks, which Spark puts after every 76 characters."""
    return F.translate(F.base64(x.cast("binary")), "\r\n", "")


def sentences(x: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit("[^.!?]+[.!?]*"), F.lit(0)), strip), lambda s: F.length(s) > 0)


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"[{WORD}]+|[^{WORD}\\s]"), F.lit(0))


def paragraphs(x: Column, pattern: str = "\\n\\s*\\n") -> Column:
    return F.filter(F.transform(F.split(x, pattern), strip), lambda p: F.length(p) > 0)


def shorten(x: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three of them dots where something was cut."""
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - 3), F.lit("..."))).otherwise(x)


def summary(found: Column, limit: int = 200) -> Column:
    """First and last sentence: all of one or two, else joined by an ellipsis."""
    first, last = F.element_at(found, 1), F.element_at(found, -1)
    n = F.size(found)
    whole = F.when(n == 0, "").when(n == 1, first).when(n == 2, F.concat(first, F.lit(" "), last)).otherwise(F.concat(first, F.lit(" ... "), last))
    return shorten(whole, limit)


def length_bound(a: Column, b: Column) -> Column:
    """The highest similarity that lengths allow; cases don't count, as they don't in ``ratio``."""
    la, lb = F.length(F.lower(a)), F.length(F.lower(b))
    return F.when((la > 0) & (lb > 0), 2.0 * F.least(la, lb) / (la + lb)).otherwise(0.0)


def numbered(parts: Column) -> Column:
    """The texts of an array, each with its number among its equals, so that intersections of sets are those of multisets; in their order."""
    of = lambda found: F.transform(found, lambda c, i: F.concat(c, (i - F.array_position(found, c) + 1).cast("string")))
    return F.element_at(F.transform(F.array(F.sort_array(parts)), of), 1)


def multiset_bound(a: Column, b: Column) -> Column:
    """The highest similarity that the characters allow, in any order and case."""
    a, b = F.lower(a), F.lower(b)
    la, lb = F.length(a), F.length(b)
    return F.when((la > 0) & (lb > 0), 2.0 * F.size(F.array_intersect(numbered(F.split(a, "")), numbered(F.split(b, "")))) / (la + lb)).otherwise(0.0)


def runs_bound(a: Column, b: Column) -> Column:
    """The highest similarity that shared pairs of neighbouring characters allow, in any order and case.

    Matched runs are parted by an unmatched character at least, so M matched characters of L in all lie in L - 2M + 1 runs at most, and each run holds a pair less than characters:
    3M - L - 1 pairs are shared.
    """
    a, b = F.lower(a), F.lower(b)
    twos = lambda x: F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    whole = F.length(a) + F.length(b)
    return 2.0 * (F.size(F.array_intersect(numbered(twos(a)), numbered(twos(b)))) + whole + 1) / (3.0 * whole)


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of lower-cased texts; 0 if either is empty.  It depends on the order."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio() if a and b else 0.0


@lru_cache(maxsize=1 << 16)
def _letters(text: str) -> Counter:
    return Counter(text)


def alike(a: str | None, b: str | None, least: float) -> bool:
    """``ratio(a, b) >= least``, computed only where the lengths and the characters allow it."""
    if not a or not b:
        return least <= 0
    a, b = a.lower(), b.lower()
    whole = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / whole < least:
        return False
    if a == b:
        return least <= 1
    few, many = sorted((_letters(a), _letters(b)), key=len)
    if 2.0 * sum(min(n, many[c]) for c, n in few.items()) / whole < least:
        return False
    return SequenceMatcher(None, a, b).ratio() >= least


#: Letters of the longest names that are compared many at once; pairs in a block of them.
SHORT, BLOCK = 64, 4096


def _codes(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Code points, a column for each text."""
    width = int(sizes.max())
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).T


def _windows(codes: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, none: int) -> np.ndarray:
    """The letters from ``low`` to ``high`` of the texts ``rows``, and ``none`` beyond."""
    at = np.arange(int((high - low).max()))[:, None] + low
    return np.where(at < high, codes[np.minimum(at, codes.shape[0] - 1), rows], np.uint32(none))


def _matched(a: list[str], b: list[str]) -> np.ndarray:
    """Matched letters of pairs of at most ``SHORT`` letters, as SequenceMatcher counts them: the longest block, the first of equals in ``a`` and then in ``b``, then those left and right of it."""
    la, lb = (np.array([len(x) for x in side]) for side in (a, b))
    ca, cb, out = _codes(a, la), _codes(b, lb), np.zeros(len(a), dtype=np.int64)
    rows, a0, a1, b0, b1 = np.arange(len(a)), np.zeros_like(la), la, np.zeros_like(lb), lb
    while rows.size:
        x, y = _windows(ca, rows, a0, a1, 0xFFFFFFFF), _windows(cb, rows, b0, b1, 0xFFFFFFFE)
        # A run's length counts 256 and its end in b, from the back, 1, so the greatest is the longest and first.
        back = np.arange(255, 255 - len(y), -1, dtype=np.uint16)[:, None]
        run, best, end = np.zeros((len(y) + 1, rows.size), dtype=np.uint16), np.zeros(rows.size, dtype=np.uint16), np.zeros_like(rows)
        for i in range(len(x)):
            run[1:] = (run[:-1] + np.uint16(256)) * (y == x[i])
            top = (run[1:] + back).max(axis=0)
            more = (top >> 8) > (best >> 8)
            best, end = np.where(more, top, best), np.where(more, i, end)
        size = (best >> 8).astype(np.int64)
        np.add.at(out, rows, size)
        i, k = a0 + end + 1 - size, b0 + 255 - (best & 255).astype(np.int64) + 1 - size
        left, right = (size > 0) & (i > a0) & (k > b0), (size > 0) & (i + size < a1) & (k + size < b1)
        parts = ((rows[left], a0[left], i[left], b0[left], k[left]), (rows[right], (i + size)[right], a1[right], (k + size)[right], b1[right]))
        rows, a0, a1, b0, b1 = (np.concatenate(p) for p in zip(*parts, strict=True))
    return out


def ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """``ratio`` of many pairs: short ones together, of others each distinct pair once."""
    low = [(x.lower(), y.lower()) if x and y else None for x, y in zip(a, b, strict=True)]
    out, seen = np.zeros(len(low)), {}
    short: dict[int, list[int]] = {}
    for i, pair in enumerate(low):
        if pair and all(pair):
            most = max(len(pair[0]), len(pair[1]))
            if most <= SHORT:
                short.setdefault(most // 16, []).append(i)
            else:
                if pair not in seen:
                    seen[pair] = ratio(*pair)
                out[i] = seen[pair]
    for rows in short.values():
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            x, y = [low[i][0] for i in part], [low[i][1] for i in part]
            out[part] = 2.0 * _matched(x, y) / np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
    return out


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of (new, candidate), by batches."""
    return pd.Series(ratios(list(a), list(b)))
