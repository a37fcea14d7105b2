"""Operator 8: personal data replaced by format-preserving Feistel pseudonyms, with DataFrame functions only.

One pattern finds candidates; each kind is validated (Luhn, mod 97, octets, the calendar, number plans) and,
if sound, permuted within its format by a keyed Feistel network, so the same value gets the same pseudonym
in every document and two values never share one.  A network works on a row of symbols, each with a base of its own
(10 for a digit, 26 for a letter, 256 for an octet): the halves are changed in turn, symbol by symbol, by
a keyed digest of the other half modulo the base.  Numbers are permuted as bare digits and letters and written back
into their separators, so all spellings of a number share a pseudonym.  Check digits are computed anew; dates are numbered and walk the
cycle until they fall into the calendar.

A phone number has the digits that its country's numbers have and ends at the end of a group, so it takes nothing from the value after it.

All patterns are bounded, and what may be long starts only where its run does, so the time goes with the length of a text
and no match recurses over it.  A text without a digit, ``@``, ``=``, ``:`` or the head of an access key is passed on untouched after one quick scan; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import spare_name

ROUNDS = 8
#: The session's key, where no key is given.
KEY_SETTING = "spark.kgloom.pseudonym.key"
#: Symbols permuted together at most; longer values are permuted piece by piece.
PIECE = 128
#: Digits of a symbol's share of a digest.
_SHARE = 12
#: Dates from 1900-01-01 on, this many days; SIDE * SIDE is the least square above.
FIRST_DATE, DAYS, SIDE = "1900-01-01", 73049, 271
#: The other dates of the years 1 to 9999, numbered on over the gap: days before FIRST_DATE, days in all, and the least square's side.
EARLY, FAR_DAYS, FAR_SIDE = 693595, 3579010, 1892
#: Characters of an IBAN by country; other codes are taken as far as they go.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    spaced = f"(?: [A-Z0-9]{{4}}){{{groups}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})\b"


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: The calling codes of one and two digits; all others have three.
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: The least and most digits of a national number by calling code, and of those not listed.
PHONE_DIGITS = {
    (8, 8): "45|47|53|65", (8, 9): "32|36|51|66", (8, 10): "20|57|60|63|64|82", (9, 9): "27|31|33|34|40|41|48|56|61|93|94", (9, 10): "44|81|84|92",
    (10, 10): "1|7|30|52|58|90|91|98", (10, 11): "54|55|86", (7, 10): "46|95", (6, 11): "39|49", (6, 12): "43|62",
}
OTHER_DIGITS = (6, 12)
_GAP = r"(?:\)[ .-]?|[ .-]\(?|\()"
_DAY = lambda first, last: rf"\d{{{first}}}(?:-\d{{1,2}}-|/\d{{1,2}}/|\.\d{{1,2}}\.)\d{{{last}}}(?![\d/-]|\.\d)"
#: Digits that begin a value of another kind (or another phone number) and so don't go on with a phone number that could end before them.
_ANOTHER = "|".join((
    r"\d{3}-\d{2}-\d{4}(?![\d-])", _DAY("4", "1,2"), _DAY("1,2", "4"), rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)", r"\d{13,19}(?!\d)", r"\d{4}[ -]\d{6}[ -]\d{5}(?!\d)",
    r"\d{4} \d{4} \d{4} \d{1,7}(?![ -]?\d)", r"\d{4}-\d{4}-\d{4}-\d{1,7}(?![ -]?\d)", r"\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?!\d)", r"\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)",
))


def _digits(least: int, most: int) -> str:
    """As many digits, in any groups; beyond the least, no group that begins another value."""
    return rf"(?:{_GAP}?\d){{{least}}}" + (rf"(?:\d|{_GAP}(?!{_ANOTHER})\d){{0,{most - least}}}" if most > least else "")


#: What each kind looks like.  The first that fits a place is taken.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,126}\.[A-Za-z]{2,63}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\"?\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"'<>]{5,}[^\s\"'<>,;.)]",
    "aws": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b(?=[A-Z]{2}\d{2})(?:" + "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()) + r"|[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b)",
    "ipv4": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)",
    "phone": rf"(?<![\w+])(?:\+(?:{'|'.join(f'(?:{codes})' + _digits(*lengths) for lengths, codes in PHONE_DIGITS.items())}|(?!{CALLING_CODES})\d{{3}}{_digits(*OTHER_DIGITS)})"
    rf"|\(\d{{3}}\) ?\d{{3}}[-. ]\d{{4}}|\d{{3}}([-.])\d{{3}}\3\d{{4}})(?!\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z])(?:\d{4}([ -])\d{4}\4\d{4}\4\d{1,7}|\d{4}([ -])\d{6}\5\d{5}|\d{13,19})(?![\dA-Za-z])",
}
ANY = "|".join(PATTERNS.values())
QUICK = "[0-9@=:]|A[KS]IA"


# Expressions are built as SQL text, as thousands of column calls would cost seconds of the driver's time.
_names = count()


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(value: str, then: Callable[[str], str]) -> str:
    """``then(name)`` with ``value`` computed once, however often the name is used."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {then(name)}), 1)"


def _is_digit(c: str) -> str:
    return f"{c} BETWEEN '0' AND '9'"


def _base(c: str) -> str:
    return f"CASE WHEN {_is_digit(c)} THEN 10 WHEN {c} BETWEEN 'a' AND 'z' OR {c} BETWEEN 'A' AND 'Z' THEN 26 ELSE 1 END"


def _origin(c: str) -> str:
    return f"CASE WHEN {_is_digit(c)} THEN 48 WHEN {c} BETWEEN 'a' AND 'z' THEN 97 ELSE 65 END"


def feistel(symbols: str, key: str, kind: str, rounds: int = ROUNDS) -> str:
    """Permute an array of ``struct<x int, base int>``, each x below its base, under a key and a tweak; the new x."""
    per = 64 // _SHARE

    def changed(own: str, other: str) -> str:
        seen = f"concat({_literal(f'{key}|{kind}|')}, string(r), '|', array_join(cast({other}.x AS array<string>), ','), '|', string(k))"
        digests = f"transform(sequence(0, greatest(0, int((size({own}) - 1) div {per}))), k -> sha2({seen}, 256))"
        share = f"bigint(conv(substr(element_at(d, int(i div {per}) + 1), i % {per} * {_SHARE} + 1, {_SHARE}), 16, 10))"
        return f"element_at(transform(array({digests}), d -> transform({own}, (y, i) -> named_struct('x', int((y.x + {share}) % y.base), 'base', y.base))), 1)"

    # The halves change in turn: what was changed comes second, so each round is of one form.
    turn = f"named_struct('a', s.b, 'b', {changed('s.a', 's.b')})"
    half = "int((size(w) + 1) div 2)"
    start = f"named_struct('a', slice(w, 1, {half}), 'b', slice(w, {half} + 1, size(w) - {half}))"
    return f"element_at(transform(array({symbols}), w -> aggregate(sequence(0, {rounds - 1}), {start}, (s, r) -> {turn}, s -> concat(s.a.x, s.b.x))), 1)"


def permute_text(value: str, key: str, kind: str) -> str:
    """Digits to digits and ASCII letters to letters of their case; other characters stay."""
    symbols = f"transform(c, e -> named_struct('x', CASE WHEN {_base('e')} > 1 THEN ascii(e) - {_origin('e')} ELSE 0 END, 'base', {_base('e')}))"
    back = f"array_join(zip_with(c, {feistel(symbols, key, kind)}, (e, x) -> CASE WHEN {_base('e')} > 1 THEN char(x + {_origin('e')}) ELSE e END), '')"
    return f"array_join(transform(regexp_extract_all({value}, '(?s).{{1,{PIECE}}}', 0), q -> element_at(transform(array(split(q, '')), c -> {back}), 1)), '')"


def _bare(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9A-Za-z]', '')"


def _respell(value: str, bare: str) -> str:
    """``bare`` in place of the digits and letters of ``value``, of which there are as many; short values only."""
    place = f"length({_bare(f'substr({value}, 1, j + 1)')})"
    return _bind(bare, lambda b: f"array_join(transform(split({value}, ''), (e, j) -> CASE WHEN {_base('e')} > 1 THEN substr({b}, {place}, 1) ELSE e END), '')")


def _luhn(digits: str, doubled: int) -> str:
    """The sum of a text of digits by Luhn's rule, every second one doubled from the right."""
    one = f"CASE WHEN j % 2 = {doubled} THEN CASE WHEN int(e) > 4 THEN 2 * int(e) - 9 ELSE 2 * int(e) END ELSE int(e) END"
    return f"aggregate(transform(split(reverse({digits}), ''), (e, j) -> {one}), 0, (t, y) -> t + y) % 10"


def _mod97(value: str) -> str:
    return f"aggregate(split({value}, ''), 0, (t, e) -> CASE WHEN {_is_digit('e')} THEN t * 10 + ascii(e) - 48 ELSE t * 100 + ascii(e) - 55 END % 97)"


def _card(value: str, key: str) -> str:
    """The first digit stays."""

    def new(d: str) -> str:
        body = f"concat(substr({d}, 1, 1), {permute_text(f'substr({d}, 2, length({d}) - 2)', key, 'card')})"
        whole = _bind(body, lambda x: f"concat({x}, string((10 - {_luhn(x, 0)}) % 10))")
        return f"CASE WHEN {_luhn(d, 1)} = 0 THEN {_respell(value, whole)} END"

    return _bind(_bare(value), new)


def _iban(value: str, key: str) -> str:
    def new(p: str) -> str:
        country, zeros = f"substr({p}, 1, 2)", "'00'"
        check = lambda body: f"lpad(string(98 - {_mod97(f'concat({body}, {country}, {zeros})')}), 2, '0')"
        whole = _bind(permute_text(f"substr({p}, 5)", key, "iban"), lambda body: f"concat({country}, {check(body)}, {body})")
        return f"CASE WHEN {_mod97(f'concat(substr({p}, 5), substr({p}, 1, 4))')} = 1 THEN {_respell(value, whole)} END"

    return _bind(_bare(value), new)


def _symbols(*pairs: tuple[str, object]) -> str:
    return "array(" + ", ".join(f"named_struct('x', int({x}), 'base', int({base}))" for x, base in pairs) + ")"


def _ssn(value: str, key: str) -> str:
    """Area, group and serial as one row of symbols whose bases leave out what no number may have."""
    area = f"int(substr({value}, 1, 3))"
    moved = feistel(_symbols((f"{area} - if({area} < 666, 1, 2)", 898), (f"int(substr({value}, 5, 2)) - 1", 99), (f"int(substr({value}, 8)) - 1", 9999)), key, "ssn")
    return _bind(moved, lambda x: f"format_string('%03d-%02d-%04d', {x}[0] + if({x}[0] < 665, 1, 2), {x}[1] + 1, {x}[2] + 1)")


def _phone(value: str, key: str) -> str:
    """The calling code after a plus stays; a number without one is permuted as it would be after +1."""

    def new(digits: str) -> str:
        code = f"if(startswith({value}, '+'), regexp_extract({digits}, {_literal(rf'^(?:{CALLING_CODES}|\d{{3}})')}, 0), '')"
        return _bind(code, lambda c: _respell(value, f"concat({c}, {permute_text(f'substr({digits}, length({c}) + 1)', key, 'phone')})"))

    return _bind(_bare(value), new)


def _ipv4(value: str, key: str) -> str:
    octets = f"transform(split({value}, {_literal('[.]')}), c -> named_struct('x', int(c), 'base', 256))"
    return f"array_join(cast({feistel(octets, key, 'ipv4')} AS array<string>), '.')"


def _date(value: str, key: str) -> str:
    """Year first, or else month/day with a slash and day.month otherwise, or the other way where only that is valid.

    Dates from 1900 to 2099 are permuted among themselves, and so are the others of the years 1 to 9999.
    """
    day = lambda y, m, d: f"try_to_date(concat_ws('-', p[{y}], lpad(p[{m}], 2, '0'), lpad(p[{d}], 2, '0')), 'yyyy-MM-dd')"
    epoch = f"DATE'{FIRST_DATE}'"

    def read(p: str) -> str:
        parts = f"named_struct('first', length({p}[0]) = 4, 'iso', {day(0, 1, 2)}, 'us', {day(2, 0, 1)}, 'eu', {day(2, 1, 0)}, 'sep', regexp_extract({value}, '[-/.]', 0))"
        return parts.replace("p[", f"{p}[") if p != "p" else parts

    def placed(q: str) -> str:
        us = f"({q}.us IS NOT NULL AND ({q}.sep = '/' OR {q}.eu IS NULL))"
        n = f"datediff(CASE WHEN {q}.first THEN {q}.iso WHEN {us} THEN {q}.us ELSE {q}.eu END, {epoch})"
        return _bind(n, lambda n: shown(q, us, n))

    def shown(q: str, us: str, n: str) -> str:
        near = f"{n} BETWEEN 0 AND {DAYS - 1}"
        # Where a date stands among its kind, of how many, and the side of the square that holds them.
        place = f"CASE WHEN {near} THEN array({n}, {DAYS}, {SIDE}) WHEN {n} >= -{EARLY} THEN array(if({n} < 0, {n}, {n} - {DAYS}) + {EARLY}, {FAR_DAYS}, {FAR_SIDE}) END"

        def walked(g: str) -> str:
            out = feistel(_symbols((f"u div {g}[2]", f"{g}[2]"), (f"u % {g}[2]", f"{g}[2]")), key, "date")
            step = f"aggregate({out}, 0, (t, y) -> t * {g}[2] + y)"
            # Out of the calendar once in 190 steps or less: 8 of them are never all needed in practice; what is left stays unchanged.
            last = f"aggregate(sequence(1, 8), {g}[0], (u, z) -> CASE WHEN z = 1 OR u >= {g}[1] THEN {step} ELSE u END)"
            moved = _bind(last, lambda x: f"CASE WHEN {x} < {g}[1] THEN CASE WHEN {g}[1] = {DAYS} THEN {x} WHEN {x} < {EARLY} THEN {x} - {EARLY} ELSE {x} - {EARLY} + {DAYS} END END")
            return _bind(f"date_add({epoch}, {moved})", lambda t: written(q, us, t))

        return f"CASE WHEN {n} IS NOT NULL THEN {_bind(place, walked)} END"

    def written(q: str, us: str, t: str) -> str:
        y, m, d = f"date_format({t}, 'yyyy')", f"lpad(string(month({t})), 2, '0')", f"lpad(string(day({t})), 2, '0')"
        order = f"CASE WHEN {q}.first THEN array({y}, {m}, {d}) WHEN {us} THEN array({m}, {d}, {y}) ELSE array({d}, {m}, {y}) END"
        return f"CASE WHEN {t} IS NOT NULL THEN array_join({order}, {q}.sep) END"

    return _bind(f"split({value}, '[-/.]')", lambda p: _bind(read(p), placed))


def _tail(value: str, head: str, key: str, kind: str) -> str:
    """Keep what ``head`` matches at the start and permute the rest."""
    return _bind(f"regexp_extract({value}, {_literal(head)}, 0)", lambda k: f"concat({k}, {permute_text(f'substr({value}, length({k}) + 1)', key, kind)})")


def pseudonym(value: str, key: str) -> str:
    """The pseudonym of one candidate, as SQL text; null if it isn't sound."""
    is_ = lambda kind: f"{value} RLIKE {_literal(f'^(?:{_alone(kind)})$')}"
    dot = f"length({value}) - length(substring_index({value}, '.', -1)) - 1"
    email = _bind(dot, lambda d: f"concat({permute_text(f'substr({value}, 1, {d})', key, 'email')}, substr({value}, {d} + 1))")
    return f"""CASE WHEN contains({value}, '@') AND {is_("email")} THEN {email}
        WHEN {is_("secret")} THEN {_tail(value, "^[^=:]*[=:]" + chr(92) + "s*[" + chr(34) + "']?", key, "secret")}
        WHEN {is_("aws")} THEN {_tail(value, "^.{4}", key, "aws")}
        WHEN {is_("iban")} THEN {_iban(value, key)}
        WHEN {is_("ipv4")} THEN {_ipv4(value, key)}
        WHEN {is_("date")} THEN {_date(value, key)}
        WHEN {is_("phone")} THEN {_phone(value, key)}
        WHEN {is_("ssn")} THEN {_ssn(value, key)}
        WHEN {is_("card")} THEN {_card(value, key)} END"""


def _alone(kind: str) -> str:
    """The pattern of one kind, its back references numbered from 1."""
    shift = {"phone": 2, "card": 3}.get(kind, 0)
    out = PATTERNS[kind]
    for n in range(1, 6):
        if n > shift:
            out = out.replace(f"\\{n}", f"\\{n - shift}")
    return out


def session_key(spark: SparkSession) -> str:
    """The key of the session's setting ``KEY_SETTING``; an error without one."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pseudonyms need a key: pass one or set {KEY_SETTING}")
    return key


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str | None = None, count_col: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and ``count_col`` (long), the values replaced; other columns stay.

    ``key`` is the session's by default (``session_key``).  It is a literal of the plan: set ``spark.sql.redaction.string.regex`` to keep it out of
    logs and the UI.  A null text stays null with 0; a candidate that fails its validation stays as it is; a ``count_col`` that exists is
    replaced.  Rows are independent of each other, so repeated rows agree.  Texts of any length are read whole; an e-mail's local part has 64
    characters at most and its labels 63, and a secret of more than ``PIECE`` characters is permuted piece by piece.

    Not found: IBANs in small letters, phone numbers with a zero in brackets (``(0)``) or without a plus outside North America, dates without separators or with
    written months, and e-mail addresses with letters beyond ASCII (of one with such a local part, the ASCII letters next to the ``@`` are replaced).  Where a
    country's numbers differ in length, digits after a blank that would still fit are taken as part of the number unless they begin another value.
    """
    key = key or session_key(docs.sparkSession)
    text = F.col(text_col).cast("string")
    made = spare_name(docs, "new")
    found = f"regexp_extract_all(string(`{text_col.replace('`', '``')}`), {_literal(ANY)}, 0)"
    new = F.when(text.rlike(QUICK), F.expr(f"transform({found}, m -> named_struct('new', {pseudonym('m', key)}, 'old', m))"))
    # Three projections, as each refers to the one before more than once.
    rows = docs.withColumn(made, new)
    pieces = F.zip_with(F.split(text, ANY, -1), F.col(made), lambda gap, x: F.concat(gap, F.coalesce(x["new"], x["old"], F.lit(""))))
    rows = rows.withColumn(text_col, F.when(F.size(made) > 0, F.array_join(pieces, "")).otherwise(text))
    replaced = F.size(F.filter(F.coalesce(F.col(made), F.array().cast("array<struct<new:string,old:string>>")), lambda x: x["new"].isNotNull()))
    return rows.withColumn(count_col, replaced.cast("long")).drop(made)
