"""PII pseudonyms by a keyed Feistel permutation within each value's format.

Only DataFrame and SQL functions are used. One pattern finds candidates; each
is validated for its kind (card numbers by their check digit, dates by the
calendar, addresses by their octets, phone and social security numbers by their
ranges). A valid value becomes digits with a radix for each place; a Feistel
network, whose round function is SHA-256 under the key, permutes them within
those radices; the value is put back into its format, with a new check digit
where there is one. Equal values under one key stay equal in every document,
whatever their separators, and different values stay different. Dates are equal
in all their formats: days up to 12 are permuted among themselves, so that a
date with its month first doesn't turn into one with its day first.

Kinds: card numbers (first digit stays), North American phone numbers, social
security numbers, IPv4 addresses, dates from 1900 to 2099 (year first with
hyphens, or day or month first with slashes or dots), the local part of e-mail
addresses, and access keys, passwords and tokens with a clear mark. Letters
stay letters of their case and digits digits.

Null text stays null. Text without a valid value stays as it is, byte for
byte; a candidate that isn't valid is left alone. Ids, repeated rows and other
columns are untouched; an empty table stays empty. There is no length limit.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

KEY_SETTING = "spark.graphloom.pseudonym.key"

ROUNDS = 8

# The formats looked for, as Java patterns.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
CARD = r"(?<![\d-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])"
SECRET = r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?[A-Za-z0-9_+/.-]{8,}+)"
KINDS = {"email": EMAIL, "date": DATE, "ipv4": IPV4, "ssn": SSN, "phone": PHONE, "card": CARD, "secret": SECRET}
FIRST_DAY, DAYS = "1900-01-01", 73049


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel(digits: str, radices: str, key: str, tag: str) -> str:
    """SQL for the permuted digits; both arguments are SQL array<int>.

    Even rounds add to the left half a keyed hash of the right one, odd rounds
    the other way round, each place within its radix.
    """

    def step(k: int) -> str:
        lo, hi = ("1", "size(x.l)"), ("size(x.l) + 1", "size(x.r)")
        own, other, (first, n) = ("x.l", "x.r", lo) if k % 2 == 0 else ("x.r", "x.l", hi)
        # A hash has four hex digits for each of 16 places; longer halves take
        # another hash for each further 16.
        added = (
            f"transform({own}, (d, i) -> cast((d + cast(conv(substring(sha2(concat_ws('|', {_sql(key)}, {_sql(tag)}, '{k}', cast(i div 16 as string), array_join({other}, ',')), 256),"
            f" cast(4 * (i % 16) + 1 as int), 4), 16, 10) as int)) % element_at(m, cast(i + {first} as int)) as int))"
        )
        return f"named_struct('l', {added if k % 2 == 0 else 'x.l'}, 'r', {added if k % 2 else 'x.r'})"

    halves = "named_struct('l', slice(g, 1, cast(size(g) div 2 as int)), 'r', slice(g, cast(size(g) div 2 as int) + 1, size(g) - cast(size(g) div 2 as int)))"
    body = halves
    for k in range(ROUNDS):
        body = _let("x", body, step(k))
    return _let("m", radices, _let("g", digits, _let("z", body, "concat(z.l, z.r)")))


def _chars(value: str) -> str:
    return f"filter(split({value}, ''), c -> c != '')"


def _classes(value: str, key: str, tag: str) -> str:
    """Permute letters within their case and digits; the rest stays."""
    base = "case when c between 'a' and 'z' then 97 when c between 'A' and 'Z' then 65 when c between '0' and '9' then 48 else ascii(c) end"
    radix = "case when c between 'a' and 'z' then 26 when c between 'A' and 'Z' then 26 when c between '0' and '9' then 10 else 1 end"
    moved = feistel(f"transform(cs, c -> ascii(c) - ({base}))", f"transform(cs, c -> {radix})", key, tag)
    out = f"array_join(zip_with(cs, {moved}, (c, d) -> char(d + ({base}))), '')"
    return _let("cs", _chars(value), out)


def _refill(form: str, digits: str) -> str:
    """Put a string of digits in place of the digits of ``form``."""
    nth = "length(regexp_replace(substring(f, 1, i), '[^0-9]', ''))"
    return _let("f", form, _let("ds", digits, f"array_join(transform(sequence(1, length(f)), i -> if(substring(f, i, 1) between '0' and '9', substring(ds, {nth}, 1), substring(f, i, 1))), '')"))


def _luhn(digits: str) -> str:
    """Sum of the digits, each second one from the right doubled."""
    return f"aggregate(transform(reverse({_chars(digits)}), (c, i) -> if(i % 2 = 1, cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0), cast(c as int))), 0, (s, d) -> s + d)"


def _card(v: str, key: str) -> str:
    body = feistel("transform(ps, c -> cast(c as int))", "transform(ps, c -> 10)", key, "card")
    new = _let("ps", _chars("substring(n, 2, length(n) - 2)"), f"concat(substring(n, 1, 1), array_join({body}, ''))")
    checked = _let("p", new, f"concat(p, cast((10 - ({_luhn('concat(p, \"0\")')}) % 10) % 10 as string))")
    return _let("n", f"regexp_replace({v}, '[^0-9]', '')", f"if(length(n) between 13 and 19 and ({_luhn('n')}) % 10 = 0 and n not rlike '^0+$', {_refill(v, checked)}, {v})")


def _phone(v: str, key: str) -> str:
    # Area and exchange begin with 2 to 9 in assigned numbers, 0 or 1 in others;
    # each class stays itself.
    low = "if(i in (0, 3) and c >= '2', 2, 0)"
    radix = "if(i in (0, 3), if(c >= '2', 8, 2), 10)"
    body = feistel(f"transform(ps, (c, i) -> cast(c as int) - {low})", f"transform(ps, (c, i) -> {radix})", key, "phone")
    new = _let("ps", _chars("right(n, 10)"), f"array_join(transform(zip_with({body}, ps, (d, c) -> named_struct('d', d, 'c', c)), (e, i) -> e.d + {low.replace('c >=', 'e.c >=')}), '')")
    return _let("n", f"regexp_replace({v}, '[^0-9]', '')", _refill(v, f"concat(substring(n, 1, length(n) - 10), {new})"))


def _ssn(v: str, key: str) -> str:
    # Areas 001 to 899 without 666 count from 0 to 897.
    digits = "array(a - 1 - if(a > 666, 1, 0), g - 1, s - 1)"
    body = feistel(digits, "array(898, 99, 9999)", key, "ssn")
    out = _let("w", body, "format_string('%03d-%02d-%04d', w[0] + 1 + if(w[0] >= 665, 1, 0), w[1] + 1, w[2] + 1)")
    valid = "a between 1 and 899 and a != 666 and g > 0 and s > 0"
    part = lambda i: f"cast(split({v}, '-')[{i}] as int)"
    return _let("a", part(0), _let("g", part(1), _let("s", part(2), f"if({valid}, {out}, {v})")))


def _ipv4(v: str, key: str) -> str:
    # First octets 1 to 223 stay among themselves, as do 0 and 224 to 255.
    digits = "array(case when o[0] between 1 and 223 then o[0] - 1 when o[0] = 0 then 0 else o[0] - 223 end, o[1], o[2], o[3])"
    body = feistel(digits, "array(if(o[0] between 1 and 223, 223, 33), 256, 256, 256)", key, "ipv4")
    head = "case when o[0] between 1 and 223 then w[0] + 1 when w[0] = 0 then 0 else w[0] + 223 end"
    out = _let("w", body, f"concat_ws('.', cast({head} as string), cast(w[1] as string), cast(w[2] as string), cast(w[3] as string))")
    return _let("o", f"transform(split({v}, '[.]'), e -> cast(e as int))", f"if(forall(o, e -> e <= 255), {out}, {v})")


def _moved_date(t: str, key: str) -> str:
    """SQL for the pseudonym of a date from 1900 to 2099.

    Days up to 12 stay such days, so that a date reads alike with day and
    month in either order; the others move among months of their length.
    """
    y, m, d = f"year({t})", f"month({t})", f"day({t})"
    long_, short = "array(1, 3, 5, 7, 8, 10, 12)", "array(4, 6, 9, 11)"
    cases = [
        (f"{d} <= 12", f"array({y} - 1900, {m} - 1, {d} - 1)", "array(200, 12, 12)", "make_date(w[0] + 1900, w[1] + 1, w[2] + 1)"),
        (f"array_contains({long_}, {m})", f"array({y} - 1900, cast(array_position({long_}, {m}) as int) - 1, {d} - 13)", "array(200, 7, 19)", f"make_date(w[0] + 1900, {long_}[w[1]], w[2] + 13)"),
        (f"array_contains({short}, {m})", f"array({y} - 1900, cast(array_position({short}, {m}) as int) - 1, {d} - 13)", "array(200, 4, 18)", f"make_date(w[0] + 1900, {short}[w[1]], w[2] + 13)"),
        (f"{d} <= 28", f"array({y} - 1900, {d} - 13)", "array(200, 16)", "make_date(w[0] + 1900, 2, w[1] + 13)"),
        # The 49 leap days, 1904 to 2096.
        ("true", f"array(cast(({y} - 1904) div 28 as int), cast(({y} - 1904) % 28 div 4 as int))", "array(7, 7)", "make_date(1904 + 28 * w[0] + 4 * w[1], 2, 29)"),
    ]
    return "case " + " ".join(f"when {c} then {_let('w', feistel(g, r, key, f'date{i}'), out)}" for i, (c, g, r, out) in enumerate(cases)) + " end"


def _date(v: str, key: str) -> str:
    moved = _moved_date("t", key)
    parse = "to_date(try_to_timestamp({0}, '{1}'))"
    sep = f"if(contains({v}, '/'), '/', '.')"
    plain = f"replace({v}, '.', '/')"
    # Day first where that is a date, else month first; both keep their order.
    iso, day, month = parse.format(v, "yyyy-MM-dd"), parse.format(plain, "d/M/yyyy"), parse.format(plain, "M/d/yyyy")
    inside = f"t between date'{FIRST_DAY}' and date'2099-12-31'"
    written = f"if(k = 0, date_format(u, 'yyyy-MM-dd'), replace(date_format(u, if(k = 1, if(length({v}) = 10, 'dd/MM/yyyy', 'd/M/yyyy'), if(length({v}) = 10, 'MM/dd/yyyy', 'M/d/yyyy'))), '/', {sep}))"
    kind = f"if({v} like '____-__-__', 0, if({day} is not null, 1, 2))"
    when = f"case k when 0 then {iso} when 1 then {day} else {month} end"
    return _let("k", kind, _let("t", when, f"if(t is not null and {inside}, {_let('u', moved, written)}, {v})"))


def _secret(v: str, key: str) -> str:
    mark = f"regexp_extract({v}, {_sql('^(AKIA|[A-Za-z_-]+ ?[=:] ?[\"' + chr(39) + ']?)')}, 1)"
    return _let("h", mark, f"concat(h, {_classes(f'substring({v}, length(h) + 1)', key, 'secret')})")


def _email(v: str, key: str) -> str:
    return f"concat({_classes(f'substring_index({v}, \"@\", 1)', key, 'email')}, '@', substring_index({v}, '@', -1))"


def pseudonym(value: str, key: str) -> str:
    """SQL for the pseudonym of a candidate; itself if it isn't valid."""
    whole = {k: _sql(f"^(?:{p})$") for k, p in KINDS.items()}
    make = {"email": _email, "date": _date, "ipv4": _ipv4, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret}
    return "case " + " ".join(f"when {value} rlike {whole[k]} then {make[k](value, key)}" for k in KINDS) + f" else {value} end"


def session_key(spark: SparkSession) -> str:
    """The key named by ``spark.graphloom.pseudonym.key``.

    Where the session names none, a random one that lasts as long as it: values
    are then linked within the session's results, and nobody can turn them back.
    """
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        named = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, named)
    return named


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; ``count_col`` gets their number.

    The key stands in the query's plan: keep plans and event logs as safe as it.
    """
    if not key:
        raise ValueError("a key is needed")
    any_ = _sql("|".join(KINDS.values()))
    c = f"`{text_col}`"
    found, put = fresh(docs, "_found"), fresh(docs, "_put")
    # A text with neither a digit nor '@' holds none of the kinds but secrets.
    hint = f"{c} rlike {_sql('[0-9@]|(?i:passw|pwd|secret|token|key)')}"
    out = docs.withColumn(found, F.expr(f"if({hint}, regexp_extract_all({c}, {any_}, 0), cast(array() as array<string>))"))
    out = out.withColumn(put, F.expr(f"transform({found}, v -> {pseudonym('v', key)})"))
    joined = f"if(size({found}) > 0, array_join(transform(split({c}, {any_}, -1), (s, j) -> concat(s, coalesce(get({put}, j), ''))), ''), {c})"
    counted: Column = F.expr(f"cast(aggregate(zip_with({found}, {put}, (a, b) -> if(a != b, 1, 0)), 0, (s, d) -> s + d) as long)")
    if count_col:
        out = out.withColumn(count_col, counted)
    return out.withColumn(text_col, F.expr(joined)).drop(found, put)
