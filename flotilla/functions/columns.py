"""Column expressions shared by the operators. All are built-in Spark
expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STAMP_FORMAT


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    return col_or(c).cast("string")


# -- integers with Python semantics -------------------------------------------------

def py_mod(n: Column, d: int) -> Column:
    """``n % d`` as Python computes it (sign of the divisor)."""
    return F.pmod(n, F.lit(d))


def py_floordiv(n: Column, d: int) -> Column:
    """``n // d`` as Python computes it (rounds toward minus infinity)."""
    return ((n - py_mod(n, d)) / d).cast("int")


def host_ips(prefix: str, first_host: int, count: Column) -> Column:
    """``[prefix + str(first_host + i) for i in range(count)]``."""
    return F.transform(F.array_repeat(F.lit(0), count),
                       lambda _, i: F.concat(F.lit(prefix), (i + first_host).cast("string")))


# -- time rendering --------------------------------------------------------------

def iso_micros(ts: Column) -> Column:
    """ISO time with six fraction digits, always."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_time(ts: Column) -> Column:
    """Python ``isoformat()``: the fraction is printed only when the
    microseconds are not zero."""
    full = iso_micros(ts)
    return F.when(full.endswith(".000000"), F.substring(full, 1, 19)).otherwise(full)


def stamp(ts: Column) -> Column:
    """Deployment stamp ``dd-mm-yy-HHhMM``."""
    return F.date_format(ts, STAMP_FORMAT)


# -- JSON text --------------------------------------------------------------------

# Text that JSON writes unchanged between quotes (no quote, backslash or
# control character).
PLAIN_JSON_TEXT = r'^[^"\\\x00-\x1f]*$'


def json_string(c: Column) -> Column:
    """JSON text of a string column; SQL null becomes JSON ``null``.

    Plain text is quoted directly; anything needing escapes goes through
    ``to_json`` (a one-element array whose brackets are cut off, which
    avoids a struct field name)."""
    c = c.cast("string")
    wrapped = F.to_json(F.array(c))
    escaped = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    return (F.when(c.isNull(), F.lit("null"))
            .when(c.rlike(PLAIN_JSON_TEXT), F.concat(F.lit('"'), c, F.lit('"')))
            .otherwise(escaped))


def json_decode_text(value_json: Column) -> Column:
    """The decoded value of a JSON scalar as text: string content, number
    text, ``true``/``false``; null for JSON null."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")


def json_value(given: Column) -> Column:
    """One JSON value given as text, written anew on one line; SQL null if
    the text is not exactly one JSON value.

    Parsed as a VARIANT, so objects and lists keep their content whatever
    their spacing (keys of an object come out sorted; one that names a key
    twice is no value). A number on its own stays as it was written. The
    parser stops after a first value, so the text is also read as the one
    element of a list and as the one field of an object: no text that closes
    or opens something of its own passes both."""
    given = F.trim(given, F.lit(" \t\n\r"))
    listed = F.try_parse_json(F.concat(F.lit("["), given, F.lit("]")))
    field = F.try_parse_json(F.concat(F.lit('{"v":'), given, F.lit("}")))
    value = F.try_variant_get(field, "$.v", "variant")
    alone = value.isNotNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.when(given.rlike(NUMBER_JSON), given).otherwise(F.to_json(value)))


def is_json_string(value_json: Column) -> Column:
    return value_json.startswith('"')


def py_int_text(digits: Column) -> Column:
    """A decimal integer as Python prints it: no plus, no leading zeros."""
    bare = F.regexp_replace(F.regexp_replace(digits, "[\\s_+-]", ""), "^0+(?=[0-9])", "")
    return F.when(F.trim(digits).startswith("-") & (bare != "0"), F.concat(F.lit("-"), bare)).otherwise(bare)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used
    (the one element of an array that is transformed)."""
    return F.get(F.transform(F.array(value), use), 0)


def py_float_text(value: Column) -> Column:
    """A double as Python prints it: the fewest digits that give the same
    double, positional for exponents from -4 to 15, else scientific. Of several
    such forms Python takes the nearest; here, seldom, a last digit may differ."""
    def shortest(v: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(16)),
                            lambda p: F.call_function("format_string", F.concat(F.lit("%."), p.cast("string"), F.lit("e")), v))
        return F.get(F.filter(tries, lambda t: t.try_cast("double") == v), 0)

    def printed(scientific: Column) -> Column:  # Python's own form but for plain exponents
        exponent = F.substring_index(scientific, "e", -1).try_cast("int")
        digits = F.regexp_replace(F.substring_index(scientific, "e", 1), "[-.]", "")
        places = F.length(digits)
        plain = (F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
                 .when(exponent >= places - 1, F.concat(digits, F.repeat(F.lit("0"), exponent - places + 1), F.lit(".0")))
                 .otherwise(F.concat(F.left(digits, exponent + 1), F.lit("."), F.substr(digits, exponent + 2))))
        sign = F.when(scientific.startswith("-"), "-").otherwise("")
        return F.when(exponent.between(-4, 15), F.concat(sign, plain)).otherwise(scientific)

    return bound(value.cast("double"), lambda v: F.when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
                 .otherwise(bound(shortest(v), printed)))


def py_string_repr(value: Column) -> Column:
    """``repr`` of a string: the quote it does not hold (single if it holds
    both or none), escapes for backslashes, that quote and control characters.
    Characters beyond Latin-1 are printed as they are."""
    def printed(v: Column) -> Column:
        single = ~(v.contains("'") & ~v.contains('"'))
        out = F.replace(v, F.lit("\\"), F.lit("\\\\"))
        out = F.replace(out, F.lit("'"), F.when(single, "\\'").otherwise("'"))
        for char, letter in (("\n", "n"), ("\r", "r"), ("\t", "t")):
            out = F.replace(out, F.lit(char), F.lit("\\" + letter))
        quote = F.when(single, "'").otherwise('"')
        return F.concat(quote, bound(out, plain), quote)

    def plain(o: Column) -> Column:
        odd = F.transform(F.split(o, ""), lambda c: F.when(c.rlike(ODD_CHAR), F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(c)), 2, "0")))).otherwise(c))
        return F.when(o.rlike(ODD_CHAR), F.array_join(odd, "")).otherwise(o)

    return bound(value, printed)


ODD_CHAR = "[\\x00-\\x1f\\x7f-\\xa0\\xad]"
#: Tokens of JSON text without space between them.
JSON_TOKEN = r'("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null|[\[\]{},:])'


def _py_number(text: Column) -> Column:
    return F.when(text.rlike(INT_JSON), py_int_text(text)).otherwise(py_float_text(text.try_cast("double")))


def py_repr(value_json: Column) -> Column:
    """``str`` of a list or object given as JSON on one line (its members are
    printed by ``repr``): token by token, however deep it goes."""
    def token(t: Column) -> Column:
        return (F.when(t.startswith('"'), py_string_repr(json_decode_text(t)))
                .when(t == ",", ", ").when(t == ":", ": ")
                .when(t == "null", "None").when(t == "true", "True").when(t == "false", "False")
                .when(t.rlike("^[-0-9]"), _py_number(t)).otherwise(t))
    return F.array_join(F.transform(F.regexp_extract_all(value_json, F.lit(JSON_TOKEN), F.lit(1)), token), "")


def py_str(value_json: Column) -> Column:
    """``str(value)`` of a decoded JSON value as Python prints it, used when
    a value is formatted into text (the database URL)."""
    odd = bound(value_json, lambda v: F.when(v.rlike("^[\\[{]"), py_repr(v)).otherwise(_py_number(v)))
    return (F.when(value_json == "null", F.lit("None"))
            .when(value_json == "true", F.lit("True"))
            .when(value_json == "false", F.lit("False"))
            .when(is_json_string(value_json), json_decode_text(value_json))
            .otherwise(odd))


def strict_bool(value_json: Column) -> Column:
    """``value == 'True'``: true only for the string ``True``. The boolean
    ``true``, ``'true'`` and null are all false (C3)."""
    return F.coalesce(value_json == F.lit('"True"'), F.lit(False))


INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"
NUMBER_JSON = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
INT_JSON = r"^-?[0-9]+$"
FLOAT_JSON = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def config_int(value_json: Column) -> Column:
    """``int(value)`` (C4). Strings follow Python's integer syntax (spaces
    around, a sign, single underscores between digits); booleans give 1 and
    0; JSON integers pass, other JSON numbers lose their fraction. Anything
    else, JSON null, and integers beyond 64 bits give SQL null, which
    :func:`config_int_error` flags."""
    decoded = json_decode_text(value_json)
    from_text = F.when(decoded.rlike(INT_TEXT), F.regexp_replace(decoded, "_", "").try_cast("bigint"))
    return (F.when(value_json == "true", F.lit(1).cast("bigint"))
            .when(value_json == "false", F.lit(0).cast("bigint"))
            .when(is_json_string(value_json), from_text)
            .when(value_json.rlike(INT_JSON), value_json.try_cast("bigint"))
            .when(value_json.rlike(FLOAT_JSON), value_json.try_cast("double").try_cast("bigint")))


def config_int_error(value_json: Column) -> Column:
    return config_int(value_json).isNull()


#: Doubles from here on are not turned into integers (their digits would pass a decimal's 38).
LARGEST_FLOAT_INT = 2.0 ** 125


def config_int_text(value_json: Column) -> Column:
    """``int(value)`` of any length as decimal text (C4): like
    :func:`config_int`, but integers may be as long as they like, and a
    fraction is cut from doubles of up to 2**125 exactly. Null where ``int``
    fails."""
    decoded = json_decode_text(value_json)
    whole = value_json.try_cast("double")
    whole = F.when(F.abs(whole) < LARGEST_FLOAT_INT, whole)
    # Exact: a double's multiple of 2**62, and the rest below that.
    high = (whole / float(1 << 62)).cast("bigint")
    low = (whole - high.cast("double") * float(1 << 62)).cast("bigint")
    cut = (high.cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + low.cast("decimal(19,0)")).cast("string")
    return (F.when(value_json == "true", "1").when(value_json == "false", "0")
            .when(is_json_string(value_json), F.when(decoded.rlike(INT_TEXT), py_int_text(decoded)))
            .when(value_json.rlike(INT_JSON), py_int_text(value_json))
            .when(value_json.rlike(FLOAT_JSON), cut))


# -- constant tables as one SQL expression -------------------------------------------
#
# Lookups over the fixed tables (40 configuration keys, 27 state keys, ...)
# are written as SQL text and parsed once, instead of being assembled from
# hundreds of small Column calls; the plan is the same CASE / array literal.

def sql_literal(v) -> str:
    """A Python constant as Spark SQL literal text."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L" if abs(v) >= 2 ** 31 else str(v)
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def case_sql(col_name: str, mapping: dict, default=None) -> str:
    whens = " ".join(f"WHEN {sql_literal(k)} THEN {sql_literal(v)}" for k, v in mapping.items())
    return f"CASE `{col_name}` {whens} ELSE {sql_literal(default)} END"


def case_lookup(col_name: str, mapping: dict, default=None, cast: str | None = None) -> Column:
    """``CASE col WHEN k THEN v ... ELSE default END`` for a constant table."""
    expr = case_sql(col_name, mapping, default)
    return F.expr(f"CAST({expr} AS {cast})" if cast else expr)


def struct_sql(fields: dict) -> str:
    """``named_struct(..)`` text; values are SQL text already."""
    return "named_struct(" + ", ".join(f"{sql_literal(k)}, {v}" for k, v in fields.items()) + ")"
