"""Message codec (G1-G3): rows <-> ``k:v,k:v`` text. Decoding is a built-in
map parse and regular expressions, so it stays in whole-stage codegen; only
the typed JSON text of a message walks its entries one by one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kv_encode(*fields) -> Column:
    """G1: ``key:value`` items joined by ``,``. ``fields`` are column names or
    ``(key, Column)`` pairs. NULL renders as an empty value."""
    items = []
    for f in fields:
        key, col = (f, F.col(f)) if isinstance(f, str) else f
        items.append(F.concat(F.lit(f"{key}:"), F.coalesce(col.cast("string"), F.lit(""))))
    return F.concat_ws(",", *items)


# What a text must look like to be read as a number with a fraction (no type suffix).
_FLOAT = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def value_kind(v) -> Column:
    """Type of a decoded text value, in the reference's precedence (E19):
    a dot means float, ASCII digits mean int, anything else is text. A value
    that is not a valid number stays text instead of failing the message."""
    v = _c(v)
    return (F.when(v.rlike(_FLOAT), F.lit("float"))
            .when(v.rlike(r"^[0-9]+$") & v.try_cast("bigint").isNotNull(), F.lit("int"))
            .otherwise(F.lit("str")))


# A message is decodable iff every ``,``-item holds a ``:`` (key before it).
_ITEM = r"[^,:]*:[^,]*"
VALID_MESSAGE = rf"^{_ITEM}(,{_ITEM})*$"


def kv_valid(msg) -> Column:
    """False for a message with an item that lacks ``:`` (dead letter); NULL stays NULL."""
    return _c(msg).rlike(VALID_MESSAGE)


def kv_decode(msg) -> Column:
    """Text message -> struct<ok boolean, fields map<string, string>>.

    Items split at ``,``; each item splits at its *first* ``:`` so values may
    hold colons (E18). A repeated key keeps its last value: earlier items of
    such a key are cut out of the text first, and only in messages that have
    one, whatever the session's rule for duplicate map keys is."""
    m = _c(msg)
    ok = kv_valid(m)
    keys = F.regexp_extract_all(m, F.lit("(?:^|,)([^,:]*):"), F.lit(1))
    last = F.regexp_replace(F.regexp_replace(m, r"(?:^|,)([^,:]*):[^,]*(?=,(?:[^,]*,)*\1:)", ""), "^,", "")
    text = F.when(F.size(F.array_distinct(keys)) == F.size(keys), m).otherwise(last)
    return F.struct(ok.alias("ok"), F.when(ok, F.str_to_map(text, F.lit(","), F.lit(":"))).alias("fields"))


def decode_messages(df, msg: str, out: str = "_msg"):
    """G2 as a DataFrame step: adds the decoded struct ``out``."""
    return df.withColumn(out, kv_decode(msg))


def kv_get(decoded, key: str, kind: str = "str") -> Column:
    """Typed value of ``key`` from a decoded message (NULL when absent)."""
    v = _c(decoded)["fields"][F.lit(key)]
    if kind == "int":
        return F.when(value_kind(v) == "int", v.try_cast("bigint"))
    if kind == "float":
        return F.when(value_kind(v).isin("int", "float"), v.try_cast("double"))
    return v


def kv_kinds(decoded) -> Column:
    """``key:kind`` list of a decoded message, in the order of its keys."""
    return F.array_join(F.transform(F.map_entries(_c(decoded)["fields"]),
                                    lambda e: F.concat(e["key"], F.lit(":"), value_kind(e["value"]))), ",")


def kv_to_json(decoded) -> Column:
    """JSON object of a decoded message, numbers as numbers (the reference's
    ``json.dumps`` of the typed dict)."""
    def text(v):
        quoted = F.to_json(F.array(v))
        return quoted.substr(F.lit(2), F.length(quoted) - 2)

    def frag(e):
        kind = value_kind(e["value"])
        num = F.when(kind == "int", e["value"].try_cast("bigint").cast("string")) \
               .when(kind == "float", e["value"].try_cast("double").cast("string"))
        return F.concat(text(e["key"]), F.lit(":"), F.coalesce(num, text(e["value"])))
    return F.when(_c(decoded)["ok"], F.concat(
        F.lit("{"), F.array_join(F.transform(F.map_entries(_c(decoded)["fields"]), frag), ","), F.lit("}")))


def line_tokens(line) -> Column:
    """Whitespace tokens of a line, to be exploded by the caller."""
    return words(line)
