"""Column functions on numbers, dates, payloads and type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskmill.functions import fixed as X
from deskmill.functions.text import bind

# The two spellings of each payload field.
PAYLOAD_FIELDS = {
    "counterparty_name": ("counterpartyName", "counterparty_name"),
    "bin": ("bin", "BIN"),
    "debt_amount": ("debtAmount", "debt_amount"),
    "unsigned_eavr_count": ("unsignedEavrCount", "unsigned_eavr_count"),
    "unsigned_eavr_amount": ("unsignedEavrAmount", "unsigned_eavr_amount"),
}


def lenient_number(col: Column) -> Column:
    """Number out of text such as ``1 234,50``; anything else is null."""
    bare = F.translate(F.translate(col, " \u00a0", ""), ",", ".")
    number = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return F.when(bare.rlike(number), bare.try_cast("double"))


def lenient_int(col: Column) -> Column:
    n = lenient_number(col)
    return F.when(n == F.floor(n), n.cast("long"))


def payload_body(payload: Column) -> Column:
    """The JSON object that holds the known fields: on top, under result, or under data."""
    top = F.when(F.json_array_length(payload) == 1, F.get_json_object(payload, "$[0]")).otherwise(payload)
    known = F.array(*[F.lit(n) for names in PAYLOAD_FIELDS.values() for n in names])
    inner = [top, F.get_json_object(top, "$.result"), F.get_json_object(top, "$.data")]
    held = [F.when(F.arrays_overlap(F.json_object_keys(c), known), c) for c in inner]
    return F.when(F.json_object_keys(top).isNotNull(), F.coalesce(*held, top))


def pick(body: Column, field: str) -> Column:
    return F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in PAYLOAD_FIELDS[field]])


def http_error_kind(code: Column) -> Column:
    return (F.when(code.between(200, 299), None).when(code == 400, "bad_request").when(code == 401, "unauthorized")
            .when(code == 403, "forbidden").when(code >= 500, "server_error").otherwise("http_error"))


def typed_cell(col: Column) -> Column:
    """struct(kind, d, ts, i, n, s): what a text cell holds. Codes with leading zeros stay text."""
    v = F.trim(col)
    moment = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?)?"
    day = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v.try_cast("date"))
    at = F.when(v.rlike(moment) & (F.length(v) != 10), F.regexp_replace(v, r"(Z|[+-]\d{2}:\d{2})$", "").try_cast("timestamp_ntz"))
    numeric = v.rlike(r"^-?\d+([.,]\d+)?$") & ~v.rlike(r"^0[^.,]")
    whole = F.when(numeric & ~v.rlike("[.,]"), v.try_cast("long"))
    real = F.when(numeric & v.rlike("[.,]"), F.translate(v, ",", ".").try_cast("double"))
    kind = (F.when(day.isNotNull(), "date").when(at.isNotNull(), "datetime").when(whole.isNotNull(), "int")
            .when(real.isNotNull(), "float").otherwise("text"))
    return F.struct(kind.alias("kind"), day.alias("d"), at.alias("ts"), whole.alias("i"), real.alias("n"),
                    F.when(kind == "text", col).alias("s"))


def coerce_param(col: Column) -> Column:
    """Timestamp of an ISO date or date-time text; null when the text is neither and stays as it is."""
    iso = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$"
    return F.when(col.rlike(iso), col.try_cast("timestamp_ntz"))


def json_value(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def shown_type(value: Column) -> Column:
    """Type name as shown: primitives by list, references and objects of the known kinds by suffix."""
    primitive = F.create_map(*[F.lit(x) for kv in X.PRIMITIVE_TYPES.items() for x in kv])
    kinds = F.create_map(*[F.lit(x) for _, single, shown in X.OBJECT_KINDS for x in (single, shown)])

    def shown(v, head):
        tail = F.when(F.contains(v, F.lit(".")), F.substring(v, F.length(head) + 2, F.length(v))).otherwise("")
        named = lambda dot: F.coalesce(
            F.concat(F.try_element_at(kinds, F.regexp_extract(head, "^(.*)Ref$", 1)), F.lit("Ссылка"), dot),
            F.concat(F.try_element_at(kinds, F.regexp_extract(head, "^(.*)Object$", 1)), F.lit("Объект"), dot),
            F.concat(F.try_element_at(kinds, head), dot), v)
        return bind(tail, lambda t: F.coalesce(F.when(t == "", F.try_element_at(primitive, F.lower(head))),
                                               named(F.when(t != "", F.concat(F.lit("."), t)).otherwise(""))))

    return bind(F.regexp_replace(F.trim(value), r"^[^:]*:", ""), lambda v: bind(F.substring_index(v, ".", 1), lambda head: shown(v, head)))
