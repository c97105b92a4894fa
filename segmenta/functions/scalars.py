"""Scalar functions of the message dialects, all built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col, bind, sql_text

# Code tables of the standards and of the mappings.
SEX_TO_GENDER = {"M": "male", "F": "female", "O": "other"}
GENDER_TO_SEX = {"male": "M", "female": "F"}
ORDER_ACTIONS = {"NW": "N", "CA": "C"}
DURATION_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def lookup(col: Column, table: dict[str, str], default: str) -> Column:
    expr = F
    for k, v in table.items():
        expr = expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def gender_from_sex(sex: Column, with_other: bool = True) -> Column:
    table = SEX_TO_GENDER if with_other else {k: v for k, v in SEX_TO_GENDER.items() if k != "O"}
    return lookup(sex, table, "unknown")


def sex_from_gender(gender: Column) -> Column:
    return lookup(gender, GENDER_TO_SEX, "U")


def action_code(order_control: Column) -> Column:
    return lookup(order_control, ORDER_ACTIONS, "A")


def iso_date(hl7: Column) -> Column:
    """YYYYMMDD... to YYYY-MM-DD; NULL when shorter than eight characters."""
    return F.when(F.length(hl7) >= 8, F.concat_ws(
        "-", F.substring(hl7, 1, 4), F.substring(hl7, 5, 2), F.substring(hl7, 7, 2)))


def hl7_date(iso: Column) -> Column:
    return F.replace(iso, F.lit("-"), F.lit(""))


def hl7_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def parse_hl7_time(text: Column) -> Column:
    """Second precision; NULL when the text is no timestamp."""
    return F.try_to_timestamp(F.substring(text, 1, 14), F.lit("yyyyMMddHHmmss"))


def parse_hl7_date(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("date")


def composite(*parts) -> Column:
    """a^b^c, with empty text for missing parts."""
    return F.concat_ws("^", *(F.coalesce(as_col(p).cast("string"), F.lit("")) for p in parts))


def value_text(col: Column, type_name: str) -> Column:
    """Text of a typed value: shortest exact form, empty for NULL."""
    if type_name in ("double", "float"):
        x = col.cast("double")
        mag = F.abs(x)
        digits = F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0(E|$)", "$1"), r"E(-?)(\d)$", "E$10$2")
        sci = F.regexp_replace(F.regexp_replace(digits, r"E(\d)", "e+$1"), "E-", "e-")
        plain = F.regexp_replace(F.format_string("%.17f", x), r"\.?0+$", "")
        fixed = F.when(digits.contains("E"), F.when(mag >= 1, x.cast("decimal(38,0)").cast("string")).otherwise(plain)
                       ).otherwise(digits)
        text = (F.when(F.isnan(x), F.lit("NaN"))
                .when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf"))
                .when((x == 0), F.when(x.cast("string").startswith("-"), F.lit("-0")).otherwise(F.lit("0")))
                .when((mag < 1e-4) | (mag >= 1e21), sci)
                .otherwise(fixed))
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(""))


_JSON_SPECIAL = '[\\\\"\\x00-\\x1f\u2028\u2029]'


def json_quote_sql(t: str) -> str:
    """JSON string literal of ``t`` as SQL text; markup is not escaped."""
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"),
             ("\u2028", "\\u2028"), ("\u2029", "\\u2029")]
    short = t
    for old, new in pairs:
        short = f"replace({short}, {sql_text(old)}, {sql_text(new)})"
    cut = sql_text(r"(?<=[\x00-\x1f])|(?=[\x00-\x1f])")
    ctl = sql_text(r"^[\x00-\x1f]$")
    rare = (f"array_join(transform(split({short}, {cut}), j -> CASE WHEN j RLIKE {ctl} "
            f"THEN concat({sql_text(chr(92) + 'u00')}, lower(hex(j))) ELSE j END), '')")
    odd = sql_text(r"[\x00-\x07\x0b\x0e-\x1f]")
    return (f"concat('\"', CASE WHEN {t} RLIKE {sql_text(_JSON_SPECIAL)} THEN CASE WHEN {t} RLIKE {odd} THEN {rare} ELSE {short} END "
            f"ELSE {t} END, '\"')")


def json_quote(text: Column) -> Column:
    """The same of a column; texts without anything to escape stay in compiled code."""
    return F.coalesce(F.when(text.rlike(_JSON_SPECIAL), bind(text, "t -> " + json_quote_sql("t"))), F.concat(F.lit('"'), text, F.lit('"')))


def json_number_ok(text: Column) -> Column:
    return text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$")


def _entities(text: Column, pairs) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), pairs, text)


_TEXT = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")]


def xml_text(text: Column) -> Column:
    return _entities(text, _TEXT)


def xml_attr(text: Column) -> Column:
    return _entities(text, [*_TEXT, ('"', "&quot;"), ("\n", "&#xA;"), ("\t", "&#x9;")])


def csv_cell(text: Column) -> Column:
    """Minimal quoting; a lone ``\\.`` is quoted as well."""
    needs = text.rlike(r'[,"\r\n]') | text.rlike(r"^[\s\x{85}\x{A0}]") | (text == "\\.")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(cells: Column) -> Column:
    return F.array_join(F.transform(cells, csv_cell), ",")


def csv_row(cells: Column) -> Column:
    """One record without terminator; a record that would be a blank line is
    written as a quoted empty field."""
    line = csv_line(cells)
    return F.when((F.size(cells) == 0) | ((F.size(cells) == 1) & (F.get(cells, F.lit(0)) == "")), F.lit('""')).otherwise(line)


def duration_seconds(text: Column) -> Column:
    """Seconds of a duration such as ``1m30s``; NULL without a unit, negative
    or malformed."""
    unit = r"(?:ns|us|µs|ms|s|m|h)"
    ok = text.rlike(rf"^\+?(?:(?:\d+\.?\d*|\.\d+){unit})+$")
    parts = F.regexp_extract_all(text, F.lit(rf"((?:\d+\.?\d*|\.\d+){unit})"), F.lit(1))

    def seconds(p):
        number = F.regexp_extract(p, r"^([\d.]+)", 1).cast("double")
        name = F.regexp_extract(p, r"([a-zµ]+)$", 1)
        scale = F
        for k, v in DURATION_UNITS.items():
            scale = scale.when(name == k, F.lit(v))
        return number * scale.otherwise(F.lit(None).cast("double"))

    total = F.aggregate(F.transform(parts, seconds), F.lit(0.0), lambda a, x: a + x)
    return F.when(text == "0", F.lit(0.0)).when(ok, total)


def checksum(number: Column, text: Column, terminator: Column) -> Column:
    """Frame checksum: byte sum of number, text and terminator, mod 256, as
    two upper-case hex digits.  ``text`` holds one byte per character.

    No built-in sums bytes, so a batch of frames is summed at once in Arrow."""
    import numpy as np
    import pyarrow as pa

    digits = [f"{v:02X}" for v in range(256)]

    def sums(batch: pa.Array) -> pa.Array:
        _, offsets, data = batch.cast(pa.large_binary()).buffers()
        ends = np.frombuffer(offsets, np.int64)[batch.offset:batch.offset + len(batch) + 1] if len(batch) else np.zeros(1, np.int64)
        held = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(held, dtype=np.int64)])[ends - ends[0]]
        missing = batch.is_null().to_numpy(zero_copy_only=False)
        return pa.array(digits).take(pa.array(np.diff(total) % 256, mask=missing))

    sums.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(sums, returnType="string")(F.encode(F.concat(number, text, terminator), "ISO-8859-1"))


def frame_number(index: Column) -> Column:
    """Wire number of the 1-based frame index: 1..7, 0, 1, ..."""
    return (index % 8).cast("string")


def next_frame_number(number: Column) -> Column:
    return ((number.cast("int") + 1) % 8).cast("string")


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_-]", "_")


def file_name(pattern: str, ts: Column, msg_id: Column, channel: Column, dest: Column) -> Column:
    """Expand {ts} {id} {channel} {dest} in a file-name pattern."""
    out = F.lit(pattern)
    stamp = F.date_format(ts, "yyyyMMdd'T'HHmmss.SSSSSSSSS")
    for token, value in (("{ts}", stamp), ("{id}", msg_id.cast("string")), ("{channel}", channel), ("{dest}", dest)):
        out = F.replace(out, F.lit(token), F.coalesce(value, F.lit("")))
    return out


def one_newline(text: Column) -> Column:
    """Exactly one trailing newline."""
    return F.concat(F.regexp_replace(text, r"[\r\n]+\z", ""), F.lit("\n"))


def snippet(body: Column) -> Column:
    """Start of an error body: first 512 bytes, trimmed, with a lead-in."""
    head = F.make_valid_utf8(F.substring(body.cast("binary"), 1, 512).cast("string"))
    cut = F.regexp_replace(head, r"^\s+|\s+\z", "")
    return F.when(cut == "", F.lit("")).otherwise(F.concat(F.lit(": "), cut))


def patient_number(facility: Column, n: Column) -> Column:
    return F.concat(F.substring(facility, 1, 4), F.lpad(n.cast("string"), 7, "0"))


def visit_number(n: Column) -> Column:
    return F.concat(F.lit("V"), F.lpad(n.cast("string"), 9, "0"))


def account_number(n: Column) -> Column:
    return F.concat(F.lit("A"), F.lpad(n.cast("string"), 9, "0"))


def control_id(n: Column, prefix: str = "SIM") -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 9, "0"))


def summary_line(**attrs: Column) -> Column:
    """Operator-readable summary of a message as compact JSON; absent
    attributes are left out."""
    return F.to_json(F.struct(*(F.nullif(c, F.lit("")).alias(k) for k, c in attrs.items())))
