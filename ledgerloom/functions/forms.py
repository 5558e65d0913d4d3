"""Canonical and normalised forms, identities and positions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMP = r"^(\d{4}-\d{2}-\d{2})[-T ](\d{2})[.:](\d{2})[.:](\d{2})(?:[.,](\d+))?$"


def event_id(*parts: Column | str) -> Column:
    """PRJ-2: sha256 of source system, journal, receiver and sequence joined by bars."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def key_fingerprint(present: Column, *keys: Column | str) -> Column:
    """PRJ-5: hash of the key values as a JSON array; null where the image is absent (an array of nulls
    would hash to a constant and pull unrelated rows in)."""
    values = [F.coalesce(F.to_json(F.array(F.col(k) if isinstance(k, str) else k), {"ignoreNullFields": "false"}), F.lit("[null]")) for k in keys]
    return F.when(present, F.sha2(F.concat_ws(",", *values), 256))


def encode_position(receiver: Column | str, sequence: Column | str) -> Column:
    """PRJ-15: receiver:%020d."""
    r, s = (F.col(x) if isinstance(x, str) else x for x in (receiver, sequence))
    return F.concat(r, F.lit(":"), F.lpad(s.cast("string"), 20, "0"))


def decode_position(position: Column | str) -> tuple[Column, Column]:
    p = F.col(position) if isinstance(position, str) else position
    return F.regexp_extract(p, r"^(.*):(\d{20})$", 1), F.regexp_extract(p, r"^(.*):(\d{20})$", 2).cast("long")


def canonical_char(text: Column, width: int) -> Column:
    """Fixed-width text compares padded on the right; longer values stay as they are."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def canonical_decimal(text: Column, scale: int, precision: int = 38) -> Column:
    """Exact decimal at its scale, ties to even."""
    wide = text.cast(f"decimal({precision},{min(precision - 1, scale + 6)})")
    return F.bround(wide, scale).cast(f"decimal({precision},{scale})").cast("string")


def canonical_date(text: Column) -> tuple[Column, Column]:
    """PRJ-9: ISO date of ISO text or the date part of a timestamp; two-digit years are refused."""
    iso = F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})(?:$|[T -])", 1)
    day = F.try_to_date(F.when(iso != "", iso), "yyyy-MM-dd")
    short = F.trim(text).rlike(r"^\d{2}-\d{2}-\d{2}$")
    return F.date_format(day, "yyyy-MM-dd"), F.when(short, "two_digit_year").when(text.isNotNull() & day.isNull(), "not_a_date")


def canonical_timestamp(text: Column, digits: int) -> Column:
    """PRJ-10: one spelling with a fixed number of fractional digits, cut or padded, never rounded; null if
    the text is no timestamp."""
    t = F.trim(text)
    part = [F.regexp_extract(t, STAMP, i) for i in range(1, 6)]
    base = F.concat(part[0], F.lit(" "), F.concat_ws(":", *part[1:4]))
    full = F.concat(base, F.lit("."), F.rpad(F.substring(part[4], 1, digits), digits, "0")) if digits else base
    return F.when(t.rlike(STAMP), full)


def plain_decimal(value: Column) -> Column:
    """PRJ-11: decimal text without trailing zeros, and no negative zero."""
    s = value.cast("string")
    cut = F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)
    return F.when(cut.isin("-0", "0", ""), "0").otherwise(cut)


def exact_integer(text: Column) -> Column:
    """PRJ-11: integers as they are; null if the text is not one."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).cast("decimal(38,0)"))


def epoch_ms(text: Column, offset_hours: int) -> Column:
    """PRJ-12: milliseconds of an ISO timestamp, cut and not rounded; text without a zone is ``offset_hours``
    ahead of UTC.  Read in a UTC session."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    micros = F.unix_micros(F.try_to_timestamp(text))
    return F.floor((micros - F.when(zoned, F.lit(0)).otherwise(F.lit(offset_hours * 3600 * 1000000))) / 1000)


def technical_key(receiver: str, sequence: str, op: str) -> Column:
    """PRJ-14: receiver/sequence/op, foreign operation codes made common."""
    return F.concat_ws("/", receiver, F.col(sequence).cast("string"), common_op(F.col(op)))


def temporal_key(at_ms: str, op: str) -> Column:
    return F.concat_ws("/", F.col(at_ms).cast("string"), common_op(F.col(op)))


def common_op(op: Column) -> Column:
    return F.when(op.isin("c", "r"), "c").when(op.isin("u", "u_after"), "u").when(op == "d", "d")


def local_to_utc(local: Column, zone: str) -> tuple[Column, Column]:
    """PRJ-13: UTC of a local wall clock, and why it has none: a nonexistent or an ambiguous hour is
    refused.  A clock time is ambiguous if an hour later or earlier in UTC shows the same wall clock."""
    t = local.cast("timestamp")
    utc = F.to_utc_timestamp(t, zone)
    back = F.from_utc_timestamp(utc, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(utc + hour, zone) == t) | (F.from_utc_timestamp(utc - hour, zone) == t)
    why = F.when(local.isNull(), "missing").when(back != t, "nonexistent_hour").when(twice, "ambiguous_hour")
    return F.when(why.isNull(), utc), why


def september_to_utc(local: Column) -> tuple[Column, Column]:
    """PRJ-13 for the system value whose summer time (one hour ahead of UTC+1) begins at 02:00 on the last Sunday of March
    and ends at 02:00 on the last Sunday of September, a rule that no zone database has."""
    t = local.cast("timestamp")
    last = lambda month: F.date_sub(F.next_day(F.last_day(F.make_date(F.year(t), F.lit(month), F.lit(1))), "SUN"), 7)
    at = lambda month, h: last(month).cast("timestamp") + F.make_dt_interval(hours=F.lit(h))
    why = (F.when(local.isNull(), "missing").when((t >= at(3, 2)) & (t < at(3, 3)), "nonexistent_hour").when((t >= at(9, 1)) & (t < at(9, 2)), "ambiguous_hour"))
    summer = (t >= at(3, 3)) & (t < at(9, 1))
    return F.when(why.isNull(), t - F.make_dt_interval(hours=F.when(summer, 2).otherwise(1))), why


def key_object(present: Column, **keys: Column | str) -> Column:
    """PRJ-5: the key values as a JSON object, nulls kept; null where the image is absent."""
    values = [(F.col(k) if isinstance(k, str) else k).alias(n) for n, k in keys.items()]
    return F.when(present, F.to_json(F.struct(*values), {"ignoreNullFields": "false"}))


def canonicalise(df: DataFrame, schema: dict[str, tuple]) -> DataFrame:
    """PRJ-8: every declared column in its one spelling, as text: ("integer",), ("char", width), ("varchar",),
    ("decimal", precision, scale), ("date",), ("timestamp", digits); what has none is null.  Other columns stay."""
    def form(c: str, kind: str, *args: int) -> Column:
        x = F.col(c).cast("string")
        if kind == "integer":
            return exact_integer(x).cast("string")
        if kind == "char":
            return canonical_char(x, *args)
        if kind == "varchar":
            return x
        if kind == "decimal":
            return canonical_decimal(x, args[1], args[0])
        if kind == "date":
            return canonical_date(x)[0]
        if kind == "timestamp":
            return canonical_timestamp(x, *args)
        raise ValueError(f"unknown kind {kind}")
    return df.withColumns({c: form(c, *kind) for c, kind in schema.items()})
