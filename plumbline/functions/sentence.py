"""GPGGA-type altitude sentences as text columns."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Talkers whose fix sentences carry the altitude, and the fields around it in a built sentence.
KINDS = ("GPGGA", "GNGGA")
BEFORE, AFTER = ",,,,,1,08,1.0,", ",M,0.0,M,,"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checksum(payload: Column) -> Column:
    """The xor of a sentence's characters, as two hexadecimal digits."""
    return F.lpad(F.hex(F.aggregate(F.split(payload, ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))), 2, "0")


def altitude_tenths(altitude: Column) -> Column:
    """One decimal, halves away from zero; empty for null."""
    tenths = F.floor(F.abs(altitude) * 10 + 0.5).cast("bigint")
    text = F.concat(F.when((altitude < 0) & (tenths > 0), "-").otherwise(""), F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    return F.coalesce(text, F.lit(""))


def build(token: Column, altitude: Column, kind: str = "GPGGA") -> Column:
    payload = F.concat(F.lit(f"{kind},"), token, F.lit(BEFORE), altitude_tenths(altitude), F.lit(AFTER))
    return _let(payload, lambda p: F.concat(F.lit("$"), p, F.lit("*"), checksum(p)))


def parse(line: Column) -> Column:
    """A struct of timestamp_utc, radar_alt_m, raw, valid; null for lines that are no such sentence.

    valid: the checksum fits and the unit is empty or M. An altitude that is no number is null, with valid false.
    A filter on what was parsed is pushed below the column and parses anew for each name in it; where rows are filtered, parsed_rows parses once.
    """
    return _let(F.regexp_replace(line, r"^\s+|\s+$", ""), lambda raw: _let(F.regexp_extract(raw, r"^\$([^*]*)\*", 1), lambda payload: _let(F.split(payload, ","), lambda fields: _frame(raw, payload, fields))))


def _frame(raw: Column, payload: Column, fields: Column) -> Column:
    field = lambda n: F.coalesce(F.get(fields, F.lit(n)), F.lit(""))
    altitude = field(9).try_cast("double")
    given = F.upper(F.regexp_extract(raw, r"^\$[^*]*\*(.*)$", 1))
    valid = (checksum(payload) == given) & field(10).isin("", "M") & ((field(9) == "") | altitude.isNotNull())
    frame = F.struct(field(1).alias("timestamp_utc"), altitude.alias("radar_alt_m"), raw.alias("raw"), valid.alias("valid"))
    return F.when(raw.rlike(r"^\$[^*]*\*") & field(0).isin(*KINDS), frame)


def parsed_rows(line: Column) -> Column:
    """The columns of parse, for a select: lines that are no such sentence have no row. Filters stay above it, so each line is parsed once."""
    return F.inline(F.filter(F.array(parse(line)), lambda f: f.isNotNull()))
