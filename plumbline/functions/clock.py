"""Times of day: seconds since midnight and hhmmss.sss tokens."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without time zone, from its fields, so that the session's zone doesn't count."""
    day, c = F.unix_date(F.to_date(F.col(ts))).cast("bigint"), F.col(ts)
    return (day * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def day_ms(ts: str = "ts") -> Column:
    return F.pmod(F.floor(micros(ts) / 1000), F.lit(DAY_MS)).cast("bigint")


def token(ms: Column) -> Column:
    """hhmmss.sss of milliseconds since midnight, over midnight from 0."""
    ms = F.pmod(ms, F.lit(DAY_MS)).cast("bigint")
    part = lambda div, mod: F.pmod(F.floor(ms / div), F.lit(mod)).cast("int")
    return F.format_string("%02d%02d%02d.%03d", part(3_600_000, 24), part(60_000, 60), part(1000, 60), part(1, 1000))


def seconds(tok: Column) -> Column:
    """Seconds since midnight of a token. Fewer than six digits: a plain number of seconds. Empty or unreadable: null."""
    digits = F.length(F.replace(tok, F.lit("."), F.lit("")))
    number = lambda c: c.try_cast("double")
    whole = number(F.substring(tok, 1, 2)) * 3600 + number(F.substring(tok, 3, 2)) * 60 + number(F.substring(tok, 5, 100))
    return F.when(tok == "", None).when(digits < 6, number(tok)).otherwise(whole)
