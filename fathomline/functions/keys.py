"""Column functions on texts and keys shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of any kind, with no-break ones.
BLANKS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(text: Column | str) -> Column:
    """Lower case, with ß as ss."""
    return F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))


def stripped(text: Column | str) -> Column:
    """Without outer blanks."""
    return F.regexp_replace(col(text), rf"^{BLANKS}+|{BLANKS}+$", "")


def plain_key(key: Column | str) -> Column:
    """A key as it is compared: lower case, without outer blanks; null for null and blank keys."""
    return F.nullif(F.lower(stripped(key)), F.lit(""))


def words(text: Column | str, least: int = 1) -> Column:
    """Maximal runs of letters or of digits of the folded text, ``least`` characters or longer."""
    return F.regexp_extract_all(folded(text), F.lit(rf"\p{{L}}{{{least},}}|\p{{Nd}}{{{least},}}"), F.lit(0))


def utc_month(ts: Column | str) -> Column:
    """``yyyy-MM`` in UTC, whatever the session's time zone."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(col(ts)) / F.lit(86_400_000_000)).cast("int"))
    return F.date_format(day, "yyyy-MM")
