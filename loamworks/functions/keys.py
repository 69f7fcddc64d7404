"""Reference keys as they are typed: padded, in either letter case, blank."""

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n "


def text_key(c: Column | str) -> Column:
    """Lower-cased and stripped key; null for null and blank keys."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.btrim(c, F.lit(BLANKS))), F.lit(""))


def upper_key(c: Column | str) -> Column:
    """The same for tickers, which are written in capitals."""
    return F.upper(text_key(c))
