"""Dates and names as they are typed in records of filings and people."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_time(c: Column) -> Column:
    """A time in ISO form with or without an offset, with a blank between date and time, or a date; the least time where nothing fits."""
    bare = F.trim(c)
    least = F.lit("0001-01-01 00:00:00").cast("timestamp")
    return F.coalesce(F.try_to_timestamp(bare), F.try_to_timestamp(F.split_part(bare, F.lit("."), F.lit(1)), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd")), least)


def accession_date(folder: Column) -> Column:
    """January 1st of the year in an accession number (issuer-year-number); years below 50 are of this century, null where there is none."""
    year = F.try_element_at(F.split(folder, "-"), F.lit(2)).try_cast("int")
    whole = F.size(F.split(folder, "-")) >= 3
    return F.when(whole & year.between(0, 99), F.make_date(F.when(year < 50, 2000 + year).otherwise(1900 + year), F.lit(1), F.lit(1)))


def filing_address(base: Column, folder: Column, file: Column) -> Column:
    """The address of a filing's file: issuer without leading zeros, accession number without hyphens; null without three parts."""
    issuer = F.coalesce(F.nullif(F.ltrim(F.element_at(F.split(folder, "-"), 1), F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(F.size(F.split(folder, "-")) >= 3, F.concat_ws("/", base, issuer, F.replace(folder, F.lit("-")), file))


def tenure(since: Column, year: Column) -> Column:
    """Years since a year after 1950 and not in the future, else null."""
    return F.when((since > 1950) & (since <= year), year - since)


def ticker_like(c: Column) -> Column:
    """Whether a name is one or two capitals."""
    return F.coalesce(F.trim(c).rlike("^[A-Z]{1,2}$"), F.lit(False))


def search_term(c: Column) -> Column:
    """What to search a company's patents by: its name up to a comma, without legal forms at its end, at most two words."""
    head = F.trim(F.split_part(c, F.lit(","), F.lit(1)))
    bare = F.trim(F.regexp_replace(head, r"(?i)(?:(?:^|\s+)(?:corporation|inc|llc|ltd|co|company|incorporated)\.*)+$", ""))
    words = F.slice(F.split(bare, r"\s+"), 1, 2)
    return F.when(bare == "", F.trim(c)).otherwise(F.array_join(words, " "))
