"""Text expressions that stay in the JVM."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(c: Column) -> Column:
    """NUL to blank, one blank for runs of blanks and tabs, \\n for line ends, at most one empty line, no blanks around."""
    c = F.regexp_replace(F.translate(c, "\x00", " "), r"\r\n?", "\n")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{2,}", "\n\n"), F.lit(" \n"))


def word_count(c: Column) -> Column:
    """Words separated by white space; 0 for an empty text."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("bigint")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


#: Lists of more words are searched by a function over one literal array: a plan with a node for every word takes seconds to optimise.
LONG_LIST = 8


def hit_count(low: Column, words: Sequence[str]) -> Column:
    """How many of the words stand as substrings in a text that is in lower case; null texts hold none. Short lists become generated code."""
    if len(words) > LONG_LIST:
        listed = F.split(F.lit("\x1f".join(words)), "\x1f")
        return F.size(F.filter(listed, lambda w: F.contains(F.coalesce(low, F.lit("")), w)))
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def whole_word_hits(c: Column, words: Sequence[str]) -> Column:
    """The words that stand in the text between characters other than ASCII letters, digits and underscores; words are no patterns."""
    low = F.lower(c)
    stands = lambda w: F.contains(low, F.lit(w.lower())) & low.rlike(rf"(^|[^a-z0-9_])\Q{w.lower()}\E([^a-z0-9_]|$)")
    return F.array_compact(F.array(*[F.when(stands(w), F.lit(w)) for w in words]))


def domain(c: Column) -> Column:
    """The host of an address: without scheme, www and path, in lower case."""
    return F.lower(F.regexp_replace(F.split_part(F.regexp_replace(c, r"^[A-Za-z]+://", ""), F.lit("/"), F.lit(1)), r"^www\.", ""))


def company_name(c: Column) -> Column:
    """A company's name without punctuation and legal form, in lower case."""
    bare = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(^| )(inc|incorporated|corp|corporation|llc|ltd|limited|plc|co|company|gmbh|lp)( |$)", " "), r" +", " "))


def shortened(c: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis only where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def filing_form(c: Column) -> Column:
    """A filing type in capitals without blanks and hyphens."""
    return F.upper(F.regexp_replace(c, r"[\s-]+", ""))


def garbage(c: Column) -> Column:
    """Whether a text is too short or holds too few letters to be of use."""
    return F.coalesce((F.length(c) < 50) | (F.length(F.regexp_replace(c, r"[^\p{L}]", "")) < 0.4 * F.length(c)), F.lit(True))


def form_like(c: Column, headings: Sequence[str], start: int = 200) -> Column:
    """Whether a text is too short, holds too few letters, or starts with a heading of a form."""
    low = F.lower(F.substring(c, 1, start))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.coalesce((F.length(F.trim(c)) < 50) | (letters < 0.4 * F.length(c)) | (hit_count(low, headings) > 0), F.lit(True))


def squished(c: Column) -> Column:
    """The ASCII letters and digits of a name, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def committees(c: Column, patterns: Sequence[str]) -> Column:
    """The names that fit the patterns in a text, in title case, once each in the order of the patterns."""
    low = F.lower(c)
    found = F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(p), F.lit(0)) for p in patterns]))
    return F.array_distinct(F.transform(found, lambda x: F.initcap(F.regexp_replace(x, r"\s+", " "))))
