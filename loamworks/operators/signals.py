"""Evidence extractors: postings, pages, patents and leadership become scores from 0 to 100. All are generated code."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.functions import signal_words as S
from loamworks.functions.numeric import clamp
from loamworks.functions.text import hit_count


def _any(low: Column, words: Sequence[str]) -> Column:
    return hit_count(low, words) > 0


def _capped(low: Column, families: Mapping[str, Sequence[str]], weights: Mapping[str, tuple[int, float]]) -> Column:
    """The sum over families of their hits, up to a number, times their weight."""
    return sum((F.least(hit_count(low, families[f]), F.lit(n)) * F.lit(w) for f, (n, w) in weights.items()), F.lit(0.0))


def generic_title(title: Column) -> Column:
    """Whether a title in lower case is one of general IT and names nothing of AI."""
    return _any(title, S.GENERIC_TITLES) & ~_any(title, S.AI_TITLES)


def skill_count(text: Column) -> Column:
    """How many different skills stand in a text in lower case."""
    return hit_count(text, tuple(dict.fromkeys(w for words in S.SKILLS.values() for w in words)))


def job_relevance(title: Column, text: Column) -> Column:
    """How far a posting is about AI, 0 to 1, by its skills and title, both in lower case; general IT reaches 0.25."""
    hits = hit_count(title, S.AI_TITLES)
    boost = F.when(hits >= 2, 0.40).when(hits == 1, 0.25).otherwise(0.0)
    boost = F.when(_any(title, S.HARDWARE_TITLES), F.greatest(boost, F.lit(0.30))).otherwise(boost)
    general = F.least(skill_count(text) / 10, F.lit(1.0)) * 0.25
    return F.round(F.when(generic_title(title), general).otherwise(F.least(_capped(text, S.SKILLS, S.SKILL_WEIGHTS) + boost, F.lit(1.0))), 3)


def signal_score(share: Column) -> Column:
    """A share as a score from 1 to 100."""
    return clamp(F.bround(share * 100), 1, 100).cast("bigint")


def tech_mentions(text: Column) -> Column:
    """How many different technologies stand in a text in lower case."""
    return hit_count(text, tuple(dict.fromkeys(w for words in S.TECHNOLOGIES.values() for w in words)))


def tech_adoption(title: Column, text: Column) -> Column:
    """How far a page shows AI technology, 0 to 1; 0 without a mention."""
    boost = F.when(_any(title, S.TECHNOLOGY_TITLES), 0.10).otherwise(0.0)
    return F.when(tech_mentions(text) == 0, 0.0).otherwise(F.least(_capped(text, S.TECHNOLOGIES, S.TECHNOLOGY_WEIGHTS) + boost, F.lit(1.0)))


def _starts_with(start: str):
    return lambda x: F.upper(x).startswith(start)


def patent_flags(text: Column, classes: Column | None = None) -> dict[str, Column]:
    """Of each category, whether a patent is of it, by its text in lower case and, where given, an array of class codes; ml_core if nothing fits."""
    flags = {c: _any(text, words) for c, words in S.PATENT_CATEGORIES.items()}
    if classes is not None:
        for start, c in S.PATENT_CLASSES.items():
            flags[c] = flags[c] | F.coalesce(F.exists(classes, _starts_with(start)), F.lit(False))
    none = ~sum((f.cast("int") for f in flags.values()), F.lit(0)).cast("boolean")
    return flags | {"ml_core": flags["ml_core"] | none}


def patent_activity(patents: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    """(keys, n, recent, categories, score, maturity) of patents (text, filed): counts, recency and breadth, each up to a limit.

    Only counts and flags are shuffled. A patent without a date is not recent; one without a text is of the core.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    flags = patent_flags(low)
    rows = patents.select(*keys, (F.col("filed") >= F.date_sub(as_of, 365)).alias("_recent"), *[f.alias(f"_{c}") for c, f in flags.items()])
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_recent").alias("recent"), sum((F.bool_or(f"_{c}").cast("int") for c in flags), F.lit(0)).cast("bigint").alias("categories"))
    score = F.least(F.col("n") * 5, F.lit(50)) + F.least(F.col("recent") * 2, F.lit(20)) + F.least(F.col("categories") * 10, F.lit(30))
    maturity = F.when(F.col("score") >= 80, "AI Innovator").when(F.col("score") >= 60, "AI Developer").when(F.col("score") >= 30, "AI Experimenter").otherwise("Limited AI Innovation")
    return g.withColumn("score", score.cast("bigint")).withColumn("maturity", maturity)


def role_weight(title: Column) -> Column:
    """How much a role counts, by its title; 0.5 where nothing fits."""
    t = F.lower(F.coalesce(title, F.lit("")))
    has = lambda *words: _any(t, words)
    return (
        F.when(has("chief ai officer", "cai"), 1.0).when(has("ceo", "chief executive", "founder"), 1.0).when(t.startswith("cto") | has("chief technology"), 0.9)
        .when(t.startswith("cdo") | has("chief data"), 0.85).when(t.startswith("vp") | has("vice president"), 0.7).otherwise(0.5)
    )


def indicator_score(title: Column, bio: Column) -> Column:
    """The strongest indicator of AI leadership in a title (the first that fits) and a biography (all that fit); 0 without one."""
    of_title = F.lit(0.0)
    for pattern, name in reversed(S.TITLE_PATTERNS):
        of_title = F.when(title.rlike(f"(?i){pattern}"), S.INDICATORS[name]).otherwise(of_title)
    of_bio = [F.when(bio.rlike(f"(?i){pattern}"), S.INDICATORS[name]).otherwise(0.0) for pattern, name in S.BIO_PATTERNS]
    return F.greatest(of_title, *of_bio)


def leadership(members: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """(keys, n, score) of leaders (title, bio), each id once: the mean of their indicators, weighted by role, 0 to 1."""
    rows = members.select(id_col, *keys, role_weight(F.col("title")).alias("w"), indicator_score(F.coalesce("title", F.lit("")), F.coalesce("bio", F.lit(""))).alias("s")).dropDuplicates([id_col])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.least(F.sum(F.col("w") * F.col("s")) / F.sum("w"), F.lit(1.0)).alias("score"))


def looks_like_job(content: Column) -> Column:
    """Whether a content is the title of a job rather than a person and a role."""
    listed = F.contains(content, F.lit(" — ")) | F.contains(content, F.lit(" – "))
    return F.coalesce((F.length(content) >= 10) & ~listed & _any(F.lower(F.trim(content)), S.JOB_WORDS), F.lit(False))


def placeholder(category: Column, score: Column, raw: Column, count: Column) -> Column:
    """Whether a signal only states that nothing was found: no score and no count, or a text that says so."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    none = F.coalesce(count == 0, F.lit(False))
    told = (
        F.when(category == "innovation_activity", none | low.startswith("0 ai patents")).when(category == "digital_presence", none | _any(low, ("scan failed", "no pages accessible")))
        .when(category == "technology_hiring", none & (F.trim(low) == "")).when(category == "leadership_signals", none).otherwise(F.lit(False))
    )
    return F.coalesce(score <= 0, F.lit(False)) & told


def _broad_points(k: int) -> float:
    """The score of a text with ``k`` broad terms: 20 to 95, in pieces."""
    for least, base, step in ((20, 70.0, 1.5), (10, 55.0, 1.5), (5, 40.0, 3.0), (0, 20.0, 4.0)):
        if k >= least:
            return min(95.0, base + (k - least) * step)
    return 20.0


def broad_score(low: Column) -> Column:
    """The score of a text in lower case by the number of broad terms in it."""
    points = F.array(*[F.lit(_broad_points(k)) for k in range(len(S.BROAD_TERMS) + 1)])
    return F.element_at(points, hit_count(low, S.BROAD_TERMS) + 1)


def posting_level(title: Column) -> Column:
    """senior, mid or entry by the words of a title; mid where none fits."""
    t = F.lower(F.coalesce(title, F.lit("")))
    return F.when(_any(t, S.SENIOR_POSTS), "senior").when(_any(t, S.MID_POSTS), "mid").when(_any(t, S.ENTRY_POSTS), "entry").otherwise("mid")
