"""Evidence mapped to dimensions, levels of texts against a rubric, and records of one person merged."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamworks.functions.numeric import clamp
from loamworks.functions.text import hit_count, whole_word_hits
from loamworks.operators.lineage import cut
from loamworks.operators.signals import broad_score


def to_dimensions(evidence: DataFrame, weights: DataFrame, keys: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Per key and dimension: the weighted mean of evidence (source, score, confidence), its confidence, weight and sources.

    ``weights`` has (source, dimension, weight, reliability), a row per pair. Confidence is the chance that at least one
    piece of evidence holds. A dimension without evidence has score 50, confidence 0 and no source; evidence without a
    score or of an unknown source counts for nothing, but its key comes out.

    Evidence is added up by source first, and that small table is written down, as it is read twice.
    """
    spark = evidence.sparkSession
    trust = F.broadcast(weights.groupBy("source").agg(F.max("reliability").alias("reliability")))  # one row a source
    scored = F.col("score").isNotNull()
    doubt = 1 - F.coalesce("confidence", F.lit(0.0)) * F.coalesce("reliability", F.lit(0.0))
    by_source = cut(evidence.join(trust, "source", "left").groupBy(*keys, "source").agg(F.sum(clamp(F.col("score"), 0, 100)).alias("_sum"), F.count_if(scored).alias("_n"), F.product(F.when(scored, doubt)).alias("_doubt")))
    frame = by_source.select(*keys).distinct().join(F.broadcast(spark.createDataFrame([(x,) for x in dimensions], "dimension string")))
    w = F.col("weight")
    g = by_source.where("_n > 0").join(F.broadcast(weights), "source").groupBy(*keys, "dimension").agg(
        (F.sum(F.col("_sum") * w) / F.sum(F.col("_n") * w)).alias("score"), (1 - F.product("_doubt")).alias("confidence"), F.sum(F.col("_n") * w).alias("total_weight"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")
    )
    zero = F.lit(0.0)
    return frame.join(g, [*keys, "dimension"], "left").select(*keys, "dimension", F.coalesce("score", F.lit(50.0)).alias("score"), F.coalesce("confidence", zero).alias("confidence"), F.coalesce("total_weight", zero).alias("total_weight"), F.coalesce("sources", F.lit("")).alias("sources"))


def rubric_level(text: Column, rubric: Mapping[int, Sequence[str]], least: Mapping[int, int]) -> tuple[Column, Column]:
    """The highest level whose keywords stand in a text often enough (1 if none does), and how many of its keywords do."""
    level, found = F.lit(1), F.lit(0)
    for n in sorted(rubric):
        k = F.size(whole_word_hits(text, rubric[n]))
        level, found = F.when(k >= least[n], F.lit(n)).otherwise(level), F.when(k >= least[n], k).otherwise(found)
    return level.cast("bigint"), found.cast("bigint")


def rubric_confidence(found: Column, length: Column, measured: Column | bool = False) -> Column:
    """Confidence of a level from the keywords found, the length of the text, and whether a metric was given."""
    base = F.when(found >= 5, 0.90).when(found >= 3, 0.75).when(found >= 2, 0.65).otherwise(0.50)
    metric = F.when(measured if isinstance(measured, Column) else F.lit(measured), 1.1).otherwise(1.0)
    return clamp(base * F.when(length > 10_000, 1.1).when(length < 1_000, 0.9).otherwise(1.0) * metric, 0.3, 1.0)


#: Lowest and highest score of each level of a rubric.
BANDS = {5: (80, 100), 4: (60, 79), 3: (40, 59), 2: (20, 39), 1: (0, 19)}


def rubric_scored(df: DataFrame, text_col: str, rubric: Mapping[int, Sequence[str]], least: Mapping[int, int], metric_col: str | None = None, thresholds: Mapping[int, float] | None = None) -> DataFrame:
    """``df`` without its text, but with level, score, found and confidence by a rubric of keywords by level.

    The highest level counts whose keywords stand in the text often enough and, where the metric is not null, whose
    threshold it reaches; the score lies within the level's band by the keywords beyond the least number, with 5 points
    for a metric of 1.5 times the threshold. If no level fits, a text of many broad terms has their score at level 3 with
    confidence 0.5, and any other 15 at level 1 with 0.3. A null text counts as empty.
    """
    text, hits = F.coalesce(F.col(text_col), F.lit("")), {n: f"_hits{n}" for n in rubric}
    counted = {f"_hits{n}": F.size(whole_word_hits(text, words)) for n, words in rubric.items()}
    df = df.withColumns({**counted, "_broad": broad_score(F.lower(text)), "_length": F.length(text)}).drop(text_col)
    metric = F.col(metric_col) if metric_col else F.lit(None).cast("double")
    result = lambda level, score, found, confidence: F.struct(F.lit(level).cast("bigint").alias("level"), score.cast("double").alias("score"), found.cast("bigint").alias("found"), confidence.cast("double").alias("confidence"))
    out = F.when(F.col("_broad") >= 40, result(3, F.col("_broad"), F.lit(0), F.lit(0.5))).otherwise(result(1, F.lit(15.0), F.lit(0), F.lit(0.3)))
    for n in sorted(rubric):
        (low, high), k, spare, floor = BANDS[n], F.col(hits[n]), len(rubric[n]) - least[n], (thresholds or {}).get(n, 0.0)
        share = (k - least[n]) / F.lit(spare) if spare > 0 else F.lit(0.5)
        bonus = F.when(metric > 1.5 * floor, 5.0).otherwise(0.0)
        fits = (k >= least[n]) & F.coalesce(metric >= floor, F.lit(True))
        out = F.when(fits, result(n, clamp(low + (high - low) * share + bonus, low, high), k, rubric_confidence(k, F.col("_length"), metric.isNotNull()))).otherwise(out)
    return df.withColumn("_result", out).select(*[c for c in df.columns if c not in (*hits.values(), "_broad", "_length")], "_result.*")


def cited(passages: DataFrame, keys: Sequence[str], words: Sequence[str], id_col: str, top: int = 5, prefix: int = 200) -> DataFrame:
    """(keys, id, n_matched, place): per key, the ``top`` passages (content) that match most of the keywords, ties by id.

    A keyword matches if any of its words stands in the passage; passages that start with the same ``prefix`` characters
    count once, the one that matches most and then the least id. Only counts and a hash leave the task that read a text.
    """
    low = F.lower("content")
    matched = sum((_any_word(low, w).cast("int") for w in words), F.lit(0))
    rows = passages.where("content is not null").select(*keys, F.col(id_col), F.xxhash64(F.left("content", F.lit(prefix))).alias("_start"), matched.cast("bigint").alias("n_matched")).where("n_matched > 0")
    once = rows.groupBy(*keys, "_start").agg(F.min(F.struct((-F.col("n_matched")).alias("m"), F.col(id_col).alias("id"))).alias("best"))
    w = Window.partitionBy(*keys).orderBy("best.m", "best.id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(*keys, F.col("best.id").alias(id_col), (-F.col("best.m")).alias("n_matched"), F.col("place").cast("bigint").alias("place"))


def _any_word(low: Column, keyword: str) -> Column:
    return hit_count(low, keyword.lower().split()) > 0


def merged_members(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of board members: the longest bio, the first title that is not Director, whether any is independent, the longest tenure, and the committees as they were typed."""
    bio = F.coalesce("bio", F.lit(""))
    own = F.when(F.lower(F.trim("title")) != "director", F.struct("created_at", "title"))
    return members.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.max_by(bio, F.struct(F.length(bio), bio)).alias("bio"), F.coalesce(F.min(own)["title"], F.lit("Director")).alias("title"), F.coalesce(F.bool_or("is_independent"), F.lit(False)).alias("is_independent"),
        F.max(F.col("tenure_years").cast("double")).alias("tenure_years"), F.sort_array(F.collect_set(F.trim("committees"))).alias("committees"),
    )


def concentration(jobs: DataFrame, key: str, mentions: str | None = None) -> DataFrame:
    """Talent concentration of groups of jobs (level, title): how far they depend on few and senior people.

    ``mentions`` names a column of how often each row's review names a single person; without it that part counts nothing.
    """
    named = F.sum(mentions) if mentions else F.lit(0)
    g = jobs.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("level") == "senior").alias("senior"), F.countDistinct("title").alias("skills"), named.alias("_named"))
    lead = F.when(F.col("n") == 0, 0.5).otherwise(F.col("senior") / F.col("n"))
    team = F.least(F.lit(1.0), 1 / (F.sqrt("n") + 0.1))
    persons = F.least(F.lit(1.0), F.col("_named") / F.col("n"))
    return g.withColumn("concentration", clamp(0.4 * lead + 0.3 * team + 0.2 * F.greatest(F.lit(0.0), 1 - F.col("skills") / 15) + 0.1 * persons, 0, 1)).drop("_named")


def justification(passages: DataFrame, keys: Sequence[str], words: Sequence[str], strong: int = 2) -> DataFrame:
    """Per key: how many passages (content, confidence) hold a word, which words stand in none, and how strong the case is."""
    low = F.lower("content")
    held = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    g = passages.select(*keys, "confidence", held.alias("held")).groupBy(*keys).agg(F.count_if(F.size("held") > 0).alias("matching"), F.avg("confidence").alias("confidence"), F.array_distinct(F.flatten(F.collect_set("held"))).alias("found"))
    gaps = F.array_except(F.array(*[F.lit(w) for w in words]), F.col("found"))
    strength = F.when((F.col("confidence") >= 0.8) & (F.col("matching") >= strong), "strong").when((F.col("confidence") >= 0.6) | (F.col("matching") >= 1), "moderate").otherwise("weak")
    return g.select(*keys, "matching", F.array_join(gaps, ",").alias("gaps"), strength.alias("strength"))
