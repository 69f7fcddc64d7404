"""The chain from dimension scores to a final score with its confidence interval, and text features that become scores."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.functions import lexicons as L
from loamworks.functions.numeric import clamp, ratio
from loamworks.functions.text import hit_count
from loamworks.operators.lineage import spread


def dimension_name(c: Column) -> Column:
    """The name of a dimension in the scoring vocabulary, null for others."""
    low = F.lower(F.trim(c))
    name = F.when(low.isin(*L.DIMENSIONS), low)
    for alias, to in L.DIMENSION_ALIASES.items():
        name = name.when(low == alias, F.lit(to))
    return name


def chain(df: DataFrame, places: int | None = 4) -> DataFrame:
    """``df`` with vr, position, hr, synergy, final, sem, ci_lower and ci_upper.

    It has a double column for each dimension, talent_concentration, percentile, sector and evidence_count. With
    ``places``, what a stage takes from the one before is rounded half up to so many places; without, nothing is.
    """
    q = (lambda c: F.round(F.round(c, 9), places)) if places is not None else (lambda c: c)  # of decimals, not of their binary neighbours
    table = F.create_map(*[x for s, v in L.SECTORS.items() for x in (F.lit(s), F.array(*[F.lit(y) for y in v]))])
    sector = F.coalesce(F.try_element_at(table, F.coalesce("sector", F.lit(""))), F.array(*[F.lit(y) for y in L.SECTOR_DEFAULT]))
    dims = [(clamp(q(F.col(d)), 0, 100), w) for d, w in L.DIMENSIONS.items()]
    df = df.withColumn("_s", sector).withColumn("_mean", q(sum((c * w for c, w in dims), F.lit(0.0))))
    df = df.withColumn("_sd", q(F.sqrt(sum((F.lit(w) * (c - F.col("_mean")) * (c - F.col("_mean")) for c, w in dims), F.lit(0.0)))))
    df = df.withColumn("_cv", q(ratio(F.col("_sd"), F.col("_mean"))))
    tc = clamp(q(F.col("talent_concentration")), 0, 1)
    vr = F.col("_mean") * clamp(1 - L.PENALTY * F.col("_cv"), 0, 1) * clamp(1 - L.TALENT_COEFFICIENT * F.greatest(F.lit(0.0), tc - L.TALENT_THRESHOLD), 0, 1)
    df = df.withColumn("vr", clamp(vr, 0, 100))
    position = 0.6 * clamp((q(F.col("vr")) - F.col("_s")[0]) / 50, -1, 1) + 0.4 * clamp((q(F.col("percentile")) - 0.5) * 2, -1, 1)
    df = df.withColumn("position", clamp(position, -1, 1))
    df = df.withColumn("hr", clamp(F.col("_s")[1] * (1 + L.POSITION * q(F.col("position"))), 0, 100))
    df = df.withColumn("synergy", clamp(q(F.col("vr")) * q(F.col("hr")) / 100 * F.col("_s")[2] * clamp(F.col("_s")[3], 0.8, 1.2), 0, 100))
    df = df.withColumn("final", (1 - L.SYNERGY) * (L.SHARE * q(F.col("vr")) + (1 - L.SHARE) * q(F.col("hr"))) + L.SYNERGY * q(F.col("synergy")))
    n = F.greatest(F.col("evidence_count").cast("double"), F.lit(1.0))
    rho = F.least(n * L.RELIABILITY / (1 + (n - 1) * L.RELIABILITY), F.lit(L.MOST_RELIABLE))
    df = df.withColumn("sem", L.SPREAD * F.sqrt(1 - rho))
    half = L.Z95 * F.col("sem")
    return df.withColumns({"ci_lower": clamp(F.col("final") - half, 0, 100), "ci_upper": clamp(F.col("final") + half, 0, 100)}).drop("_s", "_mean", "_sd", "_cv")


def culture_scores(reviews: DataFrame, keys: Sequence[str], as_of: Column, id_col: str = "id") -> DataFrame:
    """Culture scores of groups of reviews, each id once: keyword hits weighted by recency and employment.

    Hits are counted before repeated rows are dropped, so that no text is shuffled.
    """
    text = F.lower(F.concat_ws(" ", "title", "pros", "cons", "job_title", "advice_to_management"))
    weight = F.when(F.datediff(as_of, "review_date") < 730, 1.0).otherwise(0.5) * F.when(F.col("is_current_employee"), 1.2).otherwise(1.0)
    n = lambda words: hit_count(F.col("_text"), words) * F.col("_weight")
    rows = spread(reviews.select(id_col, *keys, "rating", "is_current_employee", text.alias("_text"), weight.alias("_weight"))).select(
        id_col, *keys, "rating", "is_current_employee", (n(L.INNOVATION_POSITIVE) - n(L.INNOVATION_NEGATIVE)).alias("i"), n(L.DATA_DRIVEN).alias("d"), n(L.AI_AWARENESS).alias("a"), (n(L.CHANGE_POSITIVE) - n(L.CHANGE_NEGATIVE)).alias("c")
    ).dropDuplicates([id_col])
    mean = lambda c: F.sum(c) / F.count("*")
    scored = rows.groupBy(*keys).agg(
        F.count("*").alias("review_count"), clamp(mean("i") * 50 + 50, 0, 100).alias("innovation"), clamp(mean("d") * 100, 0, 100).alias("data_driven"), clamp(mean("a") * 100, 0, 100).alias("ai_awareness"),
        clamp(mean("c") * 50 + 50, 0, 100).alias("change_readiness"), F.avg(F.col("rating").cast("double")).alias("avg_rating"), F.avg(F.coalesce("is_current_employee", F.lit(False)).cast("int")).alias("current_ratio"),
    )
    overall = 0.30 * F.col("innovation") + 0.25 * F.col("data_driven") + 0.25 * F.col("ai_awareness") + 0.20 * F.col("change_readiness")
    k = F.col("review_count")
    confidence = F.when(k < 10, 0.5).when(k < 20, 0.7).when(k < 40, 0.85).otherwise(0.95)
    return scored.withColumns({"overall": overall, "confidence": confidence})


def governance(members: DataFrame, keys: Sequence[str], id_col: str = "id", strategy: DataFrame | None = None) -> DataFrame:
    """Governance flags and score of boards, each member id once: each flag adds its points to a base of 20, up to 100.

    ``strategy`` (keys, text) are texts on a board's strategy, any number a board; without them no board has an AI strategy.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    any_of = lambda c, words: hit_count(F.col(f"_{c}"), words) > 0
    office = any_of("title", L.DATA_OFFICERS) | F.arrays_overlap(F.split(F.col("_title"), r"\s+"), F.array(*[F.lit(x) for x in ("caio", "cdo", "cto", "cio")]))
    rows = members.select(id_col, *keys, "is_independent", *[low(c).alias(f"_{c}") for c in ("title", "committees", "bio")]).select(
        id_col, *keys, any_of("committees", L.TECH_COMMITTEES).alias("tech"), any_of("bio", L.BOARD_EXPERTISE).alias("expert"), office.alias("office"), F.coalesce("is_independent", F.lit(False)).alias("independent"),
        F.contains("_committees", F.lit("risk")).alias("risk"), any_of("bio", L.TECH_MENTIONS).alias("mention"),
    ).dropDuplicates([id_col])
    g = rows.groupBy(*keys).agg(F.count("*").alias("members"), F.bool_or("tech").alias("has_tech_committee"), F.bool_or("expert").alias("has_ai_expertise"), F.bool_or("office").alias("has_data_officer"), (F.avg(F.col("independent").cast("int")) > 0.5).alias("has_independent_majority"), F.bool_or("risk").alias("_risk"), F.bool_or("mention").alias("_mention"))
    if strategy is None:
        g = g.withColumns({"_plan": F.lit(False), "_tech": F.lit(False)})
    else:
        low = F.lower("text")
        told = strategy.where("text is not null").select(*keys, (hit_count(low, L.STRATEGY_WORDS) > 0).alias("_plan"), (hit_count(low, (*L.TECH_MENTIONS, "data")) > 0).alias("_tech"))
        g = g.join(told.groupBy(*keys).agg(F.bool_or("_plan").alias("_plan"), F.bool_or("_tech").alias("_tech")), list(keys), "left").fillna(False, ["_plan", "_tech"])
    g = g.withColumns({"has_risk_tech_oversight": F.col("_risk") & (F.col("_mention") | F.col("_tech")), "has_ai_strategy": F.col("_plan")}).drop("_risk", "_mention", "_tech", "_plan")
    points = {"has_tech_committee": 15, "has_ai_expertise": 20, "has_data_officer": 15, "has_independent_majority": 10, "has_risk_tech_oversight": 10, "has_ai_strategy": 10}
    score = sum((F.col(c).cast("int") * p for c, p in points.items()), F.lit(20))
    return g.withColumns({"governance": score.cast("bigint"), "confidence": F.least(0.5 + F.col("members") / 20, F.lit(0.95))})
