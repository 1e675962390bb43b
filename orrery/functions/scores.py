"""Reliability scores: bucketed tiers as CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tiers as (at least or at most, points), in order.
RECENCY_LOW = ((30, 15), (90, 12), (180, 8), (365, 4))
RECENCY_HUB = ((30, 25), (90, 20), (180, 14), (365, 8))
MAINTENANCE = ((14, 25), (45, 20), (90, 15), (180, 10), (365, 5))
STARS = ((500, 15), (100, 12), (30, 8), (5, 4), (1, 1))
HUB_DOWNLOADS = ((100_000, 25), (10_000, 20), (1_000, 14), (100, 8), (10, 4), (1, 1))
HUB_LIKES = ((1_000, 15), (200, 12), (50, 8), (10, 4), (1, 1))
SET_DOWNLOADS = ((100_000, 22), (10_000, 18), (1_000, 12), (100, 7), (10, 3), (1, 1))
SET_VOTES = ((1_000, 12), (200, 9), (50, 6), (10, 3), (1, 1))
BOOK_VOTES = ((500, 28), (100, 22), (30, 15), (10, 9), (3, 4), (1, 1))
MEDALS = {"gold": 12, "silver": 8, "bronze": 4, "1": 12, "2": 8, "3": 4}
README_SIGNALS = ("install", "usage", "example", "train", "evaluate", "inference", "setup")
README_BASICS = ("install", "usage", "setup", "quickstart", "getting started")
README_WHY = ("why ", "purpose", "objective", "advantage", "benefit", "comparison", "features")
README_WHEN = ("roadmap", "status", "future plan", "changelog", "version history")
RESEARCH_SIGNALS = ("arxiv", "paper", "citation", "dataset", "benchmark")
PRACTICE_SIGNALS = ("security", "vulnerability", "lts", "github actions", "ci/cd", "workflow", "pytest", "travis", "circleci")
SIZE_TIERS = ((20_000, "20k+"), (5_000, "5k-20k"), (1_000, "1k-5k"), (0, "<1k"))


def at_least(value: Column, tiers: Sequence[tuple[int, int]], otherwise: int = 0) -> Column:
    out = None
    for bound, points in tiers:
        out = F.when(value >= bound, points) if out is None else out.when(value >= bound, points)
    return out.otherwise(otherwise)


def at_most(value: Column, tiers: Sequence[tuple[int, int]], otherwise: int) -> Column:
    """Null scores 0."""
    out = F.when(value.isNull(), 0)
    for bound, points in tiers:
        out = out.when(value <= bound, points)
    return out.otherwise(otherwise)


def days_since(ts: Column, as_of: Column) -> Column:
    """Whole days, never negative; null for bad stamps."""
    days = F.datediff(as_of, F.try_to_timestamp(ts.cast("string")).cast("date"))
    return F.when(days < 0, 0).otherwise(days)


def updated_year(ts: Column) -> Column:
    return F.coalesce(F.year(F.try_to_timestamp(ts.cast("string"))), F.lit(0))


def activity(days: Column) -> Column:
    return at_most(days, RECENCY_LOW, 1)


def hub_activity(days: Column) -> Column:
    return at_most(days, RECENCY_HUB, 2)


def adoption(stars: Column) -> Column:
    return at_least(stars, STARS)


def hub_adoption(downloads: Column, likes: Column) -> Column:
    return at_least(downloads, HUB_DOWNLOADS) + at_least(likes, HUB_LIKES)


def dataset_adoption(downloads: Column, votes: Column, usability: Column) -> Column:
    us = F.bround(F.greatest(F.least(usability, F.lit(1.0)), F.lit(0.0)) * 6, 0).cast("int")
    return F.least(at_least(downloads, SET_DOWNLOADS) + at_least(votes, SET_VOTES) + us, F.lit(40))


def notebook_adoption(votes: Column, medal: Column) -> Column:
    points = F.lit(0)
    for name, p in MEDALS.items():
        points = F.when(F.lower(F.trim(medal)) == name, p).otherwise(points)
    return F.least(at_least(votes, BOOK_VOTES) + points, F.lit(40))


def license_points(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")).isin("", "NOASSERTION"), 0).otherwise(10)


def hub_license(name: Column) -> Column:
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(n == "", 0).when(n.isin("other", "unknown", "unlicense-other"), 7).otherwise(15)


def has_any(text: Column, signals: Sequence[str]) -> Column:
    out = F.lit(False)
    for s in signals:
        out = out | text.contains(s)
    return out


def count_of(text: Column, signals: Sequence[str]) -> Column:
    return sum((text.contains(s).cast("int") for s in signals), F.lit(0))


def readme_points(readme: Column) -> Column:
    t = F.lower(F.coalesce(readme, F.lit("")))
    return F.when(t == "", 0).otherwise(F.least(3 + 2 * count_of(t, README_SIGNALS), F.lit(15)))


def readme_completeness(readme: Column) -> Column:
    t = F.lower(F.coalesce(readme, F.lit("")))
    basics = F.least(4 + 2 * count_of(t, README_BASICS), F.lit(10))
    rest = F.when(has_any(t, README_WHY), 5).otherwise(0) + F.when(has_any(t, README_WHEN), 5).otherwise(0)
    return F.when(t == "", 0).otherwise(F.least(basics + rest, F.lit(20)))


def code_blocks(readme: Column) -> Column:
    t = F.coalesce(readme, F.lit(""))
    n = F.floor((F.length(t) - F.length(F.replace(t, F.lit("```"), F.lit("")))) / 6)
    return F.when(n >= 3, 10).when(n >= 1, 5).otherwise(0)


def research_linkage(description: Column, readme: Column) -> Column:
    return F.when(has_any(F.lower(F.concat_ws("\n", description, readme)), RESEARCH_SIGNALS), 5).otherwise(0)


def practices(description: Column, readme: Column, license_name: Column) -> Column:
    t = F.lower(F.concat_ws("\n", description, readme))
    return license_points(license_name) + F.least(2 * count_of(t, PRACTICE_SIGNALS), F.lit(10)) + research_linkage(description, readme)


def completed_stable(stars: Column, forks: Column, opened: Column, closed: Column) -> Column:
    """Adopted, with issue history and at least as many issues closed as open."""
    return ((stars >= 50) | (forks >= 10)) & (opened + closed > 0) & (closed > 0) & (closed >= opened)


def maintenance(days: Column, stars: Column, forks: Column, opened: Column, closed: Column) -> Column:
    fresh = at_most(days, MAINTENANCE, 1)
    floor = F.when(stars >= 200, 15).otherwise(12)
    return F.when(days.isNull(), 0).when(completed_stable(stars, forks, opened, closed), F.greatest(fresh, floor)).otherwise(fresh)


def fork_to_star(stars: Column, forks: Column) -> Column:
    """Ratios are compared as products, so no division rounds."""
    few = F.when(forks > 0, 5).otherwise(0)
    return F.when(stars < 10, few).when(forks * 10 >= stars, 10).when(forks * 20 >= stars, 7).when(forks * 50 >= stars, 4).otherwise(1)


def release_cadence(n: Column) -> Column:
    return at_least(n, ((6, 6), (3, 4), (1, 2)))


def ci_health(success: Column, sampled: Column) -> Column:
    good = F.when(success * 5 >= sampled * 4, 3).when(success * 2 >= sampled, 1).otherwise(0)
    return F.when(sampled <= 0, 0).otherwise(3 + good)


def third_party(contributors: Column, reporters: Column) -> Column:
    return at_least(contributors, ((8, 3), (3, 2), (1, 1))) + at_least(reporters, ((5, 3), (3, 2), (1, 1)))


def issue_points(issues: Column, with_body: Column, closed: Column, labelled: Column, stars: Column) -> Column:
    none = F.when(stars >= 50, 0).otherwise(3)
    some = 3 + F.when(with_body > 0, 3).otherwise(0) + F.when(closed > 0, 3).otherwise(0) + F.when(labelled > 0, 1).otherwise(0)
    return F.when(issues == 0, none).otherwise(F.least(some, F.lit(10)))


def pool_relative(rows: DataFrame, days: str, score: str, pool: str) -> DataFrame:
    """rows with the maintenance score lifted by the recency rank within the pool; only lifts, from three rankable rows on.

    Ranks come from counts of distinct days, so a large pool is never sorted in one task.
    """
    per_day = rows.where(F.col(days).isNotNull()).groupBy(pool, days).agg(F.count("*").alias("__c"))
    w = W.partitionBy(pool)
    staler = F.sum("__c").over(w) - F.sum("__c").over(w.orderBy(days))
    side = per_day.select(pool, days, F.sum("__c").over(w).alias("__n"), staler.alias("__staler"))
    lifted = F.bround(2 + F.col("__staler") * 10 / F.greatest(F.col("__n") - 1, F.lit(1)), 0).cast("int")
    got = rows.join(side, [pool, days], "left")
    return got.withColumn(score, F.when(F.col("__n") >= 3, F.greatest(F.col(score), lifted)).otherwise(F.col(score))).drop("__n", "__staler")


def quality_band(score: Column) -> Column:
    return F.when(score >= 70, "高").when(score >= 40, "中").otherwise("低")


def relevance(fit: Column, scale: int) -> Column:
    return F.least(F.greatest(fit / F.lit(float(scale)), F.lit(0.0)), F.lit(1.0))


def relevance_level(r: Column) -> Column:
    return F.when(r >= 0.67, "高").when(r >= 0.35, "中").otherwise("低")


def anchor_score(reliability: Column, r: Column) -> Column:
    return reliability * (0.35 + 0.65 * r)


def size_tier(n: Column) -> Column:
    out = None
    for bound, name in SIZE_TIERS:
        out = F.when(n >= bound, name) if out is None else out.when(n >= bound, name)
    return out
