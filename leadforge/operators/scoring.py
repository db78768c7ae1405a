"""Lead scores: pain x ability to pay x reach, then hard gates. All of it is column arithmetic.

The order of operations is part of the contract: pain parts are rounded before they are summed, pay
is rounded before it is multiplied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadforge.functions.numbers import clamp, first_number, first_year, half_up, lcp_bucket, present, round2, text

#: Fixed values of the scoring formula.
STALE_PER_YEAR, STALE_YEARS, NEVER_REDESIGNED = 4.0, 11, 6.0
LEGACY_JQUERY, LEGACY_BOOTSTRAP, DATED_SLIDER, OLD_GENERATOR = 5.0, 3.0, 5.0, 4.0
NO_VIEWPORT, OVERFLOW_PER_PX, OVERFLOW_CAP, TAP_PER, TAP_CAP = 14.0, 0.04, 12.0, 0.35, 7.0
NO_HTTPS, BAD_CERTIFICATE, MIXED_PER, MIXED_CAP, BROKEN_PER, BROKEN_CAP, DEAD_PER, DEAD_CAP = 18.0, 20.0, 0.8, 6.0, 1.2, 8.0, 0.6, 5.0
LCP_PAIN = {"fast": 0.0, "ok": 3.0, "slow": 7.0, "dire": 11.0}
WEIGHT_PER_MB, WEIGHT_CAP, HERO_VIDEO = 0.7, 8.0, 2.0
REVIEWS_FULL, RATING_FLOOR, AGED_YEARS = 120, 3.8, 5
FULL_PAIN, SPREAD = 150.0, 2.25
TIER_CUTS = {"A": 62, "B": 42, "C": 24}
GATE_CEILINGS = {"A": 100, "B": 61, "C": 43, "X": 23}
DATED_SLIDERS = "(?i)revslider|revolution|nivo|owl|cycle|flexslider"
FREE_BUILDERS = "(?i)ai site builder|wix|weebly|godaddy builder|builder default"


def points(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def capped(signal: Column, per: float, cap: float) -> Column:
    return clamp(F.coalesce(signal, F.lit(0.0)) * per, 0.0, cap)


def total(*parts: Column) -> Column:
    """Left to right, so that the doubles agree everywhere."""
    return reduce(lambda a, b: a + b, parts)


def old_wordpress(generator: Column) -> Column:
    version = F.regexp_extract(text(generator), r"(?i)wordpress\s*([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(F.nullif(version, F.lit("")).try_cast("double") < 5.5, F.lit(False))


def staleness(s: dict[str, Column], year: int) -> Column:
    built = F.coalesce(first_year(s["redesigned"]), first_year(s["copyright"]), first_year(s["wayback"]))
    untouched = first_year(s["wayback"]).isNotNull() & first_year(s["redesigned"]).isNull() & (F.lower(text(s["redesigned"])) != "n/a")
    return round2(total(
        F.when(built.isNotNull(), clamp(year - built, 0, STALE_YEARS) * STALE_PER_YEAR).otherwise(F.lit(0.0)), points(untouched, NEVER_REDESIGNED),
        points(first_number(s["jquery"]) < 3, LEGACY_JQUERY), points(first_number(s["bootstrap"]) < 4, LEGACY_BOOTSTRAP),
        points(text(s["slider"]).rlike(DATED_SLIDERS), DATED_SLIDER), points(old_wordpress(s["generator"]), OLD_GENERATOR),
        points(text(s["generator"]).rlike("(?i)frontpage|static html|table") | text(s["theme"]).rlike("(?i)table"), OLD_GENERATOR),
    ))


def mobile(s: dict[str, Column]) -> Column:
    return round2(total(points(F.lower(text(s["viewport"])) == "missing", NO_VIEWPORT), capped(first_number(s["overflow"]), OVERFLOW_PER_PX, OVERFLOW_CAP), capped(first_number(s["tapTargets"]), TAP_PER, TAP_CAP)))


def trust(s: dict[str, Column], dead_links: Column) -> Column:
    https = F.lower(text(s["https"]))
    door = F.when(https.rlike("none|http only|^no$"), NO_HTTPS).when(https.rlike("expired|invalid|self"), BAD_CERTIFICATE).otherwise(F.lit(0.0))
    return round2(total(door, capped(first_number(s["mixedContent"]), MIXED_PER, MIXED_CAP), capped(first_number(s["brokenImages"]), BROKEN_PER, BROKEN_CAP), capped(dead_links, DEAD_PER, DEAD_CAP)))


def performance(s: dict[str, Column]) -> Column:
    bucket = F.create_map(*(F.lit(x) for kv in LCP_PAIN.items() for x in kv))[lcp_bucket(s["lcp"])]
    return round2(total(bucket, capped(first_number(s["pageWeight"]), WEIGHT_PER_MB, WEIGHT_CAP), points(present(s["heroVideo"]), HERO_VIDEO)))


def ability(reviews: Column, rating: Column, s: dict[str, Column], agency: Column) -> Column:
    reviews, rating = F.coalesce(reviews, F.lit(0)), F.coalesce(rating, F.lit(0.0))
    a = F.sqrt(clamp(reviews, 0, REVIEWS_FULL) / REVIEWS_FULL)
    a = F.when((rating != 0) & (rating < RATING_FLOOR), a * 0.75).otherwise(a)
    a = F.when(F.coalesce(first_number(s["domainAge"]), F.lit(0.0)) >= AGED_YEARS, a * 0.85 + 0.15).otherwise(a)
    a = F.when(F.coalesce(agency, F.lit(False)), a * 0.8 + 0.2).otherwise(a)
    a = F.when(present(s["whatsapp"]) | present(s["quoteForm"]), a * 0.9 + 0.1).otherwise(a)
    return round2(clamp(a, 0.0, 1.0))


def reach(kinds: Column) -> Column:
    phone, email, insta = (F.array_contains(F.coalesce(kinds, F.array().cast("array<string>")), k) for k in ("phone", "email", "instagram"))
    return F.when(phone & (email | insta), 1.0).when(phone | email, 0.8).otherwise(F.lit(0.4))


def gate(s: dict[str, Column], reviews: Column, pain: Column) -> Column:
    """struct(tier, why) of the first gate that closes, else null."""
    reviews = F.coalesce(reviews, F.lit(0))
    age = first_number(s["domainAge"])

    def closed(tier: str, why: str) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(why).alias("why"))

    return (
        F.when(F.concat(text(s["generator"]), F.lit(" "), text(s["theme"])).rlike(FREE_BUILDERS), closed("C", "free or AI builder"))
        .when((F.when(age == 0, 99.0).otherwise(F.coalesce(age, F.lit(99.0))) < 1) & (reviews < 10), closed("C", "young domain with few reviews"))
        .when(pain < 12, closed("X", "no measurable pain"))
        .when((reviews < 20) & (pain > 45), closed("C", "much pain and little budget"))
    )


SIGNALS = (
    "copyright jquery bootstrap slider wayback redesigned generator theme domainAge viewport overflow tapTargets lcp pageWeight heroVideo https mixedContent brokenImages whatsapp quoteForm blog"
).split()


def score(leads: DataFrame, year: int = 2026) -> DataFrame:
    """``leads`` with pain parts, pain, pay, reach, score, tier, gate and lcp_bucket.

    Reads the 21 signal columns, dead_links, reviews, rating, agency (boolean) and kinds (array of contact kinds).
    """
    s = {k: F.col(k) for k in SIGNALS}
    out = leads.withColumns({"staleness": staleness(s, year), "mobile": mobile(s), "trust": trust(s, F.col("dead_links").cast("double")), "perf": performance(s)})
    out = out.withColumns({
        "pain": round2(total(F.col("staleness"), F.col("mobile"), F.col("trust"), F.col("perf"))),
        "pay": ability(F.col("reviews"), F.col("rating"), s, F.col("agency")), "reach": reach(F.col("kinds")), "lcp_bucket": lcp_bucket(s["lcp"]),
    })
    raw = half_up(clamp(clamp(F.col("pain") / FULL_PAIN, 0.0, 1.0) * F.col("pay") * F.col("reach") * SPREAD * 100, 0.0, 100.0)).cast("int")
    out = out.withColumns({"raw_score": raw, "closed": gate(s, F.col("reviews"), F.col("pain"))})
    open_tier = F.when(F.col("raw_score") >= TIER_CUTS["A"], "A").when(F.col("raw_score") >= TIER_CUTS["B"], "B").when(F.col("raw_score") >= TIER_CUTS["C"], "C").otherwise("X")
    ceiling = F.create_map(*(F.lit(x) for kv in GATE_CEILINGS.items() for x in kv))[F.col("closed.tier")]
    return out.withColumns({
        "tier": F.coalesce("closed.tier", open_tier), "score": F.when(F.col("closed").isNotNull(), F.least("raw_score", ceiling)).otherwise(F.col("raw_score")), "gate": F.col("closed.why"),
    }).drop("raw_score", "closed")
