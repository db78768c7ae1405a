"""Scores, gates, flags and angles, with a worked lead and edge values."""

import pytest
from pyspark.sql import functions as F

from leadforge.functions import numbers
from leadforge.operators import flags, report, scoring

GOLDEN = dict(
    copyright="2019", jquery="1.12.4", bootstrap="3.3.7", slider="revslider 5.2", wayback="2015", redesigned="never", generator="WordPress 4.9.8", theme="interico (ThemeForest)", domainAge="11 yr",
    viewport="missing", overflow="+142px", tapTargets="19 under 44px", lcp="8.4s", pageWeight="11.2 MB", heroVideo="6.1 MB mp4, autoplay", https="ok", mixedContent="3 assets", brokenImages="2",
    whatsapp="present", quoteForm="mailto: only", blog="last post 2021", reviews=87, rating=4.6, agency=True, dead_links=3, kinds=["phone", "email"],
)
SCHEMA = ", ".join(f"{k} string" for k in scoring.SIGNALS) + ", reviews bigint, rating double, agency boolean, dead_links bigint, kinds array<string>"


def scored(spark, *changes):
    names = [*scoring.SIGNALS, "reviews", "rating", "agency", "dead_links", "kinds"]
    rows = [(*((GOLDEN | c)[n] for n in names), i) for i, c in enumerate(changes)]
    df = scoring.score(spark.createDataFrame(rows, SCHEMA + ", i int"), 2026)
    s = {k: F.col(k) for k in scoring.SIGNALS}
    df = df.withColumn("flags", flags.flagged(s))
    df = df.withColumn("angle", flags.angle(F.col("flags"), s, F.col("gate")))
    return df.withColumn("pitch", flags.pitch(F.col("angle"), F.col("gate"))).withColumn("reasons", flags.reasons(F.col("flags"))).orderBy("i").collect()


def test_worked_lead(spark):
    (x,) = scored(spark, {})
    assert (x.staleness, x.mobile, x.trust, x.perf, x.pain, x.pay, x.reach, x.score, x.tier, x.gate, x.lcp_bucket) == (51.0, 26.33, 6.6, 20.84, 104.77, 0.91, 1.0, 100, "A", None, "dire")
    assert x.flags == "viewport overflow lcp pageWeight brokenImages tapTargets mixedContent redesigned jquery slider copyright generator bootstrap heroVideo blog".split()
    assert x.angle == "mobile-gallery-broken" and len(x.reasons) == 5


def test_gates_and_bands(spark):
    calm = {k: "none" for k in scoring.SIGNALS} | {"https": "ok", "viewport": "present", "redesigned": "n/a", "dead_links": 0, "lcp": "1s"}
    builder, young, painless, poor, expired, plain, zero = scored(
        spark, {"generator": "Wix.com"}, {"domainAge": "0.5 yr", "reviews": 9}, calm, {"reviews": 19}, {"https": "expired 2024-11"}, {"https": "none - http only"}, {"domainAge": "0 mo", "reviews": 30},
    )
    assert (builder.tier, builder.score) == ("C", 43) and young.tier == "C" and (painless.tier, painless.gate) == ("X", "no measurable pain") and painless.score <= 23
    assert painless.pitch == "No measurable pain. Skip." and builder.pitch == "Gate: free or AI builder." and poor.tier == "C"
    assert expired.angle == "cert-expired" and plain.angle == "no-https" and zero.gate is None


def test_nulls_never_raise(spark):
    empty = {k: None for k in GOLDEN}
    (x,) = scored(spark, empty)
    assert x.tier == "X" and x.score == 0 and x.reach == 0.4 and x.flags == []


@pytest.mark.parametrize("value,number,year", [("+142px", 142.0, None), ("-3.5 x", -3.5, None), ("1.12.4", 1.12, None), ("none", None, None), (None, None, None), ("© 2015-2019", 2015.0, 2015), ("1899", 1899.0, None)])
def test_numbers(spark, value, number, year):
    df = spark.createDataFrame([(value,)], "v string").select(numbers.first_number(F.col("v")), numbers.first_year(F.col("v")))
    assert tuple(df.first()) == (number, year)


def test_rounding_is_on_binary_doubles(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-2.5,), (0.125,)], "v double")
    assert {tuple(x) for x in df.select("v", numbers.round2(F.col("v"))).collect()} == {(1.005, 1.0), (2.675, 2.68), (-2.5, -2.5), (0.125, 0.13)}
    assert {tuple(x) for x in df.select("v", numbers.half_up(F.col("v"))).collect()} == {(1.005, 1), (2.675, 3), (-2.5, -2), (0.125, 0)}
    assert tuple(spark.range(1).select(numbers.percent(F.lit(1), F.lit(0)), numbers.percent(F.lit(1), F.lit(8))).first()) == (0, 13)


def test_reports(spark):
    leads = spark.createDataFrame([("v", "a", 90, "A", "A"), ("v", "b", 50, "B", None), ("v", "c", 50, "B", "A"), ("w", "d", 10, "X", None)], "vertical string, domain string, score int, tier string, human_tier string")
    assert {tuple(x) for x in report.tier_pivot(leads).collect()} == {("v", 1, 2, 0, 0, 3), ("w", 0, 0, 0, 1, 1)}
    assert tuple(report.agreement(leads).first()) == (2, 1, 50) and report.agreement(leads.where("human_tier is null")).first()["rate"] is None
    deck = {x.domain: (x.place, x.next_three, x.next_unreviewed) for x in report.deck(leads).collect()}
    assert deck["a"] == (1, ["b", "c"], "b") and deck["b"] == (2, ["c"], None) and deck["d"] == (1, [], None)
    old, new = leads.select("domain", "score"), spark.createDataFrame([("a", 1), ("z", 2)], "domain string, score int")
    assert sorted(tuple(x) for x in report.upsert(old, new, "domain").collect()) == [("a", 1), ("b", 50), ("c", 50), ("d", 10), ("z", 2)]
    assert sorted(tuple(x) for x in report.insert_absent(old, new, "domain").collect())[0] == ("a", 90)
    shared = spark.createDataFrame([("x.in", "phone", "+91 98765 43210", "9876543210", None), ("y.in", "phone", "098765 43210", "9876543210", None), ("y.in", "email", "a@b.in", "a@b.in", "site by a@b.in"), ("y.in", "email", "c@b.in", "c@b.in", "")], "domain string, kind string, value string, key string, credit string")
    assert sorted((x.value, x.owner) for x in report.contact_owner(shared).collect()) == [("+91 98765 43210", "agency"), ("098765 43210", "agency"), ("a@b.in", "agency"), ("c@b.in", "business")]
