"""Leads put together from the stages' relations, and what is reported of them.

Relations are keyed by (vertical, domain). A field that is null, empty or zero counts as missing and
gives way to the next source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.functions.numbers import percent
from leadforge.functions.strings import csv_cell, phone_key
from leadforge.operators.report import TIERS

KEY = ["vertical", "domain"]
SHOTS = ("mobile", "desktop", "full")
#: Columns of the reports, in order.
LEAD_COLUMNS = ("tier", "score", "vertical", "domain", "business", "address", "phone", "email", "rating", "reviews", "built_by", "pitch_angle")
PITCH_COLUMNS = (*LEAD_COLUMNS, "your_tier", "note")
#: The columns of the list that a reviewer saves without the service, in their order.
SAVED_COLUMNS = ("domain", "business", "vertical", "address", "phone", "email", "rating", "reviews", "machine_tier", "score", "your_tier", "angle", "note", "agency")
AGENCY_COLUMNS = ("agency", "domain", "built_in_run", "portfolio_clients", "published_pricing", "note")


def filled(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: later duplicates replace earlier ones."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def auditable(businesses: DataFrame) -> DataFrame:
    """Businesses with a domain that nothing has skipped."""
    return businesses.where(F.col("domain").isNotNull() & F.col("skip_reason").isNull())


def audit_queue(businesses: DataFrame, only: str | None = None) -> DataFrame:
    """Businesses that are to be captured, or the one of a domain."""
    out = businesses.where(F.col("domain").isNotNull() & (F.col("verdict") == "audit"))
    return out if only is None else out.where(F.col("domain") == only)


def first_arrivals(businesses: DataFrame, most: int) -> DataFrame:
    """The first businesses by arrival, skipped ones counted: the stage's own limit."""
    return businesses.orderBy("arrival").limit(most)


def matched(scores: DataFrame, businesses: DataFrame) -> DataFrame:
    """Each score row with its business; ``error`` says which rows have none."""
    own = last_by(businesses.where(F.col("domain").isNotNull()), KEY, "arrival").select(*KEY, F.col("name").alias("business"), F.lit(True).alias("_found"))
    out = scores.join(own, KEY, "left")
    return out.withColumn("error", F.when(F.col("_found").isNull(), F.concat(F.lit("no qualified business: "), F.col("domain")))).drop("_found")


def stage_counts(rows: DataFrame, by: str = "vertical") -> DataFrame:
    """Rows that went well and that failed."""
    return rows.groupBy(by).agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("err"))


def with_provider_phones(contacts: DataFrame, businesses: DataFrame) -> DataFrame:
    """Contacts, and the provider's number of each site whose page shows none; it is marked ``places``, so that no later rule reassigns it."""
    key = phone_key(F.col("phone"))
    usable = (F.length(key) >= 7) & ~key.rlike("^[0-9]{6}$")
    given = last_by(businesses.where(F.col("domain").isNotNull()), KEY, "arrival").where(usable)
    given = given.join(contacts.where("kind = 'phone'").select(*KEY).distinct(), KEY, "left_anti")
    return contacts.unionByName(given.select(*KEY, F.lit("phone").alias("kind"), F.col("phone").alias("value"), F.lit(2**62).alias("seq"), F.lit("places").alias("owner")))


def contact_lists(contacts: DataFrame) -> DataFrame:
    """(vertical, domain, contacts) with a site's contacts in page order."""
    one = F.struct("seq", "kind", "value", "owner")
    return contacts.groupBy(*KEY).agg(F.sort_array(F.collect_list(one)).alias("contacts"))


def of_business(contacts: Column) -> Column:
    return F.filter(contacts, lambda c: c["owner"] == "business")


def first_contact(contacts: Column, kind: str) -> Column:
    """Value of the business's first contact of a kind, empty if it has none."""
    return F.coalesce(F.get(F.filter(of_business(contacts), lambda c: c["kind"] == kind), F.lit(0))["value"], F.lit(""))


def contact_kinds(contacts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(contacts, lambda c: c["kind"])))


def assemble(scores: DataFrame, signals: DataFrame, businesses: DataFrame, contacts: DataFrame, links: DataFrame) -> DataFrame:
    """One row per site that has both signals and a score, with what the other relations know of it.

    scores: score, tier, gate, flaws, pitch_angle; signals: signals; businesses: name, rating, review_count, address, arrival;
    contacts: contacts, page_address; links: links, agency_name, agency_domain, credit.
    """
    own = last_by(businesses.where(F.col("domain").isNotNull()), KEY, "arrival").select(*KEY, "name", "rating", "review_count", F.col("address").alias("listed_address"))
    out = signals.join(scores, KEY).join(own, KEY, "left").join(contacts, KEY, "left").join(links, KEY, "left")
    agency = F.when(F.col("credit").isNotNull(), F.struct(F.col("agency_name").alias("name"), F.col("agency_domain").alias("domain"), "credit"))
    return out.select(
        *KEY, filled(F.col("name"), F.col("domain")).alias("name"), F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("review_count", F.lit(0)).alias("reviews"),
        filled(F.col("page_address"), F.col("listed_address"), F.lit("none")).alias("address"), "score", "tier", F.nullif(F.col("gate"), F.lit("")).alias("gate"),
        "signals", "flaws", F.coalesce("pitch_angle", F.lit("")).alias("pitch_angle"), F.coalesce("contacts", F.array().cast(out.schema["contacts"].dataType)).alias("contacts"), agency.alias("agency"), "links",
    )


def index_leads(leads: DataFrame, reasons: Column) -> DataFrame:
    """The nested row that a lead has in the index: business contacts only, agency or null, where its shots are."""
    shots = F.struct(*(F.concat_ws("/", "vertical", "domain", F.lit(f"{s}.webp")).alias(s) for s in SHOTS))
    return leads.select(
        *KEY, "name", "rating", "reviews", "address", "score", "tier", "gate", "signals", "flaws", reasons.alias("reasons"), F.col("pitch_angle").alias("angle"),
        of_business(F.col("contacts")).alias("contacts"), "agency", "links", shots.alias("shots"),
    )


def vertical_index(verticals: DataFrame, businesses: DataFrame) -> DataFrame:
    """Every enabled vertical of the configuration with its counts, zero where nothing was found; in order of priority."""
    n = businesses.groupBy("vertical").agg(
        F.max("raw_results").alias("raw"), F.count(F.lit(1)).alias("rows"), F.count("domain").alias("with_domain"), F.count_if(F.col("verdict") == "audit").alias("audited"),
    )
    out = verticals.where("enabled").join(n, "vertical", "left")
    counts = [F.coalesce(F.nullif(F.col("raw"), F.lit(0)), F.col("rows"), F.lit(0)).alias("discovered"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("with_domain", "audited"))]
    return out.select("vertical", "label", "priority", *counts).orderBy("priority", "vertical")


def discover_counts(businesses: DataFrame) -> DataFrame:
    """Totals of a discovery: all rows, those with a domain, those that only a portal shows."""
    portal = F.col("skip_reason") == "aggregator-profile-only"
    return businesses.groupBy("vertical").agg(F.count(F.lit(1)).alias("total"), F.count("domain").alias("with_domain"), F.count_if(portal).alias("greenfield"))


def lead_rows(leads: DataFrame) -> DataFrame:
    """Columns of leads.csv."""
    made = {"business": F.col("name"), "phone": first_contact(F.col("contacts"), "phone"), "email": first_contact(F.col("contacts"), "email"), "built_by": F.coalesce(F.col("agency.name"), F.lit(""))}
    return leads.select(*(made.get(c, F.col(c)).alias(c) for c in LEAD_COLUMNS))


def pitch_rows(leads: DataFrame, reviews: DataFrame) -> DataFrame:
    """Columns of pitch.csv: the leads that a reviewer wants to pitch to."""
    marks = reviews.where("pitch").select("domain", F.coalesce("human_tier", F.lit("")).alias("your_tier"), F.coalesce("note", F.lit("")).alias("note"))
    return lead_rows(leads).join(marks, "domain").select(*PITCH_COLUMNS)


def saved_rows(leads: DataFrame, reviews: DataFrame) -> DataFrame:
    """Columns of the pitch list in its other form (SAVED_COLUMNS)."""
    return pitch_rows(leads, reviews).withColumnsRenamed({"tier": "machine_tier", "pitch_angle": "angle", "built_by": "agency"}).select(*SAVED_COLUMNS)


def agency_rows(agencies: DataFrame) -> DataFrame:
    """Columns of agencies.csv: published prices in one cell."""
    prices = F.concat_ws(" | ", F.transform("pricing", lambda p: F.concat_ws(" ", p["tier"], p["price"])))
    return agencies.select(F.col("name").alias("agency"), "domain", "built_in_run", "portfolio_clients", prices.alias("published_pricing"), F.coalesce("note", F.lit("")).alias("note"))


def csv_line(df: DataFrame) -> Column:
    """All columns as one quoted line; null is an empty cell."""
    return F.concat_ws(",", *(csv_cell(F.coalesce(df[c].cast("string"), F.lit(""))) for c in df.columns))


def agency_chips(agencies: DataFrame, leads: DataFrame) -> DataFrame:
    """Agencies with the domains of their leads, best first."""
    own = leads.where(F.col("agency").isNotNull()).groupBy(F.col("agency.domain").alias("domain")).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("domain").alias("d")))).alias("own"))
    out = agencies.join(own, "domain", "left")
    return out.withColumn("leads", F.coalesce(F.transform("own", lambda x: x["d"]), F.array().cast("array<string>"))).drop("own")


def deck_signals(leads: DataFrame) -> DataFrame:
    """A row for each measured signal of a lead, with whether it is a flaw."""
    out = leads.select(*KEY, "flaws", F.explode("signals").alias("signal", "value")).where(F.col("value").isNotNull())
    return out.select(*KEY, "signal", "value", F.coalesce(F.array_contains("flaws", F.col("signal")), F.lit(False)).alias("flaw"))


def merged_reviews(leads: DataFrame, seeded: DataFrame, saved: DataFrame) -> DataFrame:
    """A review for every lead: saved marks over seeded ones over the default (no tier, no pitch, no note)."""
    names = ("human_tier", "pitch", "note")
    out = leads.select("domain")
    for prefix, df in (("_a", seeded), ("_b", saved)):
        out = out.join(df.select("domain", *(F.col(c).alias(f"{prefix}{c}") for c in names)), "domain", "left")
    default = {"human_tier": F.lit(None).cast("string"), "pitch": F.lit(False), "note": F.lit("")}
    return out.select("domain", *(F.coalesce(f"_b{c}", f"_a{c}", default[c]).alias(c) for c in names))


def grid(leads: DataFrame, show: str = "all") -> DataFrame:
    """Reviewed leads that a grid shows (all, unreviewed, pitch, or a machine tier), most reviewed businesses first."""
    keep = {"all": F.lit(True), "unreviewed": F.col("human_tier").isNull(), "pitch": F.col("pitch")}.get(show, F.col("tier") == show)
    return leads.where(keep).orderBy(F.desc("reviews"), "domain")


def tier_share(leads: DataFrame) -> DataFrame:
    """Percent of a vertical's leads in each tier, two decimals."""
    n = F.count(F.lit(1))
    shares = [(F.floor(F.count_if(F.col("tier") == t) / n * 10000 + 0.5) / 100).alias(f"share_{t.lower()}") for t in TIERS]
    return leads.groupBy("vertical").agg(*shares)


def checked_marks(marks: DataFrame, businesses: DataFrame, scores: DataFrame) -> DataFrame:
    """Marks with ``error``: bad domain, tier, pitch (JSON text in ``pitch_json``, where a mark has it), or unknown domain (in neither relation); null where a mark can be stored."""
    known = businesses.select("domain").unionByName(scores.select("domain")).where(F.col("domain").isNotNull()).distinct().withColumn("_known", F.lit(True))
    good = F.col("domain").rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$")
    # fixed values: the texts of the errors
    error = F.when(~F.coalesce(good, F.lit(False)), "Invalid domain").when(F.col("human_tier").isNotNull() & ~F.col("human_tier").isin(*TIERS), "human_tier must be A|B|C|X|null")
    if "pitch_json" in marks.columns:
        error = error.when(F.col("pitch_json").isNotNull() & ~F.trim("pitch_json").isin("true", "false"), "pitch must be boolean")
    error = error.when(F.col("_known").isNull(), "Unknown domain")
    return marks.join(known, "domain", "left").withColumn("error", error).drop("_known")


def archive_years(snapshots: DataFrame) -> DataFrame:
    """First and last year in which an archive saw a site."""
    return snapshots.groupBy("domain").agg(F.min(F.year("seen")).alias("first_year"), F.max(F.year("seen")).alias("last_year"))


def dead_links(links: DataFrame, statuses: DataFrame, key: str, most: int = 40) -> DataFrame:
    """Links of a site by kind, and how many of its first internal ones answered with an error; of several statuses of an address the largest counts."""
    statuses = statuses.groupBy("href").agg(F.max("status").alias("status"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("kind") != "internal", "pos"))
    asked = links.withColumn("_asked", (F.col("kind") == "internal") & (place <= most)).join(statuses.hint("merge"), "href", "left")
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("internal", "external", "social")]
    return asked.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *kinds, F.count_if(F.col("_asked") & (F.col("status") >= 400)).alias("dead"))


def score_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, percent(part, whole))
