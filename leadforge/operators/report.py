"""Reports over scored leads: verticals, tiers, agencies, agreement, grouped file reports, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.functions.numbers import percent
from leadforge.functions.strings import email_key, phone_key
from leadforge.operators.config import canonical_name

TIERS = ("A", "B", "C", "X")


def tier_pivot(leads: DataFrame, by: str = "vertical") -> DataFrame:
    counts = [F.count_if(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in TIERS]
    return leads.groupBy(by).agg(*counts, F.count(F.lit(1)).alias("total"))


def agreement(leads: DataFrame, machine: str = "tier", human: str = "human_tier") -> DataFrame:
    """Leads judged, agreed, and the rate in percent (null if none was judged)."""
    judged, same = F.count(human), F.count_if(F.col(machine) == F.col(human))
    return leads.agg(judged.alias("judged"), same.alias("agreed")).withColumn("rate", F.when(F.col("judged") > 0, percent(F.col("agreed"), F.col("judged"))))


def drift(machine: Column, human: Column) -> Column:
    """Whether a human rated a lead better, worse or the same."""
    order = F.array(*map(F.lit, TIERS))
    d = F.array_position(order, machine) - F.array_position(order, human)
    return F.when(d > 0, "up").when(d < 0, "down").otherwise("same")


def contact_key(kind: Column, value: Column) -> Column:
    """Form in which contacts of different sites are compared."""
    return F.when(kind == "phone", phone_key(value)).when(kind == "email", email_key(value)).otherwise(value)


def contact_owner(contacts: DataFrame) -> DataFrame:
    """``contacts`` (domain, kind, value, key, credit) with owner: shared keys and values within a credit text are the agency's.

    A provider's number (owner ``places`` already) keeps its owner, but counts as shown by its site.
    """
    shared = contacts.where(F.col("key") != "").groupBy("kind", "key").agg((F.min("domain") != F.max("domain")).alias("several"))
    owner = F.when(F.col("owner") == "places", F.col("owner")) if "owner" in contacts.columns else F
    owner = owner.when(F.coalesce("several", F.lit(False)), "agency").when(F.coalesce(F.contains(F.col("credit"), F.col("value")), F.lit(False)), "agency").otherwise("business")
    return contacts.join(shared, ["kind", "key"], "left").withColumn("owner", owner).drop("several")


def agency_key(credit_domain: Column, name: Column) -> Column:
    """What credits of one agency share: its domain, or else its name."""
    return F.coalesce(F.nullif(credit_domain, F.lit("")), F.lower(name))


def agency_directory(credits: DataFrame, aliases: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Agencies and their clients from (lead_no, domain, credit_name, credit_domain, raw_text), names resolved by their aliases.

    Agencies (agency, name, domain, raw_text, built_in_run): name and text of the first lead. Clients (agency, domain): a row for
    each site, not a list, since an agency may have built a third of all.
    """
    named = credits.withColumn("credit_name", canonical_name(F.col("credit_name"), aliases))
    named = named.withColumn("agency", agency_key(F.col("credit_domain"), F.col("credit_name"))).where(F.col("agency").isNotNull())
    first = lambda c: F.min_by(c, "lead_no").alias(c)
    agencies = named.groupBy("agency").agg(first("credit_name"), F.max(F.nullif("credit_domain", F.lit(""))).alias("domain"), first("raw_text"), F.count(F.lit(1)).alias("built_in_run"))
    return agencies.withColumnRenamed("credit_name", "name"), named.select("agency", "domain").distinct()


def agency_table(credits: DataFrame) -> DataFrame:
    """Agencies from (lead_no, domain, credit_name, credit_domain): name from the first lead, count and clients."""
    key = F.coalesce("credit_domain", F.lower("credit_name"))
    return credits.where(key.isNotNull()).groupBy(key.alias("agency")).agg(F.min_by("credit_name", "lead_no").alias("name"), F.count(F.lit(1)).alias("built_in_run"))


def file_report(files: DataFrame) -> DataFrame:
    """Counts and sizes by (vertical), (shot) and overall, from (vertical, shot, src, out, error)."""
    cubes = files.groupingSets([["vertical"], ["shot"], []], "vertical", "shot")
    out = cubes.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("files"), F.sum("src").alias("src_bytes"), F.sum("out").alias("out_bytes"), F.count_if("error").alias("errors"))
    return out.withColumn("ratio", F.col("src_bytes") / F.when(F.col("out_bytes") == 0, F.lit(1)).otherwise(F.col("out_bytes")))


def top_values(df: DataFrame, by: str, value: str, most: int = 4) -> DataFrame:
    """The commonest values of each group, and how many more there are."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(by).orderBy(F.desc("n"), value)
    counts = counts.withColumns({"place": F.row_number().over(w), "kinds": F.count(F.lit(1)).over(W.partitionBy(by))})
    return counts.where(F.col("place") <= most).withColumn("more", F.greatest(F.col("kinds") - most, F.lit(0))).drop("kinds")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Last write of each key."""
    w = W.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return events.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


def deck(leads: DataFrame, by: str = "vertical") -> DataFrame:
    """Leads in reviewing order with place, the next three domains and the next unreviewed one.

    A deck is one vertical, which a person steps through: its rows are ordered in one task.
    """
    w = W.partitionBy(by).orderBy(F.desc("score"), "domain")
    # the rows after one are those before it in the opposite order, where the frame only grows
    rest = W.partitionBy(by).orderBy("score", F.desc("domain")).rowsBetween(W.unboundedPreceding, -1)
    return leads.withColumns({
        "place": F.row_number().over(w), "next_three": F.collect_list("domain").over(w.rowsBetween(1, 3)),
        "next_unreviewed": F.last(F.when(F.col("human_tier").isNull(), F.col("domain")), ignorenulls=True).over(rest),
    })


def csv_lines(df: DataFrame, *columns: str) -> Column:
    from leadforge.functions.strings import csv_cell

    return F.concat_ws(",", *(csv_cell(df[c]) for c in columns))
