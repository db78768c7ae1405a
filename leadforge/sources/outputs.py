"""Signals, links and contacts of saved pages from one parse: tagged elements, one write partitioned by what they feed, read as three tables.

Every element is written once for each table that it feeds: anchors feed all three, bodies feed signals and contacts, everything else signals alone. A table then reads its own
folder, so pages are parsed once and no table scans what it does not use. Who owns a contact is known when all sites' contacts are: it is decided
in a second table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadforge.functions import urls
from leadforge.operators import links as link_rows
from leadforge.operators import report
from leadforge.operators.signals import page_signals
from leadforge.sources.html import html_elements

KINDS = ("signals", "links", "contacts")


@dataclass(frozen=True)
class Outputs:
    """The tables of a run: one row for each page, link, and contact; ``owned`` are the contacts with their owners."""

    signals: DataFrame
    links: DataFrame
    contacts: DataFrame
    owned: DataFrame


def tagged(pages: DataFrame, key: str, html: str) -> DataFrame:
    """The pages' elements with the table that each feeds in ``kind``."""
    tag = F.col("tag")
    kinds = F.when(tag == "a", F.array(*map(F.lit, KINDS))).when(tag == "body", F.array(F.lit("signals"), F.lit("contacts"))).otherwise(F.array(F.lit("signals")))
    return html_elements(pages, key, html).select("*", F.explode(kinds).alias("kind"))


def write_outputs(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", html: str = "html") -> Outputs:
    """Parses the pages once and writes the tables under ``root``. Pages without elements have no row; credits of agencies are not looked for here."""
    spark = pages.sparkSession
    tagged(pages, key, html).write.mode("overwrite").partitionBy("kind").parquet(f"{root}/elements")
    elements = spark.read.parquet(f"{root}/elements")
    of = lambda kind: elements.where(F.col("kind") == kind).drop("kind")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    signals = kept(page_signals(of("signals"), key), "signals")
    links = kept(link_rows.links(of("links"), pages, key, url), "links")
    contacts = kept(link_rows.contacts(of("contacts"), key), "contacts")
    sited = contacts.join(pages.select(key, urls.registrable(pages[url]).alias("domain")).hint("merge"), key)
    owned = report.contact_owner(sited.select(key, "domain", "kind", "value", F.col("norm").alias("key"), F.lit(None).cast("string").alias("credit")))
    return Outputs(signals, links, contacts, kept(owned.drop("credit"), "contacts_owned"))
