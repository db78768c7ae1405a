"""The lead tables as keyed tables: eight schemas, what each write does to a row that exists, and lists as JSON text.

A report writes verticals, scores, contacts and agencies over what was there, and adds businesses and an agency's clients where they are new.
Reviews belong to people: only :meth:`LeadStore.review` writes them, so no run of a stage can change one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadforge.sources.keyed import KeyedTable


@dataclass(frozen=True)
class Table:
    schema: str
    keys: tuple[str, ...]
    kind: str


#: The columns of the tables and their keys.
TABLES = {
    "verticals": Table("slug string, label string, city string, keywords string, discovered bigint, with_domain bigint, audited bigint", ("slug",), "replace"),
    "businesses": Table(
        "domain string, vertical string, name string, places_id string, rating double, review_count bigint, address string, phone string, lat double, lng double, "
        "business_status string, source string, first_seen string", ("domain",), "ignore",
    ),
    "runs": Table("id string, started_at string, finished_at string, vertical string, stage string, config_hash string, scorer string", ("id",), "replace"),
    "scores": Table("domain string, run_id string, tier string, score bigint, pain double, pay double, reach double, gate string, angle_template string, flaws string", ("domain", "run_id"), "replace"),
    "reviews": Table("domain string, human_tier string, pitch int, note string, reviewed_at string", ("domain",), "update"),
    "contacts": Table("domain string, kind string, value string, owner string", ("domain", "kind", "value"), "replace"),
    "agencies": Table("domain string, name string, pricing string, portfolio_clients bigint, note string", ("domain",), "replace"),
    "agency_clients": Table("agency_domain string, domain string, confidence double", ("agency_domain", "domain"), "ignore"),
}


def as_text(df: DataFrame, name: str) -> Column:
    """A column as the tables hold it: lists, maps and structures as JSON text, an absent list as null."""
    nested = isinstance(df.schema[name].dataType, T.ArrayType | T.MapType | T.StructType)
    return F.to_json(df[name]).alias(name) if nested else df[name]


class LeadStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16) -> None:
        self.tables = {n: KeyedTable(spark, f"{root.rstrip('/')}/{n}", t.schema, list(t.keys), buckets) for n, t in TABLES.items()}

    def write(self, name: str, rows: DataFrame, order: list[str] | None = None) -> None:
        """Writes what a stage has computed; columns that the table lacks are left out, missing ones are null."""
        if name == "reviews":
            raise ValueError("stages do not write reviews")
        self._put(name, rows, order)

    def review(self, marks: DataFrame) -> None:
        """Sets people's marks: the last by time of each domain. The pitch mark is kept as 0 or 1, an empty note as none."""
        shaped = {"pitch": F.coalesce(F.col("pitch").cast("int"), F.lit(0)), "note": F.nullif(F.col("note"), F.lit(""))}
        self._put("reviews", marks.withColumns({c: v for c, v in shaped.items() if c in marks.columns}), ["reviewed_at"])

    def _put(self, name: str, rows: DataFrame, order: list[str] | None) -> None:
        table = self.tables[name]
        shaped = rows.select(*(as_text(rows, c) for c in rows.columns if c in table.schema.names or c in (order or [])))
        table.upsert(shaped, TABLES[name].kind, order)

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()
