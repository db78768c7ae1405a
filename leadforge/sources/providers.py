"""Rows of listing providers: nested answers projected to flat listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a provider's answer that are read.
PLACE = (
    "id string, displayName struct<text:string>, websiteUri string, rating double, userRatingCount bigint, formattedAddress string, nationalPhoneNumber string, "
    "location struct<latitude:double,longitude:double>, businessStatus string, primaryType string"
)


def listing(place: Column) -> Column:
    """struct of a listing from an answer's JSON text. What is no number where one is expected, and empty text, is null; a name is empty rather than null."""
    p = F.from_json(place, PLACE)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        some(p["id"]).alias("provider_id"), F.coalesce(p["displayName"]["text"], F.lit("")).alias("name"), some(p["websiteUri"]).alias("website"), p["rating"].alias("rating"), p["userRatingCount"].alias("review_count"),
        some(p["formattedAddress"]).alias("address"), some(p["nationalPhoneNumber"]).alias("phone"), p["location"]["latitude"].alias("lat"), p["location"]["longitude"].alias("lng"),
        some(p["businessStatus"]).alias("business_status"), some(p["primaryType"]).alias("primary_type"),
    )
