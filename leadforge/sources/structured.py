"""Structured data of pages: postal addresses and opening hours in JSON-LD scripts of the element table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The parts of a postal address, in order.
ADDRESS = ("streetAddress", "addressLocality", "addressRegion", "postalCode")


def postal_address(data: object) -> str | None:
    """The first postal address in depth-first order; of a list only the first element is looked into."""
    stack = [data]
    while stack:
        item = stack.pop()
        if isinstance(item, list):  # a list at the very top is walked like an object
            stack.extend(reversed([x[0] if isinstance(x, list) and x else x for x in item]))
        elif isinstance(item, dict):
            if item.get("@type") == "PostalAddress":
                if found := ", ".join(str(item[k]) for k in ADDRESS if item.get(k)):
                    return found
            else:
                stack.extend(reversed([v[0] if isinstance(v, list) and v else v for v in item.values()]))
    return None


def opening_hours(data: object) -> str | None:
    hours = (data.get("openingHours") or data.get("openingHoursSpecification")) if isinstance(data, dict) else None
    if not hours:
        return None
    return ", ".join(x if isinstance(x, str) else json.dumps(x, sort_keys=True) for x in (hours if isinstance(hours, list) else [hours]))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf["text"]:
            try:
                data = json.loads(text or "{}")
            except ValueError:
                data = None
            rows.append((postal_address(data), opening_hours(data)))
        yield pd.DataFrame({"key": pdf["key"], "pos": pdf["pos"], "address": [a for a, _ in rows], "hours": [h for _, h in rows]})


def structured(elements: DataFrame, key: str) -> DataFrame:
    """(key, address, hours) of the documents with JSON-LD: the first address and the distinct hours; malformed scripts say nothing."""
    scripts = elements.where((F.col("tag") == "script") & (F.col("attrs")["type"] == "application/ld+json"))
    key_type = elements.schema[key].dataType.simpleString()
    found = scripts.select(F.col(key).alias("key"), "pos", "text").mapInPandas(_scan, f"key {key_type}, pos int, address string, hours string")
    hours = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("hours").isNotNull(), F.struct("pos", "hours")))), lambda x: x["hours"]))
    return found.groupBy(F.col("key").alias(key)).agg(F.min_by("address", F.when(F.col("address").isNotNull(), F.col("pos"))).alias("address"), hours.alias("hours"))
