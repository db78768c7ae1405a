"""Configuration as small tables that compile to columns: pitch angles, reasons, agency aliases, theme slugs, suffixes.

Each is read as a DataFrame with an ordinal, since first matches win, and its few rows become a chain of conditions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadforge.functions.numbers import text

ANGLES = "ordinal int, key string, when array<string>, guard string, text string"
PAIRS = "ordinal int, key string, value string"
#: Rows that a configuration may have: it is read by the driver.
MOST_ROWS = 10_000


@dataclass(frozen=True)
class Angle:
    key: str
    when: tuple[str, ...]
    guard: str | None
    text: str


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file with an array of objects. A row without an ``ordinal`` takes its place in the file, since first matches win."""
    kind = T.StructType.fromDDL(schema)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", T.ArrayType(kind))).alias("_place", "_row"))
    return rows.select(*(F.coalesce(F.col("_row.ordinal"), F.col("_place")).alias("ordinal") if c == "ordinal" else F.col(f"_row.{c}").alias(c) for c in kind.names))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file with one object as (ordinal, key, value) in the file's order; keys that begin with an underscore are notes."""
    entries = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "map<string,string>")).alias("ordinal", "key", "value"))
    return entries.where(~F.col("key").startswith("_"))


def _rows(table: DataFrame) -> list:
    rows = table.orderBy("ordinal").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("a configuration table has too many rows")
    return rows


def angles(table: DataFrame) -> list[Angle]:
    return [Angle(r["key"], tuple(r["when"] or ()), r["guard"] or None, r["text"]) for r in _rows(table)]


def pairs(table: DataFrame) -> list[tuple[str, str]]:
    return [(r["key"], r["value"]) for r in _rows(table)]


def pick_angle(flags: Column, signals: dict[str, Column], gate: Column, choices: list[Angle]) -> Column:
    """struct(template, text): the gate's sentence, else the first angle whose flags are all up and whose guard the first
    flag's value holds, else the last angle."""

    def as_struct(key, words) -> Column:
        return F.struct(F.lit(key).alias("template"), words.alias("text"))

    empty = gate.contains("no measurable pain") | gate.contains("nothing to sell")
    out = F.when(F.nullif(gate, F.lit("")).isNotNull(), as_struct("gate", F.when(empty, F.lit("No measurable pain. Skip.")).otherwise(F.concat(F.lit("Gate: "), gate, F.lit(".")))))
    for a in choices:
        fits = F.lit(True)
        for k in a.when:
            fits = fits & F.array_contains(flags, k)
        if a.guard:
            fits = fits & F.contains(F.lower(text(signals[a.when[0]])), F.lit(a.guard))
        out = out.when(fits, as_struct(a.key, F.lit(a.text)))
    return out.otherwise(as_struct(choices[-1].key, F.lit(choices[-1].text)))


def reasons(flags: Column, gate: Column, known: list[tuple[str, str]], most: int = 5) -> Column:
    """Sentences of the first flags, cut before names without one are dropped; none for a gated lead."""
    table = F.create_map(*(F.lit(x) for kv in known for x in kv))
    found = F.array_compact(F.transform(F.slice(flags, 1, most), lambda k: F.try_element_at(table, k)))
    return F.when(F.nullif(gate, F.lit("")).isNotNull(), F.array().cast("array<string>")).otherwise(found)


def canonical_name(name: Column, aliases: list[tuple[str, str]]) -> Column:
    """An agency's name without marks at its end: the first alias that it contains, else its words capitalised, their other letters kept."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(name, "[.,;!:]+$", ""), r"\s+", " "))
    out = F.when(plain.isNull(), plain)
    for key, value in aliases:
        out = out.when(F.contains(F.lower(plain), F.lit(key.lower())), F.lit(value))
    return out.otherwise(capitalised(plain))


def capitalised(plain: Column) -> Column:
    """Words with their first letter raised, their other letters kept."""
    return F.array_join(F.transform(F.split(plain, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000))), " ")


def theme_note(slug: Column, market: list[tuple[str, str]]) -> Column:
    """A theme's slug, with the name that the market list has for it."""
    table = F.create_map(*(F.lit(x) for kv in market for x in kv))
    return F.when(slug.isNull() | (slug == ""), "none").otherwise(F.concat(slug, F.coalesce(F.concat(F.lit(" ("), F.try_element_at(table, F.lower(slug)), F.lit(")")), F.lit(""))))
