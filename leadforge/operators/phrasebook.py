"""Many phrases at once: the first phrase of a list that a text contains, by one automaton instead of a condition for each phrase.

The automaton (Aho-Corasick) is built once in each task from the list, which is bounded by :data:`leadforge.operators.config.MOST_ROWS`, and reads every text once,
whatever the number of phrases. "First" is the place in the list, not in the text. Letters are lowered before they are compared. A null text contains nothing;
an empty phrase is in every text; of equal phrases the first counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadforge.operators import config


def automaton(phrases: list[str]) -> tuple[ahocorasick.Automaton | None, int | None]:
    """The automaton of the non-empty phrases with their places, and the place of the first empty one."""
    places: dict[str, int] = {}
    for place, phrase in enumerate(phrases):
        places.setdefault(phrase, place)
    empty = places.pop("", None)
    if not places:
        return None, empty
    found = ahocorasick.Automaton()
    for phrase, place in places.items():
        found.add_word(phrase, place)
    found.make_automaton()
    return found, empty


def first_of(text: str, found: ahocorasick.Automaton | None, empty: int | None) -> int | None:
    best = empty
    for _, place in found.iter(text) if found is not None else ():
        if best is None or place < best:
            best = place
            if best == 0:
                break
    return best


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """Place in ``phrases`` (from 0) of the first one that the text contains, else null."""
    lowered = [p.lower() for p in phrases]

    @F.pandas_udf("int")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found, empty = automaton(lowered)
        for texts in batches:
            yield pd.Series([None if t is None else first_of(t, found, empty) for t in texts], dtype="Int32")

    return search(F.lower(text))


def canonical_names(df: DataFrame, name: str, aliases: list[tuple[str, str]], out: str = "name") -> DataFrame:
    """``df`` with an agency's name in ``out``: as :func:`config.canonical_name` gives it, for thousands of aliases."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(df[name], "[.,;!:]+$", ""), r"\s+", " "))
    table = df.sparkSession.createDataFrame([(i, v) for i, (_, v) in enumerate(aliases)], "_place int, _alias string")
    marked = df.withColumns({"_plain": plain, "_place": first_phrase(plain, [k for k, _ in aliases])})
    # the list is bounded, so its values may be broadcast
    return marked.join(F.broadcast(table), "_place", "left").withColumn(out, F.coalesce("_alias", config.capitalised(F.col("_plain")))).drop("_plain", "_place", "_alias")
