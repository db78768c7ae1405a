"""Public suffixes from a table of rules: plain ones, wildcards (``*.ck``) and exceptions (``!www.ck``).

A host's candidates are its endings of one label, two and so on; each is looked up as it is, as a wildcard and as an exception. An exception wins and leaves its first label to the owner;
else the rule with most labels; else the last label is the suffix. Rules are matched by a join on their text, once for each distinct host, so the list may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ending(labels: Column, n: Column) -> Column:
    """The last ``n`` labels."""
    return F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n))


def with_registrable(df: DataFrame, host: str, rules: DataFrame, out: str = "domain") -> DataFrame:
    """``df`` with the registrable domain of its host in ``out``: the public suffix and one label.

    ``rules`` has a column ``rule``; case, blanks and repeats in it do not matter. Null for a null host, an address of numbers, a host that is a suffix itself, and one with an empty label.
    """
    name = F.lower(df[host])
    hosts = df.select(name.alias("_host")).where(name.isNotNull() & ~name.rlike(r"^[0-9.]+$") & ~name.rlike(r"(^|\.)(\.|$)")).distinct()
    labels = F.split("_host", r"\.")
    candidates = hosts.select("_host", labels.alias("_labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_n"))
    end = ending(F.col("_labels"), F.col("_n"))
    wildcard = F.concat(F.lit("*."), ending(F.col("_labels"), F.col("_n") - 1))
    forms = [(F.lit(0), end), (F.lit(0), F.when(F.col("_n") > 1, wildcard)), (F.lit(1), F.concat(F.lit("!"), end))]
    forms = candidates.select("_host", "_labels", "_n", F.explode(F.array(*(F.struct(kind.alias("exception"), text.alias("rule")) for kind, text in forms))).alias("_f"))
    known = rules.select(F.lower(F.trim(rules["rule"])).alias("_rule")).where("_rule <> ''").distinct()
    met = forms.join(known, forms["_f.rule"] == known["_rule"]).groupBy("_host").agg(F.max(F.struct("_f.exception", "_n")).alias("_best"))
    width = F.coalesce(F.col("_best._n") - F.col("_best.exception"), F.lit(1))
    decided = hosts.join(met, "_host", "left").select("_host", F.when(F.size(labels) > width, ending(labels, width + 1)).alias(out))
    return df.join(decided, name == decided["_host"], "left").drop("_host")
