"""robots.txt bodies to rules: groups of consecutive agents, the exact bot group outranking the star group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def robots_rules(df: DataFrame, bot: str, key: str = "host", body: str = "body") -> DataFrame:
    """(key, allow, disallow) arrays that hold for ``bot``, in file order."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(body, F.lit("")), r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    lines = lines.withColumns({"field": F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))), "value": F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))})
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = W.partitionBy(key).orderBy("at")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("group", F.sum(starts.cast("int")).over(order))
    agent = F.col("field") == "user-agent"
    name = F.lower(F.col("value"))
    ranks = lines.groupBy(key, "group").agg(F.max(F.when(agent & (name == bot.lower()), 2).when(agent & (name == "*"), 1).otherwise(0)).alias("rank"))
    best = ranks.where("rank > 0").groupBy(key).agg(F.max("rank").alias("rank"))
    chosen = lines.join(ranks.join(best, [key, "rank"]), [key, "group"])

    def listed(field: str):
        found = F.sort_array(F.collect_list(F.when((F.col("field") == field) & (F.col("value") != ""), F.struct("at", "value"))))
        return F.transform(found, lambda x: x["value"])

    rules = chosen.groupBy(key).agg(listed("allow").alias("allow"), listed("disallow").alias("disallow"))
    none = F.array().cast("array<string>")
    return df.select(key).join(rules, key, "left").select(key, F.coalesce("allow", none).alias("allow"), F.coalesce("disallow", none).alias("disallow"))
