"""Columns and small relations that stages pass on: page choice, run ids, shots, redirects, formats, samples, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.functions.numbers import half_up

#: Fixed patterns: consent scripts, and labels of buttons that do not accept.
CONSENT = r"(?i)cookiebot|onetrust|cookieyes|termly|iubenda|osano|quantcast|cookie-?consent|cookie-?notice|gdpr|borlabs"
NEGATIVE = r"(?i)settings|preferences|manage|customi[sz]e|reject|decline|more info"
#: Bytes of a page that the quick checks look at.
HEAD = 8192


def page_text(rendered: Column, home: Column) -> Column:
    """The rendered page, or else the raw one; null if both are empty."""
    return F.coalesce(F.nullif(rendered, F.lit("")), F.nullif(home, F.lit("")))


def has_viewport(html: Column) -> Column:
    """Whether the head of a page has a viewport tag."""
    return F.coalesce(F.substring(html, 1, HEAD).rlike(r"""(?i)<meta[^>]+name=["']?viewport"""), F.lit(False))


def head_generator(html: Column) -> Column:
    """The generator that the head of a page names, with its attributes in either order."""
    head, some = F.substring(html, 1, HEAD), lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(F.regexp_extract(head, r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)""", 1)), some(F.regexp_extract(head, r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+name=["']generator["']""", 1)))


def viewport_note(present: Column) -> Column:
    return F.when(present, "responsive").otherwise("missing - legacy layout")


def run_id(at: Column) -> Column:
    """An ISO time without colons; the time is a parameter, never a clock."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def effective_run(own: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), given)


def redirect_chain(hops: Column, final: Column) -> Column:
    """Addresses from the first to the last, from the hops that a response tells latest first."""
    return F.concat(F.reverse(F.coalesce(hops, F.array().cast("array<string>"))), F.array(final))


def patched(headers: Column, more: Column) -> Column:
    """Headers with further ones laid over them."""
    kept = F.map_filter(headers, lambda k, _: ~F.array_contains(F.map_keys(more), k))
    return F.map_concat(kept, more)


def vitals(lcp: Column, cls: Column) -> Column:
    """struct(lcp_ms, cls): whole milliseconds, and shifts to three decimals."""
    return F.struct(half_up(lcp).alias("lcp_ms"), (F.floor(cls * 1000 + 0.5) / 1000).alias("cls"))


def size_label(size: Column, unit: int = 1048576) -> Column:
    """Bytes in a unit with one decimal."""
    return F.format_string("%.1f", F.floor(size / unit * 10 + 0.5) / 10)


def is_consent_script(url: Column) -> Column:
    return F.coalesce(url.rlike(CONSENT), F.lit(False))


def accepts(label: Column) -> Column:
    return ~F.coalesce(label.rlike(NEGATIVE), F.lit(True))


def shown_phone(key: Column) -> Column:
    """A comparable number as it is shown: mobiles in two groups of five, city numbers after their code."""
    mobile, city = key.rlike("^[6-9][0-9]{9}$"), (F.length(key) >= 6) & key.startswith("422")
    cut = F.when(mobile, 5).otherwise(3)
    return F.when(mobile | city, F.concat(F.lit("+91 "), F.substr(key, F.lit(1), cut), F.lit(" "), F.substr(key, cut + 1))).otherwise(F.concat(F.lit("+91 "), key))


def first_existing(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, file): of each key's candidates (key, file, place) the first that is among its files; the first candidate if none is."""
    known = files.select(key, "file").distinct().withColumn("_found", F.lit(True))
    marked = wanted.join(known, [key, "file"], "left")
    return marked.groupBy(key).agg(F.coalesce(F.min_by("file", F.when(F.col("_found"), F.col("place"))), F.min_by("file", "place")).alias("file"))


def one_of_each(df: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each group: a sample of one."""
    return df.groupBy(by).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def skip_reasons(businesses: DataFrame) -> DataFrame:
    """How often each reason to skip occurs, those of discovery and of qualification, commonest first; a verdict without one is unknown."""
    later = F.when(F.col("verdict") == "skip", F.coalesce("reason", F.lit("unknown")))
    every = businesses.select(F.explode(F.array_compact(F.array("skip_reason", later))).alias("reason"))
    return every.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def in_order(passed: DataFrame, done: DataFrame, place: str) -> DataFrame:
    """Rows that were passed through and rows that were worked on, in their first order."""
    return passed.unionByName(done, allowMissingColumns=True).orderBy(place)


def nearest_label(prices: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """Prices (key, pos, price) with the last heading (key, pos, text) before each: a running last value over both."""
    both = prices.select(key, "pos", F.lit(1).alias("_kind"), "price", F.lit(None).cast("string").alias("_text")).unionByName(headings.select(key, "pos", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("price"), F.col("text").alias("_text")))
    w = W.partitionBy(key).orderBy("pos", "_kind", "_text").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("label", F.last("_text", ignorenulls=True).over(w)).where("_kind = 1").select(key, "pos", "price", "label")


def credit_domains(links: DataFrame, key: str, own: str = "own_domain") -> DataFrame:
    """(key, domain): domain of the first external link in a page's footer, its agency's site."""
    outside = links.where((F.col("region") == "footer") & (F.col("kind") == "external") & (F.col("domain") != F.col(own)))
    return outside.groupBy(key).agg(F.min_by("domain", "pos").alias("domain"))
