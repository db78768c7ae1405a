"""Links, contacts and agency credits from the element table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadforge.functions import strings, urls

#: Fixed patterns of an agency's credit line, in order.
CREDITS = (
    r"(?i)(?:designed|developed|created|maintained|powered|crafted|built)\s*(?:&|and)?\s*(?:designed|developed|maintained)?\s*by\s*[:\-]?\s*(.{2,60})",
    r"(?i)website\s+by\s+(.{2,60})", r"(?i)a\s+unit\s+of\s+(.{2,60})",
)
#: Mail domains that belong to no business.
BAD_EMAIL_DOMAINS = ("example.com", "sentry.io", "wixpress.com", "cloudflare.com", "schema.org", "w3.org", "google.com", "googleapis.com")
#: Elements that links and contacts are read from.
LINK_TAGS, CONTACT_TAGS = frozenset({"a"}), frozenset({"a", "body"})


def region(landmarks: Column) -> Column:
    """Innermost landmark around an element, main if there is none."""
    return F.coalesce(F.try_element_at(landmarks, F.lit(-1)), F.lit("main"))


def absolute(href: Column, base: Column) -> Column:
    """An href made absolute against its page: host-relative, path-relative and scheme-relative forms."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(F.concat(F.regexp_replace(base, "[?#].*$", ""), F.lit("")), r"^([a-zA-Z]+://[^/?#]+(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(base, "^([a-zA-Z]+:)", 1)
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("#") | href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href)).otherwise(F.concat(folder, href))


def links(elements: DataFrame, pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, pos, href, text, region, kind, visible): first of each address in document order."""
    a = elements.where((F.col("tag") == "a") & (F.trim(F.coalesce(F.col("attrs")["href"], F.lit(""))) != "") & ~F.lower(F.trim(F.col("attrs")["href"])).startswith("javascript:"))
    # addresses of all pages are a broadcast that grows with the input, however small their table is on disk; the window below needs the shuffle anyway
    a = a.join(pages.select(key, F.col(url).alias("base")).hint("merge"), key)
    raw = F.trim(F.col("attrs")["href"])
    address = F.when(urls.scheme(raw).isin("mailto:", "tel:"), raw).otherwise(urls.clean_href(absolute(raw, F.col("base"))))
    a = a.withColumns({"href": address, "kind": urls.kind(address, urls.registrable(F.col("base"))), "region": region(F.col("landmarks"))})
    clip = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 120)
    w = W.partitionBy(key, "href").orderBy("pos")
    out = a.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    return out.select(key, "pos", "href", clip.alias("text"), "region", "kind", ~F.coalesce(F.col("attrs")["style"].rlike(r"display\s*:\s*none"), F.lit(False)).alias("visible"))


def link_counts(links_: DataFrame, key: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    return links_.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), n(F.col("kind") == "internal").alias("internal"), n(F.col("kind") == "external").alias("external"),
        n(F.col("region") == "nav").alias("nav"), n(F.col("region") == "footer").alias("footer"), n(F.col("kind") == "social").alias("socials"),
    )


def probe_queue(links_: DataFrame, key: str, most: int = 40) -> DataFrame:
    """The first internal links of each document, those whose status is asked."""
    w = W.partitionBy(key).orderBy("pos")
    return links_.where("kind = 'internal'").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most).drop("_rank")


def is_footer() -> Column:
    """Whether an element is a footer by its tag, or by a class or id that says so."""
    named = F.coalesce(F.contains(F.concat_ws(" ", F.col("attrs")["class"], F.col("attrs")["id"]), F.lit("footer")), F.lit(False))
    return ((F.col("tag") == "footer") | named) & (F.col("text") != "")


def credit_elements(elements: DataFrame) -> DataFrame:
    """The elements that :func:`links` and :func:`agency_credits` read."""
    return elements.where(F.col("tag").isin(*LINK_TAGS) | is_footer())


def agency_credits(elements: DataFrame, key: str) -> DataFrame:
    """(key, name, raw_text): the first credit line of a footer."""
    foot = elements.where(is_footer())
    raw = F.coalesce(*(F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for p in CREDITS))
    name = F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in CREDITS))
    return foot.where(name.isNotNull()).groupBy(key).agg(F.min_by(strings.tidy_name(name), "pos").alias("name"), F.min_by(F.trim(raw), "pos").alias("raw_text"))


def contacts(elements: DataFrame, key: str) -> DataFrame:
    """(key, kind, value, norm): phones, e-mails and profiles of a document, first of each in order tel/mailto, then body (mobiles before numbers of the city)."""
    href = F.coalesce(F.col("attrs")["href"], F.lit(""))

    def hits(tag: str, kind: str, values: Column, stage: int) -> Column:
        made = F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), i.alias("i"), v.alias("value")))
        return F.when(F.col("tag") == tag, made).otherwise(F.array().cast("array<struct<kind:string,stage:int,i:int,value:string>>"))

    one = lambda p, g=1: F.array_compact(F.array(F.nullif(F.regexp_extract(href, p, g), F.lit(""))))
    every = lambda p, g: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    city = F.transform(every(strings.LANDLINE, 1), lambda x: F.concat(F.lit(strings.CITY_CODE), x))
    found = [
        hits("a", "phone", one("(?i)^tel:(.*)$"), 0), hits("body", "phone", every(strings.MOBILE, 1), 1), hits("body", "phone", city, 2),
        hits("a", "email", one("(?i)^mailto:([^?]*)"), 0), hits("body", "email", every(strings.EMAIL, 0), 1),
        hits("a", "whatsapp", one(r"(?i)(?:wa\.me/|whatsapp\.com/send\?phone=)\+?([0-9]+)"), 0),
        hits("a", "instagram", one(r"(?i)instagram\.com/(?!(?:share|p)(?:[/?#]|$))([A-Za-z0-9_.]+)"), 0), hits("a", "facebook", one(r"(?i)facebook\.com/(?!(?:share|sharer|dialog)(?:[/?#]|$))([A-Za-z0-9_.]+)"), 0),
    ]
    # one pass: elements that are parsed on the fly would be parsed again for each branch of a union
    out = elements.where(F.col("tag").isin("a", "body")).select(key, "pos", F.explode(F.concat(*found)).alias("hit")).select(key, "pos", "hit.*")
    out = out.withColumn("norm", F.when(F.col("kind") == "phone", strings.phone_key(F.col("value"))).when(F.col("kind") == "email", strings.email_key(F.col("value"))).otherwise(F.col("value")))
    mail = F.col("kind") == "email"
    bad = (mail & (F.regexp_extract("norm", "@(.*)$", 1).isin(*BAD_EMAIL_DOMAINS) | F.col("norm").rlike(r"\.(png|jpg|jpeg|gif|webp|svg)$|^(?:do-?not-?|no-?)reply"))) | ((F.col("kind") == "phone") & ((F.length("norm") < 7) | F.col("norm").rlike("^[0-9]{6}$")))
    w = W.partitionBy(key, "kind", "norm").orderBy("stage", "pos", "i")
    return out.where(~bad).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(key, "kind", "value", "norm", "stage", "pos", "i")
