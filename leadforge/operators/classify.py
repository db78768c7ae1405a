"""Classes of domains, sites and failures: ordered decision lists as CASE expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadforge.functions.urls import host, let, of_host, registrable

#: Hosts that are no site of a business, and portals whose profiles are not one either.
REJECTED = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "justdial.com", "sulekha.com", "indiamart.com", "tradeindia.com",
    "urbanpro.com", "wa.me", "api.whatsapp.com", "linktr.ee", "bit.ly", "goo.gl", "maps.app.goo.gl", "sites.google.com", "business.site", "wixsite.com",
    "weebly.com", "blogspot.com", "wordpress.com", "jimdosite.com", "vercel.app", "ueniweb.com", "bolt.host", "mypixieset.com", "sleek.fitness",
)
PORTALS = (
    "99acres.com", "magicbricks.com", "housing.com", "nobroker.in", "commonfloor.com", "squareyards.com", "proptiger.com", "olx.in", "olx.com",
    "practo.com", "lybrate.com", "credihealth.com", "1mg.com", "tata1mg.com", "makemytrip.com", "booking.com", "agoda.com", "goibibo.com",
    "tripadvisor.in", "tripadvisor.com", "oyorooms.com", "airbnb.co.in", "wedmegood.com", "shaadisaga.com", "weddingwire.in", "weddingz.in",
    "urbancompany.com", "urbanclap.com", "cult.fit", "zomato.com", "swiggy.com",
)
#: Fixed patterns of parked pages.
PARKED = (
    "this domain (is for sale|has expired)", "buy this domain", r"sedoparking|parkingcrew|bodis|afternic|dan\.com",
    "default web site page|apache2 (ubuntu|debian) default", "index of /", r"<title>\s*(untitled|new page [0-9])",
)
#: Fixed words of failures, in order.
FAILURES = (("dns", ("err_name_not_resolved", "enotfound")), ("refused", ("err_connection_refused", "econnrefused")), ("nav-timeout", ("timeout",)), ("crash", ("crash", "target closed")))
RETRYABLE = ("nav-timeout", "crash", "blocked-429", "blocked-403")


def _named(url: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of the host and the registrable domain, each taken from the URL once."""
    return let(host(url), lambda h: let(of_host(h), lambda d: body(h, d)))


def _either(h: Column, d: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(d.isin(*names), F.lit(False)) | F.coalesce(h.isin(*names), F.lit(False))


def _rejected(h: Column, d: Column) -> Column:
    return _either(h, d, REJECTED) | F.coalesce(h.rlike(r"^webnode\."), F.lit(False))


def is_portal(url: Column) -> Column:
    return _named(url, lambda h, d: _either(h, d, PORTALS))


def is_rejected(url: Column) -> Column:
    return _named(url, _rejected)


def skip_reason(url: Column) -> Column:
    return _named(url, lambda h, d: F.when(_either(h, d, PORTALS), "aggregator-profile-only").when(_rejected(h, d) | d.isNull(), "aggregator-or-social-only"))


def is_parked(body: Column, length: Column) -> Column:
    b = F.coalesce(body, F.lit(""))
    found = F.lit(False)
    for p in PARKED:
        found = found | b.rlike(f"(?i){p}")
    return found | ((length < 2048) & b.rlike("(?i)coming soon")) | ((length < 512) & ~b.rlike("(?i)<img") & ~b.rlike(r"(?i)<a\s[^>]*href"))


def verdict(allowed: Column, error: Column, status: Column, final_url: Column, own_url: Column, parked: Column) -> Column:
    """struct(verdict, reason): the first reason to skip a site, else audit."""
    away = registrable(final_url)
    reason = (
        F.when(~allowed, F.lit("robots-disallow"))
        .when(error.isNotNull(), F.lit("probe-error"))
        .when(status.isNull(), F.lit("dead-host"))
        .when(status >= 400, F.lit("http-error"))
        .when(is_rejected(final_url) & (away != registrable(own_url)), F.concat(F.lit("redirected-to-"), away))
        .when(parked, F.lit("parked"))
    )
    return F.struct(F.when(reason.isNull(), "audit").otherwise("skip").alias("verdict"), reason.alias("reason"))


def robots_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Longest matching rule decides, allow wins ties, no rule allows."""

    def longest(rules: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter(rules, lambda p: (p != "") & F.startswith(path, p)), F.length)), F.lit(-1))

    return longest(allow) >= longest(disallow)


def error_kind(message: Column, status: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.when(status.isin(403, 429), F.concat(F.lit("blocked-"), status.cast("string")))
    for kind, words in FAILURES:
        hit = F.lit(False)
        for w in words:
            hit = hit | m.contains(w)
        out = out.when(hit, F.lit(kind))
    return out.otherwise("unknown")


def certificate_status(expires: Column, today: Column) -> Column:
    """none, ok or expired yyyy-MM, from TLS date text."""
    at = F.try_to_timestamp(F.regexp_replace(expires, " +", " "), F.lit("MMM d HH:mm:ss yyyy z"))
    return F.when(at.isNull(), "none").when(at < today, F.concat(F.lit("expired "), F.date_format(at, "yyyy-MM"))).otherwise("ok")
