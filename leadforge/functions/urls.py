"""URL columns: registrable domain, clean href, kind of link."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels that the data can hold, tracking parameters, social hosts.
TWO_LABEL_SUFFIXES = ("co.in", "net.in", "org.in", "gen.in", "firm.in", "ac.in", "gov.in", "co.uk", "org.uk", "me.uk", "com.au", "co.nz", "co.za", "com.br", "com.sg", "co.jp")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid")
SOCIAL = ("facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "wa.me", "whatsapp.com", "pinterest.com", "t.me", "tiktok.com", "threads.net")


def host(url: Column) -> Column:
    """Lower-case host, null for what is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, wherever the expression is moved: a one-element transform binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def of_host(name: Column) -> Column:
    """Public suffix and one label of a host."""

    def cut(labels: Column) -> Column:
        n = F.size(labels)
        last = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), 2))
        width = F.when(last.isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2)
        return let(width, lambda k: F.when(n >= k, F.concat_ws(".", F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k))))

    return F.when(~name.rlike(r"^[0-9.]+$"), let(F.split(name, r"\."), cut))


def registrable(url: Column) -> Column:
    """Public suffix and one label; null for bad URLs, addresses and single labels."""
    return let(host(url), of_host)


def clean_href(url: Column) -> Column:
    """An absolute URL without fragment and tracking parameters."""
    bare = F.regexp_replace(url, "#.*$", "")
    gone = F.regexp_replace(bare, rf"([?&])(?:(?:{'|'.join(TRACKING)})=[^&]*(?:&|$))+", "$1")
    return F.regexp_replace(gone, "[?&]$", "")


def scheme(href: Column) -> Column:
    return F.lower(F.regexp_extract(href, "^([a-zA-Z]+:)", 1))


def kind(href: Column, own_domain: Column) -> Column:
    """mailto, tel, social, internal or external."""
    s, d = scheme(href), registrable(href)
    return F.when(s == "mailto:", "mailto").when(s == "tel:", "tel").when(d.isin(*SOCIAL), "social").when(d.isNull() | (d == own_domain), "internal").otherwise("external")
