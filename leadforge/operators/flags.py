"""Weak-signal flags in order of weight, reasons and pitch angles, compiled from rule tables to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadforge.functions.numbers import first_number, first_year, lcp_bucket, text
from leadforge.operators.scoring import DATED_SLIDERS, old_wordpress

#: Fixed order of flags, worst first.
ORDER = "https viewport overflow lcp pageWeight brokenImages tapTargets mixedContent redesigned jquery slider copyright generator bootstrap heroVideo whatsapp quoteForm blog domainAge".split()
#: Fixed order of angles: name, flags that must all be up, words that the first flag's signal must hold.
ANGLES = (
    ("cert-expired", ("https",), "expired"), ("no-https", ("https",), "http only"), ("form-broken", ("quoteForm",), "broken"),
    ("mobile-gallery-broken", ("viewport", "overflow"), None), ("mobile-overflow", ("overflow",), None), ("mobile-tap-targets", ("tapTargets",), None),
    ("hero-video-weight", ("heroVideo", "lcp"), None), ("slow-photography", ("lcp", "pageWeight"), None), ("unpatched-cms", ("generator",), None),
    ("broken-images", ("brokenImages",), None), ("mixed-content", ("mixedContent",), None), ("dated-template", ("redesigned", "slider"), None),
    ("no-lead-capture", ("whatsapp", "quoteForm"), None), ("generic", (), None),
)
REASONS = {
    "https": "Browsers warn visitors about the connection.", "viewport": "Phones get a shrunken desktop layout.", "overflow": "The page is wider than a phone.",
    "lcp": "The main content appears late.", "pageWeight": "The page weighs several megabytes.", "brokenImages": "Some images do not load.",
    "tapTargets": "Buttons are too small for thumbs.", "mixedContent": "Some parts load without encryption.", "redesigned": "The look is as old as the site.",
    "jquery": "An old script library is in use.", "slider": "The slider belongs to another decade.", "copyright": "The footer year is long past.",
    "generator": "The site software is no longer patched.", "bootstrap": "The layout framework predates phones.", "heroVideo": "A video loads before the content.",
    "whatsapp": "There is no chat contact.", "quoteForm": "There is no enquiry form.", "blog": "The last post is years old.", "domainAge": "The domain is new.",
}


def rules(s: dict[str, Column], year: int) -> dict[str, Column]:
    n, y = (lambda k: first_number(s[k])), (lambda k: first_year(s[k]))
    return {
        "viewport": s["viewport"] == "missing", "overflow": n("overflow") > 0, "tapTargets": n("tapTargets") >= 5, "lcp": lcp_bucket(s["lcp"]).isin("slow", "dire"),
        "pageWeight": n("pageWeight") > 4, "heroVideo": s["heroVideo"] != "none", "https": s["https"] != "ok", "mixedContent": s["mixedContent"] != "none",
        "brokenImages": n("brokenImages") >= 1, "jquery": n("jquery") < 3, "bootstrap": n("bootstrap") < 4, "slider": text(s["slider"]).rlike(DATED_SLIDERS),
        "redesigned": (s["redesigned"] == "never") | (y("redesigned") <= year - 6), "copyright": y("copyright") <= year - 5,
        "generator": old_wordpress(s["generator"]) | text(s["generator"]).rlike("(?i)frontpage|static html"), "whatsapp": s["whatsapp"] == "none", "quoteForm": s["quoteForm"] == "none",
        "blog": y("blog") <= year - 3, "domainAge": n("domainAge") < 1,
    }


def flagged(s: dict[str, Column], year: int = 2026) -> Column:
    """Names of the flags that are up, worst first; a missing signal is not judged."""
    up = rules(s, year)
    return F.array_compact(F.array(*(F.when(F.coalesce(up[k], F.lit(False)), F.lit(k)) for k in ORDER)))


def reasons(flags: Column, most: int = 5) -> Column:
    """Reasons of the first flags, cut before names without a reason are dropped."""
    known = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    return F.array_compact(F.transform(F.slice(flags, 1, most), lambda k: F.try_element_at(known, k)))


def angle(flags: Column, s: dict[str, Column], gate: Column) -> Column:
    """The first angle whose flags are all up and whose guard holds; ``gate`` where a gate is closed."""
    out = F.when(gate.isNotNull(), F.lit("gate"))
    for name, needs, guard in ANGLES:
        ok = F.lit(True)
        for k in needs:
            ok = ok & F.array_contains(flags, k)
        if guard:
            ok = ok & F.contains(F.lower(text(s[needs[0]])), F.lit(guard))
        out = out.when(ok, F.lit(name))
    return out


def pitch(angle_name: Column, gate: Column) -> Column:
    """The gate's sentence for gated leads, else the angle."""
    return F.when(gate.isNull(), angle_name).when(gate.contains("no measurable pain"), F.lit("No measurable pain. Skip.")).otherwise(F.concat(F.lit("Gate: "), gate, F.lit(".")))
