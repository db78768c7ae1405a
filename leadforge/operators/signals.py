"""Measured signals of saved pages: one conditional aggregate per document over the element table.

Absent measurements are the text ``none`` (or ``missing``), as reports expect. The reference year and
date are parameters, never a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadforge.functions.numbers import first_year
from leadforge.operators.config import theme_note

VERSION = r"([0-9]+\.[0-9]+(?:\.[0-9]+)?)"
YEAR = "((?:19|20)[0-9]{2})"
#: Fixed order of slider libraries: name, pattern, pattern of a version.
SLIDERS = (
    ("revslider", "revslider|rev_slider|revolution", rf"(?i)revslider[.\-]?{VERSION}"), ("nivo slider", "nivo", rf"(?i)nivo[.\-]?slider[.\-]?{VERSION}"),
    ("owl carousel", r"owl[.\-]?carousel", rf"(?i)owl\.carousel[.\-]?{VERSION}"), ("flexslider", "flexslider", rf"(?i)flexslider[.\-]?{VERSION}"),
    ("jquery cycle", r"jquery[.\-]?cycle", None), ("slick", "slick(?![a-z])", rf"(?i)slick[.\-]?{VERSION}"), ("swiper", "swiper", rf"(?i)swiper[.\-]?(?:bundle[.\-]?)?{VERSION}"),
    ("splide", "splide", None), ("embla", r"embla[.\-]?carousel", None), ("keen-slider", r"keen[.\-]?slider", None),
)
#: Fixed patterns of chat links and marks, of blog links, and fixed classes of form plugins with their labels.
CHAT_LINK, CHAT_NAME, CHAT_MARK, BLOG = r"(?i)wa\.me|api\.whatsapp\.com|whatsapp://", "(?i)whats-?app", "whatsapp|whats-app", "(?i)blog|news|articles"
FORMS = (("wpcf7", "contact form 7"), ("wpforms", "wpforms"), ("gform", "gravity form"))
#: Fixed order of site builders by their asset paths.
BUILDERS = (("Next.js", r"/_next/static/"), ("Wix", r"(?i)wix|_partials/|wixstatic"), ("Squarespace", "(?i)squarespace"), ("Shopify", "(?i)shopify"))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, group), F.lit(""))


def first(value: Column, order: Column | str = "pos") -> Column:
    """First non-null value in document order."""
    at = F.col(order) if isinstance(order, str) else order
    return F.min_by(value, F.when(value.isNotNull(), at))


def copyright_years(text: Column) -> Column:
    mark = r"(?i)(?:©|&copy;|copyright)[^0-9]{0,40}"
    return F.coalesce(found(text, mark + r"(?:19|20)[0-9]{2}\s*[-–]\s*" + YEAR), found(text, mark + YEAR)).cast("int")


def page_signals(elements: DataFrame, key: str, https: Column | None = None) -> DataFrame:
    """One row per document: the signals that its HTML shows. ``https``: whether the page was served by https."""
    tag, attr = F.col("tag"), lambda k: F.col("attrs")[k]
    is_script, is_link = (tag == "script") & attr("src").isNotNull(), (tag == "link") & attr("href").isNotNull()
    script, link = F.when(is_script, attr("src")), F.when(is_link, attr("href"))
    asset = F.coalesce(script, link)
    # scripts come before links wherever both are looked through
    asset_order = F.struct(is_link, F.col("pos"))
    inline, style, body = F.when((tag == "script") & attr("src").isNull(), F.col("text")), F.when(tag == "style", F.col("text")), F.when(tag == "body", F.col("text"))
    tail = F.substr(body, F.floor(F.length(body) * 0.85).cast("int") + 1)
    named = F.concat(F.coalesce(attr("class"), F.lit("")), F.coalesce(attr("id"), F.lit("")))
    floats = F.coalesce(F.lower(attr("class")).rlike("float|fixed"), F.lit(False)) | F.coalesce(F.lower(attr("style")).rlike(r"position\s*:\s*fixed"), F.lit(False))
    chat = (tag == "a") & attr("href").isNotNull() & (attr("href").rlike(CHAT_LINK) | named.rlike(CHAT_NAME))
    chat_mark = F.coalesce(attr("class").rlike(CHAT_MARK) | attr("id").rlike("whatsapp"), F.lit(False))
    floating = F.coalesce(F.lower(attr("class")).rlike("float|fixed"), F.lit(False))
    action, post = F.coalesce(attr("action"), F.lit("")), F.lower(F.coalesce(attr("method"), F.lit("get"))) == "post"
    css = F.coalesce(attr("class"), F.lit(""))
    plugin = F
    for name, label in FORMS:
        plugin = plugin.when(css.contains(name), label)
    form = F.when(action.startswith("mailto:"), "mailto: only").when(post | (action != ""), plugin.otherwise("contact form"))
    blog_link = (tag == "a") & attr("href").isNotNull() & F.concat(attr("href"), F.col("text")).rlike(BLOG)
    plain = sum((F.coalesce(attr(k).startswith("http://"), F.lit(False)).cast("int") for k in ("src", "href", "srcset")), F.lit(0))
    theme = found(link, "/wp-content/themes/([^/]+)/")

    agg = {
        "foot_year": F.max(F.when(tag == "footer", copyright_years(F.col("text")))), "tail_year": F.max(copyright_years(tail)),
        "jq1": first(found(script, rf"(?i)jquery[.\-]?{VERSION}")), "jq2": first(found(inline, rf"""(?i)jQuery\.fn\.jquery\s*=\s*["']{VERSION}["']""")), "jq3": F.bool_or(script.rlike("(?i)jquery")),
        "bs1": first(found(link, rf"(?i)bootstrap[.\-]?{VERSION}")), "bs2": first(found(script, rf"(?i)bootstrap[.\-]?{VERSION}")), "bs3": first(found(style, rf"(?i)Bootstrap\s+v{VERSION}")),
        "gen": first(F.when((tag == "meta") & (attr("name") == "generator"), F.nullif(attr("content"), F.lit("")))),
        "wp": F.bool_or(asset.rlike("/wp-content/|/wp-includes/")), "wp_version": first(F.when(asset.rlike("wp-includes|wp-content/themes"), found(asset, rf"[?&]ver={VERSION}")), asset_order),
        "front_page": F.bool_or(F.col("text").contains("FrontPage")), "word": F.bool_or(F.col("text").contains("Microsoft Word")), "theme": first(theme),
        "viewport": F.bool_or((tag == "meta") & (F.lower(attr("name")) == "viewport")),
        "plain": F.sum(plain), "empty_images": F.count_if((tag == "img") & (F.trim(F.coalesce(attr("src"), F.lit(""))) == "")),
        "autoplay": F.bool_or((tag == "video") & attr("autoplay").isNotNull()),
        "chat": F.max(F.when(chat, F.when(floats, 2).otherwise(1))), "chat_mark": F.max(F.when(chat_mark, F.when(floating, 2).otherwise(1))),
        "form": first(F.when(tag == "form", form)), "forms": F.collect_set(F.when((tag == "form") & (action != ""), action)),
        "post_year": first(F.when(blog_link, F.col("parent_year"))), "blog_link": F.bool_or(blog_link),
    }
    for i, (_, pattern, version) in enumerate(SLIDERS):
        hit = asset.rlike(pattern)
        named_version = found(asset, version) if version else F.lit(None)
        agg[f"s{i}"] = first(F.when(hit, F.coalesce(named_version, found(asset, rf"[.\-]{VERSION}(?:\.min)?\.(?:js|css)"), F.lit(""))), asset_order)
    for i, (_, pattern) in enumerate(BUILDERS):
        agg[f"b{i}"] = F.bool_or(asset.rlike(pattern))
    d = elements.groupBy(key).agg(*(c.alias(n) for n, c in agg.items()))

    none = F.lit("none")
    slider = F.coalesce(*(F.when(F.col(f"s{i}").isNotNull(), F.trim(F.concat(F.lit(name + " "), F.col(f"s{i}")))) for i, (name, _, _) in enumerate(SLIDERS)), none)
    builder = F.coalesce(*(F.when(F.col(f"b{i}"), F.lit(name)) for i, (name, _) in enumerate(BUILDERS)), F.when(F.col("front_page"), "FrontPage"), F.when(F.col("word"), "Microsoft Word"), F.lit("static html"))
    talk = F.coalesce("chat", "chat_mark")
    return d.select(
        key,
        F.coalesce(F.coalesce("foot_year", "tail_year").cast("string"), none).alias("copyright"),
        F.coalesce("jq1", "jq2", F.when(F.col("jq3"), "present"), none).alias("jquery"),
        F.coalesce("bs1", "bs2", "bs3", none).alias("bootstrap"),
        slider.alias("slider"),
        F.coalesce("gen", F.when(F.col("wp"), F.trim(F.concat(F.lit("WordPress "), F.coalesce("wp_version", F.lit(""))))), builder).alias("generator"),
        F.coalesce("theme", none).alias("theme"),
        F.when(F.col("viewport"), "present").otherwise("missing").alias("viewport"),
        F.when(F.col("plain") > 0, F.concat(F.col("plain").cast("string"), F.lit(" assets"))).otherwise(none).alias("mixedContent"),
        F.col("empty_images").alias("empty_images"),
        F.coalesce("autoplay", F.lit(False)).alias("autoplay"),
        F.when(talk == 2, "float button").when(talk == 1, "present").otherwise(none).alias("whatsapp"),
        F.coalesce("form", none).alias("quoteForm"), F.col("forms").alias("form_actions"),
        F.coalesce(F.concat(F.lit("last post "), F.col("post_year")), F.when(F.col("blog_link"), "present"), none).alias("blog"),
    )


def with_capture(signals: DataFrame, year: int, today: str, market: list[tuple[str, str]] | None = None) -> DataFrame:
    """Signals with what the capture measured: reads columns overflow_px, tap_targets, lcp_ms, transfer_bytes, videos
    (array of struct(url, bytes)), broken (array of url), wayback_first, https_ok, cert_expires (date), final_url.

    Two further columns go before what the page shows, where the table has them and they are not null: ``viewport_meta`` (boolean) and ``redesigned_given``.
    ``market``: theme slugs (lower-case) with the market that sells them.
    """
    none = F.lit("none")
    first_seen, made = first_year(F.col("wayback_first")), first_year(F.col("copyright"))
    age = year - first_seen
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    biggest = F.get(F.sort_array(F.transform("videos", lambda v: F.struct(v["bytes"].alias("bytes"), v["url"].alias("url"))), asc=False), F.lit(0))
    secure = F.coalesce(F.col("final_url").startswith("https"), F.lit(False)) & F.coalesce(F.col("https_ok"), F.lit(False))
    expired = F.coalesce(F.col("cert_expires") < F.to_date(F.lit(today)), F.lit(False))
    dead_images = F.size(F.filter(F.coalesce("broken", F.array().cast("array<string>")), lambda u: u.rlike(r"(?i)\.(jpg|jpeg|png|gif|webp|svg|ico|bmp)") | u.contains("image")))
    given = lambda c, value: F.coalesce(F.col(c).cast("string"), value) if c in signals.columns else value
    redesigned = F.when(first_seen.isNull(), "n/a").when(made > first_seen + 1, made.cast("string")).otherwise("never")
    viewport = F.when(F.col("viewport_meta"), "present").when(~F.col("viewport_meta"), "missing").otherwise(F.col("viewport")) if "viewport_meta" in signals.columns else F.col("viewport")
    return signals.withColumns({
        "theme": theme_note(F.col("theme"), market) if market else F.col("theme"), "viewport": viewport,
        "wayback": F.coalesce(F.col("wayback_first").cast("string"), none),
        "domainAge": F.when(first_seen.isNull(), none).when(age < 1, F.concat((age * 12).cast("string"), F.lit(" mo"))).otherwise(F.concat(age.cast("string"), F.lit(" yr"))),
        "redesigned": given("redesigned_given", redesigned),
        "overflow": F.when(F.coalesce("overflow_px", F.lit(0)) == 0, "0px").otherwise(F.concat(F.lit("+"), F.col("overflow_px").cast("string"), F.lit("px"))),
        "tapTargets": F.concat(F.coalesce("tap_targets", F.lit(0)).cast("string"), F.lit(" under 44px")),
        "lcp": F.when(F.coalesce("lcp_ms", F.lit(0.0)) == 0, none).otherwise(F.concat(one(F.col("lcp_ms") / 1000), F.lit("s"))),
        "pageWeight": F.when(F.coalesce("transfer_bytes", F.lit(0)) == 0, none).otherwise(F.concat(one(F.col("transfer_bytes") / 1048576), F.lit(" MB"))),
        "heroVideo": F.when(biggest.isNotNull(), F.concat(one(biggest["bytes"] / 1048576), F.when(biggest["url"].contains(".webm"), " MB webm").otherwise(" MB mp4"), F.when(F.col("autoplay"), ", autoplay").otherwise(""))).when(F.col("autoplay"), "present").otherwise(none),
        "https": F.when(~F.coalesce(F.col("https_ok"), F.lit(False)), "none - http only").when(expired, F.concat(F.lit("expired "), F.date_format("cert_expires", "yyyy-MM"))).when(~secure, "none - http only").otherwise("ok"),
        "mixedContent": F.when(secure, F.col("mixedContent")).otherwise(none),
        "brokenImages": (F.col("empty_images") + dead_images).cast("string"),
        "quoteForm": F.when(F.arrays_overlap(F.coalesce("form_actions", F.array().cast("array<string>")), F.coalesce("broken", F.array().cast("array<string>"))), "broken").otherwise(F.col("quoteForm")),
    })
