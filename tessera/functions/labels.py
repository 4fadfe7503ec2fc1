"""Texts that people read, and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .normalize import number, text


def not_a_number(raw: Column) -> Column:
    """A text, but '' where it is just a number, as identifiers of suppliers' own tables are."""
    c = text(raw.cast("string"))
    return F.when(F.replace(c, F.lit("."), F.lit("")).rlike("^[0-9]+$"), "").otherwise(c)


def first_filled(*values: Column) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def clean_name(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "))


def image_url(base: Column, file: Column) -> Column:
    """The address of a supplier's photo: file names of items only, spaces and signs quoted, slashes kept."""
    name = text(file)
    quoted = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when((F.coalesce(base, F.lit("")) != "") & F.lower(name).startswith("item_img"), F.concat(base, quoted)).otherwise("")


def full_size(url: Column) -> Column:
    """The largest version of a photo that its address tells of, else the address."""
    u = text(url)
    stored, full = vocab.STORED_WIDTH
    thumb = F.contains(u, F.lit("slabcloud.com")) & F.contains(u, F.lit("_thumb."))
    return F.when(F.contains(u, F.lit(stored)), F.replace(u, F.lit(stored), F.lit(full))).when(thumb, F.replace(u, F.lit("_thumb."), F.lit("."))).otherwise(u)


def product_url(host: Column, item_id: Column, source_url: Column) -> Column:
    """Where a product stands on its supplier's own site: its own address, or the item under a bare root."""
    root, own = F.concat(F.lit("https://"), host), text(source_url)
    return (
        F.when((own != "") & (F.regexp_replace(own, "/+$", "") != root), own)
        .when(F.coalesce(item_id, F.lit("")) != "", F.concat(root, F.lit("/InventoryDetail/"), item_id))
        .when(own != "", own)
        .otherwise(F.concat(root, F.lit("/")))
    )


def plain_host(raw: Column) -> Column:
    """A host without scheme, path and www."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text(raw)), "^https://", ""), "^http://", "")
    return F.regexp_replace(F.split_part(bare, F.lit("/"), F.lit(1)), r"^www\.", "")


def apex_name(url: Column) -> Column:
    """A name made of a host's first label."""
    host = F.regexp_replace(F.lower(F.split_part(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit(1))), r"^www\.", "")
    return F.initcap(F.replace(F.split_part(host, F.lit("."), F.lit(1)), F.lit("-"), F.lit(" ")))


def geological_origin(host: Column) -> Column:
    """Whether a supplier's origins are where the stone comes from, and not where it is sold."""
    return F.lower(F.coalesce(host, F.lit(""))).endswith(vocab.GEOLOGICAL)


def elapsed(seconds: Column) -> Column:
    """A duration in the unit that fits it."""
    return (
        F.when(seconds < 90, F.concat(F.format_string("%.0f", F.bround(seconds, 0)), F.lit("s")))
        .when(seconds < 5400, F.concat(F.format_string("%.0f", F.bround(seconds / 60, 0)), F.lit(" min")))
        .otherwise(F.concat(F.format_string("%.1f", seconds / 3600), F.lit(" h")))
    )


def comma(value: Column) -> Column:
    """A whole number with thousands apart; other texts stay, null is ''."""
    whole = value.cast("string").try_cast("long")
    return F.when(value.isNull(), "").when(whole.isNotNull(), F.format_number(whole, 0)).otherwise(value.cast("string"))


def match_percent(score: Column) -> Column:
    """A cosine as a percentage: from 0.5 on, 100 at 1."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround((score - 0.5) * 200, 0).cast("int")))


def whole_price(value: Column) -> Column:
    """A price in whole dollars; '' for none."""
    amount = text(value.cast("string")).try_cast("double")
    return F.when((amount.isNotNull()) & (amount != 0), F.concat(F.lit("$"), F.format_number(F.bround(amount, 0), 0))).otherwise("")


def price_label(sources: Column, confidence: Column, low: Column, high: Column, currency: Column, basis: Column) -> Column:
    """A sourced price by the square foot, always with what it is for; '' where nothing may be said."""
    sign = F.when(F.upper(F.coalesce(currency, F.lit("USD"))) == "USD", "$").otherwise("")
    lo, hi = F.nullif(low, F.lit(0.0)), F.nullif(high, F.lit(0.0))
    span = F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi), F.concat(sign, number(lo), F.lit("–"), sign, number(hi))).otherwise(F.concat(sign, number(F.coalesce(lo, hi))))
    known = (F.coalesce(F.size(sources), F.lit(0)) > 0) & (F.coalesce(confidence, F.lit("unknown")) != "unknown") & F.coalesce(lo, hi).isNotNull()
    return F.when(known, F.concat(span, F.lit(" / sq ft"), F.when(text(basis) != "", F.concat(F.lit(" · "), text(basis))).otherwise(""))).otherwise("")
