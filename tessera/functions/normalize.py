"""Attributes of a listing as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def number(x: Column) -> Column:
    """A number as text without a fraction of zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def title(c: Column) -> Column:
    """Every letter after a non-letter in upper case."""
    return F.array_join(F.transform(F.split(F.regexp_replace(F.lower(c), r"(?<![a-zA-Z])([a-zA-Z])", "\u0001$1"), "\u0001"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def first_rule(haystack: Column) -> Column:
    """The type of the first rule found in the text, else ''."""
    return reduce(lambda rest, rule: F.when(haystack.contains(rule[0]), rule[1]).otherwise(rest), reversed(vocab.TYPE_RULES), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_type(category: Column, subcategory: Column, name: Column) -> Column:
    """The type of a listing: equipment and accessories, then the first rule that its categories meet, then its name; a general type gives way to the name's."""
    parts = [F.lower(text(c)) for c in (subcategory, category)]
    hay = F.concat_ws(" ", *(F.when((p != "") & ~F.replace(p, F.lit("."), F.lit("")).rlike("^[0-9]+$"), p) for p in parts))
    words = r"\b(?:" + "|".join(vocab.ACCESSORY_WORDS) + r")\b"
    part = "|".join(vocab.ACCESSORY_PARTS)

    def typed(t: Column) -> Column:
        hay, nm = t["hay"], t["name"]
        tool = nm.rlike(r"slab\s+(?:" + "|".join(vocab.SLAB_TOOLS) + ")")
        accessory = tool | (~nm.rlike(r"\bslab\b") & (hay.rlike(part) | nm.rlike(part) | hay.rlike(words) | nm.rlike(words)))

        def named(by: Column) -> Column:
            stronger = by["hay"].isin(*vocab.GENERIC) & (by["name"] != "") & ~by["name"].isin(*vocab.GENERIC)
            label = F.when(stronger | (by["hay"] == ""), by["name"]).otherwise(by["hay"])
            return F.coalesce(F.nullif(label, F.lit("")), F.lit("Other"))

        return F.when(accessory, vocab.ACCESSORY).otherwise(let(F.struct(first_rule(hay).alias("hay"), first_rule(nm).alias("name")), named))

    return let(F.struct(hay.alias("hay"), F.lower(text(name)).alias("name")), typed)


def finish(name: Column, structured: Column) -> Column:
    """The supplier's own finish, else the name's; several are Multiple."""
    own = text(structured)
    own = F.when(F.lower(own).isin(*vocab.FINISH_EMPTY), "").otherwise(own)
    words = "|".join(sorted(vocab.FINISHES, key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(F.when(own != "", own).otherwise(F.coalesce(name, F.lit("")))), F.lit(rf"\b({words})\b"), F.lit(1))
    names = F.create_map(*(F.lit(x) for kv in vocab.FINISHES.items() for x in kv))
    seen = F.array_distinct(F.transform(found, lambda w: F.element_at(names, w)))
    return F.when(F.size(seen) > 1, "Multiple").when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise(own)


def clean_color(raw: Column) -> Column:
    c = text(raw)
    keep = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: (p != "") & (F.length(p) <= 18) & (F.size(F.split(p, r"\s+")) <= 2) & ~p.rlike("[0-9]"))
    return F.when(F.replace(c, F.lit("."), F.lit("")).rlike("^[0-9]+$"), "").otherwise(F.array_join(F.array_distinct(F.transform(keep, title)), ", "))


def color_in_name(name: Column) -> Column:
    return title(F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"(?<![a-z])(" + "|".join(vocab.COLORS) + r")(?![a-z])", 1))


def families(color: Column) -> Column:
    """All families that a raw colour belongs to."""
    words = F.split(F.lower(F.coalesce(color, F.lit(""))), "[^a-z0-9]+")
    return F.filter(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, syns))), F.lit(fam)) for fam, syns in vocab.FAMILIES.items())), lambda f: f.isNotNull())


def in_choice(color: Column, choice: str) -> Column:
    """Whether a raw colour is what a choice stands for: a family, `Other` for colours of no family, or a raw value of old, which widens to its first family if it has one."""
    if choice not in vocab.FAMILIES and choice != "Other":
        words = set(re.split("[^a-z0-9]+", choice.lower()))
        wider = next((family for family, synonyms in vocab.FAMILIES.items() if words & set(synonyms)), "")
        if not wider:
            return color == choice
        choice = wider
    if choice == "Other":
        return (F.coalesce(color, F.lit("")) != "") & (F.size(families(color)) == 0)
    return F.array_contains(families(color), choice)


def thickness(raw: Column, name: Column, uom: Column) -> Column:
    value = F.regexp_extract(text(raw), r"^\s*(\d+(?:\.\d+)?)\s*", 1).try_cast("double")
    own = F.lower(F.regexp_extract(text(raw), r"(?i)^\s*\d+(?:\.\d+)?\s*(cm|mm|inch|in)\b", 1))
    sold = F.lower(text(uom))
    sold = F.when(sold.isin('"', "inch"), "in").when(sold.isin(*vocab.UNIT_CM), sold).otherwise("")
    unit = F.when(own != "", F.when(own == "inch", "in").otherwise(own)).when(sold != "", sold).otherwise("cm")
    cm = value * F.when(unit == "mm", 0.1).when(unit == "in", 2.54).otherwise(1.0)
    cm = F.when(unit == "in", F.round(cm, 1)).otherwise(F.round(cm, 2))
    in_name = F.regexp_extract(F.coalesce(name, F.lit("")), r"(?i)(\d+(?:\.\d+)?)\s*cm", 1)
    return F.when(value.isNotNull(), F.concat(number(cm), F.lit("cm"))).when(in_name != "", F.concat(number(in_name.try_cast("double")), F.lit("cm"))).otherwise("")


def repair_mm(stored: Column, uom: Column) -> Column:
    """A thickness in cm of 10 or more whose unit says mm was millimetres."""
    cm = F.regexp_extract(stored, r"^(\d+(?:\.\d+)?)cm$", 1).try_cast("double")
    return F.when((F.lower(text(uom)) == "mm") & (cm >= 10) & (cm / 10).between(0.1, 10), F.concat(number(cm / 10), F.lit("cm"))).otherwise(stored)


def repair_inches(stored: Column) -> Column:
    """A thickness that isn't nominal but would be in inches."""
    cm = F.regexp_extract(stored, r"(?i)^\s*(\d+(?:\.\d+)?)\s*cm\s*$", 1).try_cast("double")
    inches = F.round(cm * 2.54, 1)
    return F.when(~cm.isin(*vocab.NOMINAL_CM) & inches.isin(*vocab.NOMINAL_CM), F.concat(number(inches), F.lit("cm"))).otherwise(stored)


def inches(value: Column) -> Column:
    """A slab's side: below 20 it was metres, from 145 on centimetres."""
    return F.when(value <= 0, value).when(value < 20, F.round(value * 39.3701, 1)).when(value >= 145, F.round(value / 2.54, 1)).otherwise(value)


def _spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title_key(name: Column, material_type: Column) -> Column:
    """What a name is without finish, size, form, its own type and punctuation."""
    n = F.lower(F.coalesce(name, F.lit("")))
    for left_out in (vocab.KEY_REMARK, vocab.KEY_FINISH, vocab.KEY_QUALIFIER, vocab.KEY_SIZE, vocab.KEY_UNIT):
        n = F.regexp_replace(n, left_out, " ")
    n = _spaces(F.regexp_replace(n, "[^a-z0-9 ]+", " "))
    kind = F.lower(text(material_type))
    own = F.concat(F.lit(r"\b\Q"), kind, F.lit(r"\E\b"))
    nobody = kind.isin("", "other", vocab.ACCESSORY.lower())
    typeless = lambda n: let(_spaces(F.regexp_replace(n, own, F.lit(" "))), lambda bare: F.when(nobody | (bare == ""), n).otherwise(bare))
    formless = lambda n: let(_spaces(F.regexp_replace(n, vocab.KEY_FORM, " ")), lambda bare: F.when(bare == "", n).otherwise(bare))
    return let(let(n, typeless), formless)


def material_key(name: Column, material_type: Column) -> Column:
    return let(title_key(name, material_type), lambda base: F.when(base == "", "").otherwise(F.concat(base, F.lit("|"), F.lower(F.coalesce(material_type, F.lit(""))))))


def remap_key(key: Column) -> Column:
    kind = F.regexp_extract(key, r"\|([^|]*)$", 1)
    again = title_key(F.regexp_extract(key, r"^(.*)\|", 1), kind)
    return let(again, lambda n: F.when(~key.contains("|") | (n == ""), key).otherwise(F.concat(n, F.lit("|"), kind)))


def price(raw: Column) -> Column:
    """(basis, amount): an amount by the square foot anywhere in the text, or a bare amount that is all of it; else null."""
    by_area = F.regexp_extract(text(raw), vocab.PRICE_BY_AREA, 1)
    bare = F.regexp_extract(text(raw), vocab.PRICE_BARE, 1)
    amount = F.replace(F.when(by_area != "", by_area).otherwise(bare), F.lit(","), F.lit("")).try_cast("double")
    return F.when(amount.isNotNull(), F.struct(F.when(by_area != "", "sqft").otherwise("unit").alias("basis"), amount.alias("amount")))


def miles(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat - lat0) / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(lat0))) * F.pow(F.sin(F.radians(lon - lon0) / 2), 2)
    return 2 * 3958.8 * F.asin(F.sqrt(a))
