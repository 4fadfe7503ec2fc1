"""Personal data by boosted trees over high-recall candidates (operator 2), in DataFrame functions only.

Base rules give spans that always stay. Beside them, wider generators propose spans for each kind,
which may overlap each other and what the base rules have tried and dropped (an address with its
signs spelt out, an address whose first part runs into other digits, a number written in groups).
Format and context features of each candidate go through small boosted trees, one ensemble a kind,
written as CASE expressions. A candidate is taken at its kind's calibrated threshold unless it
overlaps a base span; of taken ones that overlap, the one furthest above its threshold stays.

The trees are trained on the driver from at most `examples` generated lines a kind, whose candidates
and features come from the same expressions. Thresholds are calibrated on lines kept aside, weighted
to `share` of positives among the candidates, as wide generators meet far more look-alikes than
personal data; a kind that reaches the precision at no threshold adds no spans (threshold infinite).

Patterns never try one place twice: runs start at their first character or where the last match
ended, and loops are possessive, so that time is linear and no text overflows a stack.

A null text is empty and has no spans. Repeated rows are read each for itself. Positions count code
points. Among spans with the same start the kinds stand in the order email, ip, card, phone. Equally
good overlapping candidates: the one that starts first, then the kind that is listed first. Columns
that find_pii adds replace those of the same names; an empty table gives an empty one.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_L, _D = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The base patterns, in forms that match the same spans without going back.
BASE = {
    "email": rf"(?:\G|(?<![{_L}]))[{_L}]++@[{_D}]++(?:\.[{_D}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\x20dot\x20|\.)"
_PART = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
#: What may be personal data of a kind.
WIDE = {
    "email": rf"(?i)(?<![{_L}])[{_L}]++{_AT}[{_D}]++(?:{_DOT}[{_D}]++)++",
    "ip": rf"(?i)(?<![0-9]){_PART}(?:(?:\.|\[\.\]|\(\.\)|\x20dot\x20){_PART}){{3}}(?![0-9])|(?<![0-9A-F:.])(?:[0-9A-F]{{1,4}}:){{7}}[0-9A-F]{{1,4}}(?![0-9A-F:])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}(?![0-9])|[0-9]{4}([\x20-])(?:[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,4}){0,2}|[0-9]{6}\1[0-9]{5})(?![0-9]))",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: A text without this has no span of the kind.
NEEDS = {"email": r"@|(?i:\bat\b)", "ip": r"[0-9](?:[.\[(:]|\x20(?i:dot)\x20)|[A-Fa-f]:", "card": r"[0-9]{4}[\x20-]?[0-9]|[0-9](?:[\x20-]?[0-9]){11}", "phone": r"[0-9][\x20().-]*+[0-9]"}
#: Words before a span that speak for or against personal data.
FOR = r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|card|visa|mastercard|amex|credit|mail|e-?mail|contact|write|reach|ip|host|address|from|login)\b"
AGAINST = r"(?i)\b(?:version|ver|v|release|order|invoice|isbn|serial|ref|sku|part|fig|figure|table|page|section|chapter|build|date|total|no)\b|[$€#]"
FEATURES = ("digits", "length", "plus", "paren", "groups", "separators", "luhn", "lead", "largest", "distinct", "dotted", "spelt", "bracketed", "for", "against", "year", "colons", "after", "joined", "domain")
_SPAN = "array<struct<s:int,e:int,m:string>>"


def found(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches as an array of (s, e, m), in code points."""
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p, m: F.struct(F.length(p).alias("skip"), m.alias("m")),
    )
    step = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["skip"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), a["out"])
            .otherwise(F.concat(a["out"], F.array(F.struct((a["at"] + x["skip"]).alias("s"), (a["at"] + x["skip"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))))
            .alias("out"),
        ),
    )
    return step["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    back = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))),
        F.lit(0),
        lambda a, i: a + F.coalesce(
            F.when(i % 2 == 1, F.substr(back, i, F.lit(1)).try_cast("int")).otherwise(
                F.get(F.array(*(F.lit(2 * d - 9 * (d > 4)) for d in range(10))), F.substr(back, i, F.lit(1)).try_cast("int"))
            ),
            F.lit(0),
        ),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _none() -> Column:
    return F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")


def base_spans(text: Column, kind: str) -> Column:
    """The base spans of a kind as an array of (s, k, e, m), k the kind's number."""
    sign = {"email": "@", "phone": "+"}.get(kind)
    there = F.contains(text, F.lit(sign)) if sign else text.rlike(NEEDS[kind])
    spans = F.filter(found(text, BASE[kind]), lambda x: _valid(kind, x["m"]))
    return F.when(there, F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["m"].alias("m")))).otherwise(_none())


def _features(text: Column, x: Column) -> Column:
    """The features of a candidate, in the order of FEATURES, as doubles."""
    m = x["m"]
    before = F.substr(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24)))
    after = F.substr(text, x["e"] + 1, F.lit(4))
    digits = _digits(m)
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    made = (
        F.length(digits), F.length(m), m.startswith("+"), F.contains(m, F.lit("(")), F.size(groups),
        F.length(F.regexp_replace(m, "[^\x20.-]", "")), luhn(m), F.coalesce(F.substr(digits, F.lit(1), F.lit(1)).try_cast("int"), F.lit(-1)),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.least(F.length(g), F.lit(4)) * 0 + F.coalesce(g.try_cast("int"), F.lit(99999)))), F.lit(-1)),
        F.size(F.array_distinct(F.split(digits, ""))), F.size(F.split(m, r"\.")) - 1, m.rlike(r"(?i)\b(?:at|dot)\b"), m.rlike(r"(?i)[(\[{]\x20?(?:at|dot)"),
        before.rlike(FOR), before.rlike(AGAINST), m.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)"),
        F.length(m) - F.length(F.replace(m, F.lit(":"), F.lit(""))), after.rlike(r"^(?:[./:-]?[0-9]|\x20?(?:[%€$£]|kg|km|mm|cm|MB|GB|ms)\b)"), before.rlike(r"[0-9A-Za-z][./:_-]?$"),
        m.rlike(r"(?i)[.\x20\])}](?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|eu|ch|at|nl|us|ca|au|in|jp|br)$"),
    )
    return F.array(*(c.cast("double") for c in made))


def candidates(text: Column, kind: str) -> Column:
    """What the wide generator of a kind proposes, as an array of (s, e, m, f), f the features."""
    spans = F.transform(found(text, WIDE[kind]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), _features(text, x).alias("f")))
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast("array<struct<s:int,e:int,m:string,f:array<double>>>"))


# --- training -----------------------------------------------------------------------------------


def _luhn_number(rng: random.Random, n: int, good: bool) -> str:
    head = [rng.choice((3, 4, 5, 6)), *(rng.randrange(10) for _ in range(n - 2))]
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(reversed(head)))
    check = -total % 10
    return "".join(map(str, [*head, check if good else (check + rng.randrange(1, 10)) % 10]))


def _example(rng: random.Random, kind: str, positive: bool) -> tuple[str, str, str]:
    """(text before, span, text after) of a generated example."""
    pick = rng.choice
    num = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    word = lambda n=7: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(rng.randrange(3, n)))
    yes = {"email": ("mail me:", "contact", "write to", "reach", "e-mail", word()), "ip": ("host", "from", "login from", "ip", "address", word()), "card": ("card", "visa", "pay by credit", "+1 (212) 555-0147", word()), "phone": ("call", "tel.", "phone:", "mobile", "fax", word())}[kind]
    no = ("version", "order", "invoice", "isbn", "serial", "part", "section", "build", "see table", "total", "release", "no.", word(), word())
    yes = (*yes, *(word() for _ in yes), "")  # half of them stand without a word that tells
    after = pick((f" {word()}", ".", ",", "", f" {num(8)}"))
    if kind == "email":
        dot = pick((".", " dot ", " (dot) ", "[dot]"))
        if positive:
            return pick(yes), pick((word(), f"{word()}.{word()}", word() + num(2))) + pick((" at ", " (at) ", "[at]", " [at] ", " @ ", " {at} ")) + word() + dot + pick(("com", "org", "net", "de", "co", "fr", "edu", "es")), after
        return pick(("look", "meet", "was", "they are", "stay", word())), word() + pick((" at ", " at ", " at ", " @ ")) + word() + pick((".", ".", ".", " dot ")) + word(), after
    if kind == "ip":
        part = lambda: rng.randrange(0, 256)
        if positive:
            four = [str(part()) for _ in range(4)]
            return pick((*yes, f"{pick(yes)} {num(3)}.")), pick((".".join(four), pick(("[.]", "(.)", " dot ")).join(four), "[.]".join(four), ":".join(f"{rng.randrange(65536):x}" for _ in range(8)))), after
        one = lambda: rng.choice((rng.randrange(0, 20), rng.randrange(256, 999)))
        return pick(no), pick((".".join(str(one()) for _ in range(4)), ".".join(str(rng.randrange(0, 12)) for _ in range(4)), ".".join(num(3) for _ in range(4)), ":".join(num(2) for _ in range(8)))), pick((after, f".{num(1)}", f".{num(2)}.{num(1)}"))
    if kind == "card":
        d = _luhn_number(rng, pick((13, 15, 16, 16, 16, 19)) if positive else rng.randrange(12, 20), positive)
        if not positive and rng.random() < 0.3:
            d = num(rng.randrange(12, 20))
        sep = pick(("", "", " ", "-"))
        return pick(yes if positive else no), sep.join(d[i : i + 4] for i in range(0, len(d), 4)), after
    if positive:
        area, a, b = num(3), num(3), num(4)
        return pick(yes), pick((f"({area}) {a}-{b}", f"+1 ({area}) {a}-{b}", f"+1 {area}-{a}-{b}", f"+{num(2)} {num(3)} {num(4)} {num(4)}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"{area} {a} {b}")), after
    return pick(no), pick((f"20{num(2)}-{num(4)}-{num(3)}", f"{num(4)} {num(4)} {num(4)}", f"19{num(2)}.{num(3)}.{num(3)}", f"{num(2)}-{num(4)}-{num(4)}", f"{num(4)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(3)}-{num(3)}")), pick((after, f".{num(3)}", "%", f"-{num(1)}"))


def example_lines(kind: str, examples: int, seed: int = 11) -> list[tuple[int, str]]:
    rng, out = random.Random(seed + KINDS.index(kind)), []
    for i in range(examples):
        before, span, after = _example(rng, kind, i % 2 == 0)
        out.append((int(i % 2 == 0), before + ("" if before.endswith(".") and before[-2:-1].isdigit() else " ") + span + after))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 16, rate: float = 0.4) -> list[tuple]:
    """Trees of two levels, by Newton steps on the logistic loss: (feature, cut, left, right), left and right being (feature, cut, value, value)."""
    z, trees = np.zeros(len(y)), []
    cuts = [np.unique(x[:, j]) for j in range(x.shape[1])]
    cuts = [(c[1:] + c[:-1]) / 2 if len(c) > 1 else c[:0] for c in cuts]
    cuts = [c[np.linspace(0, len(c) - 1, 24).astype(int)] if len(c) > 24 else c for c in cuts]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)

        def split(at: np.ndarray, g=g, h=h) -> tuple[int, float, float, float]:
            best, found_ = -1.0, (0, -np.inf, 0.0, 0.0)
            total, weight = g[at].sum(), h[at].sum()
            for j, c in enumerate(cuts):
                for cut in c:
                    low = at & (x[:, j] < cut)
                    a, b = g[low].sum(), h[low].sum()
                    gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1)
                    if gain > best + 1e-12:
                        best, found_ = gain, (j, float(cut), float(rate * a / (b + 1)), float(rate * (total - a) / (weight - b + 1)))
            return found_

        j, cut, *_ = split(np.ones(len(y), bool))
        low = x[:, j] < cut
        left, right = split(low), split(~low)
        trees.append((j, cut, left, right))
        z += np.where(low, np.where(x[:, left[0]] < left[1], left[2], left[3]), np.where(x[:, right[0]] < right[1], right[2], right[3]))
    return trees


def margins(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    z = np.zeros(len(x))
    for j, cut, a, b in trees:
        z += np.where(x[:, j] < cut, np.where(x[:, a[0]] < a[1], a[2], a[3]), np.where(x[:, b[0]] < b[1], b[2], b[3]))
    return z


def threshold(z: np.ndarray, y: np.ndarray, precision: float, share: float) -> float:
    """The lowest margin from which on the precision holds when `share` of all candidates are positive; infinite if there is none."""
    yes, no = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    for cut in np.unique(z):
        right, wrong = share * (z[y == 1] >= cut).sum() / yes, (1 - share) * (z[y == 0] >= cut).sum() / no
        if right and right >= precision * (right + wrong):
            return float(cut) - 1e-9
    return float("inf")


_trained: dict[tuple, dict] = {}


def train(spark: SparkSession, examples: int = 2400, precision: float = 0.95, share: float = 0.2) -> dict[str, tuple[list[tuple], float]]:
    """Trees and threshold of each kind, from `examples` generated lines a kind; every third pair of lines is kept for the threshold. The same for the same parameters, so they are kept."""
    if (examples, precision, share) in _trained:
        return _trained[examples, precision, share]
    out = {}
    for kind in KINDS:
        lines = example_lines(kind, examples)
        made = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit("\n".join(t for _, t in lines)), "\n")).alias("i", "t"))
        own = F.concat(*(base_spans(F.col("t"), k) for k in KINDS))  # what overlaps a base span is never judged
        free = F.filter(candidates(F.col("t"), kind), lambda x: ~F.exists("b", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        rows = made.select("*", own.alias("b")).select("i", F.explode(free).alias("c")).select("i", "c.f").collect()
        x = np.array([r["f"] for r in rows]).reshape(-1, len(FEATURES))
        y, held = np.array([lines[r["i"]][0] for r in rows]), np.array([r["i"] // 2 % 3 == 0 for r in rows], bool)
        trees = boost(x[~held], y[~held])
        out[kind] = (trees, threshold(margins(trees, x[held]), y[held], precision, share))
    _trained[examples, precision, share] = out
    return out


def _score(trees: list[tuple], f: Column) -> Column:
    leaf = lambda s: F.when(F.get(f, F.lit(s[0])) < s[1], F.lit(s[2])).otherwise(F.lit(s[3])) if np.isfinite(s[1]) else F.lit(s[3])
    total = F.lit(0.0)
    for j, cut, a, b in trees:
        total = total + F.when(F.get(f, F.lit(j)) < cut, leaf(a)).otherwise(leaf(b))
    return total


def _joined(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def selected(spans: Column, kind: str) -> Column:
    """Of spans (s, k, e, z) in order: of those that overlap the last one kept, the better takes its place."""
    last = lambda a: F.element_at(a, -1)
    return F.when(F.size(spans) < 2, spans).otherwise(
        F.aggregate(
            spans,
            F.array().cast(kind),
            lambda a, x: F.when((F.size(a) == 0) | (F.try_element_at(a, F.lit(-1))["e"] <= x["s"]), F.concat(a, F.array(x)))
            .when(last(a)["z"] < x["z"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x)))
            .otherwise(a),
        )
    )


def find_pii(docs: DataFrame, model: dict[str, tuple[list[tuple], float]] | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (base spans), base and spans: arrays of (s, k, e), sorted; and base_list and span_list, the same as text. Columns of these names in docs are replaced."""
    model = model or train(docs.sparkSession)
    own = {"n_email", "n_ip", "n_card", "n_phone", "base", "spans", "base_list", "span_list"}
    docs = docs.select(*(c for c in docs.columns if c not in own))
    text = F.col("_text")
    named = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    named = named.select("*", *(base_spans(text, k).alias(f"_{k}") for k in KINDS), *(candidates(text, k).alias(f"_w{k}") for k in KINDS))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    named = named.select("*", F.array_sort(F.concat(*(plain(F.col(f"_{k}")) for k in KINDS))).alias("base"))
    more = []
    for i, k in enumerate(KINDS):
        trees, cut = model[k]
        if not np.isfinite(cut):
            continue
        scored = F.transform(F.col(f"_w{k}"), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"), (_score(trees, x["f"]) - cut).alias("z")))  # noqa: B023
        more.append(F.filter(scored, lambda x: (x["z"] >= 0) & ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))))
    kind = "array<struct<s:int,k:int,e:int,z:double>>"
    named = named.select("*", (F.array_sort(F.concat(*more)) if more else F.array().cast(kind)).alias("_more"))
    named = named.select("*", F.array_sort(F.concat("base", plain(selected(F.col("_more"), kind)))).alias("spans"))
    return named.select(
        *docs.columns, *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), "base", "spans", _joined(F.col("base")).alias("base_list"), _joined(F.col("spans")).alias("span_list")
    )


def redact(found_: DataFrame) -> DataFrame:
    """What find_pii gives, with each span of the text (overlapping ones together) replaced by its kind in angle brackets."""
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<s:int,k:int,e:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["s"] < F.element_at(a, -1)["e"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.element_at(a, -1)["k"].alias("k"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    name = lambda x: F.element_at(F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS)), x["k"] + 1)
    with_ = found_.withColumn("_m", F.when(F.size("spans") > 0, merged))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_m", i - 1)["e"])
    parts = F.transform("_m", lambda x, i: F.concat(F.substr("text", start(i) + 1, x["s"] - start(i)), name(x)))
    rest = F.substr("text", F.element_at("_m", -1)["e"] + 1)
    return with_.withColumn("text", F.when(F.col("_m").isNotNull(), F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("text"))).drop("_m")
