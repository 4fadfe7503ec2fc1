"""Rules about who may be read: robots texts, challenges, refusals, rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Markers of errors that are a supplier's decision, by robots text and by a challenge.
BLOCKED, CHALLENGED = "robots-blocked:", "challenge-blocked:"
#: Statuses that a challenge is served with, and phrases that only its pages have.
CHALLENGE_STATUSES = (403, 503)
CHALLENGE_PHRASES = (
    "just a moment", "cf-browser-verification", "challenge-platform", "_cf_chl_opt", "cf_chl_", "checking your browser", "checking if the site connection is secure",
    "enable javascript and cookies to continue", "verifying you are human", "please verify you are a human", "incapsula incident id", "_incapsula_resource",
    "sucuri website firewall", "datadome", "perimeterx", "px-captcha",
)
#: Names of lines in a robots text; days that a challenged host isn't asked again, and a rejected one.
DIRECTIVES = ("user-agent", "allow", "disallow", "sitemap", "crawl-delay", "host")
RECHECK_DAYS, LAPSE_DAYS = 7, 90


def _any_in(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def challenge_reason(status: Column, headers: Column, body: Column) -> Column:
    """Why a response is a challenge, or '': its headers say so, or a refusal's first 4000 characters have a phrase of such pages. headers: a map of strings."""
    named = F.map_from_entries(F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    value = lambda name: F.coalesce(F.trim(F.try_element_at(named, F.lit(name))), F.lit(""))
    start = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 4000))
    return (
        F.when(F.lower(value("cf-mitigated")) == "challenge", "bot-protection challenge (cf-mitigated: challenge)")
        .when(status.isin(*CHALLENGE_STATUSES) & _any_in(start, CHALLENGE_PHRASES), F.concat(F.lit("bot-protection challenge (interstitial, server: "), F.coalesce(F.nullif(value("server"), F.lit("")), F.lit("unknown")), F.lit(")")))
        .otherwise("")
    )


def decline(error: Column) -> Column:
    """Who said no in an error text: blocked, which goes before challenged, or '' for what is no decision of the supplier."""
    said = F.coalesce(error, F.lit(""))
    return F.when(F.contains(said, F.lit(BLOCKED)), "blocked").when(F.contains(said, F.lit(CHALLENGED)), "challenged").otherwise("")


def marked(kind: Column, detail: Column) -> Column:
    """An error text of a decision (blocked or challenged) with its marker."""
    return F.concat_ws(" ", F.when(kind == "blocked", BLOCKED).when(kind == "challenged", CHALLENGED), detail)


def unclassified_refusals(suppliers: DataFrame) -> DataFrame:
    """Suppliers whose error names a refusal that nobody has told apart from a decision."""
    return suppliers.where((decline(F.col("last_error")) == "") & F.col("last_error").rlike("|".join(map(str, CHALLENGE_STATUSES))))


def backing_off(suppliers: DataFrame, now: Column, days: int = RECHECK_DAYS) -> DataFrame:
    """(host, days): challenged suppliers that answered so less than `days` ago, in whole days; stamps that can't be read, or lie ahead, don't count."""
    ago = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(F.col("last_crawled").cast("string")))) / 86400)
    return suppliers.where(decline(F.col("last_error")) == "challenged").select(F.lower("host").alias("host"), ago.cast("long").alias("days")).where(F.col("days").between(0, days - 1))


# --- robots texts ------------------------------------------------------------------------------


def robots_verdict(status: Column, headers: Column, body: Column) -> Column:
    """What a response to the request for a robots text is: rules, none (nothing published) or unreachable."""
    bare = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", "")
    head = F.lower(F.substring(bare, 1, 200))
    page = head.startswith("<!doctype") | head.startswith("<html") | head.startswith("<?xml") | F.contains(head, F.lit("<head>"))
    rules = (bare == "") | (~bare.startswith("{") & ~bare.startswith("[") & bare.rlike(r"(?im)^\s*(?:" + "|".join(DIRECTIVES) + r")\s*:"))
    return (
        F.when(status.between(200, 299), F.when(~page & rules, "rules").otherwise("none"))
        .when(challenge_reason(status, headers, body) != "", "unreachable")
        .when(status.between(400, 499), "none")
        .otherwise("unreachable")
    )


def robots_rules(texts: DataFrame) -> DataFrame:
    """(host, agent, allow, pattern) of robots texts (host, body): consecutive agent lines share the rules that follow. An agent without rules has one row without a pattern."""
    lines = texts.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("at", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    name = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1))))
    parts = lines.where(F.col("line").contains(":")).select("host", "at", F.when(name == "useragent", "user-agent").otherwise(name).alias("name"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    parts = parts.where("name in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    order = Window.partitionBy("host").orderBy("at")
    opens = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    grouped = parts.withColumn("grp", F.sum(opens.cast("int")).over(order))
    agents = grouped.where("name = 'user-agent' and value <> ''").select("host", "grp", F.lower("value").alias("agent"))
    rules = grouped.where("name in ('allow', 'disallow') and value <> ''").select("host", "grp", (F.col("name") == "allow").alias("allow"), F.col("value").alias("pattern"))
    return agents.join(rules, ["host", "grp"], "left").select("host", "agent", "allow", "pattern")


def pattern_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is any run, $ at the end is the end."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    escaped = F.replace(F.regexp_replace(body, r"([.+?^{}()|\[\]\\$])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), escaped, F.when(ends, "$").otherwise(""))


def robots_allowed(rules: DataFrame, paths: DataFrame, agent: str) -> DataFrame:
    """paths (host, path) with allowed.

    The group with the longest name that is part of ours, or that ours begins with, speaks to us, else
    that of all agents. The longest matching pattern decides, an allowing one among equals; without a
    match all is allowed. Rules are few for each host; paths of a host that has very many are spread
    by path as soon as they have met them.
    """
    mine = rules.where((F.col("agent") == "*") | F.contains(F.lit(agent.lower()), F.col("agent")))
    best = F.max(F.struct((F.col("agent") != "*").alias("own"), F.length("agent").alias("n"), "agent")).alias("g")
    chosen = mine.groupBy("host").agg(best).select("host", F.col("g.agent").alias("agent"))
    patterns = mine.join(chosen, ["host", "agent"], "left_semi").where("pattern is not null").groupBy("host").agg(F.collect_set(F.struct("pattern", "allow")).alias("_rules"))
    asked = paths.select("host", "path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path")).alias("_path")).distinct()
    met = asked.join(patterns, "host").select("host", "path", "_path", F.explode("_rules").alias("r")).select("host", "path", "_path", "r.*").where(F.regexp_like("_path", pattern_regex(F.col("pattern"))))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow")).alias("b"))
    return paths.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("b.allow", F.lit(True)).alias("allowed"))


def with_overrides(verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """verdicts (host, path, verdict: allowed, blocked or unreachable) where a curated override (host, prefix) turns blocked paths of the host or those under it into allowed; what is unreachable stays so."""
    rows = verdicts.withColumn("_id", F.xxhash64("host", "path")).select("*", F.explode(host_suffixes(F.lower("host"))).alias("_suffix"))
    met = rows.where("verdict = 'blocked'").join(overrides.select(F.lower("host").alias("_suffix"), "prefix"), "_suffix").where(F.col("path").startswith(F.col("prefix")))
    freed = met.select("host", "path", F.lit(True).alias("_freed")).distinct()
    return verdicts.join(freed, ["host", "path"], "left").select("host", "path", F.when(F.col("_freed"), "allowed").otherwise(F.col("verdict")).alias("verdict"))


# --- denials and rejections --------------------------------------------------------------------


def host_suffixes(host: Column) -> Column:
    """A host and the domains that it lies under."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def denied(suppliers: DataFrame, denylist: DataFrame) -> DataFrame:
    """(id, host, reason) of suppliers that are denied (domain, reason) or lie under a denied domain; the nearest domain gives the reason."""
    under = suppliers.select("id", "host", F.posexplode(host_suffixes(F.lower("host"))).alias("_at", "domain"))
    met = under.join(denylist.select(F.lower("domain").alias("domain"), "reason"), "domain")
    return met.groupBy("id", "host").agg(F.min_by("reason", "_at").alias("reason"))


def active_rejections(rejections: DataFrame, today: Column, days: int = LAPSE_DAYS) -> DataFrame:
    """Rejections (host, at) that haven't lapsed."""
    return rejections.where(F.datediff(today, F.try_to_date("at")) < days)


def reach(entries: DataFrame, today: Column, days: int = LAPSE_DAYS) -> DataFrame:
    """(host, reach) of registry entries (host, rejected, rejected_at): crawl, or paused where a rejection holds or has a date that can't be read. Hosts that aren't there can't be reached."""
    at = F.try_to_date("rejected_at")
    held = F.coalesce("rejected", F.lit(False)) & (at.isNull() | (F.datediff(today, at) < days))
    rows = entries.where(F.coalesce("host", F.lit("")) != "")
    return rows.groupBy(F.lower("host").alias("host")).agg(F.when(F.max(held.cast("int")) == 1, "paused").otherwise("crawl").alias("reach"))


#: Filters that select some of the suppliers behind a result.
NARROWING = ("supplier", "location", "near", "in_stock", "min_length", "min_width", "min_sqft")


def narrows(filters: dict) -> bool:
    """Whether filters leave out suppliers of a result, so that what holds for all of them can't be said of it."""
    return any(bool(filters.get(k)) for k in NARROWING)


def narrowing(filters: Column) -> Column:
    """The same of a map of filters as text; 0, false and nothing choose nothing."""
    said = lambda k: ~F.lower(F.trim(F.coalesce(F.try_element_at(filters, F.lit(k)), F.lit("")))).isin("", "0", "0.0", "false")
    return F.exists(F.array(*(said(k) for k in NARROWING)), lambda x: x)
