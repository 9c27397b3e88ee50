"""Robots files: groups of agents and rules, which rule decides a path, what a file says to each agent, and what to add to it.

A file is a row (file, value), small by protocol, and its groups are an array that a fold over its lines makes. A group ends where a line
names an agent after a rule; comments go; other lines than agents, rules and content signals are not looked at. An agent's own groups,
all together, decide for it, else those of `*`. Null and empty files have no groups.

Paths are matched with many files' rules by an equi-join: the text of a rule before its first `*` or its final `$` must
be a prefix of the path, so a path is looked up under its prefixes of the lengths that its file's rules have, and only what meets
is compared as a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# fixed values: agents by what they do, and comment lines around a block that a delivery network adds
TRAINING = ("GPTBot", "ClaudeBot", "Google-Extended")
SEARCH = ("OAI-SearchBot", "Claude-SearchBot", "PerplexityBot", "Googlebot", "Bingbot")
FETCHING = ("ChatGPT-User", "Claude-User", "Perplexity-User")
NAVER, DAUM = ("Yeti",), ("Daumoa", "DAUM")
AGENTS = TRAINING + SEARCH + FETCHING + NAVER + DAUM
MANAGED_BEGIN, MANAGED_END = "BEGIN Cloudflare Managed content", "END Cloudflare Managed Content"

RULES = "array<struct<pattern:string,allow:boolean>>"
GROUP = f"struct<agents:array<string>,rules:{RULES},signals:array<string>>"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def groups(value: Column) -> Column:
    """The groups of a file's text, in order: agents as written, rules (pattern, allow) and content signals."""
    plain = F.regexp_replace(F.coalesce(value, F.lit("")), "^﻿", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?s)\r+$|#.*$", "")))
    part = lambda x, k: F.regexp_extract(x, r"(?i)^(user-agent|allow|disallow|content-signal):\s*(.*?)\s*$", k)
    said = F.filter(F.transform(lines, lambda x: F.struct(F.lower(part(x, 1)).alias("name"), part(x, 2).alias("value"))), lambda s: s["name"] != "")
    new = lambda agents: F.struct(agents.cast("array<string>").alias("agents"), _empty(RULES).alias("rules"), _empty("array<string>").alias("signals"))
    start = F.struct(new(F.array()).alias("open"), _empty(f"array<{GROUP}>").alias("done"))

    def step(s, x):
        g = s["open"]
        agent, signal = x["name"] == "user-agent", x["name"] == "content-signal"
        ends = agent & (F.size(g["rules"]) > 0)
        rule = F.struct(x["value"].alias("pattern"), (x["name"] == "allow").alias("allow"))
        grown = F.struct(
            F.when(agent, F.array_append(g["agents"], x["value"])).otherwise(g["agents"]).alias("agents"),
            F.when(~agent & ~signal, F.array_append(g["rules"], rule)).otherwise(g["rules"]).alias("rules"),
            F.when(signal, F.array_append(g["signals"], x["value"])).otherwise(g["signals"]).alias("signals"),
        )
        return F.struct(F.when(ends, new(F.array(x["value"]))).otherwise(grown).alias("open"), F.when(ends, F.array_append(s["done"], g)).otherwise(s["done"]).alias("done"))

    out = F.aggregate(said, start, step, lambda s: F.array_append(s["done"], s["open"]))
    return F.filter(out, lambda g: (F.size(g["agents"]) > 0) | (F.size(g["rules"]) > 0) | (F.size(g["signals"]) > 0))


def of_agent(found: Column, agent: Column) -> Column:
    """Groups that name an agent by its token, without regard to case and version."""
    return F.filter(found, lambda g: F.exists(g["agents"], lambda a: text.agent_token(a) == agent))


def applying(found: Column, agent: Column) -> Column:
    """(scope, rules): what applies to an agent's token: its own groups (explicit), those of all agents (star), or nothing (none)."""
    own, star = of_agent(found, agent), of_agent(found, F.lit("*"))
    rules = lambda gs: F.flatten(F.transform(gs, lambda g: g["rules"]))
    scope = F.when(F.size(own) > 0, "explicit").when(F.size(star) > 0, "star").otherwise("none")
    return F.struct(scope.alias("scope"), F.when(F.size(own) > 0, rules(own)).otherwise(rules(star)).alias("rules"))


def _body(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"\$$", "")


def expression(pattern: Column) -> Column:
    """A rule's pattern as a regular expression: `*` is anything, a final `$` the end."""
    plain = F.regexp_replace(_body(pattern), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(plain, r"\*+", ".*"), F.when(F.endswith(pattern, F.lit("$")), r"\z").otherwise(""))


def weight(pattern: Column) -> Column:
    """How specific a rule is: the characters that it names."""
    return F.length(F.regexp_replace(_body(pattern), r"\*", ""))


def lets(rules: Column, path: str) -> Column:
    """Whether rules allow one path: the most specific that matches, of equals the one that allows; no match allows. Empty patterns match nothing."""
    hits = F.filter(rules, lambda r: (r["pattern"] != "") & F.regexp_like(F.lit(path), expression(r["pattern"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(weight(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def policy(found: Column, agent: Column) -> Column:
    """explicit- or star-, with allow, block or partial; or none. The root blocked without any allow is block; any rule about more than the root, or an allow beside a blocked root, is partial."""
    a = applying(found, agent)
    rules = F.filter(a["rules"], lambda r: r["pattern"] != "")
    open_, allows, deeper = lets(a["rules"], "/"), F.exists(rules, lambda r: r["allow"]), F.exists(rules, lambda r: r["pattern"] != "/")
    kind = F.when(~open_, F.when(allows, "partial").otherwise("block")).otherwise(F.when(deeper, "partial").otherwise("allow"))
    return F.when(a["scope"] == "none", "none").otherwise(F.concat(a["scope"], F.lit("-"), kind))


def state(status: Column, error: Column, body: Column) -> Column:
    """How a robots file was answered: ok, absent (4xx, or markup in its place) or unreachable (nothing, throttled, 5xx, a redirect that led nowhere, an error other than a cut body)."""
    markup = F.startswith(F.ltrim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", "")), F.lit("<"))
    broken = F.coalesce(error, F.lit("body_truncated")) != "body_truncated"
    return (
        F.when(status.isNull() | (status == 429) | (status >= 500), "unreachable")
        .when((status >= 200) & (status < 300), F.when(broken, "unreachable").when(markup, "absent").otherwise("ok"))
        .when((status >= 400) & (status < 500), "absent")
        .otherwise("unreachable")
    )


def parsed(files: DataFrame) -> DataFrame:
    """files with found: their groups. A column of its own, before anything is exploded."""
    return files.withColumn("found", groups(F.col("value")))


def policies(files: DataFrame, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """(file, agent, policy) of files (file, value, state): unknown where the file was not reached, none where there is none."""
    rows = parsed(files).withColumn("agent", F.explode(F.array(*map(F.lit, agents))))
    said = F.when(F.col("state") == "unreachable", "unknown").when(F.col("state") == "absent", "none").otherwise(policy(F.col("found"), text.agent_token(F.col("agent"))))
    return rows.select("file", "agent", said.alias("policy"))


def unknown(said: DataFrame) -> DataFrame:
    """(file, unknown): whether what a file says to any agent is not known, so that nothing may be inferred from it."""
    return said.groupBy("file").agg(F.bool_or(F.col("policy") == "unknown").alias("unknown"))


def access(files: DataFrame, paths: DataFrame) -> DataFrame:
    """paths (file, path, agent, ...) with allowed. Paths of files that are not there are allowed; a null or empty path is the root; a null agent is one that no group names."""
    key = "_row"
    asked = paths.withColumn(key, F.struct("file", "path", "agent")).select(key).distinct()
    path = F.when(F.coalesce(F.col(f"{key}.path"), F.lit("")) == "", "/").otherwise(F.col(f"{key}.path"))
    asked = asked.select(key, F.col(f"{key}.file").alias("file"), path.alias("path"), text.agent_token(F.coalesce(F.col(f"{key}.agent"), F.lit(""))).alias("token"))
    each = parsed(files).select("file", F.explode("found").alias("g")).select("file", F.explode(F.transform("g.agents", text.agent_token)).alias("token"), "g.rules")
    named = each.groupBy("file").agg(F.collect_set("token").alias("tokens"))
    rules = each.select("file", "token", F.explode("rules").alias("r")).where("r.pattern <> ''")
    rules = rules.select("file", "token", F.regexp_extract(_body(F.col("r.pattern")), r"(?s)^[^*]*", 0).alias("prefix"), expression(F.col("r.pattern")).alias("like"), F.struct(weight(F.col("r.pattern")).alias("n"), F.col("r.allow").alias("allow")).alias("rule"))
    lengths = rules.groupBy("file", "token").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    own = F.when(F.array_contains("tokens", F.col("token")), F.col("token")).otherwise("*")
    asked = asked.join(named, "file", "left").withColumn("token", F.coalesce(own, F.lit("*"))).drop("tokens").join(lengths, ["file", "token"], "left")
    cut = asked.withColumn("length", F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("prefix", F.left("path", F.col("length")))
    met = cut.join(rules, ["file", "token", "prefix"], "left")
    best = met.groupBy(key).agg(F.max(F.when(F.regexp_like("path", F.col("like")), F.col("rule"))).alias("best"))
    best = best.select(F.col(f"{key}.file").alias("_f"), F.col(f"{key}.path").alias("_p"), F.col(f"{key}.agent").alias("_a"), F.coalesce("best.allow", F.lit(True)).alias("allowed"))
    same = paths["file"].eqNullSafe(best["_f"]) & paths["path"].eqNullSafe(best["_p"]) & paths["agent"].eqNullSafe(best["_a"])
    return paths.join(best, same, "left").drop("_f", "_p", "_a")


def nonstandard(files: DataFrame) -> DataFrame:
    """(file, value, token) of agents that are more than a token, as versions and whole browser names, each once for a file."""
    values = parsed(files).select("file", F.explode(F.flatten(F.transform("found", lambda g: g["agents"]))).alias("value")).where(F.regexp_like("value", F.lit(r"[/\s]"))).distinct()
    return values.select("file", "value", F.regexp_extract(F.trim("value"), r"^[^/\s]*", 0).alias("token"))


def content_signals(files: DataFrame) -> DataFrame:
    """(file, place, agents, signals) of groups with content signals: a preference, never a rule. Of a name that comes twice the last value counts."""
    found = parsed(files).select("file", F.posexplode("found").alias("place", "g")).where(F.size("g.signals") > 0)
    pairs = F.filter(F.split(F.array_join("g.signals", ","), ","), lambda x: F.contains(x, F.lit("=")))
    part = lambda x, pattern: F.lower(F.trim(F.regexp_replace(x, pattern, "")))
    entries = F.filter(F.transform(pairs, lambda x: F.struct(part(x, r"(?s)=.*$").alias("key"), part(x, r"(?s)^[^=]*=").alias("value"))), lambda e: e["key"] != "")
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return found.select("file", "place", "g.agents", last.alias("signals"))


def managed(files: DataFrame) -> DataFrame:
    """(file, blocked, closed) of files with a block that a delivery network adds: agents whose root it blocks, in order, and whether its end is marked."""
    mark = lambda name: rf"^[ \t]*#[ \t]*{name}\b[^\n]*$"
    span = F.regexp_extract("value", rf"(?ism)({mark(MANAGED_BEGIN)})(.*?)({mark(MANAGED_END)}|\z)", 2)
    closed = F.regexp_extract("value", rf"(?ism)({mark(MANAGED_BEGIN)})(.*?)({mark(MANAGED_END)}|\z)", 3) != ""
    rows = files.where(F.regexp_like("value", F.lit(f"(?im){mark(MANAGED_BEGIN)}"))).select("file", groups(span).alias("found"), closed.alias("closed"))
    shut = F.filter("found", lambda g: (F.size(g["rules"]) > 0) & ~lets(g["rules"], "/"))
    names = F.transform(F.flatten(F.transform(shut, lambda g: g["agents"])), lambda a: F.regexp_extract(F.trim(a), r"^[^/\s]*", 0))
    return rows.select("file", F.array_distinct(F.filter(names, lambda a: ~a.isin("", "*"))).alias("blocked"), "closed")


def policy_findings(said: DataFrame) -> DataFrame:
    """(file, code, lane, severity, agents) of what files say to agents, from (file, agent, policy). Files of which anything is unknown have none."""
    place = F.array_position(F.array(*map(F.lit, AGENTS)), F.col("agent"))
    by = said.groupBy("file").agg(F.bool_or(F.col("policy") == "unknown").alias("unknown"), F.array_sort(F.collect_list(F.struct(place.alias("place"), "agent", "policy"))).alias("all"))

    def those(names: tuple[str, ...], end: str) -> Column:
        return F.transform(F.filter("all", lambda x: x["agent"].isin(*names) & F.endswith(x["policy"], F.lit(end))), lambda x: x["agent"])

    daum_blocked = those(DAUM, "block")
    rules = [
        ("AI_CRAWLER_BLOCKED", "GEO", "critical", those(SEARCH + FETCHING, "block")),
        ("AI_CRAWLER_PARTIAL", "GEO", "warn", those(SEARCH + FETCHING, "partial")),
        ("AI_TRAINING_BLOCKED", "GEO", "info", those(TRAINING, "block")),
        ("AI_CRAWLER_UNDECLARED", "GEO", "info", those(TRAINING + SEARCH + FETCHING, "none")),
        ("NAVER_CRAWLER_BLOCKED", "NEO", "critical", those(NAVER, "block")),
        ("DAUM_CRAWLER_BLOCKED", "KEO", "critical", daum_blocked),
        ("DAUM_CRAWLER_UNDECLARED", "KEO", "info", F.when(F.size(daum_blocked) == 0, those(DAUM, "none")).otherwise(_empty("array<string>"))),
    ]
    each = [F.when(F.size(agents) > 0, F.struct(F.lit(code).alias("code"), F.lit(lane).alias("lane"), F.lit(severity).alias("severity"), agents.alias("agents"))) for code, lane, severity, agents in rules]
    return by.where("not unknown").select("file", F.array_compact(F.array(*each)).alias("x")).select("file", F.explode("x").alias("x")).select("file", "x.*")


def plan(files: DataFrame, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """(file, agent, policy, add): rules to add for an agent so that nothing changes but what is said; null where its lines stay as they are.

    Blocks are kept, explicit groups stay, nothing is added where the file is unknown; a partial rule of all agents is copied as it is
    written; an agent that may come in is named with an allow of the root.
    """
    star = F.flatten(F.transform(of_agent(groups(F.col("value")), F.lit("*")), lambda g: g["rules"]))
    lines = F.transform(star, lambda r: F.concat(F.when(r["allow"], "Allow: ").otherwise("Disallow: "), r["pattern"]))
    said = policies(files, agents).join(files.select("file", lines.alias("lines")), "file")
    root = F.array(F.lit("Allow: /"))
    add = F.when(F.col("policy") == "star-partial", F.when(F.size("lines") > 0, F.col("lines")).otherwise(root)).when(F.col("policy").isin("star-allow", "none"), root)
    return said.select("file", "agent", "policy", add.alias("add"))


def mismatches(package: DataFrame, live: DataFrame, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """(file, agent, package, live) where the served file says something else to an agent than the one to be deployed."""
    both = policies(package, agents).withColumnRenamed("policy", "package").join(policies(live, agents).withColumnRenamed("policy", "live"), ["file", "agent"])
    return both.where("package <> live")
