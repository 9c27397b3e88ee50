"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: lengths that are neither short nor long, by kind and script
LENGTHS = {"title": {"ko": (25, 30), "en": (50, 60)}, "description": {"ko": (70, 80), "en": (150, 160)}}


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def multi(x: Column) -> Column:
    """Values separated by white space, commas, semicolons or bars, in order, each once."""
    return F.array_distinct(F.filter(F.split(F.trim(x), r"[\s,;|]+"), lambda v: v != ""))


# fixed values: what a form's yes and no look like
YES = ("y", "yes", "true", "1", "o", "예", "네", "인용", "있음")
NO = ("n", "no", "false", "0", "x", "아니오", "아니요", "없음")


def yes_no(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin(*YES), True).when(v.isin(*NO), False)


def fingerprint(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", kind, F.trim(text)), 256)


def script(x: Column) -> Column:
    hangul = F.regexp_count(x, F.lit("[가-힣]"))
    return F.when(hangul >= F.greatest(F.lit(1.0), F.length(x) * 0.15), "ko").otherwise("en")


def length_verdict(x: Column, kind: str) -> Column:
    n, out = F.length(x), None
    for lang, (low, high) in LENGTHS[kind].items():
        v = F.when(n < low, "short").when(n > high, "long").otherwise("ok")
        out = F.when(script(x) == lang, v) if out is None else out.when(script(x) == lang, v)
    return out


def brand_hit(x: Column, names: list[str]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | F.contains(F.lower(x), F.lit(name.lower()))
    return out


def directives(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.lower(x), ","), lambda v: F.trim(v)), lambda v: v != "")))


def agent_token(x: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(x), r"^[^/\s]+", 0))


def clip(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n - 1)), F.lit("…"))).otherwise(x)


def sample_cell(hits: Column, known: Column) -> Column:
    """Hits over known, or a dash where nothing is known: a rate of nothing is not zero."""
    return F.when(known > 0, F.format_string("%d/%d", hits, known)).otherwise("-")


def set_fingerprint(rows: DataFrame, by: list[str], kind: str = "kind", text: str = "text") -> DataFrame:
    """A digest of each group's questions that does not depend on their order."""
    own = fingerprint(F.col(kind), F.col(text))
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(own))), 256).alias("set_fingerprint"), F.count("*").alias("n_questions"))


def page_directives(meta: Column, header: Column, agent: str, own_meta: Column | None = None) -> Column:
    """Robots directives of a page for an agent: of the meta elements for all and for the agent, and of header lines; none means noindex and nofollow too.

    A header has lines of segments between commas; `agent: directive` opens a scope, for names of agents alone and to the end of its line. Directives end at commas,
    semicolons and white space.
    """
    named = r"(?is)^\s*(googlebot-news|[\w-]+(?:bot|user))\s*:\s*(.*)$"
    start = F.struct(F.lit("").alias("scope"), F.array().cast("array<string>").alias("found"))

    def step(s, x):
        scope = F.lower(F.regexp_extract(x, named, 1))
        scope = F.when(scope != "", scope).otherwise(s["scope"])
        said = F.when(F.regexp_like(x, F.lit(named)), F.regexp_extract(x, named, 2)).otherwise(x)
        mine = (scope == "") | (scope == agent.lower())
        return F.struct(scope.alias("scope"), F.when(mine, F.array_append(s["found"], said)).otherwise(s["found"]).alias("found"))

    lines = F.split(F.coalesce(header, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]")
    parts = F.flatten(F.transform(lines, lambda line: F.aggregate(F.split(line, ","), start, step)["found"]))
    metas = F.array(F.coalesce(meta, F.lit("")), F.coalesce(own_meta if own_meta is not None else F.lit(None).cast("string"), F.lit("")))
    said = F.transform(F.concat(metas, parts), lambda x: F.filter(F.split(F.regexp_replace(F.lower(x), r"\s*:\s*", ":"), r"[,;\s]+"), lambda t: t != ""))
    tokens = F.flatten(said)
    none = F.when(F.array_contains(tokens, "none"), F.array(F.lit("noindex"), F.lit("nofollow"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(tokens, none)))


def placeholder(x: Column) -> Column:
    """Whether a draft still holds a mark for text to come."""
    return F.regexp_like(x, F.lit(r"(?i)<<\s*todo|\[(?:todo|tbd|insert)[^\]]*\]|\{\{[^}]*\}\}|\blorem ipsum\b"))


def unchecked_tasks(x: Column) -> Column:
    return F.regexp_count(x, F.lit(r"(?m)^\s*[-*]\s+\[ \]"))


def gate(html: Column, least_bytes: int) -> Column:
    """Whether an answer page can be judged: big enough, and no request to prove that one is human."""
    return F.when(F.coalesce(F.octet_length(html), F.lit(0)) < least_bytes, "too_small").when(F.regexp_like(html, F.lit(r"(?i)captcha|unusual traffic")), "challenge").otherwise("ok")
