"""Queries over robots files made of what pages link to, and the SQL they must agree with, which reads the files' lines by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robots
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}
#: Agents whose access to a page's links is asked for.
ASKED = ("Googlebot", "GPTBot", "Bingbot", "Yeti/2.0", "*")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, value, older, links, status, error, body) of each page as a site: rules made of its links, and an answer made of its URL; see FILES_SQL."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    p = p.withColumns({"links": F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1)), "n": F.octet_length("html")})
    link = lambda k: F.coalesce(F.try_element_at("links", F.lit(k)), F.lit(f"/{k}"))
    lines = [
        F.concat(F.lit("# robots of "), "url"),
        F.lit("User-agent: *"),
        F.concat(F.lit("Disallow: "), F.left(link(1), F.lit(3)), F.lit("*")),
        F.concat(F.lit("Allow: "), link(1), F.lit("$\r")),
        F.concat(F.lit("Disallow: /*"), F.right(link(2), F.lit(2))),
        F.lit("Content-Signal: search=yes, ai-train=no"),
        F.lit("User-agent: GPTBot/1.1"),
        F.lit("  user-agent: YETI # the other"),
        F.lit("Content-signal: use=no, Use = maybe"),
        F.concat(F.lit("Disallow: "), link(2)),
        F.lit("Disallow:"),
        F.concat(F.lit("Allow: "), F.left(link(3), F.lit(4)), F.lit("  # open")),
        F.when(F.col("n") % 3 == 0, "User-agent: Bingbot\nUser-agent: Daumoa\nDISALLOW: /"),
        F.when(F.col("n") % 5 < 2, F.concat(F.lit("# BEGIN Cloudflare Managed content\nUser-agent: ClaudeBot\nUser-agent: Yeti\nDisallow: /\n"), F.when(F.col("n") % 5 == 1, "# END Cloudflare Managed Content\n").otherwise(""))),
        F.when(F.col("n") % 7 == 0, F.concat(F.lit("User-agent: gptbot\nAllow: /*\nDisallow: /*"), F.right(link(3), F.lit(1)), F.lit("$"))),
    ]
    number = F.regexp_extract("url", "://[^/]*/[^?#]*?([0-9]+)", 1)
    return p.select(
        F.col("page_id").alias("file"),
        F.concat_ws("\n", *lines).alias("value"),
        F.concat_ws("\n", *lines[:4], F.concat(F.lit("Disallow: "), link(4))).alias("older"),
        "links",
        F.when(number != "", number.cast("int")).alias("status"),
        F.when(F.contains("url", F.lit("#")), "body_truncated").when(F.contains("url", F.lit("?")), "timeout").alias("error"),
        F.when(F.contains("url", F.lit(".html")), F.concat(F.lit("\n "), "html")).otherwise(F.concat_ws("\n", *lines)).alias("body"),
    )


_LINK = "coalesce(l[{0}], '/{0}')".format
_LINES = [
    "'# robots of ' || url", "'User-agent: *'", f"'Disallow: ' || left({_LINK(1)}, 3) || '*'", f"'Allow: ' || {_LINK(1)} || '$' || chr(13)", f"'Disallow: /*' || right({_LINK(2)}, 2)",
    "'Content-Signal: search=yes, ai-train=no'", "'User-agent: GPTBot/1.1'", "'  user-agent: YETI # the other'", "'Content-signal: use=no, Use = maybe'", f"'Disallow: ' || {_LINK(2)}", "'Disallow:'",
    f"'Allow: ' || left({_LINK(3)}, 4) || '  # open'", "CASE WHEN n % 3 = 0 THEN concat_ws(chr(10), 'User-agent: Bingbot', 'User-agent: Daumoa', 'DISALLOW: /') END",
    "CASE WHEN n % 5 < 2 THEN concat_ws(chr(10), '# BEGIN Cloudflare Managed content', 'User-agent: ClaudeBot', 'User-agent: Yeti', 'Disallow: /', CASE WHEN n % 5 = 1 THEN '# END Cloudflare Managed Content' || chr(10) ELSE '' END) END",
    f"CASE WHEN n % 7 = 0 THEN concat_ws(chr(10), 'User-agent: gptbot', 'Allow: /*', 'Disallow: /*' || right({_LINK(3)}, 1) || '$') END",
]
FILES_SQL = rf"""
    f AS (SELECT page_id AS file, url, html, l AS links, concat_ws(chr(10), {", ".join(_LINES)}) AS value, concat_ws(chr(10), {", ".join(_LINES[:4])}, 'Disallow: ' || {_LINK(4)}) AS older,
        CAST(nullif(regexp_extract(url, '://[^/]*/[^?#]*?([0-9]+)', 1), '') AS INTEGER) AS status FROM (SELECT *, strlen(html) AS n, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS l FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages))),
    named AS (SELECT file, 'now' AS kind, value AS v FROM f UNION ALL SELECT file, 'older', older FROM f),
    ln AS (SELECT file, kind, generate_subscripts(x, 1) AS n, trim(regexp_replace(replace(unnest(x), chr(13), ''), '#.*$', '')) AS line FROM (SELECT file, kind, string_split(v, chr(10)) AS x FROM named)),
    kv AS (SELECT file, kind, n, lower(regexp_extract(line, '(?i)^(user-agent|allow|disallow|content-signal):', 1)) AS name, trim(regexp_replace(line, '^[^:]*:', '')) AS val FROM ln),
    pr AS (SELECT *, last_value(CASE WHEN name <> 'content-signal' THEN name END IGNORE NULLS) OVER (PARTITION BY file, kind ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM kv WHERE name <> ''),
    g AS (SELECT *, sum(CASE WHEN name = 'user-agent' AND before IN ('allow', 'disallow') THEN 1 ELSE 0 END) OVER (PARTITION BY file, kind ORDER BY n) AS grp FROM pr),
    ag AS (SELECT DISTINCT file, kind, grp, lower(regexp_extract(val, '^[^/\s]+')) AS token FROM g WHERE name = 'user-agent'),
    ru AS (SELECT file, kind, grp, n, val AS pattern, name = 'allow' AS allow, length(replace(regexp_replace(val, '\$$', ''), '*', '')) AS w,
        '(?s)^' || replace(regexp_replace(regexp_replace(val, '\$$', ''), '([\\.\[\]{{}}()+?^$|])', '\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(val, '$') THEN '\z' ELSE '' END AS re FROM g WHERE name IN ('allow', 'disallow')),
    wanted AS (SELECT unnest({list(robots.AGENTS)}) AS agent),
    used AS (SELECT k.file, k.kind, w.agent, lower(w.agent) AS token, CASE WHEN EXISTS (SELECT 1 FROM ag WHERE ag.file = k.file AND ag.kind = k.kind AND ag.token = lower(w.agent)) THEN 'explicit'
        WHEN EXISTS (SELECT 1 FROM ag WHERE ag.file = k.file AND ag.kind = k.kind AND ag.token = '*') THEN 'star' ELSE 'none' END AS scope FROM named k, wanted w),
    sums AS (SELECT u.file, u.kind, u.agent, u.scope, coalesce(arg_max(allow, w * 2 + allow::INT) FILTER (pattern <> '' AND regexp_matches('/', re)), true) AS root, coalesce(bool_or(allow AND pattern <> ''), false) AS allows, coalesce(bool_or(pattern NOT IN ('', '/')), false) AS deeper
        FROM used u LEFT JOIN ag ON ag.file = u.file AND ag.kind = u.kind AND ag.token = CASE u.scope WHEN 'explicit' THEN u.token ELSE '*' END LEFT JOIN ru ON ru.file = ag.file AND ru.kind = ag.kind AND ru.grp = ag.grp GROUP BY ALL),
    pol AS (SELECT file, kind, agent, CASE WHEN scope = 'none' THEN 'none' ELSE scope || '-' || CASE WHEN NOT root THEN CASE WHEN allows THEN 'partial' ELSE 'block' END WHEN deeper THEN 'partial' ELSE 'allow' END END AS policy FROM sums),
    st AS (SELECT file, CASE WHEN status BETWEEN 200 AND 299 THEN CASE WHEN url LIKE '%?%' AND url NOT LIKE '%#%' THEN 'unreachable' WHEN url LIKE '%.html%' AND regexp_matches(html, '^\s*<') THEN 'absent' ELSE 'ok' END
        WHEN status BETWEEN 400 AND 499 AND status <> 429 THEN 'absent' ELSE 'unreachable' END AS state FROM f)
"""
F_SQL = f"WITH {FILES_SQL}"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, with how they were answered."""
    f = robots_files(spark, sf_dir)
    return f.withColumn("state", robots.state(F.col("status"), F.col("error"), F.col("body")))


@query(f"{F_SQL} SELECT file, state FROM st")
def s10_robots_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file", "state")


@query(f"""{F_SQL}, ask AS (SELECT file, unnest(list_distinct(links || ['/', '/robots.txt?x=1'])) AS path FROM f), pa AS (SELECT file, path, unnest({list(ASKED)}) AS agent FROM ask),
    own AS (SELECT pa.*, CASE WHEN EXISTS (SELECT 1 FROM ag WHERE ag.file = pa.file AND kind = 'now' AND token = lower(regexp_extract(agent, '^[^/\\s]+'))) THEN lower(regexp_extract(agent, '^[^/\\s]+')) ELSE '*' END AS token FROM pa)
    SELECT own.file, path, agent, coalesce(arg_max(allow, w * 2 + allow::INT) FILTER (pattern <> '' AND regexp_matches(path, re)), true) AS allowed
    FROM own LEFT JOIN ag ON ag.file = own.file AND ag.kind = 'now' AND ag.token = own.token LEFT JOIN ru ON ru.file = ag.file AND ru.kind = 'now' AND ru.grp = ag.grp GROUP BY own.file, path, agent""")
def j15_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which links of its own pages a site's robots file opens to whom."""
    f = robots_files(spark, sf_dir)
    paths = f.select("file", F.explode(F.array_distinct(F.concat("links", F.array(F.lit("/"), F.lit("/robots.txt?x=1"))))).alias("path"))
    return robots.access(f, paths.withColumn("agent", F.explode(F.array(*map(F.lit, ASKED)))))


@query(f"{F_SQL} SELECT file, agent, CASE state WHEN 'unreachable' THEN 'unknown' WHEN 'absent' THEN 'none' ELSE policy END AS policy FROM pol JOIN st USING (file) WHERE kind = 'now'")
def j39_agent_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.policies(_files(spark, sf_dir))


@query(f"{F_SQL} SELECT n.file, n.agent, o.policy AS package, n.policy AS live FROM pol n JOIN pol o ON n.file = o.file AND n.agent = o.agent AND n.kind = 'now' AND o.kind = 'older' WHERE n.policy <> o.policy")
def j39_package_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = robots_files(spark, sf_dir).withColumn("state", F.lit("ok"))
    return robots.mismatches(live.withColumn("value", F.col("older")), live)


@query(f"""{F_SQL}, p AS (SELECT file, agent, CASE state WHEN 'unreachable' THEN 'unknown' WHEN 'absent' THEN 'none' ELSE policy END AS policy FROM pol JOIN st USING (file) WHERE kind = 'now'),
    star AS (SELECT ru.file, list(CASE WHEN allow THEN 'Allow: ' ELSE 'Disallow: ' END || pattern ORDER BY n) AS lines FROM ru JOIN ag ON ag.file = ru.file AND ag.kind = 'now' AND ag.grp = ru.grp AND token = '*' WHERE ru.kind = 'now' GROUP BY ru.file)
    SELECT p.file, agent, policy, array_to_string(CASE WHEN policy = 'star-partial' THEN lines WHEN policy IN ('star-allow', 'none') THEN ['Allow: /'] END, chr(10)) AS add FROM p LEFT JOIN star USING (file)""")
def z01_robots_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.plan(_files(spark, sf_dir)).withColumn("add", F.when(F.col("add").isNotNull(), F.array_join("add", "\n")))


@query(f"{F_SQL} SELECT file, state = 'unreachable' AS unknown FROM st")
def z05_robots_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.unknown(robots.policies(_files(spark, sf_dir)))


@query(f"{F_SQL} SELECT DISTINCT file, val AS value, regexp_extract(val, '^[^/\\s]*') AS token FROM g WHERE kind = 'now' AND name = 'user-agent' AND regexp_matches(val, '[/\\s]')")
def t15_nonstandard_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.nonstandard(robots_files(spark, sf_dir))


@query(f"""{F_SQL}, s AS (SELECT file, grp, list(val ORDER BY n) AS said FROM g WHERE kind = 'now' AND name = 'content-signal' GROUP BY ALL), a AS (SELECT file, grp, list(val ORDER BY n) AS agents FROM g WHERE kind = 'now' AND name = 'user-agent' GROUP BY ALL)
    SELECT file, grp::INTEGER AS place, array_to_string(agents, ',') AS agents, CASE WHEN list_contains(said, 'use=no, Use = maybe') THEN 'use=maybe' ELSE 'ai-train=no,search=yes' END AS signals FROM s JOIN a USING (file, grp)""")
def t15_content_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = robots.content_signals(robots_files(spark, sf_dir))
    pairs = F.array_sort(F.transform(F.map_entries("signals"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return s.select("file", "place", F.array_join("agents", ",").alias("agents"), F.array_join(pairs, ",").alias("signals"))


@query(f"{F_SQL} SELECT file, 'ClaudeBot,Yeti' || CASE WHEN NOT closed AND n % 7 = 0 AND gone THEN ',gptbot' ELSE '' END AS blocked, closed FROM (SELECT file, strlen(html) AS n, strlen(html) % 5 = 1 AS closed, false AS gone FROM f WHERE strlen(html) % 5 < 2)")
def t15_managed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.managed(robots_files(spark, sf_dir)).select("file", F.array_join("blocked", ",").alias("blocked"), "closed")


def _those(names: tuple[str, ...], end: str) -> str:
    return f"list(agent ORDER BY list_position({list(robots.AGENTS)}, agent)) FILTER (agent IN {names if len(names) > 1 else (names[0], names[0])} AND ends_with(policy, '{end}'))"


@query(f"""{F_SQL}, p AS (SELECT file, agent, CASE state WHEN 'absent' THEN 'none' ELSE policy END AS policy FROM pol JOIN st USING (file) WHERE kind = 'now' AND state <> 'unreachable'),
    w AS (SELECT file, {_those(robots.SEARCH + robots.FETCHING, "block")} AS b, {_those(robots.SEARCH + robots.FETCHING, "partial")} AS pa, {_those(robots.TRAINING, "block")} AS t, {_those(robots.AGENTS[:11], "none")} AS u, {_those(robots.NAVER, "block")} AS n, {_those(robots.DAUM, "block")} AS d, {_those(robots.DAUM, "none")} AS e FROM p GROUP BY file)
    SELECT file, code, lane, severity, array_to_string(agents, ',') AS agents FROM (SELECT file, 'AI_CRAWLER_BLOCKED' AS code, 'GEO' AS lane, 'critical' AS severity, b AS agents FROM w UNION ALL SELECT file, 'AI_CRAWLER_PARTIAL', 'GEO', 'warn', pa FROM w UNION ALL SELECT file, 'AI_TRAINING_BLOCKED', 'GEO', 'info', t FROM w
    UNION ALL SELECT file, 'AI_CRAWLER_UNDECLARED', 'GEO', 'info', u FROM w UNION ALL SELECT file, 'NAVER_CRAWLER_BLOCKED', 'NEO', 'critical', n FROM w UNION ALL SELECT file, 'DAUM_CRAWLER_BLOCKED', 'KEO', 'critical', d FROM w UNION ALL SELECT file, 'DAUM_CRAWLER_UNDECLARED', 'KEO', 'info', e FROM w WHERE d IS NULL) WHERE agents IS NOT NULL""")
def c15_crawler_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.policy_findings(robots.policies(_files(spark, sf_dir))).withColumn("agents", F.array_join("agents", ","))
