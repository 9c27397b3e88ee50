"""Pages as evidence: what a reader could see, what is kept from view, and whether an answer page names a site."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup, urls
from ..functions.instructions import instruction_families

#: The flag of a page whose hidden text speaks to a machine.
FLAG = "hidden_ai_instructions"


def extracted(pages: DataFrame, closed: bool = False) -> DataFrame:
    """pages (page_id, url, html) with title, h1, headings, text, table, faq, sources; hidden_count and hidden_chars of text that is kept from view, its
    families of instructions, and review_flags. Whole texts; html goes. closed: only references that end in a semicolon are decoded."""
    read = markup.read(pages, partial(markup.research, closed=closed), markup.RESEARCH)
    return read.withColumns({
        "hidden_count": F.size("hidden"),
        "hidden_chars": F.aggregate("hidden", F.lit(0), lambda n, x: n + F.length(x)),
        "hidden_families": F.when(F.size("hidden") > 0, instruction_families(F.array_join("hidden", " "))).otherwise(F.array().cast("array<string>")),
    }).withColumn("review_flags", F.when(F.size("hidden_families") > 0, F.array(F.lit(FLAG))).otherwise(F.array().cast("array<string>")))


def names_site(text: Column, site: str) -> Column:
    """Whether text names a site's host or one below it: hosts in addresses of others do not count, nor do parts of longer names."""
    labels = [x for x in re.sub(r"^www\.|\.$", "", site.lower()).split(".") if x]
    if not labels:
        return F.lit(False)
    address = r"(?i)https?://[^\s<>'\"]+"
    of_others = F.filter(F.regexp_extract_all(text, F.lit(address), F.lit(0)), lambda u: ~F.coalesce(urls.owned(urls.host(u), F.lit(".".join(labels))), F.lit(False)))
    # text without addresses, and then the addresses that are the site's own
    own = F.filter(F.regexp_extract_all(text, F.lit(address), F.lit(0)), lambda u: ~F.array_contains(of_others, u))
    rest = F.concat_ws(" ", F.regexp_replace(text, address, " "), F.array_join(own, " "))
    host = r"(?i)(?<![a-z0-9-])(?:[a-z0-9-]+\.)*" + r"\.".join(re.escape(x) for x in labels) + r"(?![a-z0-9.-])"
    return F.coalesce(F.regexp_like(rest, F.lit(host)), F.lit(False))


def seen(pages: DataFrame, site: str, closed: bool = False) -> DataFrame:
    """pages without html, with text (outside of code, titles and forms) and seen: whether that text names the site."""
    return markup.read(pages, partial(markup.answer, closed=closed), markup.ANSWER).withColumn("seen", names_site(F.col("text"), site))
