"""URL and host functions as column expressions. RFC 3986 groups are split by pattern, so odd URLs keep their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# fixed values: file endings that are assets, not pages
ASSETS = ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "ico", "bmp", "css", "js", "mjs", "map", "json", "xml", "txt", "pdf", "zip", "mp4", "webm", "mp3", "wav", "woff", "woff2", "ttf", "otf", "eot", "rss", "atom", "csv", "doc", "docx", "xls", "xlsx", "ppt", "pptx")


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def bare(h: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(h, r"^www\.", ""), r"\.$", "")


def normalize(url: Column) -> Column:
    """Lower-case scheme and authority, / for an empty path, no fragment."""
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    query = F.when(F.regexp_like(url, F.lit(r"^[^#]*\?")), F.concat(F.lit("?"), part(url, 4))).otherwise("")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), host(url), path, query)


def domain(value: Column) -> Column:
    """The bare host of a URL or of a domain without a scheme."""
    full = F.when(F.regexp_like(value, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), value).otherwise(F.concat(F.lit("https://"), value))
    return bare(F.regexp_replace(host(full), r":\d+$", ""))


def owned(value: Column, site: Column) -> Column:
    """Whether a domain is the site's or a true subdomain of it."""
    return (value == site) | F.endswith(value, F.concat(F.lit("."), site))


def link_key(url: Column) -> Column:
    """Authority, path without trailing slash, and query: one key for a page whatever the scheme."""
    query = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise("")
    return F.concat(host(url), F.regexp_replace(part(url, 3), "/+$", ""), query)


def is_page(url: Column) -> Column:
    return ~F.regexp_like(F.lower(part(url, 3)), F.lit(r"\.(" + "|".join(ASSETS) + ")$"))


def section(url: Column) -> Column:
    """The first segment of the path, or an empty string."""
    return F.regexp_extract(part(url, 3), "^/*([^/]*)", 1)


def slug(url: Column) -> Column:
    """A folder name that is unique for each normalised URL."""
    name = F.regexp_replace(F.lower(part(url, 3)), "[^a-z0-9]+", "-")
    return F.concat_ws("-", F.coalesce(F.nullif(F.regexp_replace(name, "^-+|-+$", ""), F.lit("")), F.lit("home")), F.left(F.sha2(normalize(url), 256), F.lit(12)))


def absolute(base: Column, href: Column) -> Column:
    """A reference resolved against the URL of its page (RFC 3986 5.2), without its fragment. Dot segments are taken out by a fold over the path."""
    ref = F.trim(href)
    own = lambda k: part(ref, k)
    has_authority, has_query = F.regexp_like(ref, F.lit(r"^([^:/?#]+:)?//")), F.regexp_like(ref, F.lit(r"^[^#]*\?"))
    scheme = F.when(F.regexp_like(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), own(1)).otherwise("")
    plain = F.when(scheme == "", F.when(own(1) != "", F.concat(own(1), F.lit(":"), own(3))).otherwise(own(3))).otherwise(own(3))
    folder = F.regexp_extract(part(base, 3), r"^(.*/)?[^/]*$", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.when((scheme != "") | has_authority | F.startswith(plain, F.lit("/")), plain).when(plain == "", part(base, 3)).otherwise(F.concat(folder, plain))
    segments = F.split(path, "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, x)))
    last = F.element_at(segments, -1)
    path = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    query = F.when(has_query, F.concat(F.lit("?"), own(4))).when((plain == "") & ~has_authority & (scheme == "") & (part(base, 4) != ""), F.concat(F.lit("?"), part(base, 4))).otherwise("")
    origin = F.concat(F.when(scheme != "", scheme).otherwise(part(base, 1)), F.lit("://"), F.when(has_authority, own(2)).otherwise(part(base, 2)))
    # mailto:, tel: and the like have no authority and are no pages
    return F.when((scheme != "") & ~has_authority, F.concat(scheme, F.lit(":"), own(3))).otherwise(F.concat(origin, path, query))


def entered(raw: Column) -> Column:
    """A URL as a person enters it: without surrounding brackets, quotes and punctuation, of a host with a dot and a top level of two letters or more; else null."""
    x = F.regexp_replace(F.trim(raw), r"^[<(\[\"']+|[>)\]\"'.,]+$", "")
    ok = F.regexp_like(x, F.lit(r"^(?i)https?://([^/?#@]*@)?([A-Za-z0-9-]+\.)+[A-Za-z]{2,}(:\d+)?([/?#]|$)"))
    query = F.when(F.regexp_like(x, F.lit(r"^[^#]*\?")), F.concat(F.lit("?"), part(x, 4))).otherwise("")
    return F.when(ok, F.concat(F.lower(part(x, 1)), F.lit("://"), host(x), part(x, 3), query))


def other_host(h: Column) -> Column:
    """The same site with or without www; null for addresses and localhost."""
    address = F.regexp_like(h, F.lit(r"^[\d.]+(:\d+)?$|^\[|^localhost(:\d+)?$"))
    return F.when(~address, F.when(F.startswith(h, F.lit("www.")), F.substring(h, 5, 1000)).otherwise(F.concat(F.lit("www."), h)))


def host_key(url: Column) -> Column:
    """Host with its port, unless that is the scheme's own."""
    return F.when(F.lower(part(url, 1)) == "https", F.regexp_replace(host(url), ":443$", "")).otherwise(F.regexp_replace(host(url), ":80$", ""))


def in_property(url: Column, value: Column, kind: Column) -> Column:
    """Whether a page belongs to a search property: a domain with its subdomains, or a URL's origin and path prefix."""
    h = F.regexp_replace(host(url), r":\d+$", "")
    by_prefix = (F.lower(part(url, 1)) == F.lower(part(value, 1))) & (host_key(url) == host_key(value)) & F.startswith(F.when(part(url, 3) == "", "/").otherwise(part(url, 3)), F.when(part(value, 3) == "", "/").otherwise(part(value, 3)))
    return F.when(kind == "domain", owned(h, F.lower(value))).otherwise(by_prefix)


def identifier(value: Column) -> Column:
    """A URL used as a name: normalised, but with its fragment."""
    fragment = F.when(F.regexp_like(value, F.lit("#")), F.concat(F.lit("#"), part(value, 5))).otherwise("")
    return F.when(part(value, 2) != "", F.concat(normalize(value), fragment)).otherwise(value)


def same_page(a: Column, b: Column) -> Column:
    """Whether two URLs are one page: normalised, with or without a slash at the path's end."""
    return F.regexp_replace(normalize(a), r"/+(?=\?|$)", "").eqNullSafe(F.regexp_replace(normalize(b), r"/+(?=\?|$)", ""))


def role(url: Column, site: Column, competitors: Column, hints: list[tuple[str, str]]) -> Column:
    """owned, declared_competitor (the very host), the kind of the first hint whose suffix the domain has, or unknown."""
    d = domain(url)
    out = F.when(owned(d, site), "owned").when(F.array_contains(competitors, d), "declared_competitor")
    for suffix, kind in hints:
        out = out.when((d == suffix) | F.endswith(d, F.lit("." + suffix)), kind)
    return out.otherwise("unknown")
