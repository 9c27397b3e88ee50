"""Functions that Spark has no expression for, on Arrow batches: Unicode folding, addresses, and keys of international hosts."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL = re.compile(r"(?!-)[a-z0-9-]{1,63}(?<!-)$")
LOCAL = ("localhost", ".localhost", ".local", ".internal")


def _class(value: str | None) -> str | None:
    try:
        a = ipaddress.ip_address((value or "").strip("[]"))
    except ValueError:
        return None
    a = getattr(a, "ipv4_mapped", None) or a
    for name in ("unspecified", "loopback", "link_local", "multicast"):
        if getattr(a, f"is_{name}"):
            return name
    return "public" if a.is_global else "reserved" if a.is_reserved else "private"


def _ascii(host: str) -> str | None:
    try:
        return host.encode("idna").decode().lower() if host else ""
    except UnicodeError:
        return None


def _public(url: str | None) -> bool:
    if not url or re.search(r"[\\\x00-\x20\x7f#]", url):
        return False
    try:
        parts = urlsplit(url)
        host, _ = parts.hostname or "", parts.port
    except ValueError:
        return False
    if parts.scheme.lower() not in ("http", "https") or "@" in parts.netloc:
        return False
    kind = _class(host)
    if kind:
        return kind == "public"
    name = _ascii(host.rstrip("."))
    if not name or name == "localhost" or name.endswith(LOCAL[1:]) or re.fullmatch(r"[\d.]+", name):
        return False
    labels = name.split(".")
    return len(labels) >= 2 and all(LABEL.match(x) for x in labels)


def _key(url: str | None) -> str | None:
    try:
        parts = urlsplit(url or "")
        host, port = _ascii(parts.hostname or ""), parts.port
    except ValueError:
        return None
    if not host:
        return None
    own = {"http": 80, "https": 443}.get(parts.scheme.lower())
    return urlunsplit((parts.scheme.lower(), host if port in (None, own) else f"{host}:{port}", parts.path or "/", parts.query, ""))


@F.pandas_udf(T.StringType())
def folded(x: pd.Series) -> pd.Series:
    """Text in compatibility form, without case, white space squeezed."""
    return x.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


@F.pandas_udf(T.StringType())
def caseless(x: pd.Series) -> pd.Series:
    """Text without case, as it is otherwise."""
    return x.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(T.StringType())
def lowered(x: pd.Series) -> pd.Series:
    """Text in small letters, one character for one whatever stands beside it, as SQL does it: ß and ss stay apart."""
    return x.map(lambda v: None if v is None else v.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower())


@F.pandas_udf(T.StringType())
def uppered(x: pd.Series) -> pd.Series:
    """Text in capitals, one character for one; a letter that has no capital of one character stays."""
    return x.map(lambda v: None if v is None else "".join(u if len(u := c.upper()) == 1 else c for c in v))


@F.pandas_udf(T.StringType())
def address_class(x: pd.Series) -> pd.Series:
    """public, private, loopback, link_local, multicast, reserved or unspecified; null for what is no address. An IPv4 address in IPv6 form counts as itself."""
    return x.map(_class)


@F.pandas_udf(T.BooleanType())
def public_url(x: pd.Series) -> pd.Series:
    """Whether a URL can be one of the open web: http or https, no user, fragment, backslash or control, and a public address or a name of two labels or more."""
    return x.map(_public)


@F.pandas_udf(T.StringType())
def discovery_key(x: pd.Series) -> pd.Series:
    """A URL with its host in ASCII, without the scheme's own port and fragment; null where there is no host."""
    return x.map(_key)
