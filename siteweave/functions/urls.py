"""URL algebra: cleaning, classification and resolution of links."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
#: Characters that stay as they are in a path, and in a query.
PATH, QUERY = "!$%&'()*+,-./:;=@[\\]^_|~", "!$%&()*+,-./:;=?@[\\]^_`{|}~"


def serialize(url: str) -> str:
    """An absolute URL as browsers write it. Raises ValueError if it has no valid host where its scheme needs one."""
    parts = urlsplit(url.strip())
    if not parts.scheme:
        raise ValueError("relative URL without a base")
    if parts.scheme not in PORTS:
        return url.strip()
    host = parts.hostname
    if not host or any(c in host for c in " <>^|"):
        raise ValueError("empty or invalid host")
    if not host.isascii():
        host = host.encode("idna").decode()
    if ":" in host:
        host = f"[{host}]"
    port = "" if parts.port in (None, PORTS[parts.scheme]) else f":{parts.port}"
    user = parts.netloc.rpartition("@")[0]
    out: list[str] = []
    segments = parts.path.replace("\\", "/").split("/")
    for i, s in enumerate(segments):
        if s.lower() in ("..", "%2e%2e", ".%2e", "%2e."):
            if len(out) > 1:
                out.pop()
            if i + 1 == len(segments):
                out.append("")
        elif s.lower() in (".", "%2e"):
            if i + 1 == len(segments):
                out.append("")
        else:
            out.append(s)
    path = quote("/".join(out) or "/", safe=PATH)
    return urlunsplit((parts.scheme, (user + "@" if user else "") + host + port, path, quote(parts.query, safe=QUERY), quote(parts.fragment, safe=QUERY + "#")))


def resolve_one(link: str | None, base: str | None) -> str | None:
    """A link's absolute URL, or None if it can't be one.

    Links that start with ``http`` are absolute. A link that can't be joined leads to the base itself.
    """
    if link is None or base is None:
        return None
    try:
        if link.startswith("http"):
            return serialize(link)
        root = serialize(base)
    except (ValueError, UnicodeError):
        return None
    try:
        return serialize(urljoin(root, link.strip()))
    except (ValueError, UnicodeError):
        return root


@F.pandas_udf(T.StringType())
def resolve(link: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve_one(a, b) for a, b in zip(link, base, strict=True)], dtype=object)


#: Links from the root, and bases, whose URL is put together from them as they are.
_PLAIN_LINK = r"^(?!.*//)(?!.*/\.)/[A-Za-z0-9/_.~-]*\z"
_PLAIN_BASE = r"^(https?://(?:[a-z0-9-]+\.)+[a-z]{2,})(?:[/?#].*)?\z"


def resolved(link: Column, base: Column) -> Column:
    """Like ``resolve``; plain links are put together in the JVM, and Python gets the others only."""
    plain = F.coalesce(link.rlike(_PLAIN_LINK) & base.rlike(_PLAIN_BASE), F.lit(False))
    return F.when(plain, F.concat(F.regexp_extract(base, _PLAIN_BASE, 1), link)).otherwise(resolve(F.when(~plain, link), base))


@F.pandas_udf(T.StringType())
def absolute(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in urls:
        yield batch.map(lambda u: resolve_one(u, u), na_action="ignore")


def clean_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))


def link_type(href: Column, base: Column) -> Column:
    """By host alone: scheme and port do not matter."""
    return (
        F.when(host(href).eqNullSafe(host(base)) & host(href).isNotNull(), "Internal")
        .when(href.startswith("mailto:"), "Mailto")
        .when(href.startswith("tel:"), "Tel")
        .otherwise("External")
    )


def with_scheme(text: Column) -> Column:
    """What a user types as an address: https unless it names a scheme."""
    return F.when(text.rlike("^https?://"), text).otherwise(F.concat(F.lit("https://"), text))


def root(url: Column) -> Column:
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("/"))
