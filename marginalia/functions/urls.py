"""URL identity, domains, and tracking links: Column expressions for ASCII URLs, an Arrow UDF for all others."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_PORTS = {"http": 80, "https": 443}
_BAD = re.compile(r"[\x00-\x20\x7f\\]")
_LABEL = re.compile(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?")


def clean_host(host: str) -> str | None:
    """Lower-case ASCII host or normalized IP address; None if it is not a valid one."""
    try:
        return str(ipaddress.ip_address(host.strip("[]")))
    except ValueError:
        pass
    try:
        name = host.encode("idna").decode() if not host.isascii() else host
    except UnicodeError:
        return None
    name = name.lower().removesuffix(".")
    return name if 0 < len(name) <= 253 and all(map(_LABEL.fullmatch, name.split("."))) else None


def identity(url: str | None) -> tuple[str, str] | None:
    """(canonical URL, host): no fragment, default port or empty path; None for a URL that may not be fetched."""
    if not url or _BAD.search(url):
        return None
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError:
        return None
    if parts.scheme.lower() not in _PORTS or not parts.hostname or parts.username is not None or parts.password is not None:
        return None
    host = clean_host(parts.hostname)
    if host is None:
        return None
    shown = f"[{host}]" if ":" in host else host
    scheme = parts.scheme.lower()
    place = shown if port in (None, _PORTS[scheme]) else f"{shown}:{port}"
    return urlunsplit((scheme, place, parts.path or "/", parts.query, "")), host


def normalize_domains(domains: str) -> list[str]:
    """Distinct valid domains of a comma-separated list, in order; ValueError names the first bad one."""
    out: dict[str, None] = {}
    for part in filter(None, map(str.strip, domains.split(","))):
        host = clean_host(part)
        if host is None:
            raise ValueError(f"not a domain: {part}")
        out[host] = None
    return list(out)


def safe_link(base: str, href: str) -> str | None:
    """href joined to base and quoted, if it leads to a plain HTTP(S) place."""
    try:
        url = urljoin(base, href.strip())
        parts = urlsplit(url)
        parts.port  # raises for a bad one
    except ValueError:
        return None
    if parts.scheme not in _PORTS or not parts.hostname or parts.username is not None or re.search(r"[\x00-\x1f\x7f]", url):
        return None
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]")


@F.pandas_udf(StructType([StructField("canonical_url", StringType()), StructField("host", StringType())]))
def identity_udf(urls: pd.Series) -> pd.DataFrame:
    """identity() of each URL; null fields where it has none."""
    return pd.DataFrame([identity(u) or (None, None) for u in urls], columns=["canonical_url", "host"])


def host_of(url: Column) -> Column:
    """Lower-case host of a plain ASCII HTTP(S) URL, else null."""
    host = F.lower(F.regexp_extract(url, r"^(?i:https?)://([A-Za-z0-9.-]+)(?::[0-9]{1,5})?(?:[/?#]|$)", 1))
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def canonical_ascii(url: Column) -> Column:
    """Canonical form of a plain ASCII HTTP(S) URL: no fragment, default port or empty path."""
    bare = F.regexp_replace(url, "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z]+)://", 1))
    port = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?:]+:([0-9]+)", 1)
    rest = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*(.*)$", 1)
    path = F.when(rest == "", F.lit("/")).when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    return F.when(host_of(url).isNotNull(), F.concat(scheme, F.lit("://"), host_of(url), shown, path))


def in_domains(host: Column, domains: list[str]) -> Column:
    """Whether host is one of the domains or below one; an IP address only matches itself."""
    tests = [host == d if re.fullmatch(r"[0-9.]+|.*:.*", d) else (host == d) | F.endswith(host, F.lit("." + d)) for d in domains]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def unwrap_ddg(url: Column) -> Column:
    """Target of a result link that carries it in the uddg parameter."""
    full = F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)
    target = F.try_url_decode(F.regexp_extract(full, r"[?&]uddg=([^&#]*)", 1))
    return F.when(F.coalesce(target, F.lit("")) != "", target).otherwise(full)


def unwrap_bing(url: Column) -> Column:
    """Target of a /ck/a link that carries it as a1 and URL-safe base64 in the u parameter."""
    packed = F.regexp_extract(url, r"/ck/a\?(?:[^#]*&)?u=a1([A-Za-z0-9_-]+)", 1)
    target = F.unbase64(F.translate(packed, "-_", "+/")).cast("string")
    return F.when((packed != "") & target.rlike("^https?://"), target).otherwise(url)


def with_hints(query: str, include: list[str], exclude: list[str]) -> str:
    """The query with site: hints for an engine; the filters are applied again to what it returns."""
    near = " OR ".join(f"site:{d}" for d in include)
    return " ".join(filter(None, [f"({near})" if len(include) > 1 else near, *(f"-site:{d}" for d in exclude), query]))


def over_fetch(limit: int, filtering: bool) -> int:
    """How many candidates to ask for so that enough survive the filters."""
    return min(50, max(10, 3 * limit)) if filtering else limit
