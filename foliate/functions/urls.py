"""URLs, addresses and what may be fetched, as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from foliate.functions import names

#: The host of page links, and address ranges that are never public.
PAGE_HOST = "notion.so"
PRIVATE_V4 = ["0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3"]
_WEB = r"(?i)^(https?)://([^/?#]+)([^?#]*)"


def stable(url: Column, source: Column) -> Column:
    """Origin and path of a hosted web URL; external and other ones stay."""
    scheme, host, path = F.lower(F.regexp_extract(url, _WEB, 1)), F.lower(F.regexp_extract(url, _WEB, 2)), F.regexp_extract(url, _WEB, 3)
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), F.when(scheme == "https", ":443$").otherwise(":80$"), "")
    return F.when((source != "external") & url.rlike(_WEB), F.concat(scheme, F.lit("://"), bare, F.coalesce(F.nullif(path, F.lit("")), F.lit("/")))).otherwise(url)


def path_of(url: Column) -> Column:
    return F.when(url.rlike(_WEB), F.coalesce(F.nullif(F.regexp_extract(url, _WEB, 3), F.lit("")), F.lit("/")))


def decoded(text: Column) -> Column:
    """Percent escapes decoded, a plus left alone; null where they are malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def file_name(url: Column) -> Column:
    return decoded(F.nullif(F.substring_index(F.rtrim(path_of(url), F.lit("/")), "/", -1), F.lit("")))


def path_key(url: Column) -> Column:
    return decoded(path_of(url))


def file_key(name: Column) -> Column:
    return F.nullif(F.lower(name), F.lit(""))


def page_id(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^https://([^/?#:]+)", 1))
    return F.when((host == PAGE_HOST) | host.endswith("." + PAGE_HOST), names.trailing_id(file_name(url)))


def _number(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long")))


def blocked_v4(ip: Column) -> Column:
    """Not an address, or not a public one."""
    n, out = _number(ip), F.lit(False)
    for cidr in PRIVATE_V4:
        base, bits = cidr.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        out = out | n.between(low, low + (1 << (32 - int(bits))) - 1)
    return F.coalesce(out, F.lit(True))


def safe(url: Column) -> Column:
    """A web URL without credentials, of a public address or a name that isn't local."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    literal = host.rlike(r"^[0-9.]+$")
    return url.rlike(_WEB) & ~url.rlike(r"^[^/]*//[^/?#]*@") & (host != "") & (host != "localhost") & ~host.endswith(".localhost") & F.when(literal, ~blocked_v4(host)).otherwise(True)


def may_download(source: Column, external: Column) -> Column:
    return (source == "notion") | external


def allowed_type(name: Column, mime: Column, extensions: list[str], types: list[str]) -> Column:
    bare = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    return F.lower(names.extension(name)).isin(extensions) & (bare != "") & bare.isin(types)


def signed(url: Column, hosts: list[str], keys: list[str]) -> Column:
    """A URL of a known host with a query key that marks a short-lived signature."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1))
    query = F.replace(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("&amp;"), F.lit("&"))
    return host.isin(hosts) & F.exists(F.split(query, "&"), lambda p: F.lower(F.coalesce(decoded(F.split_part(p, F.lit("="), F.lit(1))), F.lit(""))).isin(keys))


@F.pandas_udf(BooleanType())
def blocked_address(ip: pd.Series) -> pd.Series:
    """IPv6 and IPv4 literals that must not be fetched: what is no address, and what is not global unicast or is set aside in it."""
    import ipaddress

    allowed = [ipaddress.ip_network(n) for n in ("2001:1::1/128", "2001:1::2/128", "2001:1::3/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")]
    apart = [ipaddress.ip_network(n) for n in ("2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20")]
    v4 = [ipaddress.ip_network(n) for n in PRIVATE_V4]

    def one(text: str | None) -> bool:
        try:
            a = ipaddress.ip_address((text or "").split("%")[0])
        except ValueError:
            return True
        a = getattr(a, "ipv4_mapped", None) or a
        if a.version == 4:
            return any(a in n for n in v4)
        return not any(a in n for n in allowed) and (a not in ipaddress.ip_network("2000::/3") or any(a in n for n in apart))

    return ip.map(one)
