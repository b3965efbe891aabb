"""Column builders on paths, hosts and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalogs as C

#: What may stand on either side of a path segment, besides the ends of the text.
EDGE = r"[\s'\"`()\[\]{},;=@/\\]"
#: Without white space outside ASCII, for engines that lack it.
EDGE_ASCII = r"[ \t\n\x0b\x0c\r'\"`()\[\]{},;=@/\\]"


def _union(values: list[str]) -> str:
    return "|".join(re.escape(v).replace("/", "/") for v in values)


def sensitive_regex(edge: str = EDGE, segments: list[str] | None = None, suffixes: list[str] | None = None, substrings: list[str] | None = None) -> str:
    parts = [f"(^|{edge})({_union(segments or C.SENSITIVE_SEGMENTS)})($|{edge})"]
    parts.append(f"({_union(suffixes or C.SENSITIVE_SUFFIXES)})$")
    parts.append(f"({_union(substrings or C.SENSITIVE_SUBSTRINGS)})")
    return "|".join(parts)


def has_sensitive_path(t: Column, **catalog: list[str]) -> Column:
    return F.lower(t).rlike("(?U)" + sensitive_regex(**catalog))


def domain_regex(domains: list[str] | None = None) -> str:
    return rf"(?i)(^|[./])({_union(domains or C.EXFIL_DOMAINS)})($|[:/])"


def has_exfil_domain(t: Column, domains: list[str] | None = None) -> Column:
    return t.rlike(domain_regex(domains))


IP_URL = r"https?://([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})([:/]|$)"


def is_private(octets: Column) -> Column:
    """Loopback, RFC 1918 and link-local addresses, from an array of four numbers."""
    a, b = octets[0], octets[1]
    return (a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))


def public_ips(t: Column) -> Column:
    """Hosts of http(s) URLs that are IPv4 addresses without leading zeros and not private; in lower-cased text."""
    hosts = F.regexp_extract_all(t, F.lit(IP_URL), F.lit(1))
    nums = lambda h: F.transform(F.split(h, "\\."), lambda x: x.cast("int"))
    plain = lambda h: ~h.rlike(r"(^|\.)0[0-9]")
    return F.filter(hosts, lambda h: plain(h) & F.forall(nums(h), lambda x: x <= 255) & ~is_private(nums(h)))


def has_ip_url(t: Column) -> Column:
    return F.size(public_ips(F.lower(t))) > 0


def basename(t: Column) -> Column:
    return F.element_at(F.split(t, "/"), -1)


def strip_quotes(t: Column) -> Column:
    return F.regexp_replace(t, "^(?:\"(.*)\"|'(.*)')$", "$1$2")


def expand_tilde(p: Column, home: Column) -> Column:
    return F.when(p == "~", home).when(p.startswith("~/"), F.concat(home, F.expr("''"), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)


def normalize_path(p: Column) -> Column:
    """Resolves ``.`` and ``..`` textually; an absolute path keeps its root."""
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.when(p.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def resolve(p: Column, cwd: Column, home: Column) -> Column:
    q = expand_tilde(p, home)
    return normalize_path(F.when(q.startswith("/"), q).otherwise(F.concat(cwd, F.lit("/"), q)))


def is_under(p: Column, d: Column) -> Column:
    return (p == d) | p.startswith(F.concat(d, F.lit("/")))


def protected_prefix(p: Column, home: Column) -> Column:
    """The first protected prefix that a resolved path lies in, else null; the root itself is not protected."""
    slashed = F.concat(p, F.lit("/"))
    out = F.lit(None).cast("string")
    drive = p.rlike("^/mnt/[a-z]/") & (slashed.rlike("^/mnt/[a-z]/(" + _union(C.PROTECTED_DRIVE) + ")") | slashed.rlike("^/mnt/[a-z]/Users/[^/]+/(" + _union(C.PROTECTED_DRIVE_USER) + ")"))
    out = F.when(drive, "/mnt/").otherwise(out)
    for x in reversed(C.PROTECTED_HOME):
        out = F.when(slashed.startswith(F.concat(home, F.lit("/" + x))), F.lit("~/" + x)).otherwise(out)
    for x in reversed(C.PROTECTED_SYSTEM):
        out = F.when(slashed.startswith(F.lit(x)), F.lit(x)).otherwise(out)
    return out


def protected(p: Column, cwd: Column, home: Column) -> Column:
    """Protected prefix of a path as given; paths in the working directory are exempt."""
    full = resolve(p, cwd, home)
    return F.when(~is_under(full, cwd), protected_prefix(full, home))


def ancestors(p: Column) -> Column:
    """The directory and all its parents, nearest first, without the root."""
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n > 0, F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
