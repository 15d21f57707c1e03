"""URL expressions (JVM columns): canonical form, page key, host parts.

The split follows RFC 3986 appendix B by regular expression, because parse_url turns spaces, underscores in hosts and
non-ASCII hosts into null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that only track a visit.
TRACKING_PARAMS = (
    "gclid", "gclsrc", "dclid", "fbclid", "msclkid", "yclid", "igshid", "igsh", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "ref_src",
    "ref_url", "spm", "srsltid", "si", "feature", "trk", "trackingid", "originalsubdomain", "hsctatracking", "_hsenc", "_hsmi",
    "mkt_tok", "cmpid", "ocid", "wt.mc_id", "s_cid",
)
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "hsa_")
DEFAULT_PORTS = {"http": "80", "https": "443"}

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def is_tracking(key: Column) -> Column:
    k = F.lower(key)
    return k.isin(*TRACKING_PARAMS) | reduce(lambda a, b: a | b, [k.startswith(p) for p in TRACKING_PREFIXES])


def parts(url: Column) -> dict[str, Column]:
    """scheme, host, port, path, query of an absolute URL; '' where a part is missing."""
    u = F.trim(F.regexp_replace(url, r"[\t\r\n]", ""))
    at = lambda i: F.regexp_extract(u, _SPLIT, i)
    net = F.regexp_replace(at(2), r"^.*@", "")
    host = F.rtrim(F.lower(F.regexp_replace(net, r":\d*$", "")), F.lit("."))
    return {"scheme": F.lower(at(1)), "host": F.regexp_replace(host, r"[\[\]]", ""), "port": F.regexp_extract(net, r":(\d+)$", 1), "path": at(3), "query": at(4)}


def unquote_plus(s: Column) -> Column:
    """Percent decoding that leaves malformed escapes as they are."""
    return F.coalesce(F.try_url_decode(s), s)


def params(query: Column) -> Column:
    """array<struct<k,v>> of the parameters that matter, sorted by (k, v); a blank value is kept, a missing '=' gives ''."""
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.struct(unquote_plus(F.substring_index(x, "=", 1)).alias("k"), unquote_plus(F.when(x.contains("="), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")).alias("v")),
    )
    return F.array_sort(F.filter(pairs, lambda p: ~is_tracking(p["k"])))


def _quote(s: Column) -> Column:
    """Form encoding with '+' for a space and '~' left alone."""
    return F.replace(F.replace(F.url_encode(s), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Canonical absolute URL; null for null. Lower-case scheme and host, no default port, fragment, user, trailing slash or
    tracking parameter, parameters sorted. A URL without scheme counts as https when it starts with a host-like name."""
    bare = F.trim(url)
    p = parts(F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), bare).otherwise(F.concat(F.lit("https://"), F.regexp_replace(bare, "^//", ""))))
    default = reduce(lambda a, b: a | b, [(p["scheme"] == s) & (p["port"] == n) for s, n in DEFAULT_PORTS.items()])
    q = F.array_join(F.transform(params(p["query"]), lambda x: F.concat(_quote(x["k"]), F.lit("="), _quote(x["v"]))), "&")
    return F.concat(
        p["scheme"], F.lit("://"), p["host"], F.when((p["port"] != "") & ~default, F.concat(F.lit(":"), p["port"])).otherwise(""),
        F.regexp_replace(p["path"], "/+$", ""), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def url_key(url: Column) -> Column:
    """The canonical URL without scheme and leading www. (equal keys are one page)."""
    return F.regexp_replace(F.regexp_replace(normalize_url(url), r"^[^:]*://", ""), r"^www\.", "")


def hostname(url: Column) -> Column:
    return parts(url)["host"]


def host_suffixes(host: Column) -> Column:
    """All dot-suffixes of a host, longest first: turns a suffix join into an equality join."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def cctld(host: Column) -> Column:
    """Country code of the last label if it has two letters (uk is GB, eu is EU), else ''."""
    last = F.element_at(F.split(host, r"\."), -1)
    return F.when(last == "uk", "GB").when(last.rlike("^[a-z]{2}$"), F.upper(last)).otherwise("")
