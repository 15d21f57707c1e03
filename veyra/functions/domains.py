"""Registered domain of a host: one label more than its longest public suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veyra.functions.urls import host_suffixes

# Public suffixes of several labels, private registries included; single labels are suffixes anyway.
SUFFIXES = (
    "com.tr", "net.tr", "org.tr", "gov.tr", "edu.tr", "bel.tr", "k12.tr", "av.tr", "dr.tr", "gen.tr", "web.tr", "info.tr", "biz.tr", "name.tr", "pol.tr", "tsk.tr", "mil.tr", "tel.tr", "tv.tr",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "nhs.uk", "com.br", "org.br", "gov.br", "jus.br", "com.au", "net.au", "org.au", "gov.au", "edu.au",
    "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "co.nz", "org.nz", "co.za", "org.za", "com.mx", "com.ar", "com.cn", "net.cn", "org.cn", "com.hk", "com.sg", "co.in", "org.in", "co.kr", "com.tw", "com.ua", "com.pl", "com.es", "com.fr",
    "blogspot.com", "github.io", "gitlab.io", "wordpress.com", "herokuapp.com", "netlify.app", "vercel.app", "web.app", "pages.dev", "azurewebsites.net", "cloudfront.net", "appspot.com",
)


def registered_domain(host: Column, extra: tuple[str, ...] = ()) -> Column:
    """Null for null; a host that is itself a suffix, a single label or an address stays, without a leading www."""
    h = F.regexp_replace(F.lower(host), r"^www\.", "")
    parts = host_suffixes(h)
    longest = F.array_position(F.transform(parts, lambda p: p.isin(*SUFFIXES, *extra)), True)
    at = F.when(longest > 0, longest - 1).otherwise(F.size(parts) - 1)
    return F.when(h.rlike(r"^[\d.]+$|:"), h).otherwise(F.coalesce(F.get(parts, (at - 1).cast("int")), h))
