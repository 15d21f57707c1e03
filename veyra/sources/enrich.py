"""Registration, address and archive responses (staged JSON) as dimension columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.functions.text import fold_latin

# Words that mark a redacted owner, and countries given by name.
REDACTED = ("redacted", "privacy", "private", "withheld", "not disclosed", "data protected", "gdpr", "whoisguard", "domains by proxy", "proxy", "statutory masking", "contact privacy")
BY_NAME = {"turkey": "TR", "turkiye": "TR", "united states": "US", "united kingdom": "GB"}


def redacted(s: Column) -> Column:
    folded = fold_latin(s)
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in REDACTED]), lambda m: F.contains(folded, m)), F.lit(False))


def country_code(s: Column) -> Column:
    t = F.trim(s)
    return F.coalesce(F.when(t.rlike("^[A-Za-z]{2}$"), F.upper(t)), F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_NAME.items() for x in kv]), fold_latin(t)), F.lit(""))


def _registrant(entities: object) -> dict | None:
    """The first entity with the registrant role, depth first."""
    for e in entities if isinstance(entities, list) else []:
        if isinstance(e, dict):
            if "registrant" in (e.get("roles") or []):
                return e
            inner = _registrant(e.get("entities"))
            if inner:
                return inner
    return None


def rdap_domain(body: Column) -> Column:
    """Owner and country of a domain response (entities nest without bound, so this walk is Python); blanks where absent."""
    return F.pandas_udf(_rdap, "struct<org:string,name:string,country:string>")(body)


def _rdap(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:

    def one(body: str | None) -> tuple[str, str, str]:
        try:
            data = json.loads(body or "")
        except ValueError:
            return "", "", ""
        e = _registrant(data.get("entities") if isinstance(data, dict) else None)
        org = name = country = ""
        for field in ((e or {}).get("vcardArray") or [None, []])[1:2]:
            for prop in field or []:
                if not isinstance(prop, list) or len(prop) < 4:
                    continue
                value = prop[3]
                if prop[0] == "org":
                    org = " ".join(map(str, value)) if isinstance(value, list) else str(value)
                elif prop[0] == "fn":
                    name = str(value)
                elif prop[0] == "adr":
                    country = str((prop[1] or {}).get("cc") or (value[-1] if isinstance(value, list) and value else ""))
        return org, name, country

    for batch in it:
        yield pd.DataFrame([one(b) for b in batch], columns=["org", "name", "country"])


def registrant(r: Column) -> Column:
    """Organisation, else name, unless redacted; '' otherwise."""
    org, name = r["org"], r["name"]
    return F.when((org != "") & ~redacted(org), org).when((name != "") & ~redacted(name), name).otherwise("")


def ip_country(body: Column) -> Column:
    return F.upper(F.coalesce(F.get_json_object(body, "$.country"), F.lit("")))


def archived(body: Column, asked: Column) -> Column:
    """Yes, No, or Unknown where nobody asked or no answer came."""
    got = F.get_json_object(body, "$.archived_snapshots")
    return F.when(~asked | body.isNull() | got.isNull(), "Unknown").when(F.get_json_object(body, "$.archived_snapshots.closest.available") == "true", "Yes").otherwise("No")


def with_facts(rows: DataFrame, domains: DataFrame, archive: DataFrame, domain: str = "domain", url: str = "url") -> DataFrame:
    """rows plus what is known of their registered domain and of the archived copies of their address, both left outer: rows
    without either stay. domains: one row per domain; archive: one row per url; further columns are taken over."""
    return rows.join(domains, domain, "left").join(archive, url, "left")
