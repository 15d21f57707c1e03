"""Classification by dictionaries: category of a host, content type, jurisdiction text. Dictionaries are small closed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.functions.text import fold, fold_latin
from veyra.functions.urls import host_suffixes

# Names of countries by code (others show their code).
COUNTRIES = {
    "AE": "United Arab Emirates", "AT": "Austria", "AU": "Australia", "AZ": "Azerbaijan", "BE": "Belgium", "BG": "Bulgaria", "BR": "Brazil", "BZ": "Belize", "CA": "Canada", "CH": "Switzerland", "CN": "China", "CY": "Cyprus", "CZ": "Czechia",
    "DE": "Germany", "DK": "Denmark", "EE": "Estonia", "ES": "Spain", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GR": "Greece", "HK": "Hong Kong", "HR": "Croatia", "HU": "Hungary", "IE": "Ireland", "IL": "Israel", "IN": "India",
    "IS": "Iceland", "IT": "Italy", "JP": "Japan", "KR": "South Korea", "KZ": "Kazakhstan", "LI": "Liechtenstein", "LT": "Lithuania", "LU": "Luxembourg", "LV": "Latvia", "MT": "Malta", "MX": "Mexico", "NL": "Netherlands", "NO": "Norway",
    "NZ": "New Zealand", "PA": "Panama", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "RU": "Russia", "SA": "Saudi Arabia", "SC": "Seychelles", "SE": "Sweden", "SG": "Singapore", "SI": "Slovenia", "SK": "Slovakia", "TR": "Turkey",
    "TW": "Taiwan", "UA": "Ukraine", "US": "USA", "VG": "British Virgin Islands", "ZA": "South Africa",
}
BROKER = "Data broker"
OTHER = "Other"


def suffix_match(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """hosts plus the first rule (by ord) whose domain equals the host or one of its dot-suffixes: an equality join on the
    exploded suffixes of the distinct hosts. rules: domain, ord, value - a closed table; over 10 MB it is not broadcast."""
    distinct = hosts.select(host).where(F.col(host).isNotNull()).distinct()
    suffixes = distinct.select(host, F.explode(host_suffixes(F.col(host))).alias("domain"))
    best = suffixes.join(rules.select(F.lower(F.regexp_replace("domain", r"^www\.", "")).alias("domain"), "ord", "value"), "domain").groupBy(host).agg(F.min_by("value", "ord").alias("value"))
    return hosts.join(best, host, "left")


def keyword_category(host_and_path: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first category one of whose keywords stands in the folded text (anywhere, in dictionary order); null if none does."""
    found = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(host_and_path, w)), F.lit(category)) for category, words in rules if words]
    return F.coalesce(*found, F.lit(None).cast("string"))


def ending_category(host: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first category with an ending (such as .gov) that the host ends with, or is but for the leading dot; null if none."""
    fits = lambda w: F.endswith(host, w) | (host == F.ltrim(w, F.lit(".")))
    found = [F.when(F.exists(F.array(*[F.lit(w) for w in words]), fits), F.lit(category)) for category, words in rules if words]
    return F.coalesce(*found, F.lit(None).cast("string"))


def site_category(rows: DataFrame, brokers: DataFrame, domains: DataFrame, endings: list[tuple[str, list[str]]], keywords: list[tuple[str, list[str]]], host: str = "host", path: str = "path") -> DataFrame:
    """rows plus category: brokers first, then the domain lists, the endings, the keywords in host and path; Other if none fits.

    brokers: domain, ord; domains: domain, ord, value (a category; ord is its order). The lists are matched per distinct host. A null
    host or path matches nothing of its own.
    """
    hosts = rows.select(host).distinct()
    listed = suffix_match(hosts, brokers.select("domain", "ord", F.lit(BROKER).alias("value")), host).withColumnRenamed("value", "_broker")
    listed = suffix_match(listed, domains, host).withColumnRenamed("value", "_listed")
    hay = fold(F.concat_ws(" ", host, path))
    category = F.coalesce("_broker", "_listed", ending_category(F.col(host), endings), keyword_category(hay, keywords), F.lit(OTHER))
    return rows.join(listed, host, "left").withColumn("category", category).drop("_broker", "_listed")


def content_type(path: Column, mime: Column, category: Column, places: Column | None = None) -> Column:
    """Kind of a page from its path, media type and category; one that names the subject in comments only is a comment."""
    comment = F.lit(False) if places is None else F.coalesce(places == F.array(F.lit("Comments section")), F.lit(False))
    p, m = F.lower(path), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(m.contains("pdf") | p.rlike(r"\.(pdf|docx?|xlsx?|pptx?|odt)$"), "PDF / document")
        .when(m.startswith("image/") | p.rlike(r"\.(jpe?g|png|gif|webp)$"), "Image")
        .when(m.startswith("video/") | p.rlike(r"/(watch|video|videos|shorts|reel)s?\b"), "Video")
        .when(category == "Archive / cache", "Cached copy")
        .when(category == "Image / video host", "Image")
        .when(category.isin("Social media", "Professional network"), "Profile page")
        .when(category.isin("Data broker", "Business directory"), "Listing")
        .when(comment, "Comment")
        .otherwise("Text")
    )


def country_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv]), code), code)


def jurisdiction(operator: Column, registrant: Column, hosting: Column) -> Column:
    """Owner's country (operator, else registrant) and the host's, each with its role; one name if they are equal; '' if none."""
    owner = F.coalesce(F.nullif(operator, F.lit("")), F.nullif(registrant, F.lit("")))
    host = F.nullif(hosting, F.lit(""))
    role = F.when(F.coalesce(operator, F.lit("")) != "", " (operator)").otherwise(" (registrant)")
    both = F.concat_ws("; ", F.concat(country_name(owner), role), F.concat(country_name(host), F.lit(" (hosting)")))
    return F.when(owner == host, country_name(owner)).otherwise(both)


def keeps(url: Column, keep: Column) -> Column:
    """A kept account (scheme, www. and trailing slash aside) stands in the folded url."""
    bare = F.transform(F.coalesce(keep, F.array().cast("array<string>")), lambda k: F.regexp_replace(F.regexp_replace(fold_latin(F.trim(k)), r"^(https://)?(http://)?(www\.)?", ""), "/+$", ""))
    return F.coalesce(F.exists(bare, lambda k: (k != "") & F.contains(fold_latin(url), k)), F.lit(False))
