"""Dictionaries and settings from YAML or a key/value sheet, as small tables and dataclasses."""

from __future__ import annotations

import dataclasses
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.functions import ident
from veyra.functions.text import fold_latin

# Labels of the profile sheet.
PROFILE_LABELS = {
    "case_id": "client id", "full_name": "full legal name", "name_variants": "name variants", "dob": "date of birth", "cities": "current & past cities", "addresses": "current & past addresses",
    "phones": "phone numbers", "emails": "email addresses", "usernames": "usernames", "employers": "employers", "schools": "schools", "relatives": "known relatives", "authorized": "signed authorization received", "keep_accounts": "accounts client wants to keep",
}


@dataclasses.dataclass
class Settings:
    max_api_calls: int = 150
    max_results_per_query: int = 20
    site_group_size: int = 8
    max_pages: int = 200
    js_text_threshold: int = 400


def overlay(settings: Settings, values: dict) -> Settings:
    """Known keys replace defaults; unknown ones are warned about and ignored."""
    known = {f.name for f in dataclasses.fields(settings)}
    for k in sorted(set(values) - known):
        warnings.warn(f"unknown setting {k} is ignored", stacklevel=2)
    return dataclasses.replace(settings, **{k: v for k, v in values.items() if k in known})


def load_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def brokers(spark: SparkSession, data: dict) -> DataFrame:
    """ord, domain, name, opt_out_url, country; a bare string is a domain; entries without a domain are skipped."""
    rows = []
    for i, b in enumerate(data.get("brokers") or []):
        b = {"domain": b} if isinstance(b, str) else b
        if b and b.get("domain"):
            rows.append((i + 1, str(b["domain"]).lower(), b.get("name") or "", b.get("opt_out_url") or "", b.get("country") or ""))
    return spark.createDataFrame(rows, "ord int, domain string, name string, opt_out_url string, country string")


# Endings and keywords of site categories, in the order in which they are tried.
ENDINGS = [("Government / court record", [".gov", ".gov.tr", ".gov.uk", ".mil", ".jus.br", ".adalet.gov.tr", ".bel.tr", ".edu.tr.gov"])]
KEYWORDS = [
    ("News / media", ["haber", "news", "gazete", "newspaper", "magazin", "dergi"]),
    ("Forum / community", ["forum", "sozluk", "community", "topluluk", "/thread", "/konu/", "/topic/"]),
    ("Blog", ["blog", "/post/", "/yazi/"]),
    ("Business directory", ["rehber", "directory", "firma", "company-profile", "sirket", "/companies/"]),
    ("Review site", ["review", "sikayet", "yorum", "degerlendirme"]),
    ("Government / court record", ["mahkeme", "court", "karar", "resmi-gazete"]),
]


def category_domains(spark: SparkSession, data: dict) -> DataFrame:
    """domain, ord, value: the domain lists of categories, ord in the order of the file."""
    rows = [(str(d).lower(), i, category) for i, (category, ds) in enumerate((data.get("categories") or {}).items()) for d in ds or [] if d]
    return spark.createDataFrame(rows, "domain string, ord int, value string")


def category_rules(data: dict, section: str) -> list[tuple[str, list[str]]]:
    """(category, entries) of `suffix_rules` or `keyword_rules`, in the order of the file."""
    return [(category, [str(x).lower() for x in entries or []]) for category, entries in (data.get(section) or {}).items()]


def site_domains(spark: SparkSession, data: dict, brokers_: DataFrame) -> DataFrame:
    """kind, ord, domain: what site: queries are made of - brokers, social and professional networks."""
    rows = [(f"site_{kind}", i, str(d)) for kind, ds in (data.get("site_queries") or {}).items() for i, d in enumerate(ds or [])]
    return brokers_.select(F.lit("site_broker").alias("kind"), "ord", "domain").unionByName(spark.createDataFrame(rows, "kind string, ord int, domain string"))


LIST_FIELDS = ("name_variants", "cities", "addresses", "phones", "emails", "usernames", "employers", "schools", "relatives", "keep_accounts")


def validated(subjects: DataFrame) -> DataFrame:
    """subjects with placeholders and invalid values taken out of their lists, `dropped` (how many were), and `rejected`: why a
    subject cannot be used, null if it can. Nothing else is changed; null lists stay null."""
    name = ident.is_placeholder(F.coalesce(F.trim("full_name"), F.lit("")))
    why = F.when(F.coalesce(F.trim("case_id"), F.lit("")) == "", "case id is missing").when((F.coalesce(F.trim("full_name"), F.lit("")) == "") | name, "full name is missing")
    lists = [c for c in LIST_FIELDS if c in subjects.columns]
    keep = lambda c: F.filter(c, lambda v: F.coalesce(ident.valid_value(c, v), F.lit(False)))
    kept = {c: keep(c) for c in lists}
    dropped = sum((F.coalesce(F.size(F.filter(c, lambda v: v.isNotNull())), F.lit(0)) - F.coalesce(F.size(kept[c]), F.lit(0)) for c in lists), F.lit(0))
    return subjects.withColumns({"dropped": dropped.cast("int"), "rejected": why, **kept})


def profile_fields(sheet: DataFrame) -> DataFrame:
    """case_id, field, value of a key/value sheet (case_id, row, label, value): labels match folded and by prefix; the first wins."""
    label = F.trim(fold_latin(F.col("label")))
    field = F.coalesce(*[F.when(label.startswith(text), F.lit(name)) for name, text in PROFILE_LABELS.items()])
    return sheet.withColumn("field", field).where("field is not null").groupBy("case_id", "field").agg(F.min_by("value", "row").alias("value"))


def authorized(subjects: DataFrame, override: bool = False) -> DataFrame:
    """Subjects that may be analysed, and on what basis: the first step of every plan about a person."""
    basis = F.when(F.col("authorized"), "signed authorization").when(F.lit(override), "operator override")
    return subjects.withColumn("basis", basis).where("basis is not null")


def gate(rows: DataFrame, subjects: DataFrame, override: bool = False) -> DataFrame:
    return rows.join(authorized(subjects, override).select("case_id"), "case_id", "left_semi")
