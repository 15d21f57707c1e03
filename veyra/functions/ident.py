"""Expressions on identifiers: cells, names, phone numbers, check digits (JVM columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veyra.functions.text import fold_latin

# Fixed values.
PLACEHOLDER = r"(?i)\dx|x\d|\bx{2,}\b|\.\.\.|<[^>]+>|^tbd$|^n/?a$|^-$"
TRUE_WORDS = ("yes", "y", "true", "1", "evet")
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def split_list(s: Column) -> Column:
    """Values of a ';' list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(s, ";"), lambda x: F.trim(x)), lambda x: x != "")


def is_placeholder(s: Column) -> Column:
    return F.trim(s).rlike(PLACEHOLDER)


def valid_value(field: str, s: Column) -> Column:
    """Template placeholders, short phone numbers and addresses without a dotted domain are no values."""
    ok = ~is_placeholder(s)
    if field == "phones":
        return ok & (F.length(digits(s)) >= 7)
    if field == "emails":
        return ok & s.contains("@") & F.substring_index(s, "@", -1).contains(".")
    return ok


def parse_bool(s: Column) -> Column:
    return F.coalesce(F.trim(fold_latin(s)).isin(*TRUE_WORDS), F.lit(False))


def parse_date(s: Column) -> Column:
    """The first of four written forms that fits, else null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(s), F.lit(f))) for f in DATE_FORMATS])


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def national_number(s: Column) -> Column:
    """Ten-digit Turkish number, or null."""
    strip = lambda d: F.when(d.startswith("0090"), F.substring(d, 5, 30)).when(d.startswith("90") & (F.length(d) == 12), F.substring(d, 3, 30)).when(d.startswith("0") & (F.length(d) == 11), F.substring(d, 2, 30)).otherwise(d)
    return _let(_let(digits(s), strip), lambda n: F.when(n.rlike("^[2-5][0-9]{9}$"), n))


def phone_key(s: Column) -> Column:
    return F.coalesce(national_number(s), _let(digits(s), lambda d: F.when(F.length(d) >= 10, F.substring(d, -10, 10)).otherwise(d)))


def phone_formats(s: Column) -> Column:
    """The written forms of a phone number to search for."""

    def written(n: Column) -> Column:
        a, b, c, e = (F.substring(n, i, k) for i, k in ((1, 3), (4, 3), (7, 2), (9, 2)))
        spaced = F.concat_ws(" ", a, b, c, e)
        return F.array(
            F.concat(F.lit("+90 "), spaced), F.concat(F.lit("+90"), n), F.concat(F.lit("0"), n), F.concat(F.lit("0"), spaced), F.concat(a, F.lit("-"), b, F.lit("-"), c, e),
            F.concat(F.lit("("), a, F.lit(") "), F.concat_ws(" ", b, c, e)), spaced,
        )

    t, d = F.trim(s), digits(s)
    other = F.array(t, F.when(t.startswith("+"), F.concat(F.lit("+"), d)).otherwise(d))
    return F.array_distinct(_let(national_number(s), lambda n: F.when(n.isNotNull(), written(n)).otherwise(other)))


def distinct_names(full_name: Column, variants: Column) -> Column:
    """Full name and variants, without those that fold to an earlier one; blanks dropped."""
    all_names = F.filter(F.concat(F.array(full_name), F.coalesce(variants, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    key = lambda x: F.regexp_replace(F.trim(fold_latin(x)), r"(?U)\s+", " ")
    keys = F.transform(all_names, key)
    return F.filter(all_names, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def bare_username(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "^@+", "")


def safe_case_id(s: Column) -> Column:
    """A case id fit for a folder name; an id of which nothing is left is an error."""
    t = F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9_.\-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(t == "", F.raise_error(F.concat(F.lit("no usable case id in: "), s)).cast("string")).otherwise(t)


def tckn_valid(s: Column) -> Column:
    """Check digits of an 11-digit Turkish identity number."""
    d = [F.substring(s, i, 1).cast("int") for i in range(1, 12)]
    odd, even = d[0] + d[2] + d[4] + d[6] + d[8], d[1] + d[3] + d[5] + d[7]
    ok = (F.pmod(odd * 7 - even, F.lit(10)) == d[9]) & (F.pmod(odd + even + d[9], F.lit(10)) == d[10])
    return F.coalesce(F.when(s.rlike("^[1-9][0-9]{10}$"), ok), F.lit(False))


def iban_valid(s: Column) -> Column:
    """Mod-97 check; a Turkish one has 26 characters."""
    t = F.upper(F.regexp_replace(s, r"\s", ""))
    turned = F.concat(F.substring(t, 5, 40), F.substring(t, 1, 4))
    value = lambda ch: F.ascii(ch) - F.when(ch.rlike("[0-9]"), 48).otherwise(55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda ch: ch != ""), F.lit(0), lambda acc, ch: (acc * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97)
    return F.coalesce(F.when(t.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (~t.startswith("TR") | (F.length(t) == 26)), rest == 1), F.lit(False))
