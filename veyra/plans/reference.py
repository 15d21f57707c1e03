"""Queries over the case tables, one or more per operator, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veyra.functions import ident, text, urls
from veyra.operators import classify, findings, matrix, pages, report, results, tracker
from veyra.sources import dictionaries, enrich, providers, sinks
from veyra.session import spread
from veyra.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL fragments -----------------------------------------------------------------------------------------------------

_FROM, _TO = text.TURKISH, text.ASCII
_TRLOW = "lower(translate({0}, 'Iİ', 'ıi'))"
_FOLD = f"strip_accents(translate({_TRLOW}, '{_FROM}', '{_TO}'))"
_ASCII = f"strip_accents(translate({{0}}, '{_FROM}', '{_TO}'))"


def fold_sql(c: str) -> str:
    return _FOLD.format(c)


def keyed_sql(source: str, url: str) -> str:
    """source plus url_norm and key, as a parenthesised select."""
    split = urls._SPLIT.replace("'", "''")
    tracking = ", ".join(f"'{p}'" for p in urls.TRACKING_PARAMS)
    prefixes = " OR ".join(f"starts_with(lower(p.k), '{p}')" for p in urls.TRACKING_PREFIXES)
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    return f"""(SELECT *, regexp_replace(regexp_replace(url_norm, '^[^:]*://', ''), '^www\\.', '') AS key FROM (
 SELECT *, scheme || '://' || host || CASE WHEN port <> '' AND NOT (scheme = 'http' AND port = '80' OR scheme = 'https' AND port = '443') THEN ':' || port ELSE '' END
   || regexp_replace(path, '/+$', '') || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END AS url_norm FROM (
 SELECT *, array_to_string(list_transform(params, lambda p: {enc('p.k')} || '=' || {enc('p.v')}), '&') AS qs FROM (
 SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''),
   lambda x: {{'k': {dec("split_part(x, '=', 1)")}, 'v': {dec("CASE WHEN contains(x, '=') THEN substr(x, position('=' IN x) + 1) ELSE '' END")}}}),
   lambda p: NOT (lower(p.k) IN ({tracking}) OR {prefixes}))) AS params FROM (
 SELECT *, lower(regexp_extract(_u, '{split}', 1)) AS scheme, replace(replace(rtrim(lower(regexp_replace(_net, ':\\d*$', '')), '.'), '[', ''), ']', '') AS host,
   regexp_extract(_net, ':(\\d+)$', 1) AS port, regexp_extract(_u, '{split}', 3) AS path, regexp_extract(_u, '{split}', 4) AS query FROM (
 SELECT *, regexp_replace(regexp_extract(_u, '{split}', 2), '^.*@', '') AS _net FROM (
 SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(_b, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN _b ELSE 'https://' || regexp_replace(_b, '^//', '') END, '[\\t\\r\\n]', '', 'g'), ' ') AS _u FROM (
 SELECT *, trim({url}, ' ') AS _b FROM {source} WHERE {url} IS NOT NULL))))))))"""


_RESULTS = keyed_sql("search_results", "url")
_TRACKED = keyed_sql("(SELECT * FROM tracker WHERE trim(coalesce(site_link, ''), ' ') <> '')", "site_link")
_GOOGLE = ", ".join(f"'{g}'" for g in results.GOOGLE)

# ---- text --------------------------------------------------------------------------------------------------------------


@query(f"SELECT case_id, {_TRLOW.format('full_name')} AS lowered, {fold_sql('full_name')} AS folded, {_ASCII.format('full_name')} AS ascii FROM subjects")
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("full_name")
    return table(spark, d, "subjects").select("case_id", text.tr_lower(n).alias("lowered"), text.fold(n).alias("folded"), text.ascii_translit(n).alias("ascii"))


@query(f"SELECT result_id, {fold_sql('query_text')} AS folded FROM search_results")
def folded_queries(spark, d):
    return table(spark, d, "search_results").select("result_id", text.fold(F.col("query_text")).alias("folded"))


@query("SELECT result_id, trim(regexp_replace(snippet, '[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g'), ' ') AS snippet FROM search_results")
def collapsed_snippets(spark, d):
    return table(spark, d, "search_results").select("result_id", text.collapse_ws(F.col("snippet")).alias("snippet"))


@query(
    rf"""WITH s AS (SELECT r.result_id, {fold_sql('r.title')} AS t, list_filter(string_split_regex({fold_sql('s.full_name')}, '\s+'), lambda w: w <> '') AS w FROM search_results r JOIN subjects s USING (case_id) WHERE r.title IS NOT NULL),
p AS (SELECT *, array_to_string(list_transform(w, lambda x: regexp_replace(x, '([.*+?])', '\\\1', 'g')), '[\s\-_]+') AS body FROM s)
SELECT result_id, len(regexp_extract_all(regexp_replace(t, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])' || body || '(?:[^\p{{L}}\p{{N}}_]|$)')) AS mentions FROM p"""
)
def title_mentions(spark, d):
    r, s = table(spark, d, "search_results").where("title is not null"), table(spark, d, "subjects").select("case_id", text.phrase_pattern(F.col("full_name")).alias("p"))
    return r.join(s, "case_id").select("result_id", F.call_function("regexp_count", text.fold(F.col("title")), F.col("p")).cast("long").alias("mentions"))


@query()
def mention_spans(spark, d):
    """Merged spans of all names of the subject in each title, with the words around them."""
    r = table(spark, d, "search_results").where("title is not null").select("result_id", "case_id", text.fold(F.col("title")).alias("t"))
    s = table(spark, d, "subjects").select("case_id", ident.distinct_names(F.col("full_name"), F.col("name_variants")).alias("names"))
    x = r.join(s, "case_id").withColumn("spans", text.find_spans(F.col("t"), F.col("names")))
    return x.select("result_id", F.size("spans").alias("mentions"), text.contexts(F.col("t"), F.col("spans")).alias("contexts"))


@query(r"SELECT result_id, regexp_replace(url_decode(replace(regexp_replace(url, '^[^:]*://[^/]*', ''), '+', ' ')), '[/_\-+.=&?]+', ' ', 'g') AS slug FROM search_results WHERE url IS NOT NULL")
def url_slugs(spark, d):
    return table(spark, d, "search_results").where("url is not null").select("result_id", text.slug_text(F.regexp_replace("url", r"^[^:]*://[^/]*", "")).alias("slug"))


# ---- urls --------------------------------------------------------------------------------------------------------------


@query(f"SELECT result_id, url_norm, key FROM {_RESULTS}")
def url_keys(spark, d):
    return results.keyed(table(spark, d, "search_results")).select("result_id", "url_norm", "key")


@query(f"SELECT host, upper(CASE WHEN regexp_matches(split_part(host, '.', -1), '^[a-z]{{2}}$') THEN split_part(host, '.', -1) ELSE '' END) AS country, count(*) AS n_results FROM {_RESULTS} GROUP BY ALL")
def host_counts(spark, d):
    h = results.keyed(table(spark, d, "search_results")).select(urls.hostname(F.col("url_norm")).alias("host"))
    return h.groupBy("host").agg(F.count("*").alias("n_results")).select("host", urls.cctld(F.col("host")).alias("country"), "n_results")


@query(
    f"""WITH h AS (SELECT DISTINCT host FROM {_RESULTS}) SELECT host, arg_min(b.name, b.ord) AS broker FROM h LEFT JOIN brokers b ON h.host = lower(b.domain) OR ends_with(h.host, '.' || lower(b.domain)) GROUP BY host"""
)
def broker_hosts(spark, d):
    h = results.keyed(table(spark, d, "search_results")).select(urls.hostname(F.col("url_norm")).alias("host")).distinct()
    rules = table(spark, d, "brokers").select("domain", "ord", F.col("name").alias("value"))
    return classify.suffix_match(h, rules).select("host", F.col("value").alias("broker"))


def rules_sql(rules: list[tuple[str, list[str]]], test: str) -> str:
    """CASE over a dictionary; test is the condition with {} for an entry."""
    return "CASE " + " ".join(f"WHEN {' OR '.join(test.format(chr(39) + w + chr(39)) for w in words)} THEN '{category}'" for category, words in rules) + " END"


_KEYWORD = rules_sql(dictionaries.KEYWORDS, "contains(f, {})")


def host_and_path(url: str):
    bare = F.trim(url)
    p = urls.parts(F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), bare).otherwise(F.concat(F.lit("https://"), F.regexp_replace(bare, "^//", ""))))
    return p["host"], p["path"]


@query(f"SELECT DISTINCT fetch_id, coalesce({_KEYWORD}, 'Other') AS category FROM (SELECT fetch_id, {fold_sql("host || ' ' || path")} AS f FROM {keyed_sql('fetches', 'url')})")
def keyword_categories(spark, d):
    host, path = host_and_path("url")
    f = table(spark, d, "fetches").where("url is not null")
    return f.select("fetch_id", F.coalesce(classify.keyword_category(text.fold(F.concat_ws(" ", host, path)), dictionaries.KEYWORDS), F.lit(classify.OTHER)).alias("category"))


@query(
    r"""SELECT fetch_id, CASE WHEN m LIKE '%pdf%' OR regexp_matches(p, '\.(pdf|docx?|xlsx?|pptx?|odt)$') THEN 'PDF / document' WHEN m LIKE 'image/%' OR regexp_matches(p, '\.(jpe?g|png|gif|webp)$') THEN 'Image'
 WHEN m LIKE 'video/%' OR regexp_matches(p, '/(watch|video|videos|shorts|reel)s?\b') THEN 'Video' ELSE 'Text' END AS content_type
 FROM (SELECT fetch_id, lower(coalesce(content_type, '')) AS m, lower(regexp_replace(regexp_replace(regexp_replace(url, '\s+', '', 'g'), '^[^:]*://[^/]*', ''), '[?#].*$', '')) AS p FROM fetches WHERE url IS NOT NULL)"""
)
def content_types(spark, d):
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", r"\s+", ""), r"^[^:]*://[^/]*", ""), r"[?#].*$", "")
    return table(spark, d, "fetches").where("url is not null").select("fetch_id", classify.content_type(path, F.col("content_type"), F.lit("Other")).alias("content_type"))


@query(
    """SELECT s_suppkey, CASE WHEN o <> '' AND o = h THEN on_ WHEN o <> '' THEN on_ || ' (operator)' || CASE WHEN h <> '' THEN '; ' || hn || ' (hosting)' ELSE '' END WHEN h <> '' THEN hn || ' (hosting)' ELSE '' END AS jurisdiction
 FROM (SELECT s_suppkey, ['', 'TR', 'DE', 'US', 'XX'][1 + s_nationkey % 5] AS o, ['', 'TR', 'FR', 'DE'][1 + CAST(s_suppkey % 4 AS INT)] AS h,
 ['', 'Turkey', 'Germany', 'USA', 'XX'][1 + s_nationkey % 5] AS on_, ['', 'Turkey', 'France', 'Germany'][1 + CAST(s_suppkey % 4 AS INT)] AS hn FROM supplier)"""
)
def jurisdictions(spark, d):
    s = table(spark, d, "supplier")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return s.select("s_suppkey", classify.jurisdiction(pick(["", "TR", "DE", "US", "XX"], F.col("s_nationkey") % 5), F.lit(""), pick(["", "TR", "FR", "DE"], F.col("s_suppkey") % 4)).alias("jurisdiction"))


# ---- identifiers -------------------------------------------------------------------------------------------------------

_NAT = """CASE WHEN regexp_matches(n, '^[2-5][0-9]{9}$') THEN n END"""
_STRIP = """CASE WHEN d LIKE '0090%' THEN substr(d, 5) WHEN d LIKE '90%' AND length(d) = 12 THEN substr(d, 3) WHEN d LIKE '0%' AND length(d) = 11 THEN substr(d, 2) ELSE d END"""
_PHONES = f"""(SELECT *, {_NAT} AS nat FROM (SELECT *, {_STRIP} AS n FROM (SELECT *, regexp_replace(raw, '\\D', '', 'g') AS d FROM (SELECT case_id, generate_subscripts(phones, 1) - 1 AS v, unnest(phones) AS raw FROM subjects) WHERE raw IS NOT NULL)))"""


@query(f"SELECT case_id, v AS pos, coalesce(nat, CASE WHEN length(d) >= 10 THEN right(d, 10) ELSE d END) AS key, length(d) >= 7 AND NOT regexp_matches(trim(raw, ' '), '(?i)\\dx|x\\d|\\bx{{2,}}\\b|\\.\\.\\.|<[^>]+>|^tbd$|^n/?a$|^-$') AS valid FROM {_PHONES}")
def phone_keys(spark, d):
    p = table(spark, d, "subjects").select("case_id", F.posexplode("phones").alias("v", "raw")).where("raw is not null")
    return p.select("case_id", F.col("v").cast("long").alias("pos"), ident.phone_key(F.col("raw")).alias("key"), ident.valid_value("phones", F.col("raw")).alias("valid"))


_FORMS = """list_distinct(CASE WHEN nat IS NULL THEN [trim(raw, ' '), CASE WHEN trim(raw, ' ') LIKE '+%' THEN '+' || d ELSE d END] ELSE ['+90 ' || a || ' ' || b || ' ' || c || ' ' || e, '+90' || nat, '0' || nat, '0' || a || ' ' || b || ' ' || c || ' ' || e, a || '-' || b || '-' || c || e, '(' || a || ') ' || b || ' ' || c || ' ' || e, a || ' ' || b || ' ' || c || ' ' || e] END)"""


@query(f"SELECT DISTINCT case_id, unnest({_FORMS}) AS form FROM (SELECT *, substr(nat, 1, 3) AS a, substr(nat, 4, 3) AS b, substr(nat, 7, 2) AS c, substr(nat, 9, 2) AS e FROM {_PHONES})")
def phone_forms(spark, d):
    p = table(spark, d, "subjects").select("case_id", F.explode("phones").alias("raw")).where("raw is not null")
    return p.select("case_id", F.explode(ident.phone_formats(F.col("raw"))).alias("form")).distinct()


@query(
    f"""SELECT case_id, CAST(len(list_distinct(list_transform(list_filter(list_concat([full_name], coalesce(name_variants, [])), lambda x: x IS NOT NULL AND trim(x, ' ') <> ''), lambda x: regexp_replace(trim({fold_sql('x')}, ' '), '\\s+', ' ', 'g')))) AS INT) AS n_names,
 list_transform(coalesce(usernames, []), lambda u: regexp_replace(trim(u, ' '), '^@+', '')) AS usernames, regexp_replace(regexp_replace(case_id, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS folder FROM subjects"""
)
def subject_names(spark, d):
    s = table(spark, d, "subjects")
    return s.select("case_id", F.size(ident.distinct_names(F.col("full_name"), F.col("name_variants"))).alias("n_names"), F.transform(F.coalesce("usernames", F.array().cast("array<string>")), ident.bare_username).alias("usernames"), ident.safe_case_id(F.col("case_id")).alias("folder"))


@query(
    """SELECT c_custkey, n AS number, substr(n, 1, 1) <> '0' AND (((o * 7 - e) % 10) + 10) % 10 = CAST(substr(n, 10, 1) AS INT) AND (o + e + CAST(substr(n, 10, 1) AS INT)) % 10 = CAST(substr(n, 11, 1) AS INT) AS valid FROM (SELECT *,
 CAST(substr(n, 1, 1) AS INT) + CAST(substr(n, 3, 1) AS INT) + CAST(substr(n, 5, 1) AS INT) + CAST(substr(n, 7, 1) AS INT) + CAST(substr(n, 9, 1) AS INT) AS o,
 CAST(substr(n, 2, 1) AS INT) + CAST(substr(n, 4, 1) AS INT) + CAST(substr(n, 6, 1) AS INT) + CAST(substr(n, 8, 1) AS INT) AS e FROM (SELECT c_custkey, CAST(10000000000 + c_custkey * 146 AS VARCHAR) AS n FROM customer))"""
)
def identity_checks(spark, d):
    n = (F.lit(10_000_000_000) + F.col("c_custkey") * 146).cast("string")
    return table(spark, d, "customer").select("c_custkey", n.alias("number"), ident.tckn_valid(n).alias("valid"))


@query(
    """SELECT o_orderkey, i AS iban, list_reduce(list_transform(string_split(substr(i, 5) || '2927' || substr(i, 3, 2), ''), lambda x: CAST(x AS BIGINT)), lambda a, x: (a * 10 + x) % 97) = 1 AS valid
 FROM (SELECT o_orderkey, 'TR' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey AS VARCHAR), 22, '0') AS i FROM orders)"""
)
def iban_checks(spark, d):
    i = F.concat(F.lit("TR"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 22, "0"))
    return table(spark, d, "orders").select("o_orderkey", i.alias("iban"), ident.iban_valid(i).alias("valid"))


@query("SELECT authorized, count(*) AS n_results FROM search_results JOIN (SELECT case_id, authorized FROM subjects WHERE authorized) USING (case_id) GROUP BY authorized")
def gated_results(spark, d):
    """The authorization gate is a semi-join before anything else."""
    s = table(spark, d, "subjects")
    return dictionaries.gate(table(spark, d, "search_results"), s).groupBy(F.lit(True).alias("authorized")).agg(F.count("*").alias("n_results"))


# ---- query matrix ------------------------------------------------------------------------------------------------------

_NAMES = f"""(SELECT case_id, generate_subscripts(f, 1) - 1 AS n, unnest(f) AS form FROM (SELECT case_id, f FROM (SELECT case_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS f FROM (
 SELECT case_id, list_filter(flatten(list_transform(list_filter(a, lambda x, i: list_position(k, k[i]) = i), lambda x: [trim(x, ' '), {_ASCII.format("trim(x, ' ')")}])), lambda x: x <> '') AS u FROM (
 SELECT case_id, a, list_transform(a, lambda x: regexp_replace(trim({fold_sql('x')}, ' '), '\\s+', ' ', 'g')) AS k FROM (
 SELECT case_id, list_filter(list_concat([full_name], coalesce(name_variants, [])), lambda x: x IS NOT NULL AND trim(x, ' ') <> '') AS a FROM subjects))))))"""
_Q = "'\"' || trim(replace({0}, '\"', ''), ' ') || '\"'"


# Domains of the site: queries beside the brokers, as the settings of a run name them.
SITE_QUERIES = {"social": ["kisibulucu.example", "lark-copper1.com.example", "kumsal-harman2.test"], "professional": ["defter-defter4.test", "fener-copper5.example", "copper-quarry3.test", "harbor-lark6.test", "pusula-lodos11.example", "meadow-kumsal9.example", "quarry-ledger8.test", "harman-orman12.com.example", "kumsal-pusula10.com.example"]}
_SITES = "(SELECT 'site_broker' AS kind, ord, domain FROM brokers" + "".join(f" UNION ALL SELECT 'site_{k}', {i}, '{x}'" for k, xs in SITE_QUERIES.items() for i, x in enumerate(xs)) + ")"


def _cross(kind: str, field: str, block: int) -> str:
    return f"SELECT nm.case_id, {_Q.format('nm.form')} || ' ' || {_Q.format('x.value')}, '{kind}', [2, n, {block}, v] FROM nm JOIN (SELECT case_id, generate_subscripts({field}, 1) - 1 AS v, unnest({field}) AS value FROM subjects) x USING (case_id) WHERE value IS NOT NULL"


@query(
    f"""WITH nm AS {_NAMES}, raw(case_id, text, kind, ord) AS (
 SELECT case_id, {_Q.format('full_name')}, 'name_main', [0] FROM subjects UNION ALL SELECT case_id, {_Q.format('form')}, 'name', [1, n] FROM nm
 UNION ALL {_cross('name_city', 'cities', 0)} UNION ALL {_cross('name_employer', 'employers', 1)} UNION ALL {_cross('name_school', 'schools', 2)}
 UNION ALL SELECT case_id, {_Q.format('value')}, 'email', [3, v] FROM (SELECT case_id, generate_subscripts(emails, 1) - 1 AS v, unnest(emails) AS value FROM subjects) WHERE value IS NOT NULL
 UNION ALL SELECT case_id, {_Q.format("regexp_replace(trim(value, ' '), '^@+', '')")}, 'username', [4, v] FROM (SELECT case_id, generate_subscripts(usernames, 1) - 1 AS v, unnest(usernames) AS value FROM subjects) WHERE value IS NOT NULL
 UNION ALL SELECT case_id, {_Q.format('form')}, 'phone', [5, v, k] FROM (SELECT case_id, v, generate_subscripts(f, 1) - 1 AS k, unnest(f) AS form FROM (SELECT case_id, v, list_filter(r, lambda x, i: list_position(r, x) = i) AS f FROM (SELECT case_id, v, {_FORMS.replace('list_distinct', '')} AS r FROM (SELECT *, substr(nat, 1, 3) AS a, substr(nat, 4, 3) AS b, substr(nat, 7, 2) AS c, substr(nat, 9, 2) AS e FROM {_PHONES}))))
 UNION ALL SELECT case_id, {_Q.format('form')} || ' ' || filter, kind, [6, list_position({list(matrix.KINDS[8:])}, kind), g, n] FROM nm, (SELECT kind, g, CASE WHEN count(*) > 1 THEN '(' || string_agg('site:' || domain, ' OR ' ORDER BY ord) || ')' ELSE 'site:' || min(domain) END AS filter FROM (SELECT domain, ord, kind, (row_number() OVER (PARTITION BY kind ORDER BY ord) - 1) // 8 AS g FROM (SELECT kind, domain, min(ord) AS ord FROM {_SITES} WHERE domain <> '' GROUP BY kind, domain)) GROUP BY kind, g)),
k AS (SELECT case_id, trim(regexp_replace({_TRLOW.format('text')}, '[\\s\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g'), ' ') AS key, text, kind, ord, list_position({list(matrix.KINDS)!r}, kind) - 1 AS priority FROM raw),
o AS (SELECT case_id, key, min(ord) AS ord, arg_min({{'t': text, 'k': kind, 'p': priority}}, {{'p': priority, 'o': ord}}) AS q FROM k GROUP BY case_id, key)
SELECT case_id, q.t AS text, q.k AS kind, CAST(q.p AS INT) AS priority, CAST(row_number() OVER (PARTITION BY case_id ORDER BY q.p, ord) AS INT) AS place FROM o"""
)
def query_matrix(spark, d):
    sites = dictionaries.site_domains(spark, {"site_queries": SITE_QUERIES}, table(spark, d, "brokers"))
    return matrix.dedupe(matrix.raw_queries(table(spark, d, "subjects"), sites))


@query("SELECT kind, 2 * count(*) AS pages, CAST(0 AS BIGINT) AS from_cache FROM (" + ORACLES["query_matrix"] + ") GROUP BY kind")
def query_costs(spark, d):
    return matrix.cost(query_matrix(spark, d), page_size=10, max_results=20)


@query("SELECT * FROM (" + ORACLES["query_matrix"] + ") WHERE place <= 25")
def limited_matrix(spark, d):
    return matrix.limited(query_matrix(spark, d), 25)


# ---- results -----------------------------------------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT case_id, query_text, provider, url, min(seq) AS seq FROM search_results WHERE regexp_matches(lower(trim(url, ' ')), '^https?://') GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id, query_text, provider ORDER BY seq) AS position FROM o) SELECT case_id, query_text, provider, url, seq, CAST(position AS INT) AS position FROM p WHERE position <= 20"""
)
def paged_results(spark, d):
    r = table(spark, d, "search_results")
    return results.absolute_positions(r, 20).select("case_id", "query_text", "provider", "url", "seq", "position")


@query(
    """WITH c AS (SELECT case_id, query_text, provider, min(seq) AS ord, min(query_kind) <> 'name_main' AS cached FROM search_results GROUP BY 1, 2, 3),
s AS (SELECT *, sum(CASE WHEN cached THEN 0 ELSE 1 END) OVER (PARTITION BY case_id ORDER BY ord) AS spent FROM c)
SELECT case_id, query_text, provider, ord, CASE WHEN cached THEN 'cached' WHEN spent <= 5 THEN 'called' ELSE 'skipped' END AS status FROM s"""
)
def budgeted_calls(spark, d):
    c = table(spark, d, "search_results").groupBy("case_id", "query_text", "provider").agg(F.min("seq").alias("ord"), (F.min("query_kind") != "name_main").alias("cached"))
    return results.within_budget(c, 5).select("case_id", "query_text", "provider", "ord", "status")


_HITS = f"""(WITH r AS (SELECT *, coalesce(trim(snippet, ' '), '') <> '' AS filled, coalesce(trim(title, ' '), '') <> '' AS titled, coalesce(provider IN ({_GOOGLE}), false) AS g FROM {_RESULTS}),
q AS (SELECT case_id, key, list(query_text ORDER BY s) AS queries FROM (SELECT case_id, key, query_text, min(seq) AS s FROM r WHERE query_text IS NOT NULL GROUP BY ALL) GROUP BY ALL),
o AS (SELECT case_id, key, min(seq) AS first_seq, arg_min({{'u': url_norm, 't': title, 's': snippet, 'f': filled}}, seq) AS a, arg_min({{'t': title, 's': snippet, 'n': titled}}, seq) FILTER (filled) AS f, list_sort(list_distinct(list(provider))) AS providers, bool_or(g) AS found_by_google,
 arg_min({{'r': result_pos, 'p': provider}}, {{'g': NOT g, 'p': result_pos, 's': seq}}) FILTER (query_kind = 'name_main' AND result_pos IS NOT NULL) AS k FROM r GROUP BY case_id, key)
SELECT case_id, key, a.u AS url, CASE WHEN NOT a.f AND f IS NOT NULL AND f.n THEN f.t ELSE a.t END AS title, CASE WHEN NOT a.f AND f IS NOT NULL THEN f.s ELSE a.s END AS snippet, coalesce(queries, []) AS queries, providers, found_by_google, k.r AS best_rank, k.p AS rank_provider, first_seq FROM o LEFT JOIN q USING (case_id, key))"""


@query(f"SELECT * FROM {_HITS}")
def merged_hits(spark, d):
    return results.merge_hits(table(spark, d, "search_results"))


@query(f"SELECT case_id, key, best_rank, CAST(row_number() OVER (PARTITION BY case_id ORDER BY coalesce(best_rank, 10000), len(queries) DESC, first_seq) AS INT) AS place FROM {_HITS}")
def hit_order(spark, d):
    return results.ordered_hits(merged_hits(spark, d)).select("case_id", "key", "best_rank", "place")


@query(f"SELECT case_id, key, place FROM (SELECT case_id, key, CAST(row_number() OVER (PARTITION BY case_id ORDER BY coalesce(best_rank, 10000), len(queries) DESC, first_seq) AS INT) AS place FROM {_HITS}) WHERE place <= 200")
def capped_pages(spark, d):
    return results.page_cap(hit_order(spark, d), 200).select("case_id", "key", "place")


@query("SELECT query_kind, provider, count(*) AS n_results, count(DISTINCT query_text) AS n_queries FROM search_results GROUP BY ALL")
def result_counts(spark, d):
    return results.counts(table(spark, d, "search_results"))


# ---- tracker -----------------------------------------------------------------------------------------------------------


@query(f"SELECT h.case_id, h.key FROM {_HITS} h WHERE NOT EXISTS (SELECT 1 FROM {_TRACKED} t WHERE t.case_id = h.case_id AND t.key = h.key)")
def untracked_hits(spark, d):
    return tracker.new_hits(merged_hits(spark, d), table(spark, d, "tracker")).select("case_id", "key")


@query(f"SELECT h.case_id, h.key, t.row_no FROM {_HITS} h JOIN (SELECT case_id, key, max(row_no) AS row_no FROM {_TRACKED} GROUP BY ALL) t ON t.case_id = h.case_id AND t.key = h.key")
def tracked_hits(spark, d):
    return tracker.known_hits(merged_hits(spark, d), table(spark, d, "tracker")).select("case_id", "key", "row_no")


@query(
    f"""WITH n AS (SELECT h.case_id, h.key, h.first_seq FROM {_HITS} h WHERE NOT EXISTS (SELECT 1 FROM {_TRACKED} t WHERE t.case_id = h.case_id AND t.key = h.key)), l AS (SELECT case_id, max(row_no) AS last FROM tracker GROUP BY 1)
SELECT n.case_id, n.key, CAST(coalesce(last, 1) + row_number() OVER (PARTITION BY n.case_id ORDER BY first_seq) AS INT) AS row_no FROM n LEFT JOIN l ON n.case_id = l.case_id"""
)
def allocated_rows(spark, d):
    t = table(spark, d, "tracker")
    return tracker.allocate(tracker.new_hits(merged_hits(spark, d), t), t, "first_seq").select("case_id", "key", "row_no")


_SEEN = f"""(SELECT case_id, key, '2025-01-01' AS checked, best_rank, coalesce(rank_provider IN ({_GOOGLE}), false) AS rank_google, found_by_google FROM {_HITS})"""


def _seen(spark: SparkSession, d: str) -> DataFrame:
    """What the searches of a run saw, from the merged hits: no page was read in it."""
    h = merged_hits(spark, d)
    return h.select(
        "case_id", "key", F.lit("2025-01-01").alias("checked"), F.lit(False).alias("page_ok"), F.lit(None).cast("int").alias("seen_mentions"), F.lit(None).cast("string").alias("seen_types"),
        "best_rank", F.coalesce(F.col("rank_provider").isin(*results.GOOGLE), F.lit(False)).alias("rank_google"), F.lit(True).alias("main_ran"), "found_by_google", F.lit("").alias("screenshot"),
    )


_PLAN = f"""(WITH t AS (SELECT t.*, s.* EXCLUDE (case_id, key) FROM {_TRACKED} t JOIN {_SEEN} s ON t.case_id = s.case_id AND t.key = s.key)
 SELECT case_id, row_no, 'last_checked' AS field, checked AS value, false AS is_clear FROM t
 UNION ALL SELECT case_id, row_no, 'name_rank', CAST(best_rank AS VARCHAR), false FROM t WHERE best_rank IS NOT NULL
 UNION ALL SELECT case_id, row_no, 'name_rank', NULL, true FROM t WHERE best_rank IS NULL AND name_rank IS NOT NULL
 UNION ALL SELECT case_id, row_no, 'notes', CASE WHEN rtrim(notes, ' ') <> '' THEN rtrim(notes, ' ') || chr(10) ELSE '' END || '{tracker.RANK_NOTE}', false FROM t WHERE best_rank IS NOT NULL AND NOT rank_google AND NOT contains(lower(coalesce(notes, '')), '{tracker.RANK_NOTE.lower()}')
 UNION ALL SELECT case_id, row_no, 'indexed', 'Yes', false FROM t WHERE found_by_google)"""


@query(f"SELECT case_id, row_no, field, CASE WHEN field = 'notes' AND value LIKE chr(10) || '%' THEN substr(value, 2) ELSE value END AS value, is_clear FROM {_PLAN}")
def tracker_plan(spark, d):
    return tracker.plan(table(spark, d, "tracker"), _seen(spark, d))


_FETCHED = f"""(SELECT f.case_id, f.key, coalesce(f.status = 200 AND trim(coalesce(f.html, ''), ' ') <> '' AND a.source = 'page', false) AS page_ok, a.mentions AS seen_mentions, coalesce(array_to_string(a.data_types, ', '), '') AS seen_types, f.screenshot
 FROM (SELECT * FROM {keyed_sql('fetches', 'url')} QUALIFY row_number() OVER (PARTITION BY case_id, key ORDER BY fetched_at DESC NULLS LAST, fetch_id DESC) = 1) f
 LEFT JOIN (SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY fetch_id ORDER BY analysed_at DESC NULLS LAST, analysis_id DESC) = 1) a ON a.fetch_id = f.fetch_id)"""
_DIFF = f"""(WITH t AS MATERIALIZED (SELECT t.case_id, t.row_no, t.name_rank, t.notes, t.evidence, p.page_ok, p.seen_mentions, p.seen_types, p.screenshot, h.best_rank, coalesce(h.rank_provider IN ({_GOOGLE}), false) AS rank_google, coalesce(h.found_by_google, false) AS found_by_google,
   t.case_id IN (SELECT case_id FROM search_results WHERE query_kind = 'name_main') AS main_ran
  FROM {_TRACKED} t LEFT JOIN {_HITS} h ON t.case_id = h.case_id AND t.key = h.key LEFT JOIN {_FETCHED} p ON t.case_id = p.case_id AND t.key = p.key)
 SELECT case_id, row_no, 'last_checked' AS field, '2025-01-01' AS value, false AS is_clear FROM t
 UNION ALL SELECT case_id, row_no, 'mentions', CAST(seen_mentions AS VARCHAR), false FROM t WHERE page_ok
 UNION ALL SELECT case_id, row_no, 'data_types_exposed', seen_types, false FROM t WHERE page_ok
 UNION ALL SELECT case_id, row_no, 'name_rank', CAST(best_rank AS VARCHAR), false FROM t WHERE best_rank IS NOT NULL
 UNION ALL SELECT case_id, row_no, 'name_rank', NULL, true FROM t WHERE best_rank IS NULL AND main_ran AND name_rank IS NOT NULL
 UNION ALL SELECT case_id, row_no, 'notes', CASE WHEN rtrim(notes, ' ') <> '' THEN rtrim(notes, ' ') || chr(10) ELSE '' END || '{tracker.RANK_NOTE}', false FROM t WHERE best_rank IS NOT NULL AND NOT rank_google AND NOT contains(lower(coalesce(notes, '')), '{tracker.RANK_NOTE.lower()}')
 UNION ALL SELECT case_id, row_no, 'indexed', 'Yes', false FROM t WHERE found_by_google
 UNION ALL SELECT case_id, row_no, 'evidence', screenshot, false FROM t WHERE coalesce(evidence, '') = '' AND coalesce(screenshot, '') <> '')"""


def _observed(spark: SparkSession, d: str) -> DataFrame:
    """What a rescan saw of every tracked page: searches, fetches and analyses."""
    pages_ = tracker.latest_pages(table(spark, d, "fetches"), table(spark, d, "analyses"))
    return tracker.observations(table(spark, d, "tracker"), merged_hits(spark, d), pages_, table(spark, d, "search_results"), "2025-01-01")


@query(f"SELECT * FROM {_DIFF}")
def tracker_diff(spark, d):
    """The whole rescan. tracker_plan is the part of it that the searches alone give, as its SQL has it."""
    return tracker.plan(table(spark, d, "tracker"), _observed(spark, d))


@query()
def tracker_applied(spark, d):
    t = table(spark, d, "tracker")
    return tracker.applied(t, tracker.plan(t, _observed(spark, d)))


@query("SELECT 'severity' AS field, value, n_rows FROM (SELECT severity AS value, count(*) AS n_rows FROM tracker WHERE severity <> '' GROUP BY 1) WHERE value NOT IN (SELECT entry FROM lists WHERE list_name = 'severity') UNION ALL SELECT 'indexed', value, n_rows FROM (SELECT indexed AS value, count(*) AS n_rows FROM tracker WHERE indexed <> '' GROUP BY 1) WHERE value NOT IN (SELECT entry FROM lists WHERE list_name = 'indexed')")
def vocabulary_misses(spark, d):
    t, v = table(spark, d, "tracker"), table(spark, d, "lists")
    one = lambda f: tracker.outside_vocabulary(t, v, f, f).select(F.lit(f).alias("field"), "value", "n_rows")
    return one("severity").unionByName(one("indexed"))


# ---- report ------------------------------------------------------------------------------------------------------------


@query(
    """WITH i AS (SELECT * FROM tracker WHERE match_confidence IN ('Confirmed', 'Likely')) SELECT 'severity' AS what, severity AS label, count(*) AS n FROM i WHERE severity <> '' GROUP BY ALL
 UNION ALL SELECT 'category', coalesce(nullif(site_category, ''), 'Other'), count(*) FROM i GROUP BY ALL"""
)
def report_counts(spark, d):
    return report.counts(report.items(table(spark, d, "tracker")))


@query(
    "SELECT case_id, row_no, CASE coalesce(severity, '') WHEN 'Critical' THEN 'Kritik' WHEN 'High' THEN 'Yüksek' WHEN 'Medium' THEN 'Orta' WHEN 'Low' THEN 'Düşük' ELSE severity END AS severity, strftime(date_found, '%d.%m.%Y') AS found, CAST(row_number() OVER (PARTITION BY case_id ORDER BY CASE severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 ELSE 9 END, row_no) AS INT) AS place FROM tracker WHERE match_confidence IN ('Confirmed', 'Likely', 'Unverified')"
)
def report_items(spark, d):
    from pyspark.sql.window import Window

    t = report.items(table(spark, d, "tracker"), include_unverified=True)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(*report.order_key("severity")))
    return t.select("case_id", "row_no", report.localised(F.col("severity")).alias("severity"), report.written_date(F.col("date_found"), "tr").alias("found"), place.alias("place"))


@query("SELECT case_id, row_no, printf('evidence/%04d_%s.png', row_no, regexp_replace(coalesce(site_category, 'none'), '[^A-Za-z0-9_.\\-]+', '_', 'g')) AS evidence FROM tracker")
def evidence_names(spark, d):
    return table(spark, d, "tracker").select("case_id", "row_no", F.format_string("evidence/%04d_%s.png", "row_no", F.regexp_replace(F.coalesce("site_category", F.lit("none")), r"[^A-Za-z0-9_.\-]+", "_")).alias("evidence"))


# ---- sources and pages -------------------------------------------------------------------------------------------------


@query("SELECT query_text, seq AS page, url, title, snippet FROM search_results WHERE query_text IS NOT NULL")
def parsed_responses(spark, d):
    """Responses of both providers, staged as JSON and read back."""
    r = table(spark, d, "search_results").where("query_text is not null")
    google = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("position"), F.col("url").alias("link"), "title", "snippet")).alias("organic_results")))
    other = F.to_json(F.struct(F.struct(F.array(F.struct("url", "title", F.col("snippet").alias("description"))).alias("results")).alias("web")))
    odd = F.col("seq") % 2 == 1
    staged = r.select(F.when(odd, "serpapi").otherwise("brave").alias("provider"), "query_text", F.col("seq").alias("page"), F.when(odd, google).otherwise(other).alias("body"))
    return providers.results(staged, ["serpapi", "brave"]).select("query_text", "page", "url", "title", "snippet")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'TR' ELSE 'DE' END AS country FROM supplier")
def registrants(spark, d):
    s = table(spark, d, "supplier")
    org = F.when(F.col("s_suppkey") % 3 == 0, "REDACTED FOR PRIVACY").otherwise(F.col("s_name"))
    body = F.format_string('{"entities":[{"roles":["technical"],"entities":[{"roles":["registrant"],"vcardArray":["vcard",[["org",{},"text","%s"],["adr",{"cc":"%s"},"text",[""]]]]}]}]}', org, F.when(F.col("s_suppkey") % 2 == 0, "tr").otherwise("DE"))
    r = s.select("s_suppkey", enrich.rdap_domain(body).alias("r"))
    return r.select("s_suppkey", enrich.registrant(F.col("r")).alias("owner"), enrich.country_code(F.col("r.country")).alias("country"))


@query(r"SELECT fetch_id, CAST(len(regexp_extract_all(html, '(?i)<a\s')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS BIGINT) AS n_headings, CAST(length(html) AS BIGINT) AS n_chars FROM fetches")
def page_shapes(spark, d):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, d, "fetches").select("fetch_id", count(r"(?i)<a\s").alias("n_links"), count(r"(?i)<h[1-6][\s>]").alias("n_headings"), F.length("html").cast("long").alias("n_chars"))


@query(r"SELECT result_id, list_distinct(regexp_extract_all(lower(snippet), '[a-z0-9._%+\-]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+')) AS emails FROM search_results WHERE regexp_matches(lower(snippet), '[a-z0-9._%+\-]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+')")
def snippet_emails(spark, d):
    found = F.array_distinct(F.regexp_extract_all(F.lower("snippet"), F.lit(pages.EMAIL), F.lit(0)))
    return table(spark, d, "search_results").select("result_id", found.alias("emails")).where("size(emails) > 0")


@query()
def page_sections(spark, d):
    p = spread(table(spark, d, "fetches").where("html is not null").select("fetch_id", "html")).select("fetch_id", pages.sections_of("html").alias("s"))
    return p.select("fetch_id", "s.title", F.length("s.meta").alias("meta_len"), F.length("s.headings").alias("headings_len"), F.length("s.body").alias("body_len"), F.length("s.plain_body").alias("plain_len"), F.length("s.comments").alias("comments_len"), F.size("s.links").alias("n_links"), "s.owner")


@query()
def page_analysis(spark, d):
    """Mentions, places and exposed data types of every page of an authorised subject."""
    s = dictionaries.authorized(table(spark, d, "subjects"))
    f = spread(table(spark, d, "fetches").where("trim(coalesce(html, '')) != ''").select("fetch_id", "case_id", "url", "status", "html")).withColumn("s", pages.sections_of("html")).drop("html")
    photo = findings.photos(table(spark, d, "fetches"), s)
    return pages.analysis(f.join(s, "case_id").join(photo, "fetch_id", "left")).select("fetch_id", "mentions", "places", "data_types", "matched", "contexts", "visible_text_len")


@query()
def removal_links(spark, d):
    f = table(spark, d, "fetches").where("html is not null").select("fetch_id", F.coalesce("final_url", "url").alias("url"), pages.sections_of("html").alias("s"))
    return pages.ranked_links(f)


@query(r"SELECT fetch_id, status IN (404, 410) AS gone, status = 200 AND trim(coalesce(html, ''), ' ') <> '' AS ok, CASE WHEN robots_blocked THEN 'robots' WHEN coalesce(error, '') <> '' THEN 'error' WHEN status IS NOT NULL AND status <> 200 THEN 'HTTP ' || status ELSE '' END AS note FROM fetches")
def fetch_states(spark, d):
    note = F.when(F.col("robots_blocked"), "robots").when(F.coalesce("error", F.lit("")) != "", "error").when(F.col("status").isNotNull() & (F.col("status") != 200), F.concat(F.lit("HTTP "), F.col("status").cast("string"))).otherwise("")
    return table(spark, d, "fetches").select("fetch_id", F.col("status").isin(404, 410).alias("gone"), ((F.col("status") == 200) & (F.trim(F.coalesce("html", F.lit(""))) != "")).alias("ok"), note.alias("note"))


@query()
def raw_lines(spark, d):
    return sinks.raw_lines(table(spark, d, "fetches"))


@query(
    f"""SELECT r.result_id, EXISTS (SELECT 1 FROM (SELECT unnest(s.keep_accounts) AS a) WHERE regexp_replace(regexp_replace({fold_sql("trim(a, ' ')")}, '^(https://)?(http://)?(www\\.)?', ''), '/+$', '') <> '' AND contains({fold_sql('r.url')}, regexp_replace(regexp_replace({fold_sql("trim(a, ' ')")}, '^(https://)?(http://)?(www\\.)?', ''), '/+$', ''))) AS kept FROM search_results r JOIN subjects s USING (case_id) WHERE r.url IS NOT NULL"""
)
def kept_accounts(spark, d):
    r, s = table(spark, d, "search_results").where("url is not null"), table(spark, d, "subjects").select("case_id", "keep_accounts")
    return r.join(s, "case_id").select("result_id", classify.keeps(F.col("url"), F.col("keep_accounts")).alias("kept"))
