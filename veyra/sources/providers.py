"""Search responses as tables: a registry of response parsers, the cache key, and the rows of one response.

Responses are staged as (provider, query_text, page, body JSON); there is no network code here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARSERS: dict[str, tuple[int, Callable[[DataFrame], DataFrame]]] = {}


def register(name: str, page_size: int):
    """Decorator: a parser turns staged responses of one provider into url, title, snippet, more rows with their place `i`."""

    def add(parser: Callable[[DataFrame], DataFrame]):
        _PARSERS[name] = (page_size, parser)
        return parser

    return add


def page_size(name: str) -> int:
    if name not in _PARSERS:
        raise KeyError(f"unknown provider {name}; known: {', '.join(sorted(_PARSERS))}")
    return _PARSERS[name][0]


def _strip_tags(c: str) -> Column:
    return F.regexp_replace(F.col(c), r"<[^>]+>", "")


@register("serpapi", 10)
def google_backed(df: DataFrame) -> DataFrame:
    body = F.from_json("body", "organic_results array<struct<position:int,link:string,title:string,snippet:string>>, serpapi_pagination struct<next:string>")
    x = df.withColumn("b", body).select("provider", "query_text", "page", F.col("b.serpapi_pagination.next").isNotNull().alias("more"), F.posexplode("b.organic_results").alias("i", "r"))
    return x.select("provider", "query_text", "page", "i", F.col("r.link").alias("url"), F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet"), "more")


@register("brave", 20)
def brave(df: DataFrame) -> DataFrame:
    body = F.from_json("body", "web struct<results:array<struct<url:string,title:string,description:string>>>, query struct<more_results_available:boolean>")
    x = df.withColumn("b", body).select("provider", "query_text", "page", F.coalesce("b.query.more_results_available", F.lit(False)).alias("more"), F.posexplode("b.web.results").alias("i", "r"))
    x = x.select("provider", "query_text", "page", "i", F.col("r.url").alias("url"), F.col("r.title").alias("t"), F.col("r.description").alias("d"), "more")
    return x.select("provider", "query_text", "page", "i", "url", _strip_tags("t").alias("title"), _strip_tags("d").alias("snippet"), "more")


def results(staged: DataFrame, names: list[str]) -> DataFrame:
    """Rows of all staged responses of the named providers; a body that is no JSON of the provider's form gives no rows."""
    parts = [_PARSERS[n][1](staged.where(F.col("provider") == n)) for n in names if page_size(n)]
    return reduce(DataFrame.unionByName, parts)


def cache_key(provider: Column, url: Column, params: Column, secrets: tuple[str, ...] = ("api_key", "key", "token")) -> Column:
    """Hash of a request without its secrets; params is a map<string,string>."""
    public = F.map_filter(params, lambda k, v: ~k.isin(*secrets))
    pairs = F.array_sort(F.transform(F.map_entries(public), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.sha2(F.to_json(F.struct(provider.alias("provider"), url.alias("url"), pairs.alias("params"))), 256)
