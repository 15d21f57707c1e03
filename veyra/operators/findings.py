"""What a page or, failing that, a search result says of a subject: photos next to the name, imprint links, analysis of snippets,
and the choice between the two sources."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.functions import ident, text
from veyra.functions.urls import hostname
from veyra.operators import pages
from veyra.operators.pageblocks import HIDDEN, RAW, VOID, _ATTR, _TOKEN, collapse, unescape

# Images that show no person.
ICON = r"logo|icon|sprite|avatar-default|placeholder|pixel|spacer|badge"
SMALL = 48
ANCESTORS, LONGEST = 3, 600
_icon = re.compile(ICON)
_size = re.compile(r"""\b(width|height|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


def photo_contexts(html: str | None) -> list[str]:
    """For each image that is no icon: its alt and title, and the text of its nearest ancestors up to a long one."""
    if not html or "<img" not in html.lower():
        return []
    buffer: list[str] = []
    length = 0
    spans: list[list[int]] = []  # start and end of each element's text
    stack: list[tuple[str, int]] = []
    images: list[tuple[str, list[int]]] = []
    at, hidden = 0, None

    def add(s: str) -> None:
        nonlocal length
        if s.strip():
            s = collapse(unescape(s)) + " "
            buffer.append(s)
            length += len(s)

    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        if hidden is None:
            add(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if hidden is not None:
            if m[1] and tag == hidden:
                hidden = None
            continue
        if tag in HIDDEN and not m[1]:
            if tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            else:
                hidden = tag
            continue
        if tag == "img":
            a = {x[1].lower(): unescape(x[2].strip("\"'")) for x in [*_ATTR.finditer(m[3]), *_size.finditer(m[3])]}
            small = any(a.get(k, "").isdigit() and int(a[k]) < SMALL for k in ("width", "height"))
            if not small and not _icon.search(a.get("src", "").lower()):
                images.append((f"{a.get('alt', '')} {a.get('title', '')}", [i for _, i in stack[-ANCESTORS:]][::-1]))
        elif m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, k in stack[i:]:
                        spans[k][1] = length
                    del stack[i:]
                    break
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append((tag, len(spans)))
            spans.append([length, -1])
    if hidden is None:
        add(html[at:])
    whole = "".join(buffer)
    out = []
    for label, ancestors in images:
        near = [label]
        for k in ancestors:
            start, end = spans[k]
            t = whole[start : end if end >= 0 else len(whole)].strip()
            if len(t) > LONGEST:
                break
            near.append(t)
        out.append("\n".join(near))
    return out


def _contexts(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in it:
        yield html.map(photo_contexts)


def photos(fetches: DataFrame, subjects: DataFrame) -> DataFrame:
    """fetch_id, photo: an image whose label or surroundings name the subject. Null html has none."""
    f = fetches.select("fetch_id", "case_id", F.pandas_udf(_contexts, "array<string>").asNondeterministic()("html").alias("near"))
    s = subjects.select("case_id", ident.distinct_names(F.col("full_name"), F.col("name_variants")).alias("names"))
    each = f.join(s, "case_id").select("fetch_id", "names", F.explode_outer("near").alias("n")).withColumn("n", text.fold(F.coalesce("n", F.lit(""))))
    named = F.exists("names", lambda p: F.coalesce(F.call_function("rlike", F.col("n"), text.phrase_pattern(p)), F.lit(False)))
    return each.groupBy("fetch_id").agg(F.max(named).alias("photo"))


def imprint_links(pages_: DataFrame, key: str = "fetch_id", url: str = "url", first: int = 3) -> DataFrame:
    """key, hrefs: the first links (a top-3 report) of the same host that lead to an imprint. pages_: key, url, sections s."""
    x = pages_.select(key, url, pages.absolute_links(F.col(url), "s.links").alias("hrefs"), "s.links").select(key, url, F.posexplode(F.arrays_zip("hrefs", F.col("links.text").alias("text"), F.col("links.href").alias("raw"))).alias("pos", "l"))
    hay = text.fold_latin(F.concat_ws(" ", "l.text", "l.raw"))
    good = x.where(hay.rlike(pages.IMPRINT_HINT) & (hostname(F.col("l.hrefs")) == hostname(F.col(url)))).groupBy(key, F.col("l.hrefs").alias("href")).agg(F.min("pos").alias("pos"))
    place = good.withColumn("n", F.expr(f"row_number() over (partition by {key} order by pos)")).where(F.col("n") <= first)
    return place.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "href"))), lambda s: s["href"]).alias("hrefs"))


def snippet_analysis(rows: DataFrame, subjects: DataFrame, keep: tuple[str, ...] = ("result_id",)) -> DataFrame:
    """keep, mentions (0), places, data_types, matched, contexts of search results: title, snippet and url stand in for the page."""
    none = F.lit(None).cast("string")
    s = F.struct(F.concat_ws(" ", "title", "snippet").alias("title"), none.alias("meta"), none.alias("headings"), none.alias("body"), none.alias("plain_body"), none.alias("alts"), none.alias("captions"), none.alias("comments"))
    x = pages.analysis(rows.withColumn("s", s).join(pages.with_patterns(subjects), "case_id"))
    places = F.transform(F.filter("places", lambda p: p.isin("Title", "URL slug")), lambda p: F.when(p == "Title", "Search snippet").otherwise(p))
    return x.select(*keep, F.lit(0).alias("mentions"), places.alias("places"), "data_types", "matched", "contexts")


def source_of(ok: Column, hit: Column) -> Column:
    """page if one was read, snippet if a search found it, else null; only pages have observed mentions."""
    return F.when(ok, "page").when(hit, "snippet")
