"""Main body of a page: consensus host paths.

1. score    each page's containers (elements that group blocks) get a score from their own structure: sentences, facts and links
            per block, names of elements, classes and ids, place before or after the headline, small headings. A block adds its
            own text, and whether that text stands on many hosts. Cue words are one weak sign among these; none of them decides.
2. vote     per host, the scores of all blocks on one generalised path are averaged: tags and classes, the last heading's tag,
            the shape of the block's text, and whether the text stands on many hosts. A host's votes are shrunk to those of the
            same path on all hosts, and these to the path's without its classes.
3. extract  paths with a positive vote win, and every page is extracted again by the winning paths of its host; a block's own
            score only tips paths on which the votes are close.

Votes are grouped in Spark with partial aggregation (a host with a third of all pages arrives as a few rows per task), and
join back on (host, path). Nothing per host or per page is collected.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.functions.urls import hostname
from veyra.llm.encoding import TURKISH_BYTES, plain_repair
from veyra.operators.pageblocks import Block, blocks, title
from veyra.session import cut, spread

# Names of page parts on the web at large, and a few general words of page furniture.
FURNITURE_NAMES = "menu|nav|navbar|crumb|breadcrumb|sidebar|side|footer|header|cookie|consent|comment|yorum|related|share|social|ad|ads|advert|promo|widget|newsletter"
CONTENT_NAMES = "content|main|article|post|story|entry|body-?text"
CUES = r"©|copyright|cookie|çerez|privacy|gizlilik|datenschutz|confidentialité|rights reserved|hakları saklıdır|rechte vorbehalten|droits réservés|share this|paylaş|teilen|partager|subscribe|abone|abonne|newsletter|\bapp\b|uygulama|bildirimleri|benachrichtigung|advertis|reklam|anzeige|publicité"
SECTION_CUES = r"\b(?:comments?|yorum|kommentare|commentaires|related|similar|most read|see also|benzer|ilgili|okunan|ähnlich|meistgelesen|voir aussi|similaires)"

_furniture = re.compile(rf"(?:^|[#.\-_ ])(?:{FURNITURE_NAMES})")
_content = re.compile(rf"(?:^|[#.\-_ ])(?:{CONTENT_NAMES})")
_cue, _section_cue = re.compile(CUES), re.compile(SECTION_CUES)
_sentence = re.compile(r"[.!?…](?:[\"'”»)]*)(?:\s|$)")
_date = re.compile(r"\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\.? [^\W\d_]+ \d{4}\b|\b[^\W\d_]+ \d{1,2}, \d{4}\b")
_fact = re.compile(r"[^:.!?]{2,28}:\s?\S")
_separated = re.compile(r"\S\s*[|·›»•]\s*\S|\S\s/\s\S")
_TURKISH = str.maketrans(TURKISH_BYTES)  # for cue words only; the text itself stays as it stands
_GROUP = frozenset("body div section article main aside nav header footer ul ol dl table td form center figure details".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LEAVES = frozenset("p li dt dd th tr".split())


class Scored(NamedTuple):
    text: str
    key: str  # generalised path, but for what only the corpus tells
    bare: str  # the same without classes and ids
    score: float  # local log-odds of main body
    shape: str  # L links, S sentences, d short with a date, b separated labels, s short, l long
    tag: str  # innermost element
    code: int  # characters within code


def _tag(label: str) -> str:
    return re.split(r"[.#]", label, maxsplit=1)[0]


def _shape(b: Block, tags: list[str], words: int, sentences: int, cell: bool) -> str:
    if b.link > 0.8 * len(b.text):
        return "L"
    if tags[-1:] and tags[-1] in _HEADINGS:
        return "h"
    if cell or _is_fact(b, tags, words):
        return "f"
    if words <= 30 and _separated.search(b.text):
        return "b"
    if sentences and words >= 5:
        return "S"
    if words <= 9 and _date.search(b.text):
        return "d"
    return "s" if words <= 8 else "l"


def _is_fact(b: Block, tags: list[str], words: int) -> bool:
    """A label with its value, or a cell of a table or description list that is not there for the layout."""
    return tags[-1:] in (["dt"], ["dd"], ["th"]) or tags[-1:] == ["td"] and tags.count("table") > 1 or words <= 14 and bool(_fact.match(b.text)) and not b.link


def _headline(bs: list[Block], tags: list[list[str]]) -> int:
    """Index of the page's headline: the first h1, else the first h2, else, of the lines before the
    first sentences or facts, the first in bold or the last plain one; -1 if there is none."""
    for wanted in ("h1", "h2"):
        for i, t in enumerate(tags):
            if t and t[-1] == wanted:
                return i
    told = lambda i, b: len(b.text.split()) >= 8 and _sentence.search(b.text) or _is_fact(b, tags[i], len(b.text.split()))
    first = next((i for i, b in enumerate(bs) if told(i, b) and not _cue.search(plain_repair(b.text).lower())), len(bs))
    plain = [i for i in range(first) if len(bs[i].text.split()) >= 2 and not bs[i].link and not _separated.search(bs[i].text) and not _date.search(bs[i].text) and "li" not in tags[i]]
    bold = [i for i in plain if bs[i].bold >= 0.9 * len(bs[i].text)]
    return bold[0] if bold else plain[-1] if plain and first < len(bs) else -1


def score_blocks(bs: list[Block]) -> list[Scored]:
    """Local scores of a page's blocks, in order: that of their container and of their own text."""
    tags = [[_tag(x) for x in b.path] for b in bs]
    head = _headline(bs, tags)
    around = set(bs[head].ids) if head >= 0 else {b.ids[0] for b in bs if b.ids}  # elements the headline stands in
    words = [len(b.text.split()) for b in bs]
    sentences = [len(_sentence.findall(b.text)) for b in bs]
    lower = [plain_repair(b.text).translate(_TURKISH).lower().replace("i̇", "i") for b in bs]
    # A cell is data, not layout, if the headline is not in its table.
    cells = [t[-1:] == ["td"] and "table" in t and b.ids[len(t) - 1 - t[::-1].index("table")] not in around for b, t in zip(bs, tags)]
    owner: list[int] = []
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(bs):
        at = max((k for k, t in enumerate(tags[i]) if t in _GROUP and not (t == "td" and tags[i][:k].count("table") > 1)), default=-1)
        owner.append(b.ids[at] if at >= 0 else 0)
        groups.setdefault(owner[-1], []).append(i)

    # What stands under a small heading: the rest of the element the heading is in, or the list after it if the headline is in there too.
    under, above = [0.0] * len(bs), ["top"] * len(bs)
    scope: tuple[int, float, bool] | None = None  # element, penalty, lists only
    last = "top"
    for i, b in enumerate(bs):
        t = tags[i][-1] if tags[i] else ""
        if scope is not None and (scope[0] not in b.ids or scope[2] and "li" not in tags[i] or t in ("h1", "h2")):
            scope = None
        if t in _HEADINGS[2:] and words[i] <= 8:
            parent = b.ids[-2] if len(b.ids) > 1 else 0
            scope = (parent, 3.5 + 2.0 * bool(_section_cue.search(lower[i])), parent in around)
        if scope is not None:
            under[i] = scope[1]
        if i == head:
            last = "head"
        elif t in _HEADINGS:
            last = t + ("c" if scope is not None and scope[1] > 4 else "")
        above[i] = last if scope is not None or not last.startswith(("h3", "h4", "h5", "h6")) else last + "-"

    kin: dict[int, list[bool]] = {}  # names of the elements side by side, by their parent
    for g, own in groups.items():
        at = bs[own[0]].ids.index(g) if g in bs[own[0]].ids else 0
        if at and bs[own[0]].ids[at - 1] not in around:
            kin.setdefault(bs[own[0]].ids[at - 1], []).append(bool(_furniture.search(bs[own[0]].path[at])))
    container: dict[int, float] = {}
    for g, own in groups.items():
        n, chars = len(own), max(sum(len(bs[i].text) for i in own), 1)
        names = bs[own[0]].path[1 : bs[own[0]].ids.index(g) + 1] if g in bs[own[0]].ids else ()
        outer = [_tag(x) for x in names]
        s = -0.8 + 1.2 * min(sum(sentences[i] for i in own) / n, 2.0)
        s -= 2.0 * (sum(bs[i].link for i in own) > 0.6 * chars)
        s += 1.6 if own[-1] >= head else -1.6
        facts = sum((cells[i] or _is_fact(bs[i], tags[i], words[i])) and not _cue.search(lower[i]) for i in own)
        s += 2.0 * facts / n
        s += 1.0 * ("ol" in outer) - 4.0 * any(x in ("nav", "footer", "aside") for x in outer)
        said = " ".join(names)
        s -= 3.0 * bool(_furniture.search(said)) and 3.0
        s += 1.5 * bool(_content.search(said))
        at = bs[own[0]].ids.index(g) if g in bs[own[0]].ids else 0
        beside = kin.get(bs[own[0]].ids[at - 1], []) if at else []
        s -= 3.0 * (3 * sum(beside) >= len(beside) > 1) * (not _furniture.search(said))
        container[g] = s

    out = []
    for i, b in enumerate(bs):
        t = tags[i][-1] if tags[i] else ""
        shape = "h" if i == head else _shape(b, tags[i], words[i], sentences[i], cells[i])
        s = container[owner[i]] - under[i] + 0.4 * min(sentences[i], 4) + 0.03 * min(words[i], 40)
        s += 2.5 * (t in ("h1", "h2") or i == head) + 1.0 * (t == "blockquote")
        s -= 3.5 * (i < head and owner[i] in around)
        s -= 2.5 * above[i].endswith("-") * (i > head)  # after a section of furniture
        s -= 3.5 * (shape == "d") + 2.0 * (shape == "b")
        if words[i] <= 60 and _cue.search(lower[i]):
            s -= 3.5
        if words[i] <= 14 and _section_cue.match(lower[i]):
            s -= 3.0
        path, plain, end = ">".join(re.sub(r"\d+", "#", x) for x in b.path[1:]), ">".join(tags[i][1:]), f"@{above[i]}:{shape}"
        out.append(Scored(b.text, path + end, plain + end, max(-4.0, min(4.0, s)), shape, t, b.code))
    return out


def host_of(url: Column) -> Column:
    """Host of a url as fetched, wrappers and white space ignored; '' for null."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^\p{L}\p{N}]+|\s+", "")
    return F.regexp_replace(F.coalesce(hostname(F.when(bare.contains("://"), bare).otherwise(F.concat(F.lit("http://"), bare))), F.lit("")), r"^www\.", "")


WALKED = "struct<title:string,blocks:array<struct<text:string,key:long,bare:long,score:float,shape:string,tag:string,code:int>>>"


def walked(fetches: DataFrame) -> DataFrame:
    """(fetch_id, host, status, title, blocks): every fetch with non-blank html, parsed and scored once for all that follows.

    status is null where fetches has no such column. The result is written to the shared folder: it holds each page's visible text once.
    """
    status = F.col("status").cast("int") if "status" in fetches.columns else F.lit(None).cast("int")
    rows = fetches.select("fetch_id", host_of(F.coalesce("final_url", "url")).alias("host"), status.alias("status"), "html").where(F.col("html").rlike(r"(?U)[^\s]"))
    number = lambda s: int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)

    @F.pandas_udf(WALKED)
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in it:
            got = [[{"text": x.text, "key": number(x.key), "bare": number(x.bare), "score": x.score, "shape": x.shape, "tag": x.tag, "code": x.code} for x in score_blocks(blocks(h))] for h in html]
            yield pd.DataFrame({"title": html.map(title), "blocks": got})

    return cut(spread(rows).select("fetch_id", "host", "status", of("html").alias("w")).select("fetch_id", "host", "status", "w.*"), "pages")


HOSTS, HOST_SHARE = 3, 0.005  # a text is repeated if it stands on so many hosts and on this share of all hosts
REPEATED = {"S": 4.0, "b": 3.0, "L": 3.0, "h": 0.0}  # what that costs, by shape; 1.5 for the others
PRIOR, BARE_PRIOR = 30.0, 30.0  # votes of the path on all hosts that stand in for a host's own; of the bare path for those
OWN = 0.25  # weight of a block's own score beside its path's vote


def voted(pages: DataFrame) -> DataFrame:
    """(fetch_id, host, digest, score, vote): all blocks of `pages` (see walked) with the vote of their host's path. digest is the md5
    of the text as 16 bytes: the text itself goes through no shuffle."""
    b = pages.select("fetch_id", "host", F.inline("blocks")).withColumns({"t": F.xxhash64("text"), "digest": F.unhex(F.md5("text"))}).drop("text")
    hosts = pages.agg(F.countDistinct("host")).first()[0]
    # At most (texts of a host on average) / HOST_SHARE texts can be repeated.
    spread_texts = b.groupBy("t", "host").agg(F.count("*").alias("n")).groupBy("t").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= max(HOSTS, HOST_SHARE * hosts))
    b = b.join(spread_texts.select("t", F.lit(True).alias("repeated")), "t", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    cost = F.lit(1.5)
    for shape, x in REPEATED.items():
        cost = F.when(F.col("shape") == shape, x).otherwise(cost)
    score = F.col("score") - F.when(F.col("repeated"), cost).otherwise(0.0)
    b = b.select("fetch_id", "host", "digest", F.xxhash64("key", "repeated").alias("path"), F.xxhash64("bare", "repeated").alias("bare"), score.alias("score"))
    own = b.groupBy("host", "path", "bare").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    path = own.groupBy("path", "bare").agg(F.sum("s").alias("ps"), F.sum("n").alias("pn"))
    bare = path.groupBy("bare").agg((F.sum("ps") / F.sum("pn")).alias("mean"))
    prior = path.join(bare, "bare").select("path", ((F.col("ps") + BARE_PRIOR * F.col("mean")) / (F.col("pn") + BARE_PRIOR)).alias("prior"))
    votes = own.join(prior, "path").select("host", "path", ((F.col("s") + PRIOR * F.col("prior")) / (F.col("n") + PRIOR)).alias("vote"))
    return b.join(votes, ["host", "path"]).select("fetch_id", "host", "digest", "score", "vote")


def main_blocks(pages: DataFrame, excluded: DataFrame, vote_weight: float = 1.0) -> DataFrame:
    """(fetch_id, block_md5): the distinct main-body blocks of each of `pages` (see walked) that is not in `excluded` (fetch_id).

    Null, blank and text-free html give no row. Repeated deliveries are fetches of their own. A host seen once relies on the votes
    for the same paths on all hosts. An empty table gives no row. vote_weight is there to measure what the votes add.
    """
    b = voted(pages.join(excluded.select("fetch_id"), "fetch_id", "left_anti"))
    won = vote_weight * F.col("vote") + OWN * F.col("score") > 0
    return b.where(won).select("fetch_id", "digest").distinct().select("fetch_id", F.lower(F.hex("digest")).alias("block_md5"))
