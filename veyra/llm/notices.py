"""Template residue and error-page text: a regularised linear classifier on hashed n-grams, length and title features.

Weak labels come from the response status and from a handful of phrases. They are thin on purpose: most notices carry none of the
phrases, a page can fail with status 200, and real content can come with an error status. Status counts only where the text is
short, phrases only where it is short or a placeholder stands open; all other pages are left to the classifier. It is fitted on a
bounded sample of labelled pages (`sample`, by a hash of the id) of three quarters of the hosts and validated on the other
hosts, on pages that the response status alone tells apart (`p7_validation`), which no phrase takes part in.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veyra.llm.encoding import TURKISH_BYTES, plain_repair
from veyra.llm.mainbody import walked
from veyra.session import cut

DIM = 1 << 15
MARKS = 1 << 10  # ids below are marks: length, structure and title features
MARK_VALUE = 0.35
SAMPLE = 20_000
L2 = 1e-4
CUT = 0.5
OUT = -2.0  # blocks of a lower score are furniture; placeholders count in all others

# The few phrases that weak labels use.
PHRASES = r"\b404\b|not found|access denied|loading|javascript|bulunamad|erişim|yükleniyor|nicht gefunden|introuvable"
FILLER = r"lorem ipsum|dolor sit amet"
PLACEHOLDER = (
    r"\{\{\s*[\w.|\- ]+\s*\}\}|\$\{\s*[\w.]+\s*\}|<%=?\s*[\w.]+\s*%>|\[\[\s*[\w. ]+\s*\]\]|@@[\w.]+@@|##[\w.]+##|__[A-Za-zÇĞİÖŞÜçğıöşü][\w.]*?__|(?<![\w%])%[A-Za-zÇĞİÖŞÜçğıöşü_.]{3,}%|(?<![\w{$])\{[A-Za-zÇĞİÖŞÜçğıöşü_.]+\}"
    r"|\[(?!at\]|dot\]|nokta\]|et\]|punkt\]|arobase\]|point\])[A-Za-zÇĞİÖŞÜçğıöşü_.]{3,}\](?!\s*[\w.-]+\s*\[)|#\{\s*[\w.]+\s*\}|\{%\s*.*?%\}"
)
_phrase, _filler, _placeholder = (re.compile(x) for x in (PHRASES, FILLER, PLACEHOLDER))
_word = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_turkish = str.maketrans(TURKISH_BYTES)


def _norm(s: str) -> str:
    return plain_repair(s).translate(_turkish).lower().replace("i̇", "i")


class Page(NamedTuple):
    tokens: list[int]  # hashed features, distinct
    weak: int  # 1 notice, 0 content, -1 no label
    length: int  # characters of the core text
    by_status: int  # the label that status and length alone suggest


def _h(s: str, low: int = MARKS, high: int = DIM) -> int:
    return low + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (high - low)


class Piece(NamedTuple):
    """What features() needs of a block (see mainbody.Scored)."""

    text: str
    score: float
    tag: str
    code: int


def features(name: str, bs: list[Piece], status: int | None) -> Page:
    """Features of one page from its title and blocks. All of its text is read."""
    core = [b for b in bs if b.score > 0] or sorted(bs, key=lambda b: -b.score)[:1]
    head = _norm(name or "").split(" | ")[0]
    top = _norm(core[0].text) if core else ""
    holes = code = letters = 0
    body = []
    for b in bs:
        if b.score <= OUT:
            continue
        t = plain_repair(b.text)
        found = _placeholder.findall(t)
        if found:
            coded = b.code > 0 or re.search(r"[\"'“‘«`]\s*(?:%s)" % PLACEHOLDER, t)
            holes += 0 if coded else len(found)
            code += len(found) if coded else 0
            t = _placeholder.sub(" ", t)
        if b not in core:
            continue
        letters += len(t)
        body.append(t.translate(_turkish).lower().replace("i̇", "i"))
    text = "\n".join(body)
    words = _word.findall(text)
    sentences = [s for s in re.split(r"[.!?]\s+|\n", text) if len(s) > 8]
    repeated = 1 - len(set(sentences)) / len(sentences) if len(sentences) >= 3 else 0.0
    if len(words) >= 12:  # the same words over and over, also without full stops
        parts = [words[i : i + 40] for i in range(0, max(len(words) - 11, 1), 40)]
        repeated = max(repeated, 1 - sum(len(set(p)) / len(p) for p in parts) / len(parts) - 0.2)
    facts = sum(b.tag in ("dd", "td", "li") for b in core)
    prose = sum(len(s.split()) >= 5 for s in sentences)
    short = letters < 200

    size = f"L{min(int(np.log2(letters + 1)), 14)}"
    marks = [size, f"P{min(holes, 3)}", f"C{min(code, 2)}", f"R{int(max(repeated, 0) * 4)}", f"facts{min(facts, 4)}", f"prose{min(prose, 4)}", f"blocks{min(len(bs), 6)}"]
    marks += [f"{m}&{size}" for m in (f"prose{min(prose, 2)}", f"facts{min(facts, 2)}", f"holes{min(holes, 1)}")]
    if _placeholder.search(plain_repair(name or "")):
        marks.append("title=hole")
    if head and top and (head in top or top in head):
        marks.append("title=top")
    grams = [f"t:{w}" for w in _word.findall(head)] + [f"h:{w}" for w in _word.findall(top)]
    plain = [re.sub(r"\d+", "0", w) for w in words]
    where = "s" if short else "b"
    grams += [f"{where}:{w}" for w in plain] + [f"{where}:{a} {b}" for a, b in zip(plain, plain[1:])]

    bad = status is not None and status >= 400
    phrase = bool(_phrase.search(text if short else top) or _phrase.search(head))
    weak = -1
    if holes or _filler.search(text) or repeated >= 0.5:
        weak = 1
    elif short and facts < 2 and (bad or phrase):
        weak = 1
    elif not phrase and (not bad and (letters >= 120 and prose >= 2 or facts >= 3) or letters >= 400 and prose >= 4):
        weak = 0
    by_status = 1 if bad and short else 0 if status == 200 and not short else -1
    return Page(sorted({_h(m, 0, MARKS) for m in marks} | {_h(g) for g in grams}), weak, letters, by_status)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def _design(tokens: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    cols = np.fromiter((c for t in tokens for c in t), dtype=np.int64, count=len(rows))
    grams = np.bincount(rows, cols >= MARKS, minlength=len(tokens))
    values = np.where(cols < MARKS, MARK_VALUE, 1 / np.sqrt(np.maximum(grams[rows], 1)))
    return rows, cols, values


def fit(tokens: list[list[int]], y: np.ndarray, l2: float = L2, steps: int = 400, rate: float = 1.0) -> Model:
    """L2-regularised logistic regression by full-batch gradient steps with per-feature scaling, classes weighted equally.
    A page's n-grams have unit length together and its marks a fixed value, so long texts do not outvote structure."""
    w, b, acc = np.zeros(DIM), 0.0, np.full(DIM, 1e-8)
    if len(y) == 0 or y.min() == y.max():
        return Model(w, 10.0 if len(y) and y.min() == 1 else -10.0)
    rows, cols, values = _design(tokens)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    accb = 1e-8
    for _ in range(steps):
        z = np.bincount(rows, values * w[cols], minlength=len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(cols, values * g[rows], minlength=DIM) + l2 * w
        acc += grad**2
        w -= rate * grad / np.sqrt(acc)
        accb += g.sum() ** 2
        b -= rate * g.sum() / np.sqrt(accb)
    return Model(w, float(b))


def predict(model: Model, tokens: list[list[int]]) -> np.ndarray:
    if not tokens:
        return np.zeros(0)
    rows, cols, values = _design(tokens)
    z = np.bincount(rows, values * model.weights[cols], minlength=len(tokens)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def page_features(pages: DataFrame) -> DataFrame:
    """fetch_id, held_out, tokens, weak, length, by_status of every page (see mainbody.walked)."""

    @F.pandas_udf("struct<tokens:array<int>,weak:int,length:int,by_status:int>")
    def of(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for name, bs, status in it:
            got = [features(n, [Piece(b["text"], b["score"], b["tag"], b["code"]) for b in x], None if s is None or s != s else int(s)) for n, x, s in zip(name, bs, status)]
            yield pd.DataFrame({"tokens": [g.tokens for g in got], "weak": [g.weak for g in got], "length": [g.length for g in got], "by_status": [g.by_status for g in got]})

    held = F.pmod(F.xxhash64("host"), F.lit(4)) == 0
    return pages.select("fetch_id", held.alias("held_out"), of("title", "blocks", "status").alias("f")).select("fetch_id", "held_out", "f.*")


def train(feats: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled pages of the hosts that are not held out, half of each label where there are as many."""
    labelled = feats.where((F.col("weak") >= 0) & ~F.col("held_out")).select("tokens", "weak", F.xxhash64("fetch_id").alias("h"))
    got = []
    for label in (0, 1):
        got += labelled.where(F.col("weak") == label).orderBy("h").limit(sample // 2).select("tokens", "weak").collect()
    return fit([list(r["tokens"]) for r in got], np.array([r["weak"] for r in got], dtype=float))


def scored(feats: DataFrame, model: Model) -> DataFrame:
    """feats plus p, the probability of a notice."""
    held = feats.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def p(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for tokens in it:
            yield pd.Series(predict(held.value, [list(t) for t in tokens]))

    return feats.withColumn("p", p.asNondeterministic()("tokens"))  # once, also where p is filtered on


def notices_of(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(fetch_id, held_out, weak, length, by_status, p) of every page (see mainbody.walked); p >= CUT is a notice, residue or filler."""
    feats = cut(page_features(pages), "page-features")
    return scored(feats, train(feats, sample)).drop("tokens")


def notices(fetches: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """notices_of() every fetch with non-blank html.

    Null and blank html give no row (there is no page). Repeated deliveries are rows of their own. An empty table, or one whose
    weak labels are all alike, gets the label there is (content, if none). Very long pages are read whole.
    """
    return notices_of(walked(fetches), sample)
