"""Personal information in free text: found by weak supervision, replaced by typed placeholders.

1. candidates  spans that could be an EMAIL, PHONE, TCKN, IBAN, ADDRESS or NAME, wide rather than sure.
2. votes       labelers of three sorts (patterns and check digits, gazetteers from the subjects table, context words) vote for or
               against each candidate, or abstain. None of them decides.
3. reliability expectation-maximisation on the counts of vote patterns estimates how each labeler votes on true and on false
               candidates of a type, and with it a probability for each pattern.
4. classifier  a regularised logistic model per type on hashed span and context features is trained on a bounded sample with those
               probabilities; it and the votes decide, and of overlapping spans the surest, then longest, stays.
Check digits and address parsing are exact checks that follow where the type is defined by them.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veyra.llm.addresses import parse
from veyra.llm.encoding import TURKISH_BYTES, repair
from veyra.operators.pageblocks import blocks
from veyra.session import cut, spread

TYPES = ("EMAIL", "PHONE", "TCKN", "IBAN", "ADDRESS", "NAME")
SAMPLE = 20_000  # candidates per type that a classifier is trained on
DIM = 1 << 14
CUT = 0.5

# ---- check digits ------------------------------------------------------------------------------------------------------


def tckn_valid(s: str) -> bool:
    if len(s) != 11 or not s.isascii() or not s.isdigit() or s[0] == "0":
        return False
    d = [int(c) for c in s]
    return (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


#: IBAN lengths.
IBAN_LENGTH = {"TR": 26, "DE": 22, "GB": 22, "FR": 27, "NL": 18, "AT": 20, "CH": 21, "BE": 16, "ES": 24, "IT": 27, "PL": 28, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "IE": 22, "PT": 25, "GR": 27, "CZ": 24, "LU": 20, "CY": 28, "AZ": 28}


def iban_valid(s: str) -> bool:
    s = s.upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s) or IBAN_LENGTH.get(s[:2], len(s)) != len(s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


# ---- aligned repair ----------------------------------------------------------------------------------------------------


class Aligned:
    """A text with wrong decodings undone, and the way back to the positions of the text as written (repair keeps ASCII)."""

    def __init__(self, text: str) -> None:
        self.written = text
        self.text = text
        self._at: list[int] | None = None
        if not text.isascii():
            fixed = repair(text)[0]
            if fixed != text:
                self.text = fixed
                self._at = [i for i, ch in enumerate(text) if ch < "\x80"]
                self._before = np.cumsum([0, *(ch < "\x80" for ch in fixed)])

    def back(self, start: int, end: int) -> tuple[int, int]:
        if self._at is None:
            return start, end
        n, m = int(self._before[start]), int(self._before[end])
        s = self._at[n] if self.text[start] < "\x80" else (self._at[n - 1] + 1 if n else 0)
        e = self._at[m - 1] + 1 if self.text[end - 1] < "\x80" else (self._at[m] if m < len(self._at) else len(self.written))
        return s, e


# ---- candidates --------------------------------------------------------------------------------------------------------

# Context words. They vote; none of them decides.
CUES = {
    "phone": r"tel|telefon|phone|mobile|cep|gsm|fax|faks|call|ara|ulaş|rufen|erreichbar|handy|portable|appel",
    "number": r"sipari|order|parcel|paket|fatura|invoice|sendung|auftrag|colis|commande|facture|iban|hesap|hesab|account|konto|server|sunucu|sürüm|version|kimlik|t\.?c\.?|ausweis|id|tutar|amount|total|betrag|montant|ref|no",
    "tckn": r"kimlik|t\.?c\.?|tckn|national id|id number|ausweis|identité",
    "email": r"e-?posta|e-?mail|mail|write to|yazın|gönder|courriel|écri",
    "iban": r"iban|hesab|hesap|account|konto|compte|ödeme|payment",
    "address": r"adres(?:i|se)?|address|anschrift|adresse|ikamet|konum",
    "before": r"ad soyad|ad|adı|name|contact|person in charge|sorumlu kişi|ansprechpartner|responsable|sayın|dear|mr|mrs|ms|herr|frau|by|von|par|with|ile|from",
    "after": r"adlı kişi|yaşında|adı|isimli|works|aged|said|dedi|sagte|dit|\(",
}
ORGANISATION = frozenset("a.ş aş ltd şti inc llc gmbh holding ag kg corp co plc verlag lojistik logistics analytics group grup vakfı derneği association club kulübü bank bankası üniversitesi university polytechnic institut institute lisesi school okulu college koleji hastanesi belediyesi müdürlüğü".split())
STREET_WORDS = frozenset("sokak sokağı sok sk cadde caddesi cad cd bulvar bulvarı bulv blv mahallesi mahalle mah mh meydanı street st avenue ave road rd lane ln drive square way platz straße gasse rue place".split())
VESSEL = re.compile(r"\b(?:tekne|gemi|boats?|ship|vessel|boote?|schiff|bateau|proje|project|projekt|projet)\b", re.I)

_cues = {k: re.compile(rf"(?:^|\W)(?:{v})" + (r"(?:\W|$)" if k in ("number", "before") else "")) for k, v in CUES.items() if k != "after"}
_after = re.compile(rf"(?:['’]\w+)?\s*(?:{CUES['after']})")
_clause = re.compile(r"[.!?]\s")
_email = re.compile(r"(?<![\w.+@-])([A-Za-z0-9][A-Za-z0-9._%+\-]*)\s?(?:@|＠|\(at\)|\[at\]|\{at\}|\(a\)|\[a\]|\s[\[(]\s?at\s?[\])]\s)\s?([A-Za-z0-9\-]+(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\}|\[nokta\]|\(nokta\)|\[punkt\]|\(punkt\)|\[point\]|\(point\))\s?[A-Za-z0-9\-]+)+)", re.I)
_dot = re.compile(r"\s?(?:\[dot\]|\(dot\)|\{dot\}|\[nokta\]|\(nokta\)|\[punkt\]|\(punkt\)|\[point\]|\(point\))\s?", re.I)
_digits = re.compile(r"(?<![\w@*.,/:+-])(?:\(\+\d{1,3}\)[ ]?\(?|\+\(?|\()?\d(?:[\d]|[  ().\-](?=[\d(]))*\d\)?(?:[ .\-]\d+)*(?![\w*@]|[.,:/]\d|-\d)")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?:[ ]?[A-Za-z0-9]){11,32}(?![A-Za-z0-9])")
_iban_head = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}[ ]?[A-Za-z0-9]")
_label = re.compile(r"^\s*([^:\d]{2,28}?)\s*:\s*")
_token = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?")
_prose = re.compile(r"(?:(?<![^\W\d_])[a-zçğıöşüâîû]{2,}[ ,]+){3}")  # three plain words in a row are no part of an address
_ending = re.compile(r"['’][a-zçğıöşü]{1,5}$")
_TR = str.maketrans({"ı": "i", "İ": "i", "I": "i", **{k: unicodedata.normalize("NFKD", v)[0].replace("ı", "i").replace("İ", "I") for k, v in TURKISH_BYTES.items()}})


def fold(s: str) -> str:
    s = s.translate(_TR).lower()
    return s if s.isascii() else "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))


class Gazetteer(NamedTuple):
    given: frozenset[str]
    family: frozenset[str]
    places: frozenset[str]


class Candidate(NamedTuple):
    type: int
    start: int  # in the text as written
    end: int
    value: str
    votes: int  # two bits per labeler: 1 for, 2 against
    feats: list[int]


# How often each labeler is believed to vote for and against a true candidate, and for and against a false one, before anything
# is learned.
LABELERS: dict[int, dict[str, tuple[float, float, float, float]]] = {
    0: {
        "pattern": (0.95, 0.01, 0.3, 0.3),
        "context": (0.3, 0.01, 0.1, 0.01),
        "known_domain": (0.1, 0.01, 0.1, 0.01),
    },
    1: {
        "prefix": (0.4, 0.01, 0.05, 0.01),
        "shape": (0.9, 0.05, 0.1, 0.8),
        "context": (0.3, 0.01, 0.05, 0.01),
        "other_number": (0.01, 0.05, 0.01, 0.3),
        "dotted": (0.01, 0.05, 0.01, 0.5),
        "length": (0.9, 0.05, 0.3, 0.6),
    },
    2: {
        "check_digits": (0.95, 0.01, 0.3, 0.3),
        "context": (0.4, 0.01, 0.1, 0.01),
        "other_number": (0.01, 0.05, 0.01, 0.3),
    },
    3: {
        "check_digits": (0.95, 0.01, 0.3, 0.3),
        "context": (0.4, 0.01, 0.1, 0.01),
        "length": (0.9, 0.01, 0.5, 0.01),
    },
    4: {
        "places": (0.9, 0.05, 0.3, 0.6),
        "context": (0.4, 0.01, 0.1, 0.01),
        "known_place": (0.6, 0.01, 0.2, 0.01),
        "alone": (0.5, 0.01, 0.3, 0.01),
        "prose": (0.85, 0.1, 0.4, 0.5),
        "long": (0.01, 0.03, 0.01, 0.3),
        "span": (0.5, 0.01, 0.4, 0.01),
    },
    5: {
        "given": (0.75, 0.1, 0.1, 0.7),
        "family": (0.5, 0.1, 0.1, 0.2),
        "initial": (0.15, 0.01, 0.05, 0.01),
        "context": (0.3, 0.01, 0.1, 0.01),
        "place": (0.01, 0.04, 0.01, 0.2),
        "vessel": (0.01, 0.04, 0.01, 0.1),
        "alone": (0.3, 0.01, 0.1, 0.01),
        "shape": (0.01, 0.03, 0.01, 0.1),
        "organisation": (0.01, 0.03, 0.01, 0.3),
        "street": (0.01, 0.03, 0.01, 0.2),
        "run": (0.85, 0.1, 0.5, 0.4),
        "address": (0.01, 0.04, 0.01, 0.2),
        "strange": (0.01, 0.06, 0.01, 0.3),
    },
}


def _pack(votes: list[int]) -> int:
    return sum((1 if v > 0 else 2 if v < 0 else 0) << (2 * i) for i, v in enumerate(votes))


def _feats(kind: int, words: list[str]) -> list[int]:
    return sorted({zlib.crc32(f"{kind}|{w}".encode("utf-8", "surrogatepass")) % DIM for w in words})


def _around(s: str, a: int, b: int, width: int = 34) -> tuple[str, str]:
    return s[max(0, a - width) : a].lower(), s[b : b + width].lower()


def _near(cue: str, before: str) -> bool:
    """A cue word of a kind in the clause right before the span."""
    return bool(_cues[cue].search(_clause.split(before)[-1]))


def _number_spans(s: str) -> Iterator[tuple[int, int, str]]:
    for m in _digits.finditer(s):
        a, b = m.start(), m.end()
        t = m[0]
        if t.startswith("(") and (")" not in t or t.endswith(")") and t.count("(") == t.count(")") == 1):
            a, t = a + 1, t[1:]
        while t and t.count(")") > t.count("("):
            cut = t.rfind(")")
            t = t[:cut] if cut == len(t) - 1 else t[:cut]
            b = a + len(t)
        t = t.rstrip(" .-(")
        if t:
            yield a, a + len(t), t


def candidates_in(text: str, gaz: Gazetteer) -> list[Candidate]:
    """All candidates of one block of text."""
    al = Aligned(text)
    s = al.text
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []  # what a pattern with exact checks has claimed
    places: list[tuple[int, int]] = []  # address candidates

    def add(kind: int, a: int, b: int, value: str | None, votes: list[int], words: list[str]) -> None:
        x, y = al.back(a, b)
        out.append(Candidate(kind, x, y, " ".join(text[x:y].split()) if value is None else value, _pack(votes), _feats(kind, words)))

    for m in _email.finditer(s):
        local, domain = m[1], _dot.sub(".", m[2]).replace(" ", "")
        if "." not in domain or domain.rsplit(".", 1)[1].isdigit():
            continue
        before, after = _around(s, m.start(), m.end())
        disguised = "@" not in m[0] or " " in m[0]
        taken.append(m.span())
        add(0, m.start(), m.end(), f"{local}@{domain}".lower(), [1, 1 if _near("email", before) else 0, 0], [f"d{disguised}", "b:" + " ".join(before.split()[-1:]), "tld:" + domain.rsplit(".", 1)[1].lower()])

    if any(ch.isdigit() for ch in s):
        for m in _iban_head.finditer(s):
            start = m.start()
            full = _iban.match(s, start)
            if not full:
                continue
            raw = full[0]
            want = IBAN_LENGTH.get(raw[:2].upper())
            for n in [want] if want else range(34, 14, -1):
                got, end = "", None
                for i, ch in enumerate(raw):
                    if ch != " ":
                        got += ch
                        if len(got) == n:
                            end = i + 1
                            break
                if end and iban_valid(got) and not (end < len(raw) and raw[end] != " "):
                    before, _ = _around(s, start, start + end)
                    taken.append((start, start + end))
                    add(3, start, start + end, got.upper(), [1, 1 if _near("iban", before) else 0, 1 if want else 0], ["c:" + got[:2].upper(), "b:" + " ".join(before.split()[-1:])])
                    break
        for a, b, t in _number_spans(s):
            if any(a < y and b > x for x, y in taken):
                continue
            digits = re.sub(r"\D", "", t)
            if not 7 <= len(digits) <= 15:  # no telephone number is shorter or longer
                continue
            before, after = _around(s, a, b)
            wrong = _near("number", before)
            plain = re.sub(r"\d+", lambda x: str(len(x[0])), t)
            if tckn_valid(digits) and re.fullmatch(r"\d{11}|\d{3}([ .\-])\d{3}\1\d{3}\1\d{2}|\d{3} \d{3} \d{2} \d{3}", t):
                add(2, a, b, digits, [1, 1 if _near("tckn", before) else 0, -1 if wrong and not _near("tckn", before) else 0], ["s:" + plain, "b:" + " ".join(before.split()[-1:])])
                continue
            prefix = t.startswith(("+", "(+", "00")) and 10 <= len(digits) <= 14
            national = digits.startswith("0") and not digits.startswith("00") and len(digits) == 11
            local = len(digits) == 10 and (t.startswith("(") or digits[0] == "5") and not t.isdigit()
            dotted = bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){2,3}|\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}.*|\d{4}-\d\d-\d\d.*|\d{5,6}-\d{2,}", t))
            votes = [1 if prefix else 0, 1 if prefix or national or local else -1, 1 if _near("phone", before) else 0, -1 if wrong else 0, -1 if dotted else 0, 1 if 10 <= len(digits) <= 13 else -1]
            add(1, a, b, digits, votes, ["s:" + plain, "p:" + digits[:2], f"w{wrong}", "b:" + " ".join(before.split()[-1:]), "a:" + " ".join(after.split()[:1])])

        whole = s.strip()
        offset = len(s) - len(s.lstrip())
        label = _label.match(whole)
        cue = bool(label and _near("address", label[1].lower()))
        body = label.end() if cue else 0
        spans = [(offset + body, offset + len(whole), True)] + [(m.start(), m.end(), False) for m in _address_in.finditer(s)]
        for a, b, entire in spans:
            t = s[a:b]
            got = parse(t) if entire or (a, b) != spans[0][:2] else None
            if not got:
                continue
            before, after = _around(s, a, b)
            known = any(all(w in gaz.places for w in p.split()) for p in got.places)
            prose, long = bool(_prose.search(t)), len(t.split()) > 26
            said = cue if entire else _near("address", before)
            places.append((a, b))
            add(4, a, b, None, [1 if got.places else -1, 1 if said else 0, 1 if known else 0, 1 if entire else 0, -1 if prose else 1, -1 if long else 0, 0 if entire else 1], [f"cue{said}", f"known{known}", f"t:{got.stype}", f"n{min(len(t.split()) // 4, 6)}", f"prose{prose}", f"whole{entire}"])

    _names(s, gaz, taken, places, add)
    return out


_C = "A-ZÇĞİÖŞÜ"
_firm = re.compile(r"\s*(?:\w+ ){0,2}(?:a\.ş|ltd|inc\b|llc|gmbh)")
_address_in = re.compile(
    rf"(?:[{_C}][\w']+ (?:Mahallesi|Mah\.?|Mh\.?),? )?(?:[{_C}][\w']+ ){{1,3}}(?:Sokağı|Sokak|Sok\.?|Sk\.?|Caddesi|Cadde|Cad\.?|Cd\.?|Bulvarı|Bulv\.?|Blv\.?) (?:No|N)?[.: ]*\d+(?:/\d+)?(?: (?:Kat|K|Daire|D)[.:] ?\d+)*(?:,? \d{{5}})?(?:,? [{_C}]\w+)?(?:[ /,]+[{_C}]\w+)?"
    rf"|(?:(?:Flat|Apt|Unit) \d+,? )?\d+ (?:[{_C}]\w+ ){{1,3}}(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Lane|Ln\.?)(?:,? [{_C}]\w+)?(?:,? [A-Z]{{2}}\d \d[A-Z]{{2}})?"
)


MOST_WORDS = 5  # given and family names of one person


def _names(s: str, gaz: Gazetteer, taken: list[tuple[int, int]], places: list[tuple[int, int]], add) -> None:
    """NAME candidates: two to MOST_WORDS words in a row that begin with capitals (an initial may stand for a given name), and a
    family name with its given names after a comma. A span that holds a listed given name or an initial begins with one. Where a
    block has no capitals at all, the first word must be a listed given name."""
    toks = [(m.start(), m.end(), m[0]) for m in _token.finditer(s)]
    lower_block = s == s.lower()
    n = len(toks)
    clean: list[str] = []
    ends: list[int] = []
    for a, b, t in toks:
        e = _ending.search(t)
        if e and t[0] != t[0].lower():
            t, b = t[: e.start()], a + e.start()
        if t.endswith(".") and len(t) > 2:
            t, b = t[:-1], b - 1
        clean.append(t)
        ends.append(b)
    upper = [t[0] != t[0].lower() for t in clean]
    if not lower_block and sum(upper) < 2:
        return
    folded = [fold(t.rstrip(".")) for t in clean]
    first = [t.endswith(".") and len(t) == 2 and t[0] != t[0].lower() for t in clean]
    gap = [s[ends[i] : toks[i + 1][0]] if i + 1 < n else "" for i in range(n)]
    open_ = [upper[i] or lower_block for i in range(n)]
    whole = s.strip(" •·*-–—\t")
    for i in range(n):
        if not open_[i] or any(toks[i][0] < y and ends[i] > x for x, y in taken) or lower_block and folded[i] not in gaz.given:
            continue
        spans: list[tuple[int, int, bool]] = []
        if i + 1 < n and len(gap[i]) == 2 and gap[i][0] == "," and open_[i + 1] and folded[i + 1] in gaz.given and len(clean[i]) >= 4:
            j = i + 1  # family name, given names
            while j + 1 < n and gap[j] == " " and open_[j + 1] and folded[j + 1] in gaz.given and j - i + 1 < MOST_WORDS:
                j += 1
            spans.append((i, j, True))
        for j in range(i + 1, min(i + MOST_WORDS, n)):
            if gap[j - 1] not in (" ", "\u00a0") or not open_[j]:
                break
            if len(clean[j].rstrip(".")) >= 2 and not first[j]:
                spans.append((i, j, False))
            if ends[j] < toks[j][1] and s[ends[j] : ends[j] + 1] in ("'", "’", "."):
                break
        for a, b, turned in spans:
            given = range(a + 1, b + 1) if turned else range(a, b)
            family = a if turned else b
            listed = [folded[k] in gaz.given for k in given]
            initial = any(first[k] for k in given)
            if not (listed[0] or first[given[0]]) and (any(listed) or initial):
                continue  # the span that begins at the listed given name or initial is a candidate of its own
            person = all(g or first[k] for g, k in zip(listed, given))
            before, after = _around(s, toks[a][0], ends[b])
            nxt = after.split()[:1]
            next_word = re.sub(r"\W", "", nxt[0]) if nxt else ""
            fam, last = folded[family], clean[b].lower().rstrip(".")
            organisation = next_word in ORGANISATION or any(clean[k].lower().rstrip(".") in ORGANISATION for k in range(a, b + 1)) or bool(_firm.match(after))
            street = last in STREET_WORDS or (next_word in STREET_WORDS and not after.startswith((".", ",", " -")))
            place = any(folded[k] in gaz.places and folded[k] not in gaz.given for k in range(a, b + 1))
            alone = whole == s[toks[a][0] : ends[b]]
            cue = _near("before", before[-24:]) or bool(_after.match(after))
            # A capitalised given name right before belongs to the name, one right after is more likely its family name.
            early = a > 0 and gap[a - 1] in (" ", "\u00a0") and open_[a - 1] and (folded[a - 1] in gaz.given or first[a - 1])
            late = not turned and b + 1 < n and gap[b] in (" ", "\u00a0") and upper[b + 1] and fam in gaz.given and not lower_block
            votes = [
                1 if person and any(listed) else 0 if person else -1,
                1 if fam in gaz.family else -1 if fam in gaz.given and not turned else 0,
                1 if initial and len(fam) >= 4 and person else 0,
                1 if cue else 0,
                -1 if place else 0,
                -1 if VESSEL.search(s[max(0, toks[a][0] - 30) : ends[b] + 30]) else 0,
                1 if alone else 0,
                -1 if len(fam) < 3 or len(clean[b]) > 30 else 0,
                -1 if organisation else 0,
                -1 if street else 0,
                -1 if early or late else 1,
                -1 if any(toks[a][0] < y and ends[b] > x for x, y in places) else 0,
                -1 if any(not (g or first[k]) for g, k in zip(listed, given)) and (any(listed) or initial) else 0,
            ]
            shape = "".join("I" if first[k] else "U" if clean[k].isupper() else "C" if upper[k] else "l" for k in range(a, b + 1))
            words = ["shape:" + shape, f"turned{turned}", f"gaz{sum(listed)}/{len(given)}", f"fam{fam in gaz.family}", "f3:" + fam[-3:], "f4:" + fam[-4:], "f5:" + fam[-5:], "p3:" + fam[:3], "b:" + " ".join(before.split()[-1:]), "a:" + next_word, f"place{place}", f"alone{alone}", f"len{min(len(fam), 14)}"]
            words += [f"org{organisation}", f"street{street}", f"edge{early or late}", "g:" + folded[given[0]]]
            add(5, toks[a][0], ends[b], None, votes, words)


# ---- reliabilities and classifier --------------------------------------------------------------------------------------


PULL = 0.1  # weight of the beliefs in LABELERS beside what is learned, as a share of all candidates of a type


class Reliability(NamedTuple):
    prior: float  # share of true candidates
    true: np.ndarray  # labelers x (abstain, for, against) on true candidates
    false: np.ndarray

    def accuracy(self) -> np.ndarray:
        """P(a cast vote is right), by labeler."""
        right = self.prior * self.true[:, 1] + (1 - self.prior) * self.false[:, 2]
        return right / (right + self.prior * self.true[:, 2] + (1 - self.prior) * self.false[:, 1])


def reliabilities(patterns: dict[int, int], beliefs: list[tuple[float, float, float, float]], steps: int = 60) -> tuple[Reliability, dict[int, float]]:
    """EM over the vote patterns of one type: how often each labeler votes for, against and not at all on true and on false
    candidates, and with that the probability of each pattern. The beliefs count as PULL of all candidates."""
    keys, labelers = sorted(patterns), len(beliefs)
    v = np.array([[(p >> (2 * i)) & 3 for i in range(labelers)] for p in keys], dtype=int).reshape(len(keys), labelers)
    w = np.array([patterns[p] for p in keys], dtype=float)
    cast = np.stack([v == x for x in range(3)], axis=2).astype(float)
    b = np.array(beliefs)
    true, false = (np.stack([1 - x[:, 0] - x[:, 1], x[:, 0], x[:, 1]], axis=1) for x in (b[:, :2], b[:, 2:]))
    prior, pull = 0.5, PULL * w.sum()
    start = true, false

    def posterior() -> np.ndarray:
        z = np.log(prior / (1 - prior)) + (cast * (np.log(true) - np.log(false))).sum((1, 2))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    for _ in range(steps if len(keys) else 0):
        q = posterior()
        prior = float(np.clip((q * w).sum() / w.sum(), 0.02, 0.98))
        good, bad = (cast * (q * w)[:, None, None]).sum(0) + pull * start[0], (cast * ((1 - q) * w)[:, None, None]).sum(0) + pull * start[1]
        true, false = (np.clip(x / x.sum(1, keepdims=True), 0.002, 1.0) for x in (good, bad))
    return Reliability(prior, true, false), dict(zip(keys, map(float, posterior() if len(keys) else [])))


def train(feats: list[list[int]], target: np.ndarray, l2: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilistic labels, full-batch with per-feature steps."""
    w, b, acc, accb = np.zeros(DIM), 0.0, np.full(DIM, 1e-8), 1e-8
    if not feats:
        return w, 0.0
    rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    cols = np.fromiter((c for f in feats for c in f), dtype=np.int64, count=len(rows))
    for _ in range(steps):
        z = np.bincount(rows, w[cols], minlength=len(feats)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(feats)
        grad = np.bincount(cols, g[rows], minlength=DIM) + l2 * w
        acc += grad**2
        w -= 0.5 * grad / np.sqrt(acc)
        accb += g.sum() ** 2
        b -= 0.5 * g.sum() / np.sqrt(accb)
    return w, float(b)


class Model(NamedTuple):
    patterns: dict[int, dict[int, float]]
    weights: dict[int, tuple[np.ndarray, float]]


def keep(cands: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Of overlapping accepted spans the longest of the surest: within 0.3 of the best probability, length decides."""
    out: list[tuple[int, int, int, str, float]] = []
    for c in sorted(cands, key=lambda c: (-round(c[4] / 0.3), -(c[2] - c[1]), c[1])):
        if all(c[2] <= o[1] or c[1] >= o[2] for o in out):
            out.append(c)
    return sorted(out, key=lambda c: c[1])


GIVEN, FAMILY, PLACE = 1, 2, 4


def gazetteer(subjects: DataFrame) -> DataFrame:
    """(word, flags): folded given names, family names and places of the subjects table, all of them; flags is a sum of GIVEN, FAMILY, PLACE."""
    names = subjects.select(F.explode(F.concat(F.array("full_name"), F.coalesce("relatives", F.array().cast("array<string>")))).alias("n")).where("n is not null")
    words = names.select(F.split(F.trim("n"), r"\s+").alias("w")).where("size(w) >= 2")
    flagged = lambda df, flag: df.select("x", F.lit(flag).alias("flag"))
    raw = flagged(words.select(F.explode(F.slice("w", F.lit(1), F.size("w") - 1)).alias("x")), GIVEN)
    raw = raw.unionByName(flagged(words.select(F.element_at("w", -1).alias("x")), FAMILY))
    raw = raw.unionByName(flagged(subjects.select(F.explode("cities").alias("c")).where("c is not null").select(F.explode(F.split("c", " ")).alias("x")), PLACE))
    ends = F.regexp_extract_all("a", F.lit(r"([\p{L}]+)(?:[/ ,-]+[\p{L}]+)?\s*$"), F.lit(1))
    raw = raw.unionByName(flagged(subjects.select(F.explode("addresses").alias("a")).where("a is not null").select(F.explode(ends).alias("x")), PLACE))

    @F.pandas_udf("string")
    def folded(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in it:
            yield x.map(fold)

    raw = raw.where("x != ''").distinct()
    return raw.select(folded("x").alias("word"), "flag").groupBy("word").agg(F.expr("bit_or(flag)").cast("int").alias("flags"))


def _gazetteer(words: Iterable[tuple[str, int]]) -> Gazetteer:
    words = list(words)
    given = frozenset(w for w, f in words if f & GIVEN)
    return Gazetteer(given, frozenset(w for w, f in words if f & FAMILY) - given, frozenset(w for w, f in words if f & PLACE))


def texts_of_pages(fetches: DataFrame) -> DataFrame:
    """src, rec_id, lines (array of blocks of visible text)."""

    @F.pandas_udf("array<string>")
    def lines(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in it:
            yield html.map(lambda h: [b.text for b in blocks(h)])

    rows = spread(fetches.where(F.col("html").rlike(r"(?U)[^\s]")).select("fetch_id", "html"))
    return rows.select(F.lit("fetches").alias("src"), F.col("fetch_id").alias("rec_id"), lines("html").alias("lines"))


def texts_of_analyses(analyses: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    values = F.flatten(F.transform(F.coalesce(F.map_values("matched"), F.array(empty)), lambda x: F.coalesce(x, empty)))
    lines = F.filter(F.concat(F.coalesce("data_types", empty), F.coalesce(values, empty)), lambda x: x.isNotNull())
    return analyses.select(F.lit("analyses").alias("src"), F.col("analysis_id").alias("rec_id"), lines.alias("lines")).where("size(lines) > 0")


CANDIDATES = "array<struct<line:int,type:int,start:int,end:int,value:string,votes:int,feats:array<int>>>"


BROADCAST_WORDS = 200_000  # a longer gazetteer is not broadcast but joined


def candidates(texts: DataFrame, words: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """texts (src, rec_id, lines) plus the candidates of all their lines. words: see gazetteer.

    A gazetteer of at most broadcast_words is broadcast. A longer one is joined with the words of the texts, and each text comes
    with the entries it holds; candidates and votes are the same.
    """
    plain = lambda lines, g: [{"line": i, "type": c.type, "start": c.start, "end": c.end, "value": c.value, "votes": c.votes, "feats": c.feats} for i, t in enumerate(lines) for c in candidates_in(t, g)]
    few = words.limit(broadcast_words + 1).collect()
    if len(few) <= broadcast_words:
        shared = texts.sparkSession.sparkContext.broadcast(_gazetteer((r["word"], r["flags"]) for r in few))

        @F.pandas_udf(CANDIDATES)
        def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
            g = shared.value
            for batch in it:
                yield batch.map(lambda lines: plain(lines, g))

        return texts.withColumn("c", of("lines"))

    @F.pandas_udf("array<string>")
    def said(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            yield batch.map(lambda lines: sorted({fold(x) for t in lines for m in _token.finditer(Aligned(t).text) for y in (m[0].rstrip("."), _ending.sub("", m[0])) for x in (y, *re.split(r"[-'’]", y))}))

    @F.pandas_udf(CANDIDATES)
    def each(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lines, known in it:
            yield pd.Series([plain(a, _gazetteer((r["word"], r["flags"]) for r in (b if b is not None else []))) for a, b in zip(lines, known)])

    texts = cut(texts, "pii-texts")
    held = texts.select("src", "rec_id", F.explode(said("lines")).alias("word")).join(words, "word")
    known = held.groupBy("src", "rec_id").agg(F.collect_set(F.struct("word", "flags")).alias("known"))  # words of one text only
    return texts.join(known, ["src", "rec_id"], "left").withColumn("c", each("lines", "known")).drop("known")


def learn(cands: DataFrame, sample: int = SAMPLE) -> tuple[Model, dict[int, Reliability]]:
    flat = cands.select("rec_id", F.explode("c").alias("c")).select("rec_id", "c.*")
    counts = flat.groupBy("type", "votes").agg(F.count("*").alias("n")).collect()  # at most 3^labelers per type
    patterns, weights, report = {}, {}, {}
    for t in range(len(TYPES)):
        report[t], patterns[t] = reliabilities({r["votes"]: r["n"] for r in counts if r["type"] == t}, list(LABELERS[t].values()))
    h = F.xxhash64("rec_id", "line", "start", "end")
    for t in range(len(TYPES)):
        got = flat.where(F.col("type") == t).select("votes", "feats", h.alias("h")).orderBy("h").limit(sample).collect()
        weights[t] = train([list(r["feats"]) for r in got], np.array([patterns[t][r["votes"]] for r in got]))
    return Model(patterns, weights), report


def found(cands: DataFrame, model: Model, least: float = CUT) -> DataFrame:
    """The texts with the accepted spans: array<struct<line,type,start,end,value>>."""
    shared = cands.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<line:int,type:int,start:int,end:int,value:string>>")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value

        def one(cs) -> list[dict]:
            lines: dict[int, list[tuple[int, int, int, str, float]]] = {}
            for c in cs:
                w, b = m.weights[c["type"]]
                z = w[np.asarray(c["feats"], dtype=np.int64)].sum() + b
                p = 0.5 * m.patterns[c["type"]][c["votes"]] + 0.5 / (1 + np.exp(-np.clip(z, -30, 30)))
                if p >= least:
                    lines.setdefault(c["line"], []).append((c["type"], c["start"], c["end"], c["value"], float(p)))
            return [{"line": i, "type": t, "start": a, "end": e, "value": v} for i, cs in sorted(lines.items()) for t, a, e, v, _ in keep(cs)]

        for batch in it:
            yield batch.map(one)

    return cands.withColumn("spans", of("c")).drop("c")


def personal_information(fetches: DataFrame, analyses: DataFrame, subjects: DataFrame, broadcast_words: int = BROADCAST_WORDS, least: float = CUT) -> tuple[DataFrame, dict]:
    """(src, rec_id, lines, spans) of all pages and analyses with text, and the labelers' reliabilities.

    Null and blank html, null arrays and null elements hold nothing; empty tables give no rows; repeated deliveries are records
    of their own. Very long texts are read whole.
    """
    texts = texts_of_pages(fetches).unionByName(texts_of_analyses(analyses))
    cands = cut(candidates(texts, cut(gazetteer(subjects), "gazetteer"), broadcast_words), "pii")
    model, report = learn(cands)
    return found(cands, model, least), report


def values(spans: DataFrame) -> DataFrame:
    """src, rec_id, pii_type, pii_value: distinct values of each record."""
    names = F.array(*[F.lit(t) for t in TYPES])
    return spans.select("src", "rec_id", F.explode("spans").alias("s")).select("src", "rec_id", F.get(names, F.col("s.type")).alias("pii_type"), F.col("s.value").alias("pii_value")).distinct()


def redacted(spans: DataFrame) -> DataFrame:
    """src, rec_id, text: the lines with each span replaced by its type in brackets; all else stands as it was."""

    @F.pandas_udf("string")
    def of(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lines, found_spans in it:
            out = []
            for ls, ss in zip(lines, found_spans):
                ls = list(ls)
                for s in sorted(ss, key=lambda s: (s["line"], -s["start"])):
                    t = ls[s["line"]]
                    ls[s["line"]] = f"{t[: s['start']]}[{TYPES[s['type']]}]{t[s['end'] :]}"
                out.append("\n".join(ls))
            yield pd.Series(out)

    return spans.select("src", "rec_id", of("lines", "spans").alias("text"))
