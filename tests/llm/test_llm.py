import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veyra.llm import addresses, encoding, mainbody, merkle, mixture, notices, personal, quality, tokens
from veyra.operators.pageblocks import blocks

md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
HAS_RANKS = os.path.exists(tokens.vocabulary_path())

# ---- 1 -----------------------------------------------------------------------------------------------------------------

SAME = [
    "https://www.e.com:443/a-b/c/?x=1&y=2&utm_source=z#f", "HTTP://E.com/A_B//c?y=2&x=1", " «e.com/a.b/c?Y=2&X=1&ref=q»\r\n", '"https://e.com/a b/C/?x=1&y=2?"', "https://e.com/a%2Db/c?x=1&&y=2;",
]
OTHER = ["https://m.e.com/a-b/c?x=1&y=2", "https://e.com:8080/a-b/c?x=1&y=2", "https://e.com/c/a-b?x=1&y=2", "https://e.com/a-b/c?x=1&y=3", "https://e.com/a-b/c?x=1", "https://e.com/a-bx/c?x=1&y=2", "https://e.com/ab/cx?x=1&y=2", "https://e.com/ä-b/c?x=1&y=2", "http://e.com:443/a-b/c?x=1&y=2"]


def test_url_pages(spark):
    rows = [(10 - i, u, "extra") for i, u in enumerate(SAME)] + [(100 + i, u, "extra") for i, u in enumerate(OTHER)] + [(200, None, None), (201, None, None), (202, "", None), (203, "?!", None), (204, "https://e.com/" + "a" * 50_000, None)]
    got = merkle.url_pages(spark.createDataFrame(rows, "id long, url string, root string"), "url", "id").collect()
    sizes = {r["keep_id"]: r["copies"] for r in got}
    assert sizes[6] == len(SAME) and all(sizes[100 + i] == 1 for i in range(len(OTHER))) and sizes[202] == 2 and sizes[204] == 1
    assert sum(sizes.values()) == len(rows) - 2
    assert merkle.url_pages(spark.createDataFrame([], "id long, url string"), "url", "id").count() == 0


def test_one_digest_of_two_structures_is_split(spark):
    rows = [(5, "r", "a"), (3, "r", "a"), (4, "r", "b"), (9, "q", "c")]
    got = merkle.groups(spark.createDataFrame(rows, "id long, root string, structure string")).collect()
    assert {(r["keep_id"], r["copies"]) for r in got} == {(3, 2), (4, 1), (9, 1)}


def test_digest_order(spark):
    df = spark.createDataFrame([(["b", "a"],)], "x array<string>")
    a, b = df.select(merkle.unordered("t", F.col("x")), merkle.unordered("t", F.reverse("x"))).first()
    c, d = df.select(merkle.ordered("t", F.col("x")), merkle.ordered("t", F.reverse("x"))).first()
    assert a == b and c != d


# ---- 2, 7 --------------------------------------------------------------------------------------------------------------


def page(i, main, title="Sayfa"):
    nav = "<ul><li>Haberler</li><li>İletişim</li></ul>"
    foot = f"<h4>Benzer kayıtlar</h4><ul><li>Başlık {i}</li><li>Öteki {i}</li></ul><div class=f1><p>Tüm hakları saklıdır.</p><p>Bilinmeyen alt yazı</p><p>&copy; 2020 X Ltd</p></div><p>Bu internet sitesi çerez kullanır.</p>"
    return f"<html><head><title>{title} {i}</title></head><body><div class=n1>{nav}</div>{main}{foot}</body></html>"


def story(i):
    return f"<h1>Konu {i}</h1><div>Ada Ak - 01.02.2020</div><p>Bu <b>yazı</b> {i} numaralı konuyu uzun uzun anlatıyor ve hiçbir şeyi atlamıyor. İkinci cümle de burada duruyor.</p><div>Bültenimize abone olun, hiçbir gelişmeyi kaçırmayın.</div><table><tr><td>Şehir</td><td>Yer {i}</td></tr></table><blockquote>Son söz {i} idi.</blockquote><div><h3>Yorumlar</h3><div class=yorum><b>@a</b><p>ne güzel</p></div></div>"


FETCH = "fetch_id long, url string, final_url string, status int, html string, case_id string"


@pytest.fixture(scope="module")
def fetches(spark):
    rows = [(i, f"https://h{i % 4}.example/{i}", None, 200, page(i, story(i)), "C") for i in range(60)]
    rows += [(100 + i, f"https://h{i % 4}.example/e{i}", None, 404 if i % 2 else 200, page(i, "<h1>Sayfa bulunamadı</h1><p>Adresi denetleyin.</p>", "Hata"), "C") for i in range(24)]
    rows += [(200 + i, f"https://h{i % 4}.example/t{i}", None, 200, page(i, f"<h1>{{{{ad}}}}</h1><p>Merhaba ${{isim}}, bu sayfa {i} kez açıldı ve kayıt altında duruyor.</p>"), "C") for i in range(12)]
    rows += [(300, None, None, None, None, None), (301, "", "", None, "  \n", "C"), (302, "x", None, 200, "<p>", "C"), (303, "https://h1.example/l", None, 500, page(303, story(303) + "<p>" + " ".join(f"Uzun bir cümle daha, {k} ile {k * 7} arasında durur." for k in range(2000)) + "</p>"), "C")]
    return spark.createDataFrame(rows, FETCH)


def test_notices(fetches):
    got = {r["fetch_id"]: r["p"] for r in notices.notices(fetches).collect()}
    assert set(got) == {*range(60), *range(100, 124), *range(200, 212), 302, 303}
    assert all(got[i] < 0.5 for i in [*range(60), 303]) and all(got[i] >= 0.5 for i in [*range(100, 124), *range(200, 212)])


def test_notices_held_out(fetches):
    r = notices.notices(fetches).where("held_out and weak >= 0").collect()
    assert len(r) == 0 or np.mean([(x["p"] >= 0.5) == x["weak"] for x in r]) > 0.9


def test_notices_empty(spark):
    assert notices.notices(spark.createDataFrame([], FETCH)).count() == 0


def weak(main, status=200):
    html = page(1, main)
    return notices.features("Sayfa", [notices.Piece(b.text, b.score, b.tag, b.code) for b in mainbody.score_blocks(blocks(html))], status).weak


def test_code_samples_are_no_residue():
    assert weak(story(1) + "<p>Şablonda <code>{{ad}}</code> alanı</p>") == 0
    assert weak(story(1) + "<p>Merhaba {{ad}} alanı</p>") == 1


def test_notices_without_a_label_are_found(spark, fetches):
    """Notices in words that no weak label knows, with status 200, are still found: the classifier carries over from their likes."""
    more = [(400 + i, f"https://h{i % 4}.example/u{i}", None, 410 if i < 8 else 200, page(i, "<h1>Kayıt sahibi sayfayı kapattı</h1><p>Başka bir kayıt seçin.</p>", "Kapalı"), "C") for i in range(12)]
    got = {r["fetch_id"]: r for r in notices.notices(fetches.unionByName(spark.createDataFrame(more, FETCH))).collect()}
    assert all(got[i]["weak"] == -1 and got[i]["p"] >= 0.5 for i in range(408, 412))


def bodies(pages, gone, **settings):
    got = {}
    for r in mainbody.main_blocks(pages, gone, **settings).collect():
        got.setdefault(r["fetch_id"], set()).add(r["block_md5"])
    return got


def test_main_body(spark, fetches):
    gone = spark.createDataFrame([(100,)], "fetch_id long")
    got = bodies(mainbody.walked(fetches), gone)
    for i in range(60):
        want = {f"Konu {i}", f"Bu yazı {i} numaralı konuyu uzun uzun anlatıyor ve hiçbir şeyi atlamıyor. İkinci cümle de burada duruyor.", "Şehir", f"Yer {i}", f"Son söz {i} idi."}
        assert got[i] == {md5(x) for x in want}
    assert 100 not in got and 300 not in got and 301 not in got
    assert mainbody.main_blocks(mainbody.walked(fetches.limit(0)), gone).count() == 0


def test_paths_of_the_host_decide(spark):
    """A note that reads like main text stands on one path of the host; where it is short its own score gives it away, and the votes
    of those pages carry the others. A main paragraph without a sentence is carried likewise."""
    note = lambda i: "<div class=kq1>" + ("Yazdır | Gönder | Kaydet" if i else "Yazdır | Gönder | Kaydet ya da bu sayfanın tamamını başka bir yere taşıyabileceğiniz uzun bir satır halinde okuyabilirsiniz; bu satır asıl metin gibi görünür ama değildir, okuyana hiçbir şey anlatmaz, yalnızca yer kaplar ve sayfanın altında durur.") + "</div>"
    text = lambda i: f"<h1>Konu {i}</h1><div class=t2><p>Bu yazı {i} numaralı konuyu anlatıyor ve hiçbir şeyi atlamıyor. İkinci cümle burada.</p></div>"
    rows = [(i, "https://a.example/x", None, 200, f"<body>{text(i)}{note(i)}</body>", "C") for i in range(20)]
    pages, gone = mainbody.walked(spark.createDataFrame(rows, FETCH)), spark.createDataFrame([], "fetch_id long")
    by_path = {r["digest"].hex(): r["vote"] for r in mainbody.voted(pages).where("fetch_id = 1").collect()}
    assert by_path[md5("Yazdır | Gönder | Kaydet")] < 0 < by_path[md5("Konu 1")]
    with_votes, without = bodies(pages, gone), bodies(pages, gone, vote_weight=0.0)
    assert with_votes[1] == {md5("Konu 1"), md5("Bu yazı 1 numaralı konuyu anlatıyor ve hiçbir şeyi atlamıyor. İkinci cümle burada.")}
    assert set(without) == set(with_votes)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/fetches.parquet"), reason="no test tables here")
def test_votes_change_the_main_bodies(spark):
    pages = mainbody.walked(spark.read.parquet("/root/testdata/sf0.01/fetches.parquet"))
    gone = spark.createDataFrame([], "fetch_id long")
    a, b = ({tuple(r) for r in mainbody.main_blocks(pages, gone, vote_weight=w).collect()} for w in (1.0, 0.0))
    assert len(a ^ b) > 0.002 * len(a)


# ---- 3 -----------------------------------------------------------------------------------------------------------------

GAZ = personal.Gazetteer(frozenset({"isil", "ada", "melis"}), frozenset({"gokpinarci"}), frozenset({"tasbuk", "port", "selwick"}))


def found(text, gaz=GAZ):
    """What the labelers' beliefs alone accept, before anything is learned."""
    cands = []
    for c in personal.candidates_in(text, gaz):
        p = personal.reliabilities({c.votes: 1}, list(personal.LABELERS[c.type].values()), steps=0)[1][c.votes]
        if p >= 0.5:
            cands.append((c.type, c.start, c.end, c.value, p))
    return {(personal.TYPES[c[0]], c[3]) for c in personal.keep(cands)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("yaz: A.B+c@X-y.example.", {("EMAIL", "a.b+c@x-y.example")}), ("a_b [at] of [dot] ex [dot] test x", {("EMAIL", "a_b@of.ex.test")}), ("a(at)b.test", {("EMAIL", "a@b.test")}), ("adı @pusula9 olarak", set()),
        ("Tel. (598) 338-87-76 (mesai)", {("PHONE", "5983388776")}), ("(+1) 415-555-0142", {("PHONE", "14155550142")}), ("+90.597.708.33.54", {("PHONE", "905977083354")}), ("0090 592 942 59 37|05972952111", {("PHONE", "00905929425937"), ("PHONE", "05972952111")}),
        ("Sunucu 10.72.216.222 adresi", set()), ("23.09.2019 günü", set()), ("Sipariş numarası 85137399501 olan", set()), ("Kimlik No: 100 000 001 46", {("TCKN", "10000000146")}), ("no 10000000147", set()), ("10*******46", set()),
        ("IBAN TR33 0006 1005 1978 6457 8413 26 Dün 58 kişi", {("IBAN", "TR330006100519786457841326")}), ("tr330006100519786457841327", set()),
        ("Adres: Gül Mah. Uzun Sok. No: 4 D:3 Taşbük", {("ADDRESS", "Gül Mah. Uzun Sok. No: 4 D:3 Taşbük")}), ("Toplantıya IŞIL GÖKPINARCI başkanlık etti.", {("NAME", "IŞIL GÖKPINARCI")}), ("Işıl Gökpınarcı'in açıklaması", {("NAME", "Işıl Gökpınarcı")}),
        ("Gökpınarcı, Işıl", {("NAME", "Gökpınarcı, Işıl")}), ("I. Gökpınarcı", {("NAME", "I. Gökpınarcı")}),
    ],
)
def test_candidates(text, want):
    assert found(text) == want


def test_candidates_are_wide():
    types = Counter(c.type for c in personal.candidates_in("Deniz Lojistik A.Ş. ve Uzun Sokak 14.02.2019 tarihinde Kuzey Feneri ile 12345678 sayılı", GAZ))
    assert types[5] >= 3 and types[1] >= 1  # firms, streets and dates are candidates too: the votes decide


@pytest.mark.parametrize("tail", ["", " " + "Nobody could say why it had to be so. " * 40])
def test_addresses_in_blocks_of_any_length(tail):
    assert found("The firm moved to 16 Copper Bell Avenue, Ashcombe last year and nobody noticed it." + tail) == {("ADDRESS", "16 Copper Bell Avenue, Ashcombe")}


def test_half_of_the_cues_will_do(monkeypatch):
    import re

    cut = {k: re.compile(r"(?:^|\W)(?:" + "|".join(personal.CUES[k].split("|")[::2]) + ")") for k in ("phone", "tckn", "email", "iban", "before")}
    monkeypatch.setattr(personal, "_cues", personal._cues | cut)
    assert found("Toplantıya Işıl Gökpınarcı başkanlık etti, 0598 338 87 76, Kimlik No: 100 000 001 46") == {("NAME", "Işıl Gökpınarcı"), ("PHONE", "05983388776"), ("TCKN", "10000000146")}


def test_reliabilities_are_learned():
    beliefs = [(0.6, 0.2, 0.2, 0.6)] * 3
    good, bad = 0b010101, 0b101010  # all for, all against
    liar = 0b100101  # the third labeler goes against what the others say
    r, p = personal.reliabilities({good: 100, bad: 100, liar: 90, 0b011010: 90}, beliefs)
    assert p[good] > 0.9 and p[bad] < 0.1 and p[liar] > 0.8
    assert r.accuracy()[2] < r.accuracy()[0] and personal.reliabilities({}, beliefs)[1] == {}


def test_garbled_names_keep_their_spelling():
    garbled = "ToplantÄ±ya IÅŸÄ±l GÃ¶kpÄ±narcÄ± baÅŸkanlÄ±k etti."
    assert ("NAME", "IÅŸÄ±l GÃ¶kpÄ±narcÄ±") in found(garbled)


def test_personal_information(spark):
    pages = spark.createDataFrame([(1, "<head><title>Işıl Gökpınarcı</title></head><p>Sorumlu kişi: Işıl Gökpınarcı.<p>Tel 0598 338 87 76, isil@e.test<p>© Deniz Lojistik A.Ş."), (2, None), (3, ""), (4, "<p>" + "düz yazı " * 30_000)], "fetch_id long, html string")
    an = spark.createDataFrame([(7, ["Phone (0597 359 02 26)", None], {"emails": ["mail a@b.test until", None], "x": None}), (8, None, None)], "analysis_id long, data_types array<string>, matched map<string,array<string>>")
    subjects = spark.createDataFrame([("Işıl Gökpınarcı", None, None, None), (None, ["Deniz Kaya"], ["Taşbük"], ["Gül Sok. 4, Taşbük"])], "full_name string, relatives array<string>, cities array<string>, addresses array<string>")
    spans, report = personal.personal_information(pages, an, subjects)
    got = {tuple(r) for r in personal.values(spans).collect()}
    assert got == {("fetches", 1, "NAME", "Işıl Gökpınarcı"), ("fetches", 1, "PHONE", "05983388776"), ("fetches", 1, "EMAIL", "isil@e.test"), ("analyses", 7, "PHONE", "05973590226"), ("analyses", 7, "EMAIL", "a@b.test")}
    text = {(r["src"], r["rec_id"]): r["text"] for r in personal.redacted(spans).collect()}
    assert text["fetches", 1] == "Sorumlu kişi: [NAME].\nTel [PHONE], [EMAIL]\n© Deniz Lojistik A.Ş." and text["analyses", 7] == "Phone ([PHONE])\nmail [EMAIL] until"
    assert all(0 <= a <= 1 for r in report.values() for a in r.accuracy())
    joined = personal.values(personal.personal_information(pages, an, subjects, broadcast_words=0)[0])
    assert {tuple(r) for r in joined.collect()} == got
    assert personal.values(personal.personal_information(pages, an, subjects, least=-1)[0]).count() >= len(got)


def test_personal_empty(spark):
    empty = spark.createDataFrame([], "fetch_id long, html string"), spark.createDataFrame([], "analysis_id long, data_types array<string>, matched map<string,array<string>>"), spark.createDataFrame([], "full_name string, relatives array<string>, cities array<string>, addresses array<string>")
    assert personal.values(personal.personal_information(*empty)[0]).count() == 0


# ---- 4 -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["kayıt", "Şahin", "gölge", "çağrı", "İğde", "café", "plain"]), min_size=1, max_size=6), st.sampled_from(["cp1252", "latin-1", "mac_roman", "cp850"]), st.integers(1, 2))
def test_repair_round_trip(words, codec, times):
    text = " ".join(words)
    garbled = text
    for _ in range(times):
        garbled = "".join(encoding._bytes_as(codec)[b] for b in garbled.encode())
    assert encoding.repair(garbled)[0] == text


@pytest.mark.parametrize("text", ["Þórdís Ýmisdóttir: sýning í Larvík", "SÃO BRÁS – programação", "Âge d’or à Montcorbière", "Ðurđica Žarković, članak", "Kto? Co? Gdzie?", "Söðüt ðüç", "N’Diélé – où êtes-vous ?"])
def test_correct_text_stays(text):
    assert encoding.repair(text) == (text, False, False)
    assert encoding.substitute(text, frozenset({"kaydı"})) == (text, False)


def test_restore(spark):
    clean = ["Arşiv kaydı ve ılık gölge", "Şüpheli kayıt başlığı", "Çağrı İğde", "Doğrulanmış ılık kayıt"]
    bad = [("".join(encoding._bytes_as("cp1252")[b] for b in t.encode()), t) for t in clean] + [(t.encode("cp1254").decode("cp1252"), t) for t in clean]
    rows = [(i, t, "x") for i, t in enumerate(clean)] + [(10 + i, g, "x") for i, (g, _) in enumerate(bad)]
    rows += [(50, None, None), (51, "", None), (52, "Þórdís Ýmisdóttir", None), (53, "Ar�iv kayd�", None), (54, "Ar?iv kayd? ve ?l?k g?lge", None), (55, "Kim? Ne?", None), (56, bad[0][0] + " " + "uzun " * 20_000, None), (57, bad[1][0], None), (58, "Ar?iv kayd? ve ?l?k g?lge", None)]
    df = spark.createDataFrame(rows, "id long, title string, fixed string")
    texts = df.select(F.col("title").alias("text"))
    votes = encoding.learn(texts, least=1)
    assert votes["cp1252"] > 0 and votes["lost:?"] > 0
    got = {r["id"]: (r["fixed"], r["lost"]) for r in encoding.restore(df, ["id"], "title", votes, encoding.clean_words(texts)).collect()}
    assert {k: v[0] for k, v in got.items() if 10 <= k < 50} == {10 + i: t for i, (_, t) in enumerate(bad)}
    assert got[53] == got[54] == (None, True) and got[56][0].startswith(clean[0] + " uzun") and got[57][0] == clean[1]
    assert not {0, 1, 2, 3, 50, 51, 52, 55} & set(got)
    empty = encoding.learn(texts.limit(0))
    assert empty == {} and encoding.restore(df.limit(0), ["id"], "title", empty).count() == 0


@pytest.mark.parametrize("codec", ["cp1250", "cp1251", "cp850"])
def test_encoding_learned_substitutions(spark, codec):
    clean = [f"{w} {i}" for i in range(3) for w in ("Yağmur ışığı", "Beşiktaş dağı", "şoför ağı")]
    bad = [t.encode("cp1254").decode(codec) for t in clean]
    texts = spark.createDataFrame([(t,) for t in clean * 2 + bad], "text string")
    votes = encoding.learn(texts)
    df = spark.createDataFrame([(0, bad[0]), (1, bad[1]), (2, "Đorđe Ţepeş"), (3, clean[0])], "id long, title string")
    got = {r["id"]: r["fixed"] for r in encoding.restore(df, ["id"], "title", votes, encoding.clean_words(texts)).collect()}
    assert got == {0: clean[0], 1: clean[1]}


def test_decoder_without_a_name_is_learned(spark):
    codec = "cp866"
    assert codec not in encoding.WRONG
    clean = [f"{w} {i}" for i in range(3) for w in ("çağrı şubesi", "gölge şoför", "dağ üzüm kayıt " + "ğışçöü" * 9)]
    garble = lambda t: "".join(encoding._bytes_as(codec)[b] for b in t.encode())
    texts = spark.createDataFrame([(t,) for t in clean * 2 + [garble(t) for t in clean]], "text string")
    votes = encoding.learn(texts)
    df = spark.createDataFrame([(0, garble("üçüncü kaşığı")), (1, "üçüncü kaşığı")], "id long, title string")
    got = {r["id"]: r["fixed"] for r in encoding.restore(df, ["id"], "title", votes, encoding.clean_words(texts)).collect()}
    assert got == {0: "üçüncü kaşığı"}


def test_encoding_damage_after_many_runs():
    late = "şu “söz” ğ ş € “ş”"
    text = "ı " * 500 + "".join(encoding._bytes_as("cp1252")[b] for b in late.encode())
    assert encoding.repair(text, ("iso8859-15", "cp1252"))[0] == "ı " * 500 + late


def test_encoding_substitutions_chosen():
    assert encoding.substitutions({"1:đğ": 3, "1:ğđ": 1, "1:đş": 2, "1:öü": 9, "1:ţş": 1, "1:’‘": 9}) == {"đ": "ğ"}
    assert encoding.substitutions({"1:ýı": 1}) == encoding.TURKISH_BYTES


# ---- 6 -----------------------------------------------------------------------------------------------------------------

ADDRESSES = [
    (1, "Gülveren Mahallesi, Alacalı Değirmen Caddesi No: 22 K.1 D.28, Üzümlü Derbentli"), (2, "ALACALI DEĞİRMEN CAD. NO:22, ÜZÜMLÜ"), (3, "Derbentli - Üzümlü - Gülveren mah - Alacali Degrmen Cd. 22/3"), (4, "Alacalı Değirmen Sokak No: 22, Üzümlü"), (5, "Alacalı Değirmen Caddesi No: 23, Üzümlü"), (6, "Alacalı Değirmen Caddesi No: 22, Üzümlüdere"),
    (7, "Flat 3, 16 Copper Bell Ave., Ashcombe QA1 2ZZ"), (8, "Ashcombe, 16 Coper Bell Avenue"), (9, "16 Copper Bell Lane, Ashcombe"), (10, None), (11, " "), (12, "bilinmiyor"), (13, "bilinmiyor"),
]


def test_linked_by_sound_within_a_district(spark):
    rows = [(1, "ihlamur", "cadde", "5", "moda", "", "merkez", "sarihan"), (2, "ihlemor", "cadde", "5", "moda", "", "merkez", "sarihan"), (3, "ihlemor", "cadde", "6", "moda", "", "merkez", "sarihan"), (4, "ihlamur", "cadde", "5", "moda", "", "liman", "sarihan")]
    t = spark.createDataFrame(rows, "tid long, street string, stype string, number string, hood string, postcode string, district string, province string")
    assert [tuple(r) for r in addresses.linked(t).collect()] == [(1, 2)]


def test_same_building(spark):
    more = [(100 + i, f"Alacalı Değirmen Caddesi No: {i + 30}, Üzümlü/Derbentli") for i in range(30)] + [(200 + i, f"{i + 50} Copper Bell Avenue, Ashcombe") for i in range(30)]
    df = spark.createDataFrame(ADDRESSES + more, "addr_id long, address_text string").withColumn("id", F.lit("clash"))
    assert {tuple(r) for r in addresses.same_building(df).collect()} == {(1, 2), (1, 3), (2, 3), (7, 8), (12, 13)}
    assert addresses.same_building(df.limit(0)).count() == 0


def test_weights_decide(spark):
    """Pairs that only the weights turn down: with every probability taken for enough they are links."""
    rows = [(i, "ihlamur", t, str(n), "", "", "merkez", "") for i, (t, n) in enumerate([("cadde", n) for n in range(30) for _ in (0,)] + [("sokak", n) for n in range(6)])]
    rows += [(100 + n, "ihlamur", "cadde", str(n), "moda", "", "merkez", "") for n in range(30)]
    t = spark.createDataFrame(rows, "tid long, street string, stype string, number string, hood string, postcode string, district string, province string")
    links, met = ({tuple(r) for r in addresses.linked(t, p).collect()} for p in (addresses.MATCH, 0.0))
    assert links == {(n, 100 + n) for n in range(30)} and len(met) > len(links)


def test_many_copies_are_salted(spark):
    df = spark.range(2100).select(F.col("id").alias("addr_id"), F.lit("Gül Sokak No: 4 Taşbük").alias("address_text"))
    assert addresses.same_building(df).count() == 2100 * 2099 // 2


# ---- 8, 9 --------------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not HAS_RANKS, reason="no vocabulary here")
@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(1, 12))
def test_pieces_and_decode(text, size):
    text = "".join(c for c in text if not 0xD800 <= ord(c) < 0xE000)
    enc = tokens.load(tokens.vocabulary_path())
    ids = enc.encode_ordinary(text)
    assert [t for p in tokens.safe_pieces(text, size) for t in enc.encode_ordinary(p)] == ids
    assert tokens.decode(ids, enc) == text


@pytest.mark.skipif(not HAS_RANKS, reason="no vocabulary here")
def test_encode_column(spark):
    rows = [(1, "Merhaba dünya"), (2, None), (3, ""), (4, " \n "), (5, "a" * 60_000 + " son"), (1, "Merhaba dünya")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    enc = tokens.load(tokens.vocabulary_path())
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.encode_column(df, "text", ["doc_id"]).collect())
    assert got == Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in rows)
    assert tokens.encode_column(df.limit(0), "text", ["doc_id"]).count() == 0


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixture.permute(np.arange(n), np.full(n, n), np.full(n, 7))) == list(range(n))


def test_mix(spark):
    docs = spark.createDataFrame([(i, "a", [i] * 7) for i in range(200)] + [(1000 + i, "b", [i] * 9) for i in range(20)] + [(2000, None, [1]), (2001, "z", [1]), (2002, "a", []), (2003, "a", None)], "doc_id long, source string, ids array<int>")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4), ("none", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs, targets, block=16, shard_blocks=10).cache()
    rows = mixed.collect()
    uses = Counter((r["source"], r["index"]) for r in rows)
    assert max(uses[k] for k in uses if k[0] == "a") == 1 and max(uses[k] for k in uses if k[0] == "b") <= 4
    share = {r["source"]: r for r in mixture.shares(mixed, targets).collect()}
    assert abs(share["a"]["actual_share"] - 0.5) < 0.05 and share["none"]["n_tokens"] == 0
    packed = mixture.packed_blocks(docs.where("source in ('a', 'b')"), 16).collect()
    assert Counter(t for r in packed if r["source"] == "b" for t in r["ids"]) == Counter(i for i in range(20) for _ in range(9))
    assert all(r["n_tokens"] == 16 for r in packed if r["index"] < max(x["index"] for x in packed if x["source"] == r["source"]))
    assert mixture.mix(docs.limit(0), targets).count() == 0


def test_shares_at_any_total():
    for n in (10**5, 10**10):
        q = mixture.quotas({"a": n, "b": n // 10}, [("a", 0.5, 1), ("b", 0.5, 4)])
        counts = mixture.shard_counts(q, shard_blocks=n // 50)
        assert {s: sum(c for _, x, _, c in counts if x == s) for s in q} == q


def test_shards_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(mixture, "MAX_GROUPS", 3)
    docs = spark.createDataFrame([(i, "a", [i] * 8) for i in range(400)] + [(1000 + i, "b", [i] * 8) for i in range(100)], "doc_id long, source string, ids array<int>")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    mixed = mixture.mix(docs, targets, block=8, shard_blocks=16).cache()
    sizes = Counter(r["shard"] for r in mixed.select("shard").collect())
    assert sum(sizes.values()) == 800 and sorted(sizes.values())[1] == 16 and max(sizes.values()) == 16 and len(sizes) == 50
    uses = {(r["doc_id"], r["source"]): r for r in mixture.document_uses(mixed).collect()}
    assert len(uses) == 500 and all(r["used_tokens"] == 8 * r["most_uses"] and r["most_uses"] == (1 if s == "a" else 4) for (_, s), r in uses.items())


# ---- 10 ----------------------------------------------------------------------------------------------------------------

PROSE = "The meeting was held in the old hall and nobody wanted to say who had asked for it. It is not clear why the file was sent back to the office."
TEXTS = {
    "prose": [PROSE, PROSE.lower().replace(".", ""), PROSE + "\n- one\n- two", PROSE * 40],
    "list": ["- Ada Ak\n- Lodos Veri\n- ledger clerk\n- Ashcombe", "Home\nNews\nContact\nHelp\nJoin", "https://a.example/1\nhttps://b.example/2\nhttps://c.example/3", "ada ak, lodos veri, ledger clerk, ashcombe, news, home, 0598 111 22 33"],
    "table": ["a|b|c|1\na|d|c|2\na|e|f|3", "Ada Ak\tYelova\t12\t01.01.2020\nEce Ak\tYelova\t13\t02.01.2020", "Name: Ada\nTown: Yelova\n\nName: Ece\nTown: Moran"],
    "junk": ["x9Jf" * 30 + "==", "=-" * 60, "function a(b){return b&&c?d[1]:void 0};var x=function(){return 1};", "d9 e5 9d cb ca 34 03 64 3d 96 1d ef", "copy list copy result copy list notice copy list copy result notice copy list"],
}


def test_text_types(spark):
    rows = [(k, t) for k, ts in TEXTS.items() for t in ts for _ in range(5)]
    df = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)] + [(900, None, ""), (901, "", ""), (902, " \n", "")], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["kind"] for r in quality.text_types(df, ["the", "was", "in", "and", "to", "it", "is", "not", "for"]).collect()}
    assert got == {i: k for i, (k, _) in enumerate(rows)}
    assert quality.text_types(df.limit(0), []).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(1, "Ab cd.\nEf!x"), (2, None), (3, ""), (4, "  ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.statistics(df, ["ab"]).collect()}
    r = got[1]
    assert (r["n_chars"], r["n_words"], r["mean_word_length"], r["line_end_ratio"], r["common_ratio"]) == (11, 3, 3.0, 0.5, round(1 / 3, 6))
    assert got[2]["n_words"] is None and got[3]["n_words"] == 0 and got[3]["mean_word_length"] is None and got[4]["n_words"] == 0
    assert quality.common_words(df, top=2) == ["ab", "cd"]


def test_rates_stay_sane():
    rates = quality.fit({0b11: 50, 0b1: 10, 1 << 13: 5})
    assert ((rates >= 0.002) & (rates <= 0.998)).all() and (quality.fit({}) == quality.start()).all()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no test tables here")
def test_learning_moves_types(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    common = quality.common_words(docs)
    a, b = ({(r["doc_id"], r["kind"]) for r in quality.text_types(docs, common, learned=x).collect()} for x in (True, False))
    assert len(a - b) > 0.02 * len(a)
