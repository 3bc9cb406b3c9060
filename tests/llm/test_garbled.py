from __future__ import annotations

from datetime import datetime

from plumbline.llm.garbled import TRUE_DOUBLE, TRUE_SINGLE, WRONG_DOUBLE, WRONG_SINGLE, _read, find_garbled, garbled_captures, is_garbled, restore

from tests.conftest import rows

TEXTS = ["Größe für später", "호스 릴 목록으로", "最近見た商品 ホース", "Kaposé Señalta Âmbria", "© 2026 – “x” … €"]
GOOD = [*TEXTS, "SÃO Âmbria", "SÃO ÂMBRIA", "Vêtrine forêt", "10 °C · 20 °C", "рrіcе еѕѕ Теѕѕаrо", "В Москве «день»", "ÄÖÜ ÀÉ", "Ｆüｒ ＥＬＫ", "ﾎｰｽ ﾘｰﾙ", "漢字カナ交じり", "", "plain", "²³½", unicode_damage := "Ångvik la​bel"]


def wrong(text: str, true: str, shown: str) -> str:
    return text.encode(true, "ignore").decode(shown, "replace")


def test_good_text_is_left_alone():
    for text in GOOD:
        assert not is_garbled(text), text
        assert restore(text) == text
    assert not is_garbled(None) and restore(None) is None
    assert not is_garbled("S&Atilde;O &#194;mbria Vêtrine")


def test_wrong_readings_are_found_and_restored():
    for text in TEXTS:
        for shown in ("latin-1", "mac_roman", "cp437"):
            bad = wrong(text, "utf-8", shown)
            assert is_garbled(bad), (text, shown)
            assert restore("ok " + bad + " ok") == "ok " + text + " ok", (text, shown)
    twice = wrong(wrong("Kaposé Gerät", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert restore(twice) == "Kaposé Gerät"
    assert restore(wrong("장바구니 목록", "euc-kr", "latin-1")) == "장바구니 목록"


TEN = [
    ("utf-8", "Größe für später im Gerät"), ("utf-8", "호스 릴 목록으로 돌아가기 장바구니"), ("euc-kr", "전체 카테고리 모두 동의 공유하기"), ("euc-jp", "最近見た商品 ホース リールのご案内"),
    ("utf-8", "Kaposé Señalta Âmbria à la carte"), ("cp1251", "Привет как дела сегодня в Москве"), ("cp1253", "Καλημέρα σε όλους τους φίλους"), ("gbk", "我们提供各种商品的租赁服务"),
    ("big5", "我們提供各種商品的租賃服務"), ("utf-8", "© 2026 Preis 20 € – “später” …"),
]
TRUE = ("utf-8", *TRUE_DOUBLE, *TRUE_SINGLE, "cp1252", "latin-1", "mac_roman")


def test_every_text_in_every_pair_is_restored_or_left():
    """A restored text is the original, never a third one, whatever encodings were mistaken."""
    restored = 0
    for _, text in TEN:
        for true in TRUE:
            for shown in (*WRONG_SINGLE, *WRONG_DOUBLE):
                try:
                    data = text.encode(true)
                except UnicodeEncodeError:
                    continue
                bad = data.decode(shown, "replace") if shown in WRONG_DOUBLE else _read(data, shown)
                got = restore(bad)
                assert got in (text, bad), (true, shown, bad, got)
                restored += got == text != bad
    assert restored > 170
    for true, text in TEN:
        for shown in ("latin-1", "cp1252"):
            bad = _read(text.encode(true), shown)
            assert is_garbled(bad), (true, text)
            assert restore(bad) == text or true in ("gbk", "big5"), (true, text, restore(bad))
    assert restore(_read("전체 카테고리".encode("euc-kr"), "latin-1")) == "전체 카테고리"


def test_utf8_read_two_bytes_at_a_time():
    for text in ("호스 릴 목록으로", "전체 상품 보기", "Größe für später", "Señalta"):
        for shown in ("cp949", "gbk"):
            try:
                bad = text.encode().decode(shown)
            except UnicodeDecodeError:
                continue
            assert is_garbled(bad) and restore(bad) == text, (text, shown, bad)
    assert restore("Gr철횩e") == "Größe" and not is_garbled("SK철강 A채 LG체") and not is_garbled("é\xa0à\xa0bord")


def test_references_are_restored_where_they_stand():
    assert restore("<p>Caf&Atilde;&copy; &amp; Cr&egrave;me &#195;&#188;ber</p>") == "<p>Café &amp; Cr&egrave;me über</p>"
    assert restore("Cr&egrave;me &amp; é") == "Cr&egrave;me &amp; é"


def test_a_stretch_is_restored_as_a_whole():
    lost = "FÃ¼r GerÃ\ufffdte"
    assert is_garbled(lost) and restore(lost) == lost and restore(lost, by_word=True) == "Für GerÃ\ufffdte"
    assert restore(f"<b>{lost}</b>\nfÃ¼r") == f"<b>{lost}</b>\nfür"
    text = "Größe für"
    for _ in range(6):
        text = wrong(text, "utf-8", "latin-1")
    assert restore(text) == "Größe für"


def test_unrestorable_ones_are_found():
    for text, true, shown in (("호스 릴 목록으로", "utf-8", "cp949"), ("호스 릴", "euc-kr", "utf-8"), ("Señalta", "latin-1", "utf-8"), ("ホースリールのご案内", "utf-8", "cp932")):
        assert is_garbled(wrong(text, true, shown)), (text, true, shown)
    assert is_garbled("Caf&Atilde;&copy;") and is_garbled("a\x9db")


def test_mixed_text_keeps_its_correct_part():
    good = "바른저울 Brûlon"
    page = good + "\n" + wrong("SÃO Âmbria", "utf-8", "cp1252") + "\n" + good
    spans = find_garbled(page)
    assert spans and all(len(good) < s and e <= len(page) - len(good) for s, e, _ in spans)
    assert restore(page) == good + "\nSÃO Âmbria\n" + good


def test_captures(spark):
    t1, t2 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    shape = "capture_id string, ingested_at timestamp_ntz, content binary, media_type string, garbled int, v string"
    bad = wrong("Größe", "utf-8", "latin-1").encode()
    data = [
        ("a", t1, bad, None), ("b", t1, "Größe".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("c", t1, "Größe".encode(), "text/html; charset=iso-8859-1"), ("d", t1, None, None),
        ("e", t1, b"", None), ("f", t1, bad, None), ("f", t2, b"fine", None), ("g", None, "Größe".encode("latin-1"), None), (None, t1, bad, None), ("h", t1, ("좋은 글 " * 100_000).encode() + bad, None),
        ("a", t1, bad, None),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], shape)
    got = {r.capture_id: r.restored for r in garbled_captures(df).collect()}
    assert set(got) == {"a", "c", "g", "h"} and got["a"] == got["c"] == "Größe" and got["h"].endswith("Größe")
    assert rows(garbled_captures(df, restored=False).select("capture_id")) == [(k,) for k in "acgh"]
    assert garbled_captures(df.limit(0)).count() == 0


def test_an_invisible_hyphen_is_no_garbled_letter():
    assert not is_garbled("SÃ\xadO Â\xadmbria") and not is_garbled("SÃO Âmbria")
    assert is_garbled(wrong("jardín más", "utf-8", "latin-1"))
