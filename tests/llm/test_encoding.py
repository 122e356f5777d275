"""Repair of wrongly decoded text: exact round trips, sound texts left alone."""

import pytest

from marlstone.llm.encoding import SWAPS, repair, repair_values, utf8_spans

SOUND = [
    None, "", "plain", "Gebühren für Wukek sinken kräftig", "NÃO É HORA de vender, diz gestão de Łódka Pool", "¿Se acabó la caída de Bonax?", "L’âge d’or est-il terminé ?", "« Le pont est sûr. »", "“Nothing was lost”: Zürnberg — first take", "Größere Käufer", "€5.2m ±0.5",
    "Майнеры города Karsk отключают фермы", "ПОЧЕМУ ДЕРЖАТЕЛИ НЕ ПРОДАЮТ", "Γιατί δεν πωλούν οι κάτοχοι;", "手续费已降至1.01美元。“资金没有移动。”", "市场在等待……随后上涨", "ある口座から35枚のKohuwが移された。", "के निवेशक क्यों नहीं बेच रहे", "ทำไมผู้ถือยังไม่ขาย", "لماذا لا يبيع حاملو", "OPERAÇÃO À VISTA É SUSPENSA", "São Albano矿工关机",
]
TEXTS = [
    "Gebühren für Wukek sinken kräftig", "Où sont passés les jetons gelés ? L’âge d’or — terminé", "“Nothing was lost”: Łódka Pool raises €5.2m", "Почему держатели Ranid не продают", "なぜHipohは売られないのか", "矿工关机，算力下降", "के निवेशक क्यों नहीं बेच रहे", "ทำไมผู้ถือ Sidup ยังไม่ขาย", "منصة تضيف إلى قائمتها", "Γιατί δεν πωλούν οι κάτοχοι",
]


def misread(text, codec):
    """UTF-8 bytes read in a single-byte set; open bytes come through as controls."""
    out = ""
    for b in text.encode():
        try:
            out += bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("text", SOUND)
def test_sound(text):
    assert repair(text) == (text, None)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r"])
@pytest.mark.parametrize("text", TEXTS)
def test_utf8_misread(text, codec):
    assert repair(misread(text, codec)) == (text, "restored")


@pytest.mark.parametrize("text", TEXTS[:4])
def test_twice(text):
    assert repair(misread(misread(text, "cp1252"), "cp1252")) == (text, "restored")


@pytest.mark.parametrize("text,codec", [("矿工关机，算力下降", "gbk"), ("なぜHipohは売られないのか", "euc_jp"), ("なぜHipohは売られないのか", "shift_jis"), ("Почему держатели Ranid не продают", "cp1251"), ("Γιατί δεν πωλούν οι κάτοχοι", "iso8859_7")])
def test_legacy_read_as_western(text, codec):
    assert repair(text.encode(codec).decode("latin-1"))[1] == "restored"
    assert repair(text.encode(codec).decode("latin-1"))[0] == text


def test_koi8_read_as_1251():
    text = "Майнеры в городе Karsk отключили фермы"
    assert repair(text.encode("koi8_r").decode("cp1251")) == (text, "restored")


def test_stretch_and_loss():
    assert repair("नहीं " + misread("बेच रहे", "cp1252")) == ("नहीं बेच रहे", "restored")
    assert repair("Geb�hren f�r") == ("Geb�hren f�r", "lost")
    assert repair("Ni帽o Azul") == ("Niño Azul", "restored")
    assert utf8_spans("CafÃ© Ã", "latin-1")[1] == [(3, 5, "é")]


@pytest.mark.parametrize("text", ["回落", "资金没有移动", "Почему держатели", "ไม่ขาย"])
def test_stretch_after_sound_wide_text(text):
    for before, after in (("比特币", ""), ("", "，比特币"), ("比特币", "，矿工")):
        bad = text.encode().decode("gb18030", "replace")
        if "�" not in bad:
            assert repair(before + bad + after) == (before + text + after, "restored")


def test_stretch_after_a_lost_byte():
    bad = "。资金没有移动".encode()[1:].decode("gb18030", "replace")
    restored, kind = repair("�" + bad)
    assert "资金没有移" in restored and kind == "partial"
    assert repair("�傝祫閲戞病鏈夌Щ鍔ㄣ�") == ("��资金没有移动��", "partial")


#: Text whose only letter outside ASCII reads as an odd one, by pair of SWAPS.
SINGLE = {
    ("mac_roman", "cp1252"): "hôtel de ville", ("cp1252", "mac_roman"): "mañana vuelve", ("cp1252", "cp437"): "hôtel de ville", ("cp1252", "cp850"): "schön und gut", ("cp437", "cp1252"): "café noir", ("cp850", "cp1252"): "hôtel de ville", ("cp1251", "cp1252"): "hôtel de ville", ("koi8_r", "cp1252"): "Stadt Köln", ("cp1253", "cp1252"): "mañana vuelve",
}


@pytest.mark.parametrize("pair", SINGLE)
def test_one_damaged_letter(pair):
    assert pair in SWAPS and repair(SINGLE[pair].encode(pair[1]).decode(pair[0])) == (SINGLE[pair], "restored")


def test_quote_inside_a_word():
    for text in ("hôtel", "Stadt Köln", "schön"):
        for codec in ("cp437", "cp850"):
            assert repair(text.encode(codec).decode("cp1252")) == (text, "restored")


def test_long_text():
    text = "Gebühren sinken. " * 20_000
    assert repair(misread(text, "cp1252")) == (text, "restored")


def test_values(spark):
    bad = misread("Café", "cp1252")
    df = spark.createDataFrame([(1, bad, None, "x"), (1, bad, bad, "x"), (2, "", "fine é", "x"), (3, None, None, "x")], "id int, headline string, snippet string, value string")
    rows = sorted((r.id, r.field, r.restored, r.kind) for r in repair_values(df, "id", ["headline", "snippet"]).collect())
    assert rows == [(1, "headline", "Café", "restored")] * 2 + [(1, "snippet", "Café", "restored")]
    assert repair_values(df.limit(0), "id", ["headline"]).count() == 0


WORLD = [
    "🚀 to the moon", "₿ up", "✅ done", "→ next", "Giá bitcoin giảm mạnh", "מחיר הביטקוין ירד היום", "Բիթքոինի գինը նվազեց այսօր", "Ціна біткоїна впала", "Bitcoin — ‘up’", "price ≥ 5 €", "한국 시장이 상승했다", "ราคาลดลง", "日本 🚀", "ქართული ტექსტი",
]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866"])
@pytest.mark.parametrize("text", WORLD)
def test_symbols_and_scripts_of_the_world(text, codec):
    assert repair(misread(text, codec)) == (text, "restored")


@pytest.mark.parametrize("codec", ["cp1253", "iso8859_15"])
@pytest.mark.parametrize("text", WORLD)
def test_never_restored_wrongly(text, codec):
    got, kind = repair(misread(text, codec))
    assert got == text or kind != "restored"


@pytest.mark.parametrize("text", [*WORLD, "café…”", "il a dit à « Karsk »", "« passé »", "«Банк»—это", "своё «дело»…", "Україна їхати «Рівне»", "été…» dit-il", "Đồng giảm ‘mạnh’…", "שלום “עולם”…", "âme sœur… là", "NÃO, A MÃO", "Łódź, Straßenöße"])
def test_sound_of_the_world(text):
    assert repair(text) == (text, None)
