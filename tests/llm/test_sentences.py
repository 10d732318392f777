from __future__ import annotations

import pytest

from marlstone.llm.sentences import sentence_units, split_sentences

CASES = {
    "en": ["Dr. Vell and Prof. Ostrander signed.", "It cost U.S. users 317.60 ether, i.e. less than 5%.", "They checked caps, roles, etc.", "Wait... f() is public!", "He wrote: \"This is wrong. Stop it!\"", "Is it ever reset?!", "\"Why twice?\" asked the auditor.", "The note (see App. B. It is short.) lists 3.", "doIt() is reached at 9 a.m. on p. 3 ff. of it.", "J. Marrow agreed.", "Plan A beats plan B.", "Docs live at https://a.example/v1.0/x?id=3 for now.", "See Fig. 3 and No. 4.", "It is capped by cap.", "He said no.", "See App. B for more.", "Use msg.sender, not tx.origin, in A.sol.", "It was sold to Tallow Inc.", "Version v2.1. was a typo.", "The log says waiting ... and then nothing."],
    "de": ["Am 7. Mai 2025 fiel es auf 41,24.", "Wir fanden 5 Stellen, u. a. den Zugriff auf x.", "Nr. 594 betrifft A, z. B. in b().", "Sie schrieb: „Das ist falsch. Halt!“", "Hr. Dr. Falkner sah d. h. nichts."],
    "fr": ["L'auditeur note : « C'est faux. Il faut arrêter. »", "Pourquoi f() renvoie-t-elle 0 ?", "Voir l'art. 5 et la fig. 8.", "D'après M. Vellard, c'est env. 5,7."],
    "es": ["¿Por qué devuelve 0?", "¡No publiquen!", "La Sra. Velasco midió 3, p. ej. después.", "Cobra a usuarios de EE. UU. y a otros."],
    "ru": ["Эксперт А. Б. Велин насчитал 5.", "Комиссия выросла, т. к. x не сбрасывается.", "См. п. 5 и рис. 6.", "Забыли роли, лимиты и т. д.", "По данным на 5 мая 2019 г. потери составили 5.", "Аудитор написал: «Это ошибка. Стойте.»"],
    "hi": ["डॉ. वेलन के अनुसार।", "क्या मान 0 है?", "समीक्षक ने लिखा: \"यह गलत है। रोकें।\"", "उसने जाँच नहीं की।"],
    "ar": ["هل تعيد القيمة 0؟", "قال د. فلان إن ذلك صحيح.", "كتب المدقق: «هذا خطأ. أوقفوا.»", "خسر 5 رمزا؛ والسبب هو هذا."],
    "ko": ["감사자는 \"이것은 오류다. 멈춰라.\"라고 적었다.", "왜 0을 반환합니까?", "v0.1.2 버전에서 바뀌었습니다."],
}


@pytest.mark.parametrize("language", CASES)
def test_spaced(language):
    for gap in (" ", "\n", "  "):
        want = CASES[language]
        text = gap.join(want)
        assert [text[a:b] for a, b in sentence_units(text)] == want


@pytest.mark.parametrize(
    "want",
    [["审计人员写道：“这是错误的。请停止！”然后离开。", "谁可以修改?", "从v1.0.3到v0.2.1，没有检查。"], ["監査人は「誤りです。止めて。」と書いた。", "なぜ0を返すのですか?", "Irisは5行ある。"], ["ファイルはない！", "はい。"]],
)
def test_unspaced(want):
    text = "".join(want)
    assert [text[a:b] for a, b in sentence_units(text)] == want


def test_thai():
    want = ["ไฟล์ A.sol มี 5 บรรทัดซึ่งควรอ่านให้ครบ", "ห้ามเผยแพร่ X เมื่อ y ยังว่างอยู่", "หลังจาก 3 บล็อก"]
    for gap in (" ", "\n"):
        text = gap.join(want)
        assert [text[a:b] for a, b in sentence_units(text)] == want


def test_structure():
    text = "# A. heading. Two\nFirst one. Second\none here.\n\nno punctuation at\nall\n\n- item one. More.\n- item two\n1. numb. Two.\n2) x\n```sol\na. b. C\n\nd\n```\nAfter. End\r\n\r\nLast\n~~~\nopen. Fence"
    assert [text[a:b] for a, b in sentence_units(text)] == ["# A. heading. Two", "First one.", "Second\none here.", "no punctuation at\nall", "- item one.", "More.", "- item two", "1. numb.", "Two.", "2) x", "```sol\na. b. C\n\nd\n```", "After.", "End", "Last", "~~~\nopen. Fence"]


@pytest.mark.parametrize(
    ("text", "lang", "units"),
    [("Then a mind. Then left.", "en", 2), ("Then a mind. Then left.", None, 2), ("She looked in the ed. Then left.", "EN-us", 2), ("It was hr. Done.", "English", 2), ("It was hr. Done.", "de", 2), ("Es kostet mind. 5 Euro. Gut.", "de", 2), ("Es kostet mind. 5 Euro. Gut.", "en", 2), ("Hr. Falkner kam.", "de", 1), ("Hr. Falkner kam.", None, 1), ("Hr. Falkner kam.", "en", 2), ("The cap is low. La Sra. Velasco midió 5 de las 7.", "en", 2), ("ดร. สมชาย มา", "th", 2), ("ดร. สมชาย", "th", 1), ("قال د. فلان إن ذلك صحيح.", "ar", 1), ("Dr. Kim은 왔다.", "ko", 1)],
)
def test_abbreviations_by_language(text, lang, units):
    """The words around an abbreviation show its language; the stated one decides where they do not."""
    assert len(sentence_units(text, lang)) == units


def test_pairs_over_many_open_marks():
    """A mark finds its opening beyond any number of open ones, in linear time."""
    inner = "„Das ist falsch. Halt! " + "(" * 30 + " Und. Nun“ ging er."
    assert sentence_units(inner) == [(0, len(inner))]
    text = "“" + "(" * 100_000 + "a. B.” C."
    assert sentence_units(text) == [(0, len(text) - 3), (len(text) - 2, len(text))]


def test_words_of_any_length():
    """Initials of any number are one abbreviation; a long word before a stop is none."""
    assert len(sentence_units("Die " + "x.".join("abcdefghijklmnopqrs") + "y. Ende")) <= 2
    assert len(sentence_units("It is " + "word" * 40 + "etc. Then left.")) == 2
    assert len(sentence_units("See A." * 1 + "B." * 40 + " Vell now.")) == 1


def test_glued():
    text = "It is down.Plan A beats plan B. See a.b.C and X.sol."
    assert [text[a:b] for a, b in sentence_units(text)] == ["It is down.", "Plan A beats plan B.", "See a.b.C and X.sol."]


def test_cover(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    units = {}
    for r in split_sentences(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect():
        units.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for key, text in docs.items():
        at = 0
        for a, b in sorted(units.get(key, [])):
            assert a >= at and not text[at:a].strip() and text[a:b] == text[a:b].strip() and a < b
            at = b
        assert not (text or "")[at:].strip()


def test_edges(spark):
    schema = "doc_id bigint, text string, start_char string"
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (4, "A. B? " * 50_000, "x"), (5, "(" * 20_000 + "a. B", "x"), (6, "x", "x"), (7, "𝒳. 𝒴 ok. Fine.", "x")]
    got = {}
    for r in split_sentences(spark.createDataFrame(rows * 2, schema)).collect():
        got.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    assert got[6] == [(0, 1)] and set(got) == {4, 5, 6, 7} and len(got[4]) > 10_000
    assert split_sentences(spark.createDataFrame([], schema)).count() == 0
