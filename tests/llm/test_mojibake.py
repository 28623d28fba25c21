import random

import pytest

from tidemark.llm import mojibake as M

CLEAN = [
    "La compañía registró ingresos más altos que el año pasado.",
    "Le résultat opérationnel s’élève à un niveau élevé.",
    "Der Großkundenvertrieb gewann größere Aufträge für die Lösung.",
    "A administração não prevê alterações na operação de crédito.",
    "Spółka zależna ograniczyła nakłady, choć zapasy wciąż rosły.",
    "The group’s order book stood at €92 million — a new high.",
    "Závod u řeky zvýšil ceny, když dodavatel vypadl z výběru.",
]


def corpus():
    rnd = random.Random(1)
    rows = []
    for k in range(400):
        rows.append((k, " ".join(rnd.sample(CLEAN, 3))))
    return rows


def garble(text, right, wrong):
    return "".join(M._decode_table(wrong)[b] for b in text.encode(right, "ignore"))


def test_learn_find_and_restore(spark):
    rows = corpus()
    extra = {
        1000: garble(CLEAN[0] + " " + CLEAN[1], "utf-8", "cp1252"),
        1001: garble(CLEAN[2] + " " + CLEAN[3], "utf-8", "latin-1"),
        1002: garble(garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252"),
        1003: CLEAN[1] + "\n" + garble(CLEAN[3], "utf-8", "mac_roman"),
        1004: garble(CLEAN[4], "cp1250", "cp1252"),
        1005: garble(CLEAN[4], "cp1250", "cp1252") + " " + garble(CLEAN[6], "cp1250", "cp1252"),
        1006: garble(CLEAN[0], "cp850", "latin-1"),
        1007: garble(CLEAN[3], "cp850", "latin-1"),
        1008: "Les coûts ont été r�duits.",
    }
    clean = {2000: "שלום לשוק مرحبا", 2001: "plain ASCII", 2002: "", 2003: None, 2004: "A blank between words", 2005: "\U0001f600 ​", 2006: "Ångström Éclair", 2007: "SÃO PAULO: AÇÕES"}
    df = spark.createDataFrame(rows + list(extra.items()) + list(clean.items()) + [(1000, extra[1000])], "doc_id long, text string")
    df = df.selectExpr("doc_id", "text", "'z' AS restored", "1 AS reason").repartition(3)
    out = M.garbled_texts(df, "doc_id", "text").collect()
    got = {r.doc_id: r for r in out}
    assert set(got) == set(extra) and len(out) == len(extra) + 1
    assert got[1000].restored == CLEAN[0] + " " + CLEAN[1]
    assert got[1001].restored == CLEAN[2] + " " + CLEAN[3]
    assert got[1002].restored == CLEAN[0]
    assert got[1003].restored == CLEAN[1] + "\n" + CLEAN[3]
    assert got[1004].restored == CLEAN[4]
    assert got[1006].restored == CLEAN[0]
    assert got[1008].restored == extra[1008] and not got[1008].complete and got[1008].reason == "lost"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    assert M.garbled_texts(df, "doc_id", "text").count() == 0
    assert M.garbled_texts(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("wrong", M.WRONG)
def test_round_trip_of_every_encoding(wrong):
    for text in CLEAN:
        assert M.undo(garble(text, "utf-8", wrong), wrong, "utf-8") == text
        right, wrongs = M.explain(garble(text, "utf-8", wrong), text)
        assert right == "utf-8" and wrong in wrongs


def test_undo_leaves_what_it_cannot_read():
    assert M.undo("plain", "cp1252", "utf-8") is None
    assert M.undo("é", "cp1252", "utf-8") is None
    assert M.undo("日本 Ã© ü", "cp1252", "utf-8") == "日本 é ü"


def test_choose_takes_the_fewest():
    seen = [("utf-8", ["cp1252", "latin-1"], 5), ("utf-8", ["latin-1"], 1), ("cp850", ["cp1252", "cp1254"], 3), ("cp850", ["cp1254", "cp1253"], 1)]
    assert M.choose(seen, 2) == [("latin-1", "utf-8"), ("cp1254", "cp850"), ("cp1252", "utf-8")]
    assert M.choose([], 2) == []


OTHER = {
    "ru": [
        "Компания сообщила, что выручка за квартал выросла на 12 процентов.", "Совет директоров отложил решение о выплате дивидендов.",
        "Завод у реки повысил цены, когда поставщик выбыл из отбора.", "Аналитики ожидали более слабых показателей в этом году.",
    ],
    "el": [
        "Η εταιρεία ανακοίνωσε ότι τα έσοδα αυξήθηκαν κατά 12 τοις εκατό.", "Το διοικητικό συμβούλιο ανέβαλε την απόφαση για το μέρισμα.",
        "Οι αναλυτές περίμεναν πιο αδύναμα αποτελέσματα φέτος.", "Το εργοστάσιο δίπλα στο ποτάμι αύξησε τις τιμές.",
    ],
    "zh": ["公司公布季度收入增长了百分之十二，超出预期。", "董事会推迟了关于股息分配的决定。", "分析师此前预计今年的业绩会更加疲软。", "河边的工厂在供应商退出后提高了价格。"],
    "ja": ["会社は四半期の売上高が十二パーセント増加したと発表した。", "取締役会は配当の決定を延期した。", "アナリストは今年の業績がさらに弱いと予想していた。"],
}


@pytest.mark.parametrize("lang,right,wrong", [
    ("ru", "utf-8", "latin-1"), ("ru", "utf-8", "cp1251"), ("ru", "utf-8", "koi8-r"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("ru", "cp866", "cp1252"),
    ("el", "utf-8", "latin-1"), ("el", "cp1253", "cp1252"), ("zh", "utf-8", "cp1252"), ("zh", "gb18030", "latin-1"), ("ja", "utf-8", "mac_roman"), ("ja", "euc_jp", "cp1252"),
])
def test_scripts_other_than_latin(spark, lang, right, wrong):
    rnd = random.Random(lang)
    clean = OTHER[lang]
    rows = [(k, "\n".join(rnd.sample(clean, 2))) for k in range(120)] + [(500 + k, t) for k, t in corpus()[:60]]
    bad = {1000 + k: garble(t, right, wrong) for k, t in enumerate(clean)}
    df = spark.createDataFrame(rows + list(bad.items()), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.restored for r in M.garbled_texts(df, "doc_id", "text").collect()}
    assert got == {1000 + k: t for k, t in enumerate(clean)}


def test_replacement_characters_that_are_meant(spark):
    meant = ["The decoder prints U+FFFD ( \ufffd ) then.", "Shown as “\ufffd” or (\ufffd).", "replacement character: \ufffd means lost"]
    lost = ["Les co\ufffdts", "cost \ufffd79 m", "a \ufffd la carte", "\ufffd\ufffd", "the group\ufffds"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(meant + lost)], "doc_id long, text string")
    assert {r.doc_id for r in M.garbled_texts(df, "doc_id", "text").collect()} == set(range(3, 8))


def test_many_decodings_on_top_of_each_other(spark):
    text = CLEAN[0]
    for _ in range(5):
        text = garble(text, "utf-8", "cp1252")
    df = spark.createDataFrame([*corpus()[:100], (900, garble(CLEAN[0], "utf-8", "cp1252")), (1000, text)], "doc_id long, text string")
    got = {r.doc_id: r.restored for r in M.garbled_texts(df, "doc_id", "text").collect()}
    assert got == {900: CLEAN[0], 1000: CLEAN[0]}


def test_very_long_tokens(spark):
    long = "é" * 50_000 + "的" * 50_000
    rows = corpus()[:50] + [(1, long), (2, garble(CLEAN[0], "utf-8", "cp1252")), (3, garble("é" * 3000 + CLEAN[0], "utf-8", "cp1252"))]
    df = spark.createDataFrame([(k + 10_000, t) for k, t in rows[:50]] + rows[50:], "doc_id long, text string")
    got = {r.doc_id: r.restored for r in M.garbled_texts(df, "doc_id", "text").collect()}
    assert got == {2: CLEAN[0], 3: "é" * 3000 + CLEAN[0]}


def test_copies_of_a_garbled_text_do_not_pass_for_language(spark):
    bad = garble(" ".join(CLEAN[:3]), "utf-8", "cp1252")
    rows = [(k, f"{t} In {k} " + CLEAN[k % 7].replace(" ", f" {k} ", 1)) for k, t in corpus()]
    df = spark.createDataFrame(rows + [(1000 + k, bad) for k in range(200)], "doc_id long, text string")
    got = M.garbled_texts(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == set(range(1000, 1200)) and {r.restored for r in got} == {" ".join(CLEAN[:3])}
