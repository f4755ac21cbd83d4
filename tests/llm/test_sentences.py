"""Sentence units: cases per script, and properties that hold for any text."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import sentences as S

CASES = [
    "Dr. Who left.| It ended at 9 a.m.| The end.",
    "We saw Fig. 3 and No. 7, e.g. here, i.e. there, cf. Sec. 4.2 of it.| Next.",
    "The U.K. office opened.| J. R. Smith came.",
    "See the A.B.C.D.E. Report now.| See the A.B.C.D.E.F.G.H. Report now.",
    "It costs 3.50, see https://a.b/c.d?x=1.| main.py is read.| v2.1 follows.",
    "It took 3.5\r\ns.| The next. |\r\n\r\nAm 3.\r\nMai kam er.| Es gibt деревья и т.\r\nд.| Прочего нет.",
    "It waits... then goes.| It stopped...| Then it left.",
    'He said: "Stop. Go." and left.|\n\n"Stop."| He left.| Did it say "stop"?| No.',
    "(It is optional.)| Skip it.| The limit (see a. It is long.) stays.",
    "Use Inc. names, etc. in text.| Shapes, etc.| More.",
    "# Title\n|- one\n|- two. Still| two?\n|1. No. 5 is it\n|\nplain line\nwraps on. |Yes.".replace("two. Still| two?", "two.| Still two?"),
    "Am 3. Mai kam z. B. Herr Dr. Max, d. h. er, bzw. sie.| „Bitte warten.“| Danach nichts.",
    "Das Wort »Ende. Aus.« steht da.| Bäume usw.| Andere fehlen.",
    "« Attendez. »| Puis rien.| Il affiche « Fini. Bon. » puis part.| Quoi ?| Rien !",
    "¿Por qué?| ¡No!| «Espere.»| Luego EE. UU. y la pág. 7.",
    "И. К. Петров и т. д.| Прочего нет.| «Готово. Строк нет.» и вышел.",
    "Είναι ανοιχτό;| Κανείς δεν ξέρει, π.χ. αυτός.",
    "値は３．５です。|「終わり。もうない。」と表示。|彼は「止めて。」|その後。|待って……もう一度。|速い｡|遅い。",
    "它显示“完成。没有行。”然后退出。|为什么？|《开始。结束。》的那一页。|版本2.0.1很好。",
    '그것은 "끝. 없다."라고 쓴다.| 정말인가?!| 그렇다.',
    'उसने लिखा "समाप्त। नहीं।" और रुका।| भार 1.2 मि.से. तक गिरा।',
    "قال «انتهى. لا.» ثم توقف.| لماذا؟| كتب د. أحمد شيئا.",
    "کیا یہ کھلا ہے؟| ہاں۔",
    "อย่าแก้ไฟล์| ดู main.py ก่อน| แล้วเขียน 3 แถว",
    "ကျသည်။| မပြင်ပါနဲ့။", "នេះ។| ធំឡើង?| ទេ។", "ያያል።| ነው?| አዎ።",
]


def _units(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {i: [] for i in range(len(texts))}
    for r in S.sentences(df).orderBy("doc_id", "unit_no").collect():
        out[r.doc_id].append((r.start_char, r.end_char, r.unit))
    return out


def test_cases(spark):
    texts = [c.replace("|", "") for c in CASES]
    got = _units(spark, texts)
    wrong = []
    for i, c in enumerate(CASES):
        want = [u.strip() for u in c.split("|") if u.strip()]
        if [u for *_, u in got[i]] != want:
            wrong.append(("want", want, "got", [u for *_, u in got[i]]))
    assert not wrong


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=" .!?\n\r\t\"'()«»„“”。「」AbcZäя한中3-#*…\U0001f600", max_size=80), min_size=1, max_size=20))
def test_units_cover_the_text(spark, texts):
    """Units are in order, cut from the text itself, and leave out blanks only."""
    got = _units(spark, texts)
    for i, t in enumerate(texts):
        at = 0
        for start, end, unit in got[i]:
            assert at <= start < end and t[start:end] == unit and not t[at:start].strip(" \n\r\t")
            at = end
        assert not t[at:].strip(" \n\r\t")


def test_empty_null_and_long_texts(spark):
    long = "This is one. " * 30_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "a", "x"), (4, "a", "x"), (5, long, "x")], "doc_id bigint, text string, end_char string")
    n = {r.doc_id: r["count"] for r in S.sentence_ends(df.select("doc_id", "text")).groupBy("doc_id").count().collect()}
    assert n == {4: 2, 5: 30_000}
    assert S.sentences(df.limit(0)).count() == 0
    assert [(r.start_char, r.end_char) for r in S.sentences(df.filter("doc_id = 5")).filter("unit_no IN (0, 15000, 29999)").orderBy("unit_no").collect()] == [
        (13 * i, 13 * i + 12) for i in (0, 15_000, 29_999)
    ]
    assert {r.unit for r in S.sentences(df.filter("doc_id = 5")).select("unit").distinct().collect()} == {"This is one."}


@pytest.mark.parametrize("text,ends", [("﻿Hi there.\r\n\r\nYou.", [10, 18]), ("  A. \U0001f600 b.", [9])])
def test_positions_count_code_points(spark, text, ends):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r.end_char for r in S.sentence_ends(df).collect()] == ends
