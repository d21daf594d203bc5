import random

import pytest

from emberline.llm import quality, textstats
from emberline.llm.textstats import COUNTS, count, is_prose

PROSE = [
    "I bought this lamp for the office and it has been quiet from the first day. It comes with a spare cable.",
    "i bought this lamp for the office\nand it has been quiet from the\nfirst day and i would do so again",
    "DIE LIEFERUNG KAM NACH DREI TAGEN UND WAR GUT VERPACKT.",
    "La  couleur  est  un  peu  plus  foncée  que  prévu.",
    "色は少し暗いです。ふだんは庭に置いています。",
    "It is all right",
    "Gerne wieder",
    "Would I buy it again? Yes, without thinking twice.",
    "It worked for two weeks and then it stopped.\nI sent it back on the same day.\n- lid\n- cable",
    "Leider kann ich es nicht empfehlen. (model K-756, 296 W, 172 cm)",
]
OTHER = [
    "",
    "...",
    "n/a",
    "- lid\n- cable\n- sturdy base\n- 4 x switch",
    "1. not for the garage\n2. as sturdy as the old one\n3. with or without the clip\n4. too heavy for me",
    "PRO:\n✓ handy\n✓ good for my sister\n\nCONTRA:\n✗ lid\n✗ not for the garden",
    "| lid | 12 cm | heavy |\n|---|---|---|\n| base | 3 | ok |",
    "cover             stiff             heavy\nseam              44 cm             29.7",
    "<table><tr><td>lid</td><td>for the whole family and for me</td></tr></table>",
    "lid;12 cm;heavy\nbase;3;not for the garden",
    "buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy",
    "It stopped after a month. It stopped after a month. It stopped after a month. It stopped after a month.",
    "and for the of to it was is in that with on at from have not they this",
    "yoga mat suitcase travel clock frying pan rug bike light headset water bottle",
    "rmhpjzbg qwldrqpff knxpwf vpmfqsgjvv zcxphxcldwg gcfwbscjg",
    "6cE3RyRnuwQ8rBFhdKZj+x7thHQsJIrOaENADY9wAC+jvQZFaX0D9rDpZ==",
    '{"cbae":17,"zyyxu":[3,84,82],"ok":null}',
    "5990 318 4783 4292 1615 5 738",
    "whdpa uq ffefzp",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert is_prose(count(text))


@pytest.mark.parametrize("text", OTHER)
def test_no_prose(text):
    assert not is_prose(count(text))


#: Plain reviews in languages and scripts whose function words the library does not list.
ANY_LANGUAGE = [
    "这台灯我用了一个月，非常满意。灯光很柔和，晚上看书不刺眼。包装也很好，没有损坏。",
    "Купил эту лампу для кабинета и очень доволен. Свет мягкий, глаза не устают. Доставка заняла три дня.",
    "лампа работает хорошо и стоит своих денег я пользуюсь ею каждый вечер и пока никаких проблем не было",
    "اشتريت هذا المصباح للمكتب وهو هادئ منذ اليوم الأول. الجودة ممتازة والسعر مناسب. أنصح به الجميع.",
    "이 램프를 사무실용으로 샀는데 첫날부터 아주 조용합니다. 배송도 빨랐고 포장도 튼튼했어요.",
    "배송이 빨랐어요. 품질이 좋아요. 만족합니다.",
    "Bu lambayı ofis için aldım ve ilk günden beri çok sessiz çalışıyor. Kargo hızlı geldi. Herkese tavsiye ederim.",
    "Çok memnun kaldım. Fiyatına göre gayet iyi. Tekrar alırım.",
    "मैंने यह लैंप अपने दफ्तर के लिए खरीदा और यह पहले दिन से बहुत अच्छा काम कर रहा है। कीमत भी ठीक है।",
    "kupiłem tę lampę do biura i od pierwszego dnia jest bardzo cicha przesyłka dotarła szybko i wszystko było dobrze zapakowane",
    "Koupil jsem tuto lampu do kanceláře a od prvního dne svítí skvěle. Zásilka přišla za tři dny.",
    "Ostin tämän lampun toimistoon ja se on ollut hiljainen ensimmäisestä päivästä. Toimitus kesti kolme päivää.",
    "Saya membeli lampu ini untuk kantor dan sangat senang sejak hari pertama. Pengiriman cepat dan kemasannya rapi.",
    "Tôi mua chiếc đèn này cho văn phòng và nó rất êm ngay từ ngày đầu tiên. Giao hàng nhanh.",
    "Αγόρασα αυτό το φωτιστικό για το γραφείο και είμαι πολύ ευχαριστημένος. Η παράδοση ήταν γρήγορη.",
    "קניתי את המנורה הזו למשרד והיא שקטה מהיום הראשון. המשלוח הגיע תוך שלושה ימים.",
    "ฉันซื้อโคมไฟนี้สำหรับใช้ในสำนักงานและมันเงียบมากตั้งแต่วันแรก การจัดส่งรวดเร็ว แนะนำเลยค่ะ",
]
OTHER_ANY_LANGUAGE = [
    "- абажур\n- провод\n- прочная основа\n- 4 x лампа",
    "灯罩,底座,电线,开关,灯泡,说明书",
    "램프\n전선\n덮개\n스위치\n받침대\n나사",
    "手机 电脑 桌子 椅子 灯泡 背包 雨伞 水壶",
    "1. lampa\n2. kabel\n3. podstawa\n4. uchwyt\n5. śruba",
    "अच्छा\nलैंप\nतार\nबटन\nढक्कन\nआधार",
]


@pytest.mark.parametrize("text", ANY_LANGUAGE)
def test_prose_in_any_language(text):
    assert is_prose(count(text))


@pytest.mark.parametrize("text", OTHER_ANY_LANGUAGE)
def test_no_prose_in_any_language(text):
    assert not is_prose(count(text))


def test_a_passage_pasted_over_and_over_is_junk():
    rng = random.Random(4)
    passage = " ".join(f"The {rng.choice('abcdefgh')}{'lamp' * (i % 3)} number {chr(97 + i)} stood in my {chr(99 + i)}room for a while." for i in range(12))
    assert is_prose(count(passage))
    assert not is_prose(count(" ".join([passage] * 24)))


PARTS = ["word", "und", " ", "\n", ". ", "- ", "é", "色", "  \n\n", "the", "!", "x́y", '"', "| ", "; ", "1. ", "(3 cm) ", ".....", " / ", "।", "?", "Ab", "\t", "   ", "です。", "к", "q", "a" * 47, ", ", ": \n"]


def test_pieces_put_together_are_the_whole(spark):
    """Every count and every column, wherever the text is cut."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    rows += [(500, "x" * 300), (501, "a" * 40 + " the"), (502, None), (503, "No more than this. " * 40), (504, "a lamp\x00and a tent. " * 9)]
    rows += [(505, "".join(rng.choice(PARTS) for _ in range(9000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    whole = {r["doc_id"]: key(r) for r in quality.text_counts(df, chunk_chars=1 << 20).select("doc_id", *COUNTS).collect()}
    for chunk in (7, 13, 4096):
        cut = quality.text_counts(df.repartition(3), chunk_chars=chunk)
        assert {r["doc_id"]: key(r) for r in cut.select("doc_id", *COUNTS).collect()} == whole
    answers = {r["doc_id"]: key(r) for r in quality.quality(df, chunk_chars=1 << 20).collect()}
    assert {r["doc_id"]: key(r) for r in quality.quality(df, chunk_chars=11).collect()} == answers
    for i, text in rows[:40]:
        assert {r: count(text or "")[r] for r in COUNTS} == pytest.approx(dict(zip(COUNTS, whole[i][1:])))


def test_a_table_before_lines_is_judged_alike_in_any_pieces(spark):
    table = "".join(f"| lid {i} | {i * 3} cm | heavy |\n" for i in range(1500))
    lines = "\n".join(f"we took the lamp number {i} to the garden and it was fine" for i in range(3600))
    df = spark.createDataFrame([(1, table + lines)], "doc_id long, text string")
    got = {tuple(quality.quality(df, chunk_chars=c).first()) for c in (997, 8192, 65536, 1 << 20)}
    assert len(got) == 1


def test_quality_cases(spark):
    rng = random.Random(8)
    words = ["lamp", "tent", "box", "cable", "door", "garden", "knife", "paper", "river", "table", "window", "yard"]
    long = lambda: f"I took the {rng.choice(words)} to my {rng.choice(words)} and it was {rng.choice(words)} all {rng.choice(words)} long. "
    rows = [(1, PROSE[0], "clash"), (2, None, None), (3, "", None), (4, "".join(long() for i in range(30_000)), None), (None, "x", None), (5, OTHER[3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_prose string")
    got = {r["doc_id"]: r for r in quality.quality(df).collect()}
    assert {k: r["is_prose"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert got[4]["n_words"] == 30_000 * 14 and got[2]["n_words"] == 0 and got[2]["symbol_ratio"] == 0.0
    assert got[5]["bullet_share"] == 1.0 and got[1]["end_punct_share"] == 1.0
    assert quality.quality(df.limit(0)).count() == 0
    twice = quality.text_counts(df.where("doc_id = 1").unionByName(df.where("doc_id = 1"))).first()
    assert twice["n_words"] == 2 * got[1]["n_words"]


def test_agrees_with_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/doc_labels.parquet")
    joined = quality.quality(docs).join(labels, "doc_id").collect()
    right = sum((r["shape"] == "prose") == r["is_prose"] for r in joined)
    assert right >= 0.93 * len(joined)  # some labels are wrong
