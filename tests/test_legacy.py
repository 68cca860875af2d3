"""Texts of every legacy page, short and long, alone and inside a subtitle file."""

import pytest

from cueflow.sources import encodings, legacy

TEXTS = {
"cp1254": ["Teşekkürler, yarın görüşürüz.","Öğleden sonra çarşıya gideceğiz; ağabeyim de bizimle geliyor. Şu kapıyı açar mısın?\n"*3,"the cat is here and more text follows in plain words "*6+" ğışİŞĞğı","Şey"],
"cp1251": ["Доброе утро!","Она смотрела в окно и думала о прошлом лете, когда они все вместе ездили к морю.\n"*3, "Нет."],
"koi8_r": ["Доброе утро!","Она смотрела в окно и думала о прошлом лете, когда они все вместе ездили к морю.\n"*3],
"cp1253": ["Καλό βράδυ!","Το παιδί έπαιζε στον κήπο όλη μέρα και η μητέρα του το κοίταζε από το παράθυρο.\n"*3,"Όχι."],
"cp1250": ["Przepraszam, którędy na dworzec?","Wieczorem poszliśmy do kina, ale film był tak nudny, że zasnąłem w połowie.\n"*3,"Večer jsme šli do kina, ale film byl tak nudný, že jsem v půlce usnul.\n"*3,"Este elmentünk a moziba, de a film olyan unalmas volt, hogy elaludtam, őszintén, nagyszerű fűtés.\n"*2],
"cp1252": ["Je préfère être là demain à l'école.","El niño comió una manzana después de la canción.\n"*3,"Die Männer hören schöne Musik über den Dächern."],
"cp1255": ["ערב טוב!","הילדים שיחקו בגינה כל היום ואמא שלהם הסתכלה עליהם מהחלון.\n"*3],
"cp1256": ["مساء الخير","لعب الأطفال في الحديقة طوال اليوم وكانت أمهم تنظر إليهم من النافذة.\n"*3],
"mac_roman": ["Je préfère être là demain à l'école.","El niño comió una manzana después de la canción.\n"*3],
"cp932": ["おはようございます。","彼は昨日、東京から新幹線で帰ってきました。とても疲れたと言っていた。\n"*3,"どこへ？"],
"euc_jp": ["おはようございます。","彼は昨日、東京から新幹線で帰ってきました。とても疲れたと言っていた。\n"*3],
"gb18030": ["你今天有时间吗？","我们昨天晚上去看了一场电影，可是那个故事不太好，所以我睡着了。\n"*3,"不是。"],
"big5": ["你今天有時間嗎？","我們昨天晚上去看了一場電影，可是那個故事不太好，所以我睡著了。\n"*3],
"cp949": ["안녕하세요, 오늘 뭐 하세요?","우리는 어제 저녁에 영화를 보러 갔는데 이야기가 너무 지루해서 잠이 들었습니다.\n"*3],
}

FILE = "1\n00:00:01,000 --> 00:00:02,000\n"


@pytest.mark.parametrize("page", TEXTS)
def test_page(page):
    for text in TEXTS[page]:
        for whole in (text, FILE + text, FILE + "<i>" + text + "</i>\n"):
            assert legacy.detect(whole.encode(page))[1] == whole


def test_latin_text_stays_latin():
    for text in ("déjà vu", "the cat " * 50 + "ğışİŞĞğı", "año", "Übung"):
        for page in ("cp1252", "cp1254"):
            try:
                raw = text.encode(page)
            except UnicodeEncodeError:
                continue
            assert legacy.detect(raw)[0] not in legacy.SCRIPTS


def test_decode_sends_only_the_residue(spark):
    rows = [(page, bytearray(text.encode(page)), text) for page, texts in TEXTS.items() for text in texts]
    rows += [("utf-8", bytearray("ağaç 語".encode()), "ağaç 語"), ("none", None, None), ("broken", bytearray(b"\xff\x81\x8d"), None)]
    got = encodings.decode(spark.createDataFrame(rows, "page string, c binary, want string"), "c").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.page == "broken" or r.text == r.want
        assert (r.encoding is None) == (r.page == "none")
