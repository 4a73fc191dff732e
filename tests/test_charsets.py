"""Guesses of charsets on lines that no model was fitted on."""

import gettext
import glob
import tracemalloc
from collections import defaultdict

import pytest

from siftline.sources import charsets, decode
from siftline.sources.charset_texts import TEXTS

SAMPLES = [
    ("windows-1252", "Le café était fermé à Noël, près de l'hôtel; naïve façade, très élégante."),
    ("windows-1252", "Größe und Maß: schöne Straße über die Brücke, müde Füße."),
    ("Shift_JIS", "これは日本語の文章です。検索エンジンはテキストを読みます。"),
    ("EUC-JP", "これは日本語の文章です。検索エンジンはテキストを読みます。"),
    ("EUC-KR", "이것은 한국어 문장입니다. 검색 엔진은 텍스트를 읽습니다."),
    ("GBK", "这是一个中文句子，搜索引擎读取文本文件并返回结果。"),
    ("Big5", "這是一個中文句子，搜尋引擎讀取文字檔案並傳回結果。"),
    ("windows-1251", "Это русский текст, который читает поисковая система."),
    ("KOI8-R", "Это русский текст, который читает поисковая система."),
    ("ISO-8859-5", "Это русский текст, который читает поисковая система."),
    ("IBM866", "Это русский текст, который читает поисковая система."),
    ("windows-1250", "Příliš žluťoučký kůň úpěl ďábelské ódy; łódź, źdźbło, śnieg."),
    ("windows-1253", "Αυτό είναι ένα ελληνικό κείμενο για τη μηχανή αναζήτησης."),
    ("windows-1255", "זה טקסט בעברית שמנוע החיפוש קורא"),
    ("windows-1256", "هذا نص باللغة العربية يقرأه محرك البحث"),
    ("windows-874", "นี่คือข้อความภาษาไทยสำหรับการค้นหา"),
]
#: Lines of prose by language; none is in the texts of the models.
LINES = {
    "fr": ["La rivière débordait après les pluies d'été.", "Son père répétait qu'il fallait réfléchir.", "Où as-tu caché la clé du grenier ?"],
    "de": ["Der Bäcker schließt heute früher als üblich.", "Im Frühling blühen überall die Kirschbäume.", "Er hörte die Vögel vor dem Fenster zwitschern."],
    "es": ["El niño corrió detrás del pájaro hasta el jardín.", "Mañana lloverá en las montañas del norte.", "¿Cuánto cuesta el billete de avión?"],
    "pt": ["A menina não quis comer o pão da manhã.", "O avião partirá amanhã às três horas.", "Há muitos pássaros na floresta tropical."],
    "it": ["La città si svegliò sotto una pioggia leggera.", "Perché non sei venuto più a trovarci?", "Il caffè è già pronto sul tavolo."],
    "sv": ["Båten låg förtöjd vid bryggan hela sommaren.", "Hon läste tidningen på tåget mot Malmö.", "Älgen gick över vägen i gryningen."],
    "da": ["Drengen løb gennem skoven for at nå færgen.", "Vi spiste smørrebrød på en bænk ved søen.", "Året efter flyttede hun til Århus."],
    "pl": ["Wieczorem poszliśmy nad rzekę łowić ryby.", "Dziewczyna przyniosła świeży chleb z piekarni.", "Zeszłej zimy spadło dużo śniegu."],
    "cs": ["Děti si hrály na dvoře až do večera.", "Vlak přijel na nádraží s velkým zpožděním.", "Babička upekla výborný jablečný závin."],
    "hu": ["A gyerekek a folyóparton játszottak egész délután.", "Tegnap este későn értünk haza a színházból.", "Az öreg halász kedvesen mosolygott ránk."],
    "ro": ["Copiii se jucau în grădină până seara târziu.", "Dimineaţa am băut o cafea lângă fereastră.", "Bătrânul îşi aminteşte de război şi de foamete."],
    "tr": ["Çocuklar akşama kadar bahçede oynadılar.", "Yaşlı balıkçı bize gülümseyerek baktı.", "Kış geldiğinde köyün yolları kapanır."],
    "lt": ["Vaikai žaidė kieme iki pat vėlaus vakaro.", "Senelė kepė duoną ir dainavo lietuviškas dainas.", "Žiemą upė užšąla ir tampa keliu."],
    "ru": ["Вечером мы гуляли по набережной и кормили чаек.", "Старый рыбак улыбнулся и промолчал.", "Зимой деревня засыпает под снегом."],
    "uk": ["Увечері ми гуляли набережною і годували чайок.", "Старий рибалка посміхнувся і промовчав.", "Її брат поїхав до Києва."],
    "bg": ["Вечерта се разхождахме край морето.", "Старият рибар се усмихна и замълча.", "През зимата селото заспива под снега."],
    "el": ["Τα παιδιά έπαιζαν στην αυλή μέχρι το βράδυ.", "Ο γέρος ψαράς χαμογέλασε και σώπασε.", "Τον χειμώνα το χωριό κοιμάται κάτω από το χιόνι."],
    "he": ["הילדים שיחקו בחצר עד הערב", "הדייג הזקן חייך ושתק", "בחורף הכפר ישן תחת השלג"],
    "ar": ["لعب الأطفال في الفناء حتى المساء", "ابتسم الصياد العجوز وسكت", "في الشتاء تنام القرية تحت الثلج"],
    "th": ["เด็กๆ เล่นกันที่สนามจนถึงเย็น", "ชาวประมงเฒ่ายิ้มแล้วก็เงียบ", "ในฤดูหนาวหมู่บ้านเงียบสงบ"],
    "vi": ["Bọn trẻ chơi ngoài sân đến tận chiều tối.", "Ông lão đánh cá mỉm cười rồi im lặng.", "Mùa đông ngôi làng ngủ yên dưới tuyết."],
    "ja": ["子どもたちは夕方まで庭で遊んでいた。", "年老いた漁師は微笑んで黙った。", "冬になると村は雪の下で眠る。"],
    "ko": ["아이들은 저녁까지 마당에서 놀았다.", "늙은 어부는 미소를 짓고 침묵했다.", "겨울이 되면 마을은 눈 속에서 잠든다."],
    "zh": ["孩子们在院子里一直玩到傍晚。", "老渔夫微笑着沉默不语。", "冬天，村庄在雪下沉睡。"],
    "tw": ["孩子們在院子裡一直玩到傍晚。", "老漁夫微笑著沉默不語。", "冬天，村莊在雪下沉睡。"],
}
CHARSETS = [(c, t) for c, languages in charsets.LANGUAGES.items() for t in languages.split()] + [(c, v[0]) for c, v in charsets.DOUBLE.items()]


def written(line, label):
    """The line in a charset; null where it lacks a letter."""
    try:
        return charsets.spelled(line, label) if label == "windows-1258" else line.encode(charsets.codec(label))
    except UnicodeEncodeError:
        return None


def right(data, labels, label):
    """How many are read as they were written; charsets that agree on the bytes are as good."""
    return sum(d.decode(charsets.codec(got), "replace") == d.decode(charsets.codec(label)) for d, got in zip(data, labels))


@pytest.mark.parametrize(("label", "text"), SAMPLES)
def test_charsets_are_guessed_and_kept(label, text):
    data = decode.encoded(text, label)
    assert decode.decoded(data) == (text, label)
    assert decode.decoded(b"license: " + data)[0] == "license: " + text


def test_lines_of_prose():
    """All charsets, lines of one sentence that no model has seen."""
    tried = found = 0
    for label, language in CHARSETS:
        data = [d for line in LINES.get(language, []) if (d := written(line, label)) is not None and not d.isascii()]
        assert all(line not in TEXTS[language] for line in LINES.get(language, []))
        tried, found = tried + len(data), found + right(data, charsets.guessed_all(data), label)
    assert tried > 100 and found >= 0.97 * tried


def test_translated_messages_of_each_charset():
    """Messages of programs, as far as this machine has their translations: 0.95 of each charset's lines."""
    names = {"pt_BR": "pt", "nb": "no", "zh_CN": "zh", "zh_TW": "tw"}
    lines = defaultdict(set)
    for path in sorted(glob.glob("/usr/share/locale/*/LC_MESSAGES/*.mo")):
        language = names.get(folder := path.split("/")[4], folder)
        if language in TEXTS:
            with open(path, "rb") as f:
                try:
                    found = gettext.GNUTranslations(f)._catalog.values()
                except (UnicodeDecodeError, OSError):
                    continue
            lines[language].update(x.strip() for v in found if isinstance(v, str) for x in v.split("\n") if 20 <= len(x.strip()) <= 300 and not x.isascii())
    if len(lines) < 20:
        pytest.skip("too few translations are installed")
    got = defaultdict(lambda: [0, 0])
    for label, language in CHARSETS:
        every = sorted(lines[language])
        data = [d for line in every[:: max(1, len(every) // 120)] if (d := written(line, label)) is not None and not d.isascii()]
        got[label][0] += right(data, charsets.guessed_all(data), label)
        got[label][1] += len(data)
    assert {label: round(a / n, 3) for label, (a, n) in got.items() if n and a < 0.95 * n} == {}


def test_batches_and_single_texts_agree():
    data = [written(line, label) for label, language in CHARSETS for line in LINES.get(language, [])[:1]]
    data = [d for d in data if d is not None] + [b"", b"plain", b"\xff"]
    assert charsets.guessed_all(data) == [charsets.guessed(d) for d in data]


def test_code_with_a_comment():
    code = b"int main(void) { return helper(argument, 0); }\n" * 60
    for label in ("windows-1251", "KOI8-R"):
        data = code + "// Эта функция возвращает число строк и печатает ошибку, если файл не найден".encode(charsets.codec(label)) + b"\n" + code
        assert charsets.guessed(data) == label
    assert charsets.guessed(code + "// gezählt über alle Größen".encode("cp1252")) == "windows-1252"


def test_guess_never_fails():
    assert decode.decoded(b"\xff")[1] == "windows-1252"
    assert decode.decoded(bytes(range(256)))[0]
    long = "検索エンジンは".encode("cp932") * 20_000
    assert decode.decoded(long)[1] == "Shift_JIS"  # cut inside a character after 64 KiB


def test_memory_of_a_guess_does_not_follow_the_batch():
    text = "La rivière débordait après les pluies d'été, où l'on répétait qu'il fallait réfléchir. ".encode("cp1252") * 180
    charsets.models()
    peaks = []
    for n in (60, 600):
        data = [text] * n
        tracemalloc.start()
        assert set(charsets.guessed_all(data)) == {"windows-1252"}
        peaks.append(tracemalloc.get_traced_memory()[1] - 2 * n * len(text))  # the bytes themselves are joined
        tracemalloc.stop()
    assert max(peaks) < 32 << 20
