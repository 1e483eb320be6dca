import pyarrow as pa
import pytest

from tessellum.llm import sentences

# sentences joined as given; each list is one text
CASES = {
    "abbreviations": (" ", ["Dr. Kim and Prof. Lee met in Jan. 1637 at 6 p.m. on No. 6 Kem Ave. near St. Ives.", "It rained, e.g. in Wells, i.e. there.", "Traders carried looms, etc.", "Smith et al. agreed."]),
    "decimals": (" ", ["pH values stayed at 36.74.", "Version 26.4.8 is at archive.x.example/maps.html and was replaced.", "1603 was late."]),
    "quotes": (" ", ["“It rotated,” said Yele.", '"The ferry will hold!" shouted Zul, but it sank.', "The motto reads ‘Dig. Wait. Drink.’ in stone.", "He wrote: “It fell. We left.”", "Then we slept.", "(The magnet had dissolved before.)", "It (opened in 1652; closed when?) sank twice."]),
    "marks": (" ", ["Was it private?!", "The beetle widened... and then it froze.", "Nobody knows why …", "It ended."]),
    "german": (" ", ["Im 3. Jahrhundert zählte Jeas etwa 27.427 Einwohner.", "„Wo ist die Brücke?“, fragte Dr. Trosk.", "Thaco notierte: „Die Kapelle brennt. Wir gehen.“", "Wie teuer war das?!", "Holz, Leder usw."]),
    "french": (" ", ["M. Kawick visita la halle en 1738.", "Quelle chapelle !", "« Partons ! La forge brûle. » cria Paul avant de fuir."]),
    "spanish": (" ", ["El Sr. Quoard compró la colina en 1867.", "—¿Dónde está la bodega? —preguntó la Dra. Raiov.", "Cierra a las 6 p. m.", "¡La ermita ardió!"]),
    "russian": (" ", ["«Где пидай?» — спросил сторож.", "Автор — К. Пуганин.", "Он записал: «Река встала. Все ушли».", "Торговали солью и т. д.", "Жили 250 чел.", "Посёлок у г. Зуритур."]),
    "greek": (" ", ["Πού βρίσκεται η χιζο;", "Η Νεχενι είχε 25.287 κατοίκους.", "Ο δρ. Φεφις έγραψε: «Η ραλι έπεσε. Φύγαμε.»", "Το 1842 ο κ. Τελες είδε π.χ. μια γεγι."]),
    "arabic": (" ", ["كتب أ. كوشا أن الخزانة أقدم.", "من بنى المكتبة؟!", "قال الحارس: «وصلنا إلى الواحة. لم نجد أحدا.»", "يبلغ ارتفاع المزرعة نحو 93.72 م."]),
    "hindi": (" ", ["प्रो. लाक बोले, “नदी टूट गई। हम लौट आए।”", "किसने बनाई यह मंडी?", "“मंडी कहाँ है?” पहरेदार ने पूछा।", "यह लगभग 57.83 कि.मी. दूर है।"]),
    "chinese": ("", ["“走吧！渡口要塌了！”青溪喊道。", "他写道：“织坊塌了。没有人知道。”", "为什么会倒塌呢？！", "该石桥（建于1657年。）由湖管理。", "据说……那里从前有一座驿站。"]),
    "japanese": ("", ["彼は『製粉所が崩れた。誰もいない。』と書いた。", "「窯跡はどこですか。」と門番が尋ねた。", "記録によれば……そこには干潟があった。", "ver. 21.2の地図には石橋が載っていない。", "なぜ消えたのか？", "ver. 2.2の地図。", "人口は9.12万人である。"]),
    "korean": (" ", ["인구는 24.7만 명이다.", "“가자! 무너진다!” 하고 그가 외쳤다.", "아무도 이야기를 하지 않았다...", "누가 만들었는가?"]),
    "thai": (" ", ["ในปี 1693 มีนาเกลือใหม่ถูกสร้างขึ้น", "คลองเก่ากับถ้ำอยู่ห่างกัน 2.33 เมตร", "ใครเป็นคนสร้างเขื่อนแห่งนี้"]),
    "missing blank": ("", ["They surveyed it there.", "The ridge fell.", "St. Ives rose."]),
    "small starts": (" ", ["The reef burned in 1680.", "pH values near Bren rose.", "dox crystals differ."]),
    "lines": ("\n\n", ["== What is this? No. 5 ==", "History", "| St. A | 2. B | x |", "A line\nbroken once goes on.", "VOL. 18"]),
}


def split(text):
    _, start, stop = sentences.spans(pa.array([text]))
    return [text[a:b] for a, b in zip(start, stop)]


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    joint, want = CASES[name]
    assert split(joint.join(want)) == want


def test_blank_lines_and_white_space():
    text = "  A one\r\n \t\r\nB two goes on.　 C three.\n"
    assert split(text) == ["A one", "B two goes on.", "C three."]
    for empty in ("", "  \n\n ", "　"):
        assert split(empty) == []


def test_sentences_cover_all_but_white_space_and_long_texts():
    text = ("Dr. A said “No. Go!” to Bob. " * 4000 + "\n\n") * 3
    _, start, stop = sentences.spans(pa.array([text]))
    assert (start[1:] >= stop[:-1]).all()
    assert "".join(text[a:b] for a, b in zip(start, stop)).replace(" ", "") == "".join(text.split())
    assert len(start) == 12000


def test_rows(spark):
    docs = spark.createDataFrame([(1, "A bee. C dog.", "x"), (1, "A bee. C dog.", "x"), (2, None, "x"), (3, "", "x"), (None, "E.", "x")], "doc_id bigint, text string, start_pos string")
    got = sorted((tuple(r) for r in sentences.split_sentences(docs, with_text=True).collect()), key=repr)
    assert got == sorted([(1, 0, 6, "A bee."), (1, 7, 13, "C dog."), (1, 0, 6, "A bee."), (1, 7, 13, "C dog."), (None, 0, 2, "E.")], key=repr)
    assert sentences.split_sentences(docs.limit(0)).count() == 0


def test_every_state_leaves_a_text_behind_an_empty_line():
    assert (sentences.DELTA[sentences.GAP] == 0).all() and (sentences.ENDS[sentences.GAP] == 1).all()
    assert sentences.DELTA.max() < sentences.STATES <= 255


@pytest.mark.parametrize("follow", ["Next one.", "“Next,” he said.", "(Next) went.", "— Next.", "\n\nnext", "next", ", next", "7 days.", "Mai kam."])
def test_pending_ends_in_long_pieces_equal_those_in_short_ones(follow):
    """What follows a mark is a state, so it may stand in another chunk of a long piece."""
    for mark in (".", "!", "…", "No.", "3.", "。", "!”"):
        head = "It said “so" if mark == "!”" else "It said so"
        short = split(head + mark + " " + follow)
        filler = "word " * 1200
        long_ = split(filler + head + mark + " " + follow)
        assert [x.removeprefix(filler) for x in long_] == short
