"""Leaked test items and wrong encodings."""

from __future__ import annotations

import random

import pytest

from tessera.llm import encoding, leakage

RNG = random.Random(11)
NAMES = [a + b + c for a in ("gal", "tor", "vel", "nim") for b in ("da", "ru", "xo", "pe") for c in ("k", "m", "th", "l")]
COMMON = "the of and valve is in a pump between when film brine steam with moves kg every minutes and holds at sea level".split()


def passage(k: int, n: int = 60) -> list[str]:
    r = random.Random(k)
    return [r.choice(NAMES) + str(r.randint(1, 99)) if r.random() < 0.4 else r.choice(COMMON) for _ in range(n)]


ITEMS = [(k, " ".join(passage(k)), "42 percent") for k in range(40)]
FILL = lambda n: " ".join(RNG.choice(COMMON) for _ in range(n))


def case(k: int, lo: int, hi: int, edit: int = 0) -> str:
    w = passage(k)[lo:hi]
    for i in range(3, len(w), edit or 10**9):
        if i % 3 == 0:
            w[i] = "respective"
        elif i % 3 == 1:
            w[i] += " (17)"
        else:
            w[i] = ""
    return FILL(200) + " " + " ".join(w) + " " + FILL(150)


@pytest.fixture(scope="module")
def index():
    return leakage.build(ITEMS)


@pytest.mark.parametrize("text,found", [
    (case(1, 0, 60), True), (case(2, 20, 46), True), (case(3, 10, 50, 7), True), (case(4, 0, 60, 7), True),
    (case(5, 30, 45), False), (FILL(900), False), ("", False),
    (FILL(50) + " " + " ".join(random.Random(6).sample(passage(6), 60)), False),
    (FILL(9).join(passage(7)), False),
])
def test_cases(index, text, found):
    k = [i for i in range(1, 8) if any(w in text for w in passage(i) if w not in COMMON)]
    got = [r[1] for r in leakage.find(index, [text])]
    assert bool(got) == found and (not found or got == [max(k, key=lambda i: sum(w in text for w in passage(i)))])


def test_forms_dont_matter(index):
    w = passage(9)
    plain = " ".join(w)
    forms = [plain.upper(), plain.replace(" ", " "), "<i>" + plain.replace(" ", "</i> <i>"), plain.replace("al", "a\xadl"), plain.replace("ll", "l-\nl"), plain.replace(" ", " ; "), plain.replace("k", "ｋ"),
             "\n".join(" ".join(w[i : i + 5]) for i in range(0, 60, 5)), plain.replace(" ", "&nbsp;"), "é“ " + plain]
    got = leakage.find(index, [FILL(80) + "\n" + f + "\n" + FILL(80) for f in forms])
    assert [g[0] for g in sorted(got)] == list(range(len(forms))) and {g[1] for g in got} == {9}


def test_wrongly_decoded_texts_are_restored_first(index):
    table = {b: c for c, b in encoding._bytes("mac_roman").items()}
    text = FILL(60) + " " + " ".join(w[:2] + "\xad" + w[2:] for w in passage(13)) + " " + FILL(30)
    bad = "".join(chr(b) if b < 0x80 else table[b] for b in text.encode())
    half = " ".join(w if i % 4 else w[:2] + "¬≠" + w[2:] for i, w in enumerate(passage(13)))
    assert bad != text
    assert [g[:2] for g in sorted(leakage.find(index, [FILL(60) + " " + half, bad]))] == [(0, 13), (1, 13)]


def test_brute_force_agrees(index):
    """Every stretch of two fifths with its share of edits is a candidate, wherever it lies in a text."""
    texts, want = [], set()
    for t in range(120):
        k, n = RNG.randrange(40), RNG.randint(24, 60)
        lo = RNG.randint(0, 60 - n)
        w = passage(k)[lo : lo + n]
        inner = range(2, n - 2)
        for i in RNG.sample(inner, n // 8):
            w[i] = RNG.choice(["", "such", w[i] + " 31"])
        texts.append(f"{FILL(RNG.randint(0, 300))} {' '.join(w)} {FILL(RNG.randint(0, 300))}")
        if n >= 30:  # an edit within the first or last two words shortens the aligned stretch
            want.add((t, k))
    got = {(g[0], g[1]) for g in leakage.find(index, texts)}
    assert want <= got


def test_stretches_right_at_the_limit(index):
    """24 of 60 words, with as many edits as the definition has, anywhere but at the ends."""
    r, texts, want = random.Random(5), [], set()
    for t in range(120):
        k, n = r.randrange(40), r.randint(24, 30)
        lo = r.randint(0, 60 - n)
        w = passage(k)[lo : lo + n]
        for i in r.sample(range(1, n - 1), n // 6):
            w[i] = r.choice(["", "such", w[i] + " 31"])
        texts.append(f"{'such ' * 200}{' '.join(w)}{' such' * 150}")
        want.add((t, k))
    assert want <= {(g[0], g[1]) for g in leakage.find(index, texts)}


def test_shorter_stretches_are_no_cases(index):
    """19 words and three missing ones, as many as 22 words may have, are short of 24."""
    assert not leakage.find(index, [f"{'such ' * 200}{' '.join(passage(k)[20:39])}{' such' * 150}" for k in range(40)])


def test_answers_and_several_items_in_one_text(index):
    text = f"{FILL(60)} {ITEMS[11][1]} 42 percent {FILL(30)} {ITEMS[12][1]} {FILL(30)} {ITEMS[11][1]}"
    got = {g[1]: g for g in leakage.find(index, [text])}
    assert set(got) == {11, 12} and got[11][5] and not got[12][5] and got[12][3] == 1.0


def test_long_texts_and_edge_cases(spark):
    docs = [(1, FILL(30_000) + " " + ITEMS[3][1] + " " + FILL(30_000), "x"), (2, None, "x"), (3, "", "x"), (4, "!!!", "x"), (1, ITEMS[4][1], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*ITEMS, (90, None, None), (91, "", ""), (92, ITEMS[3][1], None)], "item_id long, passage string, answer string")
    want = {(1, 3), (1, 92), (1, 4)}
    assert {tuple(r)[:2] for r in leakage.leaks(d, i).collect()} == want
    assert {tuple(r)[:2] for r in leakage.leaks(d, i, max_items=7).collect()} == want  # in shards of items
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


# --- encodings ---------------------------------------------------------------------------------------------------------
SOUND = ["The user’s hand turns by 45° ± 2°, 3 – 5 µm.", "Größe und Öffnung führen über die Prüfung", "Le détecteur à l’été, déjà fixé", "El diseño según la presión", "装置は、回転子を有する。【要約】制御部は測定値に基づき", "range of 5 Ω → 9 Ω"]


def misread(text: str, encoding_name: str) -> str:
    table = {b: c for c, b in encoding._bytes(encoding_name).items()}
    return "".join(chr(b) if b < 0x80 else table[b] for b in text.encode())


@pytest.mark.parametrize("enc", encoding.SINGLE[:8])
@pytest.mark.parametrize("text", SOUND)
def test_utf8_read_as_a_single_byte_encoding(text, enc):
    bad = misread(text, enc)
    got, n, _ = encoding.repair(bad)
    assert n and got == text


@pytest.mark.parametrize("text", SOUND)
def test_nested_layers(text):
    got, n, _ = encoding.repair(misread(misread(text, "cp1252"), "cp1252"))
    assert n and got == text
    assert encoding.repair(misread(text, "cp1252").replace("é", "&eacute;").replace("Â", "&Acirc;").replace("Ã", "&Atilde;").replace("â", "&acirc;"))[1]


def test_other_misreadings():
    assert encoding.repair("the user鈥檚 hand at 20 掳C")[0] == "the user’s hand at 20 °C"
    ja = SOUND[4]
    table = {b: c for c, b in encoding._bytes("cp1252").items()}
    assert encoding.repair("".join(chr(b) if b < 0x80 else table[b] for b in ja.encode("cp932")))[0] == ja
    assert encoding.repair("die Größe der Öffnung führt über".encode("cp1252").decode("koi8_r"))[0] == "die Größe der Öffnung führt über"
    assert encoding.repair("dise�o de la presi�n")[1:] == (0, 2)
    assert encoding.repair("distance at ã®ãŸã‚ kept")[1:] == (0, 6)  # bytes were dropped


@pytest.mark.parametrize("text", [*SOUND, "", "plain", "a < b &lt; c &amp; d", "Ã x = b, with Ã = [an ij ] and Â = Ã T", "├── t₁ ──┤ = 5 µs", "σ = √( ∫ f(ω) dω", "The test string “Ã©Ã¨” in table 2 is produced on purpose",
                                  "ü is shown as “Ã¼” and the sign € as “â‚¬”; the converter", " symbol", "“Å”, naïve Ångström – “É”", "ABRÉGÉ « À »", "回路図の目的は（第1図）"])
def test_sound_texts(text):
    assert encoding.repair(text) == (text, 0, 0)


LANGUAGES = {
    "Turkish": ["Muş ve Maraş şehri", "Şişli için güzel bir gün, çağrı İstanbul’da ışık"], "Czech": ["Škoda žluť", "Příliš žluťoučký kůň úpěl ďábelské ódy", "MŮŽE PŘÍŠTĚ NÍŽE"],
    "Romanian": ["Această invenție se referă la țesături și mașini"], "Polish": ["Zażółć gęślą jaźń", "ŻÓŁĆ ŹRÓDŁO"], "Hungarian": ["Árvíztűrő tükörfúrógép", "Az ő űrhajója"],
    "Ukrainian": ["Спосіб обробки її хімії та змії"], "Russian": ["Способ обработки материала, её свойства", "Её ёлка в 23 °C и № 5"], "Serbian": ["Уређај према захтеву, ћуприја и џак"], "Bulgarian": ["Устройство съгласно претенция"],
    "Vietnamese": ["Thiết bị được sử dụng để đo nhiệt độ", "Người Việt Nam ở Hà Nội"], "Korean": ["장치는 회전자를 포함한다"], "Arabic": ["يتعلق الاختراع بجهاز قياس"], "Hebrew": ["ההמצאה מתייחסת להתקן"],
    "Hindi": ["यह आविष्कार एक उपकरण से संबंधित है"], "Thai": ["อุปกรณ์ตามข้อถือสิทธิ"], "Greek": ["Η συσκευή μέτρησης της θερμοκρασίας", "ΤΑΊΝΙΑ ΜΊΑ Ή ΌΧΙ"], "Georgian": ["მოწყობილობა საქართველო"], "Chinese": ["本发明涉及一种装置"],
    "Icelandic": ["Það er ætlað að þjóna ýmsum"],
}


@pytest.mark.parametrize("text", [*(t for ts in LANGUAGES.values() for t in ts), "模", "5 Å², Å³ und Ø±0,1 für", "CAFÉ™ DÉJÀ… QUALITÉ»", "Её", "Ті Сі Рік", "ņ ģ ķ", "a×b and c×d", "TNFα and kΩ", "k÷h, Ω1 and Ω2, a÷b", "A─B─C", "naïve œuf Å²"])
def test_sound_texts_of_other_languages(text):
    assert encoding.repair(text) == (text, 0, 0)


@pytest.mark.parametrize("enc", ["cp1252", "latin_1", "cp1251", "mac_roman", "cp437"])
@pytest.mark.parametrize("language", LANGUAGES)
def test_other_languages_are_restored(language, enc):
    for text in LANGUAGES[language]:
        assert encoding.repair(misread(text, enc))[0] == text
        if enc in ("cp1252", "latin_1", "cp1251"):
            assert encoding.repair(misread(misread(text, "cp1252"), enc))[0] == text


@pytest.mark.parametrize("text,right,wrong", [
    ("Способ обработки материала", "cp1251", "cp1252"), ("Способ обработки материала", "koi8_r", "cp1252"), ("본 발명은 밸브 장치에 관한 것이다", "cp949", "latin_1"), ("يتعلق الاختراع بجهاز قياس", "cp1256", "cp1252"),
    ("Η συσκευή μέτρησης της θερμοκρασίας", "cp1253", "cp1252"), ("ההמצאה מתייחסת להתקן", "cp1255", "cp1252"),
])
def test_lines_of_other_encodings(text, right, wrong):
    table = {b: c for c, b in encoding._bytes(wrong).items()}
    assert encoding.repair("".join(chr(b) if b < 0x80 else table[b] for b in text.encode(right)))[0] == text


def test_lines_beside_sound_ones():
    """What the text around it settles: a heading of Han signs, a line with a single impossible word."""
    read = lambda text, right, wrong: "".join(chr(b) if b < 0x80 else {b: c for c, b in encoding._bytes(wrong).items()}[b] for b in text.encode(right))
    ja = "従来の弁体では、弁体が摩耗しやすい。"
    assert encoding.repair(read("【要約】", "cp932", "cp1252") + "\n" + ja)[0] == "【要約】\n" + ja
    es = "El diseño pequeño permite una fabricación económica en una única pieza.\nSegún la figura, el émbolo tiene un tamaño de 3 mm."
    assert encoding.repair(read(es, "cp1252", "mac_roman"))[0] == es
    assert encoding.repair("µ = ВЅ · (a − b)")[0] == "µ = ½ · (a − b)"
    fr = "ABRÉGÉ\nLe détecteur à l’été, déjà fixé, est réglé"
    assert encoding.repair(read(fr, "cp1252", "cp437").replace("∆", "’"))[0].startswith("ABRÉGÉ\nLe détecteur")


def test_many_layers():
    text = bad = "die Größe"
    for _ in range(6):
        bad = misread(bad, "cp1252")
    assert encoding.repair(bad)[0] == text


def test_rows_are_kept_whole(spark):
    rows = [(1, misread(SOUND[0], "cp1252"), 5), (2, SOUND[0], 5), (3, None, 5), (4, "", 5), (5, "x " * 200_000 + misread(SOUND[1], "cp1252"), 5), (6, "lost � sign", 5), (1, misread(SOUND[0], "cp1252"), 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, fixed_runs int")
    got = sorted((r["doc_id"], r["text"]) for r in encoding.repaired(d).collect())
    assert got == sorted([(1, SOUND[0]), (1, SOUND[0]), (5, "x " * 200_000 + SOUND[1]), (6, "lost � sign")])
    assert encoding.repaired(d.limit(0)).count() == 0
