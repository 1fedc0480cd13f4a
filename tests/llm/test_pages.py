import random

import pytest

from sievewright.llm import charset, language, pages, residue, stuffing, subjects
from sievewright.llm.pagetext import Batch, Vocabulary, body, segments

WORDS = {
    "en": (["The {} was moved to the old harbour last year.", "Nobody had expected that the {} would cost so much.", "She said that the {} and the {} belong together.", "If the {} fails then the {} has to carry the weight.", "There is no {} in the archive of the town.", "We asked around and heard very different answers about the {}.", "It rained for hours while the {} was on the table."], ["violin", "orchestra", "choir", "goalkeeper", "referee", "striker", "window", "garden", "market"]),
    "de": (["Der {} wurde im letzten Jahr an den alten Hafen verlegt.", "Niemand hatte erwartet, dass der {} so viel kostet.", "Sie sagte, dass der {} und der {} zusammengehören.", "Wenn der {} ausfällt, muss der {} alles alleine tragen.", "Es gibt keinen {} im Archiv der Stadt.", "Wir haben nachgefragt und über den {} sehr verschiedene Antworten gehört.", "Es regnete stundenlang, während der {} auf dem Tisch lag."], ["Geige", "Torwart", "Schiedsrichter", "Stürmer", "Bäcker", "Markt", "Garten", "Schlüssel"]),
    "fr": (["Le {} a été déplacé vers le vieux port l’année dernière.", "Personne n’avait prévu que le {} coûterait si cher.", "Elle a dit que le {} et le {} vont ensemble.", "Si le {} échoue, le {} doit tout porter.", "Il n’y a pas de {} dans les archives de la ville.", "Nous avons interrogé plusieurs personnes sur le {} et reçu des réponses différentes.", "Il a plu pendant des heures tandis que le {} était sur la table."], ["violon", "gardien", "arbitre", "château", "marché", "jardin", "théâtre", "élève"]),
}
SCHEMA = "page_id long, url_norm string, title string, body_text string, html_lang string, js_only boolean, meta_keywords array<string>, lang string, ids string"
FLAGS = "page_id long, soft_404 boolean"
LANGS = "page_id long, value string"


def prose(rng, lang, n):
    forms, nouns = WORDS[lang]
    return " ".join(rng.choice(forms).format(*[rng.choice(nouns) for _ in range(2)]) for _ in range(n))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(3)
    rows, langs, truth = [], [], {}
    for i in range(420):
        lang = ["en", "de", "fr"][i % 3]
        rows.append([i, f"https://h{i % 40}.example/{i}", "A title", prose(rng, lang, 7), lang, False, None, "x", None])
        langs.append((i, lang))
    for i in range(400, 420):
        rows[i][4] = None if i % 2 else "xx"
        truth.setdefault("language", set()).add((i, langs[i][1]))
    n = 420

    def add(kind, text, lang="en", **kw):
        nonlocal n
        rows.append([n, f"https://h{n % 40}.example/{n}", kw.get("title", "T"), text, lang, kw.get("js", False), None, None, "clash"])
        langs.append((n, lang))
        truth.setdefault(kind, set()).add(n)
        n += 1

    for i in range(24):
        add("residue", "Home | About | Contact\n" + " ".join(rng.choice(["Error 404: this page does not exist.", "Dear {{ user.name }}, welcome to {{ city }}.", "Please enable JavaScript to continue.", "Lorem ipsum dolor sit amet consectetur elit sed tempor."]) for _ in range(4)), title="Error 404", js=i % 2 == 0)
        k = rng.choice(["cheap led strip", "buy phone case", "running shoes sale"])
        add("stuffed", ", ".join([k, k + " online", "best " + k] * 9))
        add("stuffed", " ".join([f"Looking for {k}? Our {k} is the best {k} for {k} fans."] * 6))
    for i in range(20):
        t = prose(rng, "de", 7)
        add("garbled", t.encode("utf-8").decode("cp1252", "replace") if i % 2 else t.encode("cp1252", "replace").decode("mac_roman"), "de")
    for i in range(12):
        add("mixed", prose(rng, "en", 5) + " " + prose(rng, "fr", 5), "en")
    add("none", prose(rng, "en", 6) + " Put {{ user.name }} into the greeting. The é turns into “Ã©”, says the handbook. “Niemand hatte erwartet, dass der Torwart so viel kostet.”")
    for t in (None, "", " \n\t ", "x", "\x00", "a" * 300_000, "ü" * 50_000, "Home | About"):
        add("odd", t)
    rows.append(rows[-1])
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    return df, spark.createDataFrame([(0, False)], FLAGS), spark.createDataFrame(langs, LANGS), truth


def ids(df):
    got = [r.page_id for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_residue(world):
    df, flags, langs, truth = world
    got = ids(pages.residue_pages(df, flags, langs))
    assert len(got & truth["residue"]) >= 0.9 * len(truth["residue"])
    assert not got & (truth["stuffed"] | truth["none"] | set(range(400)) | truth["mixed"])


def test_stuffed(world):
    df, flags, langs, truth = world
    got = ids(pages.stuffed_pages(df, flags, langs))
    assert len(got & truth["stuffed"]) >= 0.9 * len(truth["stuffed"])
    assert not got & (truth["residue"] | truth["none"] | set(range(400)) | truth["mixed"])


def test_garbled_and_restored(world):
    df, flags, langs, truth = world
    got = ids(pages.garbled_pages(df))
    assert got >= truth["garbled"] and not got & (truth["none"] | set(range(400)))
    original = {r.page_id: r.restored_text for r in pages.restored_pages(df).collect()}
    assert sum("für" in t or "ä" in t or "ü" in t for i, t in original.items() if i in truth["garbled"]) >= 0.9 * len(truth["garbled"])


def test_every_codec_and_unseen_words():
    known = {"de": "für über größer schön können müssen möglich zurück später während gehört fährt grün böse öffnen Bäcker Gärten Häuser Mäuse Läufer Träume Bäume schräg träge".split(), "fr": "été élève théâtre château où très après même déjà été près élan écoles".split()}
    m = charset.fit([(g, " ".join(ws)) for g, ws in known.items() for _ in range(8)])
    for codec in ("iso8859_15", "cp1254", "iso8859_7", "cp1253"):  # codecs that pages are read in
        text = " ".join(w.encode("utf-8").decode(codec, "replace") for w in ["später", "schön", "für"])
        if "\ufffd" not in text:
            assert m.examine(text) == (True, "später schön für"), codec
    # every step's reading is weighed, also where no word of it is known and the page has other odd characters
    assert ("cp1252", "iso8859_5") in charset.CHAINS
    words = ["Bäckerläden", "Gärtnerträume", "Mäusehäuser"]
    garbled = " ".join(w.encode("cp1252").decode("mac_roman") for w in words)
    assert m.examine(garbled) == (True, " ".join(words))
    assert m.examine(garbled + " 漢字 仮名 日本 東京 大阪 京都")[0]
    assert not m.examine(" ".join(words))[0]


def test_language(world):
    df, flags, langs, truth = world
    rows = [(r.page_id, r.lang) for r in pages.language_cases(df, flags, langs).collect()]
    assert len(rows) == len(set(rows))
    got = set(rows)
    assert truth["language"] <= got and {(i, x) for i in truth["mixed"] for x in ("en", "fr")} <= got
    assert not {i for i, _ in got} & (truth["residue"] | truth["stuffed"] | truth["none"] | set(range(400)))
    whole = {r.page_id: r for r in pages.language_of_pages(df, langs).collect()}
    assert (whole[0].lang, whole[1].lang, whole[2].lang) == ("en", "de", "fr") and whole[0].confidence > 0.9 and not whole[0].mixed
    assert all(whole[i].mixed for i in truth["mixed"]) and any(r.lang is None and r.confidence == 0 for r in whole.values())
    segs = pages.language_segments(df, langs).where("page_id < 3").collect()
    assert {(r.page_id, r.lang) for r in segs} == {(0, "en"), (1, "de"), (2, "fr")} and all(0.5 <= r.confidence <= 1 for r in segs)


def test_subjects(spark, world):
    rng = random.Random(5)
    rows, topics, hand = [], [], []
    terms = {"mus": ["violin", "orchestra", "choir"], "spt": ["goalkeeper", "referee", "striker"]}
    for i in range(160):
        t = ["mus", "spt"][i % 2]
        text = " ".join(rng.choice(WORDS["en"][0]).format(*[rng.choice(terms[t]) for _ in range(2)]) for _ in range(6))
        if i >= 150:
            text += " The violin was on the table. " if t == "spt" else " The referee was there. "
        rows.append((i, f"https://h{i % 9}.example/{i}", "T", text, "en", False, terms[t] if i % 3 else None, None, None))
        topics.append((i, [(t, "x", None, None, 0.9)] if i % 4 else None))
        if i % 3 == 0:
            hand.append((i, t))
    tax = spark.createDataFrame([("mus", "Music", 1, None, None), ("spt", "Sport", 1, None, None), ("spt.ball", "Ball games", 2, "spt", ["ball games"])], "id string, name string, tier int, parent string, aliases array<string>")
    rec = spark.createDataFrame(topics, "page_id long, topics array<struct<tier1_id:string,tier1_name:string,tier2_id:string,tier2_name:string,confidence:double>>")
    lab = spark.createDataFrame(hand, "page_id long, topic string")
    df = spark.createDataFrame(rows, SCHEMA)
    found = pages.page_subjects(df, world[1], world[2], rec, lab, tax)
    got = {(r.page_id, r.topic) for r in found.collect()}
    assert got == {(i, ["mus", "spt"][i % 2]) for i in range(160)}
    shares = {r.topic: r for r in pages.subject_shares(found).collect()}
    assert abs(shares["mus"].page_share - 0.5) < 0.05 and shares["spt"].n_pages == 80
    assert pages.page_subjects(df, world[1], world[2], rec.where("false"), lab.where("false"), tax).count() == 0


def test_empty_tables(spark, world):
    df, flags, langs, _ = world
    e, f, g = df.where("false"), flags.where("false"), langs.where("false")
    assert pages.residue_pages(e, f, g).count() == pages.stuffed_pages(e, f, g).count() == pages.language_cases(e, f, g).count() == 0
    assert pages.garbled_pages(e).count() == pages.restored_pages(e).count() == pages.language_segments(e, g).count() == 0
    assert pages.residue_report(e, f, g).count() == 1


def test_body_and_segments():
    assert body("Home | About | Contact Real text here. © 2020 Name") == "Real text here."
    assert body("Startseite\nSuche\nKontakt") == "" and body("") == "" and body("Cookies | RSS | X") == ""
    assert segments("One. Two! “Three?” Four\nFive") == ["One.", "Two!", "“Three?”", "Four", "Five"]


def brute_phrases(text, corpus):
    """Fewest pieces of ``text`` that each occur in a sentence of the corpus, single characters allowed."""
    n = len(text)
    best = [0] + [10**9] * n
    for j in range(1, n + 1):
        for i in range(j):
            if j - i == 1 or any(text[i:j] in s for s in corpus):
                best[j] = min(best[j], best[i] + 1)
    return best[n]


def test_phrases_equal_brute_force():
    rng = random.Random(7)
    texts = {k: [language.plain("".join(rng.choice("abcd ") for _ in range(40))) for _ in range(6)] for k in ("aa", "bb")}
    m = language.LanguageModel(texts)
    segs = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 60))).strip() or "a" for _ in range(60)]
    got, letters = m.phrases(segs)
    for s, row, n in zip(segs, got, letters):
        p = language.plain(s)
        assert n == len(p.replace(" ", ""))
        assert [int(x) for x in row] == [brute_phrases(p, m.texts[k]) for k in m.langs]


def test_charset_round_trip():
    rng = random.Random(2)
    sample = [(lang, prose(rng, lang, 8)) for lang in WORDS for _ in range(60)]
    m = charset.fit(sample)
    hit = 0
    for lang in ("de", "fr"):
        for w, r in [("cp1252", "utf_8"), ("mac_roman", "utf_8"), ("cp437", "utf_8"), ("cp1251", "utf_8"), ("mac_roman", "cp1252"), ("cp850", "cp1252")]:
            t = prose(rng, lang, 8)
            try:
                bad = t.encode(r).decode(w)
            except UnicodeError:
                continue
            garbled, back = m.examine(bad)
            hit += garbled and back == t
            assert garbled
    assert hit >= 8
    for lang, t in sample:
        assert m.examine(t) == (False, t)
    assert m.examine(None) == (False, None) and m.examine("caf� au lait")[0]


def test_twice_garbled_with_a_lost_byte():
    ru = "Тем не менее сад требует больше времени, чем ожидалось, а поле ещё больше. Суд может подождать, «урожай» нет. Всем известно, что письмо пришло."
    m = charset.fit([("ru", ru), ("en", "The café was full. The Señorra house stood by the sea.")] * 12)
    bad = ru
    for _ in range(2):
        bad = bad.encode("utf-8").decode("cp1251", "replace")
    assert "�" in bad and m.examine(bad) == (True, ru)
    half = ru + " The café was full. " + ru.encode("utf-8").decode("cp1252", "replace")[:60]
    garbled, back = m.examine(half)
    assert garbled and back.startswith(ru + " The café was full.")


def test_viterbi_equals_brute_force():
    import itertools
    import numpy as np

    b = Batch(Vocabulary(), ["The cat sat on the mat. cheap shoes, cheap shoes, cheap shoes\nHome", "x", None, "Buy now\nbuy now"])
    m = stuffing.StuffingModel()
    lines = m.lines(b)
    got = m.label(lines, b.n_pages)
    loge = m.emissions(lines)
    for page in range(b.n_pages):
        at = np.flatnonzero(lines.page == page)
        if len(at):
            score = lambda path: np.log(m.initial[path[0]]) + sum(loge[i, s] for i, s in zip(at, path)) + sum(np.log(m.trans[a, c]) for a, c in zip(path, path[1:]))
            best = max(itertools.product(range(5), repeat=len(at)), key=score)
            assert abs(score(best) - score(tuple(got[at]))) < 1e-9


def test_thresholds_are_calibrated():
    m = subjects.SubjectModel([("violin", "mus", 1.0), ("striker", "spt", 1.0)])
    assert m.subjects(["The violin.", "A violin!", "No violins, striker?"]) and set(m.subjects(["The violin.", "A violin!", "A striker."])) == {"mus"}
    assert subjects.SubjectModel([]).subjects(["x"]) == {}

    def table(examples):
        out = {}
        for parts, truth in examples:
            for k, v in subjects.cells(m, parts, truth).items():
                out[k] = tuple(a + b for a, b in zip(out.get(k, (0, 0, 0)), v))
        return out

    few = subjects.choose(m, table([(["The violin."], {"mus"})] * 30))
    assert few.thresholds == {} and few.default == subjects.DEFAULT
    same = subjects.choose(m, table([(["The violin."], {"mus"})] * 60))
    assert same.thresholds == {} and same.default == subjects.DEFAULT
    # one subject is often mentioned in passing, the other not: it gets a limit of its own
    passing = [(["The violin."] * 2 + ["A striker."] * 6, {"spt"})] * 60 + [(["The violin."] * 6, {"mus"})] * 60 + [(["The violin."] * 3 + ["A striker."], {"mus", "spt"})] * 100
    got = subjects.choose(m, table(passing))
    limit = lambda t: got.thresholds.get(t, got.default)
    assert limit("mus")[1] > 0.25 and limit("spt")[0] == 1 and limit("spt")[1] <= 0.25


def test_phrase_share_of_prose_is_small():
    assert residue.phrase_share(["Put {{ user.name }} into the greeting and the engine fills it in for every visitor of the page."]) == 0
    assert residue.phrase_share(["{{ a.b }}", "{% for x in y %}"]) == 1


def test_any_number_of_languages_and_letters():
    rng = random.Random(9)
    # 60 languages with words of their own, over more letters than a dense table of this size has
    letters = "".join(map(chr, [*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x4E00, 0x4F80)]))
    words = {f"l{k}": ["".join(rng.choice(letters[k * 5 : k * 5 + 40]) for _ in range(rng.randint(2, 6))) for _ in range(30)] for k in range(60)}
    texts = {k: [language.plain(" ".join(rng.choice(ws) for _ in range(8))) for _ in range(25)] for k, ws in words.items()}
    dense = language.DENSE_CELLS
    language.DENSE_CELLS = 20 * sum(len(s) for ss in texts.values() for s in ss)  # a narrow table: most letters are looked up
    try:
        m = language.LanguageModel(texts)
        segs = [(k, " ".join(rng.choice(ws) for _ in range(9))) for k, ws in words.items() for _ in range(3)]
        got, _, letters = m.classify([s for _, s in segs])
        assert len(m.langs) == 60 and m.width < len(m.code) and [m.langs[g] for g in got] == [k for k, _ in segs]
        some = [s for _, s in segs[::30]]
        for s, row in zip(some, m.phrases(some)[0]):
            assert [int(x) for x in row] == [brute_phrases(language.plain(s), m.texts[k]) for k in m.langs]
    finally:
        language.DENSE_CELLS = dense


FOREIGN = {
    "zh": "去年春天我们搬到了河边的一座老房子里。每天早上邻居都会带着他的狗去市场买新鲜的蔬菜。孩子们放学以后喜欢在院子里踢球。没有人想到这座城市会变得这么快。老师说图书馆下个月就要重新开放了。如果天气好的话,大家会一起去山上散步。",
    "ja": "去年の春、私たちは川のそばの古い家に引っ越しました。毎朝、隣の人は犬を連れて市場へ新しい野菜を買いに行きます。子どもたちは放課後に庭でボールを蹴るのが好きです。この町がこんなに早く変わるとは誰も思いませんでした。先生は図書館が来月また開くと言いました。天気がよければ、みんなで山へ散歩に行きます。",
    "ko": "작년 봄에 우리는 강가에 있는 오래된 집으로 이사했습니다. 매일 아침 이웃은 개를 데리고 시장에 신선한 채소를 사러 갑니다. 아이들은 방과 후에 마당에서 공을 차는 것을 좋아합니다. 이 도시가 이렇게 빨리 변할 줄은 아무도 몰랐습니다. 선생님은 도서관이 다음 달에 다시 문을 연다고 말했습니다. 날씨가 좋으면 모두 함께 산에 산책하러 갑니다.",
    "hi": "पिछले वसंत में हम नदी के किनारे एक पुराने घर में रहने आए। हर सुबह पड़ोसी अपने कुत्ते के साथ बाज़ार से ताज़ी सब्ज़ियाँ लाने जाता है। बच्चे स्कूल के बाद आँगन में गेंद खेलना पसंद करते हैं। किसी ने नहीं सोचा था कि यह शहर इतनी जल्दी बदल जाएगा। अध्यापक ने कहा कि पुस्तकालय अगले महीने फिर खुलेगा।",
    "th": "ฤดูใบไม้ผลิปีที่แล้วเราย้ายไปอยู่บ้านเก่าริมแม่น้ำ ทุกเช้าเพื่อนบ้านจะพาสุนัขไปตลาดเพื่อซื้อผักสด เด็กๆชอบเล่นฟุตบอลในสนามหลังเลิกเรียน ไม่มีใครคิดว่าเมืองนี้จะเปลี่ยนไปเร็วขนาดนี้ ครูบอกว่าห้องสมุดจะเปิดอีกครั้งในเดือนหน้า ถ้าอากาศดีทุกคนจะไปเดินเล่นบนภูเขาด้วยกัน",
}


def test_scripts_beyond_latin():
    rows = []
    for lang, text in FOREIGN.items():
        parts = segments(text)
        for i in range(12):
            rows.append((lang, [parts[(i + k) % len(parts)] for k in range(max(1, len(parts) - 1))] if len(parts) > 1 else [text[i * 7 :]]))
    for lang in WORDS:
        rows += [(lang, segments(prose(random.Random(i), lang, 6))) for i in range(12)]
    m = language.fit(rows)
    assert set(FOREIGN) <= set(m.langs)
    new = {
        "zh": "图书馆的老师早上去市场买蔬菜。", "ja": "先生は毎朝市場へ野菜を買いに行きます。", "ko": "선생님은 매일 아침 시장에 채소를 사러 갑니다.",
        "hi": "अध्यापक हर सुबह बाज़ार से सब्ज़ियाँ लाने जाता है।", "th": "ครูไปตลาดทุกเช้าเพื่อซื้อผักสด", "fr": "Il n’y a pas de théâtre dans les archives.",
    }
    got, conf, _ = m.classify(list(new.values()))
    assert [m.langs[g] for g in got] == list(new) and (conf > 0.5).all()
    page = language.page_languages(m, [segments(FOREIGN["zh"]), segments(FOREIGN["ja"])])
    assert [p["main"] for p in page] == ["zh", "ja"] and page[0]["counts"]["zh"] >= 3


def test_foreign_prose_is_no_stuffing(world):
    from sievewright.llm.counts import prepare

    df, flags, langs, _ = world
    m = pages.fit(*prepare(df, flags, langs), with_residue=True)
    keywords = "便宜手机壳,手机壳批发,买手机壳,最好的手机壳,手机壳专卖,手机壳优惠,便宜手机壳,手机壳网店,手机壳批发,买手机壳"
    texts = [t * 3 if lang == "th" else t for lang, t in FOREIGN.items()] + [FOREIGN["th"], keywords, (keywords + "。") * 3, keywords.replace(",", "\n")]
    b = Batch(Vocabulary(), [None] * len(texts), [segments(t) for t in texts])
    shares = m.stuffing.page_share(b)
    assert (shares[[0, 1, 2, 3, 5]] < 0.1).all() and (shares[6:] > 0.5).all()
    assert (m.residue.page_share(b, [None] * len(texts))[[0, 1, 2, 3, 5]] <= 0.5).all()


def test_facts_agree_with_the_operators(spark, world, tmp_path):
    df, flags, langs, truth = world
    m = pages.fit_models(df, flags, langs)
    pages.save_models(spark, m, str(tmp_path / "models"))
    again = pages.load_models(spark, str(tmp_path / "models"))
    facts = {r.page_id: r for r in pages.page_facts(df, again).collect()}
    assert {i for i, r in facts.items() if r.garbled} == ids(pages.garbled_pages(df, models=m))
    assert {i for i, r in facts.items() if r.residue_share > residue.CASE} == ids(pages.residue_pages(df, flags, langs, models=m))
    assert all(set(facts[i].langs) == {"en", "fr"} and facts[i].mixed for i in truth["mixed"])


def test_curated_terms_replace_the_draft(spark):
    pg = spark.createDataFrame([(i, ["violin", "choir"]) for i in range(6)], "page_id long, meta_keywords array<string>")
    said = spark.createDataFrame([(i, "mus", False) for i in range(6)], "page_id long, topic string, hand boolean")
    assert {(r.term, r.topic) for r in subjects.terms(pg, said).collect()} == {("violin", "mus"), ("choir", "mus")}
    own = spark.createDataFrame([("Violin", "art", 2.0), ("choir", "mus", 0.0), ("goal", "spt", 1.0)], "term string, topic string, weight double")
    assert {(r.term, r.topic, r.weight) for r in subjects.terms(pg, said, own).collect()} == {("violin", "art", 2.0), ("goal", "spt", 1.0)}


def test_phrases_by_literals_equal_the_pattern():
    rng = random.Random(8)
    bits = residue._alternatives(residue._PHRASES.pattern)
    lines = ["Error 404", "40 years ago", "404 not found", "enable JavaScript", "activez javascript", "nothing here", "höchstens 30 Wörter", "Fehler 500"]
    lines += [" ".join(rng.choice(bits).replace("\\d+", "12").replace("\\", "") for _ in range(2)) for _ in range(300)]
    look = residue._Phrases()
    assert [look(s)[0] for s in lines] == [bool(residue._PHRASES.search(s)) for s in lines]
