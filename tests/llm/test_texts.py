import random

import pytest

from routescope.llm import p2_chunks, p7_packing, p8_leaks, p9_sentences

PROSE = " ".join(f"Sentence number {i} talks about thing {i * 7 % 13} and then ends." for i in range(400))


def _valid(text, pieces, size=2000, overlap=200):
    assert pieces[0][:2] == (0, 0) and pieces[-1][2] == len(text)
    for p, q in zip(pieces, [*pieces[1:], None]):
        assert p[2] > p[1] and p[2] - p[0] <= size and 0 <= p[1] - p[0] <= overlap
        assert q is None or q[1] == p[2]


def test_pieces_cover_the_text():
    for text in (PROSE, "x" * 9000, "字" * 5000, "a b " * 3000, "字。" * 3000, "x" * 2001, PROSE[:2001], "\n\n".join(PROSE[i : i + 700] for i in range(0, 7000, 700))):
        _valid(text, p2_chunks.split(text))
    assert p2_chunks.split("") == [] and p2_chunks.split("short") == [(0, 0, 5, "end")]


def test_cuts_fall_on_sentence_ends():
    assert all(PROSE[p[2] - 2 : p[2]] == ". " for p in p2_chunks.split(PROSE)[:-1])


@pytest.mark.parametrize(("stretch", "kind"), [(1999, "natural"), (2000, "natural"), (2001, "forced"), (7000, "forced")])
def test_a_cut_is_forced_only_where_nothing_natural_is_in_reach(stretch, kind):
    for left, right in ((1500, 1500), (100, 2500), (2500, 50), (0, 2500)):
        text = (PROSE[:left].rsplit(" ", 1)[0] + " " if left else "") + "x" * stretch + " " + PROSE[:right]
        kinds = {p[3] for p in p2_chunks.split(text)}
        assert ("forced" in kinds) == (kind == "forced"), (stretch, left, right)


def test_an_edit_moves_only_cuts_near_it():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega"]
    text = " ".join(" ".join(rng.choices(words, k=9)) + "." for _ in range(900))
    before = {text[p[1] : p[2]] for p in p2_chunks.split(text)}
    at = len(text) // 2
    edited = text[:at] + " inserted words here " + text[at:]
    assert len([p for p in p2_chunks.split(edited) if edited[p[1] : p[2]] not in before]) <= 4


def test_chunks_of_a_table(spark):
    rows = [("a", "  " + PROSE + "\n", 1), ("b", None, 1), ("c", "", 1), ("d", " " * 3000, 1), (None, "x" * 2500, 1)]
    got = p2_chunks.chunks(spark.createDataFrame(rows, "id string, text string, piece int")).collect()
    assert {r["id"] for r in got} == {"a", None}
    a = sorted((r for r in got if r["id"] == "a"), key=lambda r: r["piece"])
    assert "".join(r["text"][r["overlap"] :] for r in a) == PROSE
    assert p2_chunks.chunks(spark.createDataFrame([], "id string, text string")).count() == 0


def test_packing(spark):
    rng = random.Random(3)
    sizes = [rng.choice([1, 40, 40, 40, 700, 1500, 3000, 4096, 4097, 9000]) for _ in range(3000)]
    rows = [(i, s, 5) for i, s in enumerate(sizes)] + [(7, None, 1), (8, 0, 1), (None, 10, 1), (3000, 40, 1), (3000, 40, 1)]
    df = spark.createDataFrame(rows, "id bigint, tokens bigint, container int")
    got = p7_packing.pack(df, salt_rows=100).collect()
    assert sum(r["tokens"] for r in got) == sum(sizes) + 10 + 80
    fill, pieces = {}, {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        pieces.setdefault(r["id"], []).append(r)
    assert max(fill.values()) <= 4096 and sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) / (4096 * len(fill)) > 0.97
    for i, s in enumerate(sizes):
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert len(mine) == -(-s // 4096) and [r["start_token"] for r in mine] == [4096 * k for k in range(len(mine))]
    cost = {}
    for r in got:
        cost.setdefault(r["step_group"], {}).setdefault(r["container"], 0)
        cost[r["step_group"]][r["container"]] += r["tokens"] ** 2
    totals = [sum(c.values()) for c in cost.values() if len(c) == 8]
    assert max(totals) < 1.15 * min(totals)
    assert p7_packing.pack(spark.createDataFrame([], "id bigint, tokens bigint")).count() == 0
    with pytest.raises(ValueError):
        p7_packing.pack(df, tiers=(1000, 4096))


def test_the_latest_delivery_counts_even_if_short(spark, tmp_path):
    rows = [("a", PROSE, 1), ("a", "short", 2), ("b", "short", 1), ("b", PROSE, 2), ("c", PROSE, 1), ("c", None, 2), ("d", PROSE, None), (None, PROSE, 1), ("e", PROSE, 1), ("e", PROSE, 1)]
    spark.createDataFrame(rows, "text_id string, text string, loaded_at int").write.parquet(str(tmp_path / "records.parquet"))
    assert sorted(r["text_id"] for r in p2_chunks.p2_found(spark, str(tmp_path)).collect()) == ["b", "d", "e"]


def _check_plan(histogram, tiers):
    made = p7_packing.plan(histogram, 4096, tiers)
    placed = {}
    for windows, times in made:
        ends = 0
        for tier, start, pattern in windows:
            assert start >= ends and sum(s * k for s, k in pattern) <= min(tier, 4096 - start)
            ends = start + sum(s * k for s, k in pattern)
            for s, k in pattern:
                placed[s] = placed.get(s, 0) + k * times
    assert placed == histogram
    return made, sum(s * n for s, n in histogram.items()) / (4096 * max(1, sum(t for _, t in made)))


def test_tiers_shape_the_plan_and_cost_no_space():
    rng = random.Random(5)
    histogram = {}
    for _ in range(20000):
        s = min(4096, max(1, int(rng.lognormvariate(6.5, 1.0))))
        histogram[s] = histogram.get(s, 0) + 1
    many, fill = _check_plan(histogram, (512, 1024, 2048, 4096))
    one, plain = _check_plan(histogram, (4096,))
    assert many != one and fill > 0.99 and plain > 0.99
    space = {}
    for windows, times in many:
        for tier, _, pattern in windows:
            space[tier] = space.get(tier, 0) + times
            assert tier == 4096 or sum(s * k for s, k in pattern) >= 0.99 * tier
    assert all(space.get(t, 0) > 100 for t in (512, 1024, 2048, 4096)), space
    # a tier's windows are led by items of that tier
    leads = {tier: pattern[0][0] for windows, _ in many for tier, _, pattern in windows if tier < 4096}
    assert all(t / 2 < s <= t for t, s in leads.items() if t > 512)


def test_sizes_that_fill_no_window_are_packed_into_whole_containers():
    assert _check_plan({300: 1300}, (512, 1024, 2048, 4096))[1] == 1300 * 300 / 4096 / 100
    assert _check_plan({}, (512, 4096)) == ([], 0.0)
    for sizes in ({4096: 3, 1: 5}, {512: 9, 600: 7, 100: 50}, {2048: 3, 1024: 1, 512: 1}):
        _check_plan(sizes, (512, 1024, 2048, 4096))


ITEM = "Carriers of the follow-up mark who received a linear über channel for 4 weeks lost fewer units than peers given rest or allocation alone."
HAN = "携带芷淞的慢性感染在服用萦淞漪之后比仅用血浆者更少出现肝脏而萦澜漪未变。"


def _leaks(text, item=ITEM, edits=0):
    items = p8_leaks.Items([(1, item)], edits=edits)
    return bool(p8_leaks.leaks(items, *p8_leaks.streams([text])))


def test_leaks_whatever_the_typography():
    words = ITEM.split()
    plain = "Before it. " + " ".join(words[2:16]) + " and after."
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in plain)
    forms = [plain, plain.upper(), wide, plain.replace("ü", "u"), plain.replace("ü", "ü"), plain.replace("ü", "&uuml;"), plain.replace(" linear", " <b>linear</b>"), plain.replace("linear", "lin-\near"), plain.replace("linear", "lin\xadear"), plain.replace(" ", " "), plain.replace(" ", ",\n“"), plain.replace("channel", "chan​nel"), plain.replace(" a ", "&nbsp;a ")]
    assert all(_leaks(f) for f in forms), [f for f in forms if not _leaks(f)]


def test_no_leak_below_twelve_words_or_with_words_between():
    words = ITEM.split()
    assert _leaks("x " + " ".join(words[2:14]) + " y")
    assert not _leaks("x " + " ".join(words[2:13]) + " y")
    broken = words[2:9] + ["zzz"] + words[9:16] + ["qqq"] + words[16:]
    assert not _leaks(" ".join(broken))
    assert not _leaks(" ".join(words[2:9] + words[10:17]))
    assert not _leaks("pre" + " ".join(words[2:14])) and not _leaks(" ".join(words[2:14]) + "ing")
    assert not _leaks("") and not _leaks("...")


def test_chinese_counts_characters():
    assert _leaks("前文。" + HAN[3:23] + "后文", HAN) and _leaks("前" + HAN[3:13] + "，\n" + HAN[13:23] + "后", HAN)
    assert not _leaks("前文" + HAN[3:22] + "天地", HAN) and not _leaks(HAN[3:13] + "天" + HAN[13:23], HAN)


def test_markup_of_any_length_is_no_text():
    words = ITEM.split()
    for size in (10, 400, 50_000):
        tag = f'<span title="a > b" style="{"x: y; " * (size // 6)}">'
        assert _leaks("x " + " ".join(words[2:8]) + " " + tag + " ".join(words[8:14]) + "</span> y"), size
    assert _leaks("x<p>" + " ".join(words[2:14]) + "<br/>y") and _leaks("<!-- no --> " + " ".join(words[2:8]) + "<!-- a <b> -->" + " ".join(words[8:14]))
    assert _leaks("if a <b then, as before, " + " ".join(words[2:14]) + ", c > d " * 200)


def test_edit_budget():
    passage = " ".join(ITEM.split()[2:14])
    at = passage.index("linear")
    changed = [passage[:at] + "lxnear" + passage[at + 6 :], passage[:at] + "liinear" + passage[at + 6 :], passage[:at] + "linar" + passage[at + 6 :]]
    assert not any(_leaks(f"x {c} y") for c in changed) and all(_leaks(f"x {c} y", edits=1) for c in changed)
    twice = [c.replace("channel", "chanxel") for c in changed]
    assert not any(_leaks(f"x {c} y", edits=1) for c in twice) and all(_leaks(f"x {c} y", edits=2) for c in twice)


def test_every_planted_passage_is_found():
    rng = random.Random(8)
    letters = "abcdefghij"
    for trial in range(60):
        item = " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(40))
        noise = lambda: " ".join("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 30)))
        a = rng.randint(0, 28)
        edits = trial % 3
        passage = " ".join(item.split()[a : a + 12])
        for _ in range(edits):
            at = rng.randrange(len(passage))
            if passage[at] != " ":
                passage = passage[:at] + rng.choice(["z", "", passage[at] + "z"]) + passage[at + 1 :]
        assert _leaks(f"{noise()} {passage} {noise()}".strip(), item, edits) or edits, trial


def test_contaminated_table(spark):
    docs = spark.createDataFrame([(1, "a " + ITEM, "en"), (1, "a " + ITEM, "en"), (2, None, "en"), (3, "", "en"), (4, "nothing here", None), (None, ITEM, "en"), (5, ("filler " * 20000) + HAN + ITEM, "zh")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM, "en"), (11, HAN, "zh"), (12, None, "en"), (13, "too short", "en"), (None, ITEM, "en"), (14, "", "en")], "item_id bigint, text string, doc_id string")
    want = {(1, 10), (5, 10), (5, 11)}
    for block_chars in (10**6, 60):  # the second takes several passes
        assert {tuple(r) for r in p8_leaks.contaminated(docs, items, block_chars=block_chars).collect()} == want
    assert p8_leaks.contaminated(docs.limit(0), items).count() == 0 and p8_leaks.contaminated(docs, items.limit(0)).count() == 0


HELD_OUT = [
    "The storm broke the mast.| Mr. Olsen and Dr. Vance repaired it by 6 p.m.| 14 of 20 sails were torn (see Fig. 9).| Was it repaired…?| Rope, tar, etc.| The crew wrote: “We sailed.”| “Did it hold?” asked Prof. Reed.| xB7 held.",
    "Der Sturm kam um ca. 3,5 Uhr (Abb. 7).| „Hielt der Mast?“, fragte Dr. Olsen.| Geprüft wurden Seil, Segel usw.| Am 9. Mai fuhr das Schiff, d. h. es schwamm.",
    "M. Vance écrit : « Le mât tient. »| « Le vent tombe ? » demande Mme Reed.| Le prix (cf. fig. 2) monte ; il tombe.", "El Dr. Vance dijo: «El barco salió».| ¿Por qué salió?| ¡Nadie lo vio!| Pesa aprox. 4,5 kg, p. ej. con AB2.",
    "Корабль вышел, т. е. уплыл.| «Куда он плывёт?» — спросил д-р Орлов.| Взяты канат, парус и др.| Вес 4,5 кг (рис. 8).", "船は出た。|「風は吹くか？」という声がある。|「船は速い。」と彼は言った。|重さは（4.5kg）だ。", "船离开了。|“风大吗？”船长问道。|他写道：“船很快。”|帆破了……随后修好了。",
    "เรือออกไปแล้ว| ลมแรงมาก 12 เมตร| คลื่นสูง", "السفينة غادرت.| هل عادت 3.5 مرات؟| نعم.", "जहाज़ गया।| क्या वह लौटा 2.5 दिन में?| हाँ।", "Το πλοίο έφυγε.| Πού πήγε;| Γύρισε.", "መርከቡ ሄደ።| ተመለሰ?| አዎ።", "جہاز گیا۔| کیا وہ 3.5 بجے آیا؟| ہاں۔",
    "Sea log\n\nThe ship left.|\n\nReturn\n\nIt came\nback late.| All slept",
    "The cook peeled 3.5 kg of carrots.| Then Mr. Flint, i.e. the owner, came in.| 18 plates broke.|", "Is the soup hot?| L. Grant tasted it.| It lacked salt, pepper, etc.| She frowned.|", "Lunch starts at 11 a.m. and ends at 2 p.m.| The staff rest.| See Vol. 3, No. 8 (Fig. 6).|",
    "The chef vs. the waiter was loud.| Use e.g. butter.| Bake at 190.| Serve.|", "The menu read: “Fish is gone.”| 7 of 12 guests left.| “Any soup?” asked Prof. Bell.|", "Order R-12 uses part GH9.| 25 of 31 parts fit.| tQX3 did not.|", "He paused ... and poured the tea.| (The tap dripped.)| Was it fixed…?| No.",
    "Recipes\n\nBoil the rice.| Drain it.|\n\nDrinks\n\nChill the juice", "The pot held 1,204.8 ml.| The lid held .75 ml.| Version v2.0.1 of the oven failed!| Why?", "Peel, cut, etc. and boil.| Dr. Nash ate.| K. L. Marsh and J. Bell cooked.|",
    "Der Koch wog ca. 2,5 kg Mehl (Abb. 4).| Am 3. März briet er Fisch usw.| Die Gäste aßen.|", "„Ist die Suppe heiß?“, fragte Prof. Kern.| Am 19. Juli aß er z. B. Brot.| Es schmeckte!|", "Es gab Salz bzw. Pfeffer, d. h. Gewürz.| Wer kochte?| Dr. Kern kochte.|",
    "M. Lebrun écrit : « La soupe est froide. »| « Le pain est dur ? » demande Mme Petit.| Il pèse env. 2,5 kg ; il refroidit.|", "Le four (cf. fig. 6) chauffe.| Un plat, p. ex. le riz, cuit.| Pourquoi attendre ?|", "El Sr. Prado dijo: «La sopa hierve».| ¿Quién come?| ¡Nadie!| Pesa aprox. 1,5 kg.|", "La Dra. Sol usa p. ej. sal.| El pan (fig. 3) sube.| Todo huele bien.|",
    "Суп остыл, т. е. замёрз.| «Кто варил?» — спросил д-р Зимин.| Есть соль, перец и др.| Гости ели (рис. 4).|", "Рыба весит 2,5 кг.| Хлеб готов!| Где нож?|", "汤凉了。|“盐够吗？”厨师问道。|他写道：“鱼熟了。”|锅破了……后来补好了。|", "面条煮好了！|谁来吃？|（重1.5公斤）没人知道。|", "米饭熟了。|\n茶也好了。| 客人来了。|",
    "「塩は足りるか？」という声が聞こえる。|鍋は重い。|なぜ魚は焦げたのか？|", "魚が焼けた。|「米は炊けた。」と料理人は言った。|皿が割れた（2枚）。|", "แม่ครัวทำแกง| ใส่เกลือ 3 ช้อน| ทุกคนอิ่ม", "ปลาสดมาก| ราคา 45 บาท| ขายหมดแล้ว",
    "الطعام جاهز.| هل الملح كاف 2.5 مرة؟| الضيوف هنا.|", "الخبز ساخن؛ الشاي بارد.| من الطباخ؟| لا أحد.|", "کھانا تیار ہے۔| کیا نمک 1.5 چمچ ہے؟| مہمان آئے۔|", "खाना तैयार है।| क्या नमक 1.5 चम्मच है?| मेहमान आए!| सब ने खाया।|",
    "ምግቡ ደረሰ።| ጨው 1.5 ማንኪያ ነው?| እንግዶች መጡ።|", "Το φαγητό είναι έτοιμο.| Πού είναι το αλάτι;| Έβαλε 1.5 κουτάλι.|", "The stew cooked; the bread burned.| The cook said “Stop. Wait.” and ran.| It was over",
]


def test_held_out_sentences():
    good = found = wanted = 0
    for example in HELD_OUT:
        text, want = p9_sentences._labelled(example)
        want |= {len(text.rstrip())} | {i for i in range(1, len(text)) if text[i : i + 2] == "\n\n"}
        got = set(p9_sentences.ends(text))
        good, found, wanted = good + len(got & want), found + len(got), wanted + len(want)
    assert len(HELD_OUT) >= 40 and good / found >= 0.98 and good / wanted >= 0.98, (good, found, wanted)


def test_quotations_of_any_length_end_nothing_inside():
    for size in (100, 3000, 60_000):
        inner = "It rained. It snowed. " * (size // 20)
        text = f"He said “{inner}and it stopped” and left. They ate."
        assert p9_sentences.ends(text) == [len(text) - 10, len(text)], size
    stray = "A “stray mark. " * 3000
    assert len(p9_sentences.ends(stray)) >= 3000


def test_abbreviations_learned_from_the_documents(spark):
    rows = [(f"We measured the wall with the klp. of the house and the klp. was long. The day {i} ended. Klp. means rule.",) for i in range(40)]
    df = spark.createDataFrame(rows, "text string")
    assert p9_sentences.abbreviations(df) == {"klp"} and p9_sentences.abbreviations(df.limit(0)) == frozenset()
    text = "The klp. North is old. We left."
    assert p9_sentences.ends(text, p9_sentences.model(frozenset({"klp"}))) == [22, 31]


def test_training_text_is_read_as_labelled():
    good = found = wanted = 0
    for example in p9_sentences.EXAMPLES:
        text, want = p9_sentences._labelled(example)
        want |= {len(text.rstrip())} | {i for i in range(1, len(text)) if text[i : i + 2] == "\n\n"}
        got = set(p9_sentences.ends(text))
        good, found, wanted = good + len(got & want), found + len(got), wanted + len(want)
    assert good / found >= 0.99 and good / wanted >= 0.99


def test_sentences_of_a_table(spark):
    rows = [(1, "  One.  Two “x.” \n", "a"), (2, None, "a"), (3, " \n\t", "a"), (4, "", "a"), (None, "Three", "a"), (5, "word " * 50000, "a")]
    got = p9_sentences.sentences(spark.createDataFrame(rows, "doc_id bigint, text string, sentence string")).collect()
    assert sorted((r["doc_id"] or 0, r["sentence"], r["end_char"]) for r in got) == [(0, 0, 5), (1, 0, 6), (1, 1, 16), (5, 0, 249999)]
    assert p9_sentences.sentences(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
