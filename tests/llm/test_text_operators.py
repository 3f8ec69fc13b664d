"""Sentences, encodings, visual forms, splitting, repetition and truncation on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fabulon.llm import encoding as E
from fabulon.llm import repetition as R
from fabulon.llm import splitting as S
from fabulon.llm import truncation as T
from fabulon.llm import visual as V
from fabulon.llm.sentences import sentence_spans, split_sentences


def parts(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("At No. 5 St. Orrin’s Lane, Dr. Oak met J. R. Elm. He left.", 2),
        ("At 4 a.m. Zelie woke. Zelie came back at 8 p.m. In the spring, she left.", 3),
        ("“Who goes there?” asked Fenna. “Nobody. Go away,” said Orlo.", 3),
        ("Orlo read aloud: “Bring me the box.” He wept.", 2),
        ("“Wait... you must go,” Orlo began—and stopped. He left.", 2),
        ("« Qui va là ? » demanda Thélia. « Patience, mon ami. Je ne peux pas », dit-elle.", 3),
        ("Il revint à 8 h. du soir, c.-à-d. tard. M. Brun paya 3,5 francs.", 2),
        ("„Es ist zu spät!“ fragte Odran bei Nr. 7. Am 3. Mai ging er z. B. fort.", 2),
        ("«¿Quién espera?», preguntó el Sr. Gil. ¡Es tarde!", 2),
        ("«Кто там?» — шепчет г-жа Тарнвик. В 1874 г. Одран ушёл, т. е. слишком поздно.", 2),
        ("马雷克说：“我画下了瓶子。”“是谁？”塞弗林问。4.5磅盐。", 3),
        ("「誰だ？」とイルヴァは聞いた。もう遅い！", 2),
        ("“कौन है?” डॉ. क्विलान पूछता है। 3 मई को वह गया।", 2),
        ("คืนนั้นเซเวรินเปิดเกลือ 4 ถุงในหมอก ใครรออยู่ในสวน\n\nใคร", 3),
        ("(3) On market day, he left. (4) She stayed.", 2),
        ("He (who knew. All of it. And more) left. Then he came.", 2),
        ("He (who " + "knew " * 200 + ". All of it) left. Then he came.", 2),
        ("He (who knew. And so he left. Then he came.", 3),
        ("We need:\n1. Salt. It is white.\n 1.1. Fine salt.\n 1.2. Coarse salt.\n2. Rope.", 5),
        ("a) Salt is white.\nb) Rope is brown.", 2),
        ("In the year\n1874. Then he left.", 2),
        ("One line\nbroken here. Two\n\nThree without an end", 3),
        ("A cut se", 1),
        ("", 0),
        (" \n\n ", 0),
    ],
)
def test_sentences(text, want):
    assert len(parts(text)) == want, parts(text)
    assert all(p == p.strip() for p in parts(text))


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "Ab bc. Cd de.", "x"), (1, "Ab bc. Cd de.", "x"), (2, None, "x"), (3, " ", "y")], "doc_id long, text string, k string")
    assert sorted(tuple(r) for r in split_sentences(df, "doc_id", "text").collect()) == [(1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13)]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0
    long = "Word and word. " * 20_000
    assert len(sentence_spans(long)) == 20_000


CLEAN = ["L’été à Noël, « où êtes-vous ? » demanda Cécilde.", "“It’s late,” she said — twice.", "Ça coûte 5 € près du château.", "ÂMES ET CHÂTEAUX à l’épreuve", "São Brás, A NAÇÃO."] * 20


@pytest.fixture(scope="module")
def model():
    return E.train(CLEAN)


@pytest.mark.parametrize("chain", [c for c in E.CHAINS if c[0] in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")])
def test_encoding_round_trip(model, chain):
    for text in CLEAN[:4]:
        fixed = E.repair(E.garble(text, chain), model)
        assert fixed is not None and fixed[0] == text, (chain, fixed)


def test_encoding_part_and_lost(model):
    half = CLEAN[0] + " " + E.garble("Cécilde a lancé la flûte.", ("cp1252",))
    assert E.repair(half, model)[0] == CLEAN[0] + " Cécilde a lancé la flûte."
    assert all(E.repair(t, model) is None for t in CLEAN)
    assert E.repair("d�chir� en deux", model)[0] is None
    assert E.repair("a cut off tex�", model) is None
    assert E.repair(None, model) is None and E.repair("", model) is None and E.repair("plain", model) is None


def test_encoding_of_rare_characters_and_loss(model):
    assert E.repair("a\u2003" + E.garble("b\u2003c é", ("cp1252",)), model)[0] == "a\u2003b\u2003c é"
    text = E.lose("Ça coûte 5 € près du château.")
    assert "\ufffd" in text and E.repair(text, model)[:4] == (None, "lost", 0, text.count("\ufffd"))
    mixed = text + " " + E.garble("Cécilde", ("cp1252",))
    fixed = E.repair(mixed, model)
    assert fixed[0] == text + " Cécilde" and fixed[3] == text.count("\ufffd")


def test_encoding_training_reaches_the_driver_as_sums(spark):
    """Same model however the rows are spread, whole texts, repeated rows counted once."""
    rows = [(i, "x" * 5000 + CLEAN[i % 5] + str(i)) for i in range(300)] + [(1, "x" * 5000 + CLEAN[1] + "1")] * 50 + [(None, None), (7, ""), (8, "plain")]
    df = spark.createDataFrame(rows, "k long, t string")
    few, many = (E.fit_chains(df.repartition(n), "k", "t", rows=10_000) for n in (1, 64))
    assert np.allclose(few.log_p, many.log_p) and few.known == many.known
    assert E.repair(E.garble(CLEAN[0], ("cp1252",)), many)[0] == CLEAN[0]
    small = E.fit_chains(df.repartition(64), "k", "t", rows=20)
    assert E.repair(E.garble(CLEAN[0], ("cp1252",)), small)[0] == CLEAN[0]
    assert E.repair("été", E.fit_chains(df.limit(0), "k", "t")) is None


def test_held_out_accuracy(model):
    """Chains of runs that the training never saw are predicted and inverted."""
    rng = random.Random(4)
    letters = "éèêàâçôûîïëüœ’“”«»—"
    right = total = 0
    for chain in (("cp1252",), ("cp1251",), ("mac_roman",), ("cp437",), ("cp1252", "cp1252")):
        for _ in range(100):
            word = "".join(rng.choice("abcde") + rng.choice(letters) for _ in range(3))
            fixed = E.repair(E.garble(word, chain), model)
            total += 1
            right += bool(fixed) and fixed[0] == word
    assert right / total > 0.97


@pytest.mark.parametrize(
    "odd, plain",
    [
        ("ｖｅｒｔｅ", "verte"), ("été", "été"), ("a b c", "a b c"), ("ﬁn", "fin"), ("Chapter Ⅷ", "Chapter VIII"),
        ("be​hind﻿", "behind"), ("op­en", "open"), ("hοrlοge", "horloge"), ("CНAPITRЕ", "CHAPITRE"), ("ХІV.", "XIV."), ("a\r\nb", "a\nb"),
    ],
)
def test_visual_forms(odd, plain):
    assert V.normalize(odd) == plain
    assert V.normalize(plain) == plain


@pytest.mark.parametrize("text", ["“It’s” — 'so' «là»", "Ночь тиха", "λόγος", "naïve cœur, n° 5", "漢字、かな", "हिन्दी", "", None])
def test_visual_keeps(text):
    assert V.normalize(text) == text


def test_visual_composition():
    """Letters with marks in any order, composed or not, come out as the composed form does."""
    import unicodedata as ud

    rng = random.Random(1)
    bases, marks = "aeiouAEOcnsyzαωеиÅéḍệ각가", "\u0327\u0323\u0331\u0301\u0300\u0308\u030a\u0302\u0304"
    for _ in range(3000):
        word = "".join(rng.choice(bases) + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 1, 2, 3]))) for _ in range(3))
        assert "".join(map(V._rewrite_cluster, V._CLUSTER.findall(word))) == ud.normalize("NFC", word), word
    assert V.normalize(ud.normalize("NFD", "한글 Việt Nam ǖ")) == "한글 Việt Nam ǖ"
    for odd, plain in (("ɡrand", "grand"), ("hօrloge", "horloge"), ("ᏢARIS", "PARIS")):
        assert V.normalize(odd) == plain
    for text in ("Հայերեն", "ᏣᎳᎩ", "👩\u200d👩\u200d👧"):
        assert V.normalize(text) == text


def test_visual_table(spark, model):
    rows = [(1, "ab​c", None), (2, "　​", "XI."), (3, E.garble("été là", ("cp1252",)), "ＸＩ"), (4, "plain", "")]
    df = spark.createDataFrame(rows, "chapter_id long, text string, heading string")
    got = {(r["chapter_id"], r["field"]): r["affected"] for r in V.normalize_fields(df, "chapter_id", ["text", "heading"], model).collect()}
    assert got == {(1, "text"): True, (2, "text"): False, (2, "heading"): False, (3, "text"): False, (3, "heading"): True, (4, "text"): False, (4, "heading"): False}


def check_pieces(text, size, overlap):
    got = S.pieces(text, size, overlap)
    words = [m.span() for m in S._WORD.finditer(text)]
    covered = set()
    for k, (a, b, n, o, _) in enumerate(got):
        inside = [i for i, (x, y) in enumerate(words) if a <= x and y <= b]
        assert len(inside) == n <= size and words[inside[0]][0] == a and words[inside[-1]][1] == b
        if k:
            assert len(set(inside) & before) == o == overlap
        before = set(inside)
        covered |= before
    assert covered == set(range(len(words)))
    return got


def test_splitting():
    rng = random.Random(2)
    for n in (1, 5, 40, 41, 100, 777):
        text = ""
        for i in range(n):
            text += ("w%d" % i) + rng.choice([" ", " ", " ", ", ", ". W ", "\n\n", " ", "​ "])
        for size, overlap in ((40, 5), (40, 0), (10, 9), (2, 1), (1, 0)):
            check_pieces(text, size, overlap)
    prose = ("The cat sat on the mat and slept. " * 3 + "\n\n") * 40
    kinds = {k for *_, k in check_pieces(prose, 100, 10)}
    assert kinds <= {"sentence", "paragraph"}
    assert S.pieces(None, 5, 1) == [] and S.pieces(" \n", 5, 1) == []
    for size, overlap in ((5, 5), (5, 9), (5, -1), (0, 0)):
        with pytest.raises(ValueError):
            S.pieces("a b c", size, overlap)
    assert len(S.pieces("a b c​d", 3, 0)) == 1


def brute_repeated(words):
    seen, inside = set(), [False] * len(words)
    for i in range(len(words) - 7):
        gram = tuple(words[i : i + 8])
        if gram in seen:
            inside[i : i + 8] = [True] * 8
        seen.add(gram)
    return sum(inside)


def test_repetition_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["", None, "one two", "a b c d e f g h " * 5, "né É x_y é कि हिन्दी " * 9]
    for _ in range(60):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))]
        texts.append(" ".join(base * rng.randint(1, 3)))
    ids = R._Ids()
    got = R.measure(pa.array([[ids[w] for w in R.words_of(t or "")] for t in texts], pa.list_(pa.int32())))
    for t, (n, repeated, *_) in zip(texts, got):
        words = R.words_of(t or "")
        assert (n, repeated) == (len(words), brute_repeated(words))
    assert R.words_of("Né_É éx 4½ कि") == ["né", "é", "éx", "4½", "कि"]


def test_repetition_table(spark):
    rng = random.Random(6)
    sentence = lambda: " ".join(rng.choice(["sun", "moon", "sea", "tree", "rock", "wind", "fox", "owl"]) + str(rng.randint(0, 9)) for _ in range(12)) + "."
    rows = [("documents", i, "en", " ".join(sentence() for _ in range(6))) for i in range(60)]
    loop = " ".join([sentence()] * 6)
    rows += [("documents", 100, "en", loop), ("documents", 100, "en", loop), ("documents", 101, "en", None), ("documents", 102, "fr", "")]
    df = spark.createDataFrame(rows, "src string, rec_id long, lang string, t string")
    got = {(r["rec_id"]): r for r in R.repetition(df).collect()}
    assert got[100]["verdict"] == "repetitive" and got[100]["share"] == pytest.approx(5 / 6)
    assert all(got[i]["verdict"] != "repetitive" for i in range(60))
    assert got[101]["n_words"] == 0 and got[101]["share"] is None and got[102]["verdict"] == "ok"
    assert R.repetition(df.limit(0)).count() == 0
    # prices too many to be broadcast are joined, with the same figures
    joined = R.repetition(df, local_grams=0).collect()
    assert len(joined) == df.count()
    for r in joined:
        for c in ("n_words", "repeated", "share", "perplexity", "own_perplexity", "lower_band", "verdict"):
            assert r[c] == (pytest.approx(got[r["rec_id"]][c], rel=1e-4) if isinstance(r[c], float) else got[r["rec_id"]][c]), (r, c)


def test_repetition_band_misses_no_heavy_text(spark):
    """Texts at and around the share of 0.3, with common and rare phrases: all heavy ones lie under the lower band."""
    rng = random.Random(12)
    stock = ["the of and to in a is was it", "buy the best red lamp in town for less than ten coins today"]
    rows = []
    for i in range(400):
        fresh = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))  # noqa: B023, E731
        phrase = rng.choice(stock) if i % 2 else fresh(rng.randint(8, 14))
        rows.append(("d", i, "en", " ".join([fresh(rng.randint(0, 16)), phrase, fresh(rng.randint(0, 6)), phrase, fresh(rng.randint(0, 16))])))
    got = R.repetition(spark.createDataFrame(rows, "src string, rec_id long, lang string, t string")).collect()
    heavy = [r for r in got if r["repeated"] >= R.HEAVY * r["n_words"]]
    assert 50 < len(heavy) < 350
    assert all(r["own_perplexity"] <= r["lower_band"] and r["verdict"] == "repetitive" for r in heavy)


def test_repetition_of_a_phrase_common_in_the_corpus(spark, tmp_path):
    """A third of all rows repeat a phrase that the others hold once: the corpus model foresees it, and the median falls."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(rng.choice(["sun", "moon", "sea", "tree", "rock", "wind"]) + str(rng.randint(0, 30)) for _ in range(n))
    phrase = "buy the best red lamp in town for less than ten coins today"
    texts = [f"{fresh(8)} {phrase}" for _ in range(80)] + [f"{fresh(8)} {phrase} {phrase} {fresh(8)}" for _ in range(40)]
    docs = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    none = spark.createDataFrame([(1, None), (2, "")], "cand_id long, translated_text string").selectExpr("*", "'m' as model", "'b' as slug")
    spark.createDataFrame([("b", "en_to_fr")], "slug string, direction string").write.parquet(f"{tmp_path}/books.parquet")
    none.write.parquet(f"{tmp_path}/candidates.parquet")
    heavy = {i for i, t in enumerate(texts) if brute_repeated(R.words_of(t)) >= R.HEAVY * len(R.words_of(t))}
    assert heavy == set(range(80, 120))
    assert {tuple(r) for r in R.p5_found(spark, str(tmp_path)).collect()} == {("documents", i) for i in heavy}
    assert {r["rec_id"] for r in R.p5_repetition(spark, str(tmp_path)).where("verdict = 'repetitive'").collect()} >= heavy


def test_kneser_ney_is_a_distribution(spark):
    """Over the vocabulary, the probabilities after a known history sum to one."""
    import numpy as np

    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcde") for _ in range(30)) for _ in range(200)]
    rows = spark.createDataFrame([("d", i, "en", t) for i, t in enumerate(texts)], "src string, rec_id long, lang string, t string")
    m = R.fit_ngrams(R.encode(rows))
    ids = R._Ids()
    vocab = np.array([ids[w] for w in "abcde"], dtype=np.uint64)
    w1, w2 = np.full(5, ids["a"], np.uint64), np.full(5, ids["b"], np.uint64)
    assert np.exp(m.log_prob(w1, w2, vocab)).sum() == pytest.approx(1.0, abs=0.02)


def test_truncation(spark):
    rng = random.Random(8)
    subjects, verbs, things = ["Orlo", "Zelie", "Dr. Oak"], ["found", "lost", "sold"], ["the box", "a key", "the old hat", "a coin"]
    sentence = lambda: f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)} in the {rng.choice(['barn', 'mill', 'port'])}."
    whole = ["\n\n".join(" ".join(sentence() for _ in range(3)) for _ in range(3)) for _ in range(200)]
    ended = [t + "\n\nTHE END" for t in whole[:20]]
    cut = [t[: len(t) - rng.randint(3, 9)].rstrip(" .") + rng.choice(["", "...", "…", " ...", "�"]) for t in whole[:30]]
    rows = [("d", i, "en", None, t, None, False) for i, t in enumerate(whole)]
    rows += [("d", 1000 + i, "en", None, t, None, False) for i, t in enumerate(ended)]
    rows += [("d", 2000 + i, "en", None, t, None, False) for i, t in enumerate(cut)]
    rows += [("d", 3000, "en", None, whole[0], 99, False), ("d", 3001, "en", None, None, 9, False), ("d", 3002, "en", None, "​ ", 9, False), ("d", 3003, "en", None, cut[0], None, True)]
    df = spark.createDataFrame(rows, "src string, rec_id long, lang string, grp string, t string, words int, garble boolean")
    got = {r["rec_id"]: r["truncated"] for r in T.detect_truncation(df).collect()}
    assert not any(got[i] for i in range(200))
    assert not any(got[1000 + i] for i in range(20))
    assert sum(got[2000 + i] for i in range(30)) >= 29
    assert got[3000] and not got[3001] and not got[3002] and not got[3003]
    assert T.detect_truncation(df.limit(0)).count() == 0
    # a table too large to be broadcast is joined, with the same odds
    joined = T.detect_truncation(df, T.fit_ends(df, local_rows=0)).collect()
    local = {r["rec_id"]: r["log_odds"] for r in T.detect_truncation(df, T.fit_ends(df)).collect()}
    assert all(r["log_odds"] == pytest.approx(local[r["rec_id"]]) for r in joined if r["log_odds"] is not None)
    # ten copies of the corpus teach the same: texts with the same end count once
    tenfold = T.fit_ends(df.crossJoin(spark.range(10).select()))
    assert {r["rec_id"] for r in T.detect_truncation(df, tenfold).where("truncated").collect()} == {i for i in got if got[i]}


def test_tails():
    assert T.tail("a b... […] \n…\ufffd ") == "a b" and T.tail("...") == "" and T.tail("") == "" and T.tail("x [...]") == "x"
    assert T.tail("end" + " \n" * 500) == "end"
    assert T._final("ab" + " " * 300 + "\n\n" + " " * 300 + "c", 604)[-3:] == " \x01c" or T._final("ab" + " " * 300 + "\n\n" + " " * 300 + "c", 604).endswith("\x01c")


def test_truncation_of_most_values_of_a_language(spark):
    rng = random.Random(10)
    subjects, verbs, things = ["Orlo", "Zelie", "Anna"], ["found", "lost", "sold"], ["the box", "a key", "the old hat", "a coin"]
    sentence = lambda: f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)} in the {rng.choice(['barn', 'mill', 'port'])}."
    whole = ["\n\n".join(" ".join(sentence() for _ in range(3)) for _ in range(3)) for _ in range(340)]
    cut = [t[: len(t) - rng.randint(3, 9)].rstrip(" .") for t in whole[:80]]
    rows = [("d", i, "en", None, t, None, False) for i, t in enumerate(whole[:300])]
    rows += [("d", 1000 + i, "ru", None, t, None, False) for i, t in enumerate(whole[300:])]
    rows += [("d", 2000 + i, "ru", "salt", t, None, False) for i, t in enumerate(cut)]
    rows += [("d", 3000 + i, "hi", "salt", t, None, False) for i, t in enumerate(cut[:20])]  # no sound value at all
    df = spark.createDataFrame(rows, "src string, rec_id long, lang string, grp string, t string, words int, garble boolean")
    got = {r["rec_id"] for r in T.detect_truncation(df).where("truncated").collect()}
    assert not any(i < 2000 for i in got)
    assert sum(2000 + i in got for i in range(80)) >= 76 and sum(3000 + i in got for i in range(20)) >= 19


def test_language_of_candidates(spark, tmp_path):
    spark.createDataFrame([("b", "en_to_fr"), ("c", "fr_to_en")], "slug string, direction string").write.parquet(f"{tmp_path}/books.parquet")
    rows = [(1, "b", "m", "t"), (2, "c", "m", "t"), (3, "x", "m", "t"), (4, None, "m", None)]
    spark.createDataFrame(rows, "cand_id long, slug string, model string, translated_text string").write.parquet(f"{tmp_path}/candidates.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["rec_id"]: r["lang"] for r in R.p5_repetition(spark, str(tmp_path)).collect()} == {1: "fr", 2: "en", 3: "und", 4: "und"}


def test_closed_ends():
    assert T.is_closed("He left.") and T.is_closed("« Quoi ? »") and T.is_closed("了。”")
    assert not T.is_closed("said Dr.") and not T.is_closed("J. R.") and not T.is_closed("the") and not T.is_closed("Wait...")
