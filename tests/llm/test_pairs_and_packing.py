"""Alignment, defects, packing and mixing on small fixtures."""

import random
import time
from collections import Counter

import numpy as np
import pytest

from fabulon.llm import alignment as A
from fabulon.llm import defects as D
from fabulon.llm import encoding as E
from fabulon.llm import mixing as M
from fabulon.llm import packing as P
from fabulon.llm.languages import fit_languages
from fabulon.llm.truncation import fit_ends

WORDS = [("box", "boîte"), ("key", "clé"), ("hat", "chapeau"), ("coin", "pièce"), ("boat", "bateau"), ("lamp", "lampe"), ("rope", "corde"), ("bell", "cloche")]
VERBS = [("found", "trouva"), ("lost", "perdit"), ("sold", "vendit"), ("hid", "cacha"), ("broke", "cassa")]
PLACES = [("in the mill", "dans le moulin"), ("on the quay", "sur le quai"), ("near the wall", "contre le mur"), ("by the fire", "au coin du feu")]
NAMES = ["Orlo", "Zelie", "Fenna", "Odran", "Ilva"]


def bilingual(rng, n):
    """(sentences in French, in English, true links): swaps, omissions and merges."""
    fr, en, links = [], [], []
    for _ in range(n):
        name, (w, f), (v, g), (p, q) = rng.choice(NAMES), rng.choice(WORDS), rng.choice(VERBS), rng.choice(PLACES)
        fr.append(f"{name} {g} la {f} {q}.")
        en.append(f"{name} {v} the {w} {p}.")
        links.append((len(fr) - 1, len(en) - 1))
    if n > 4:
        k = rng.randrange(n - 1)
        en[k], en[k + 1] = en[k + 1], en[k]
        links = [(a, k + 1 if b == k else k if b == k + 1 else b) for a, b in links]
        drop = rng.randrange(n)
        en.pop(drop)
        links = [(a, b - (b > drop)) for a, b in links if b != drop]
        m = rng.randrange(len(en) - 1)
        en[m : m + 2] = [en[m][:-1] + "; " + en[m + 1]]
        links = [(a, b - (b > m)) for a, b in links]
    return fr, en, links


def test_alignment(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for i in range(150):
        fr, en, links = bilingual(rng, rng.randint(3, 14))
        sa = np.cumsum([0] + [len(s) + 1 for s in fr])
        sb = np.cumsum([0] + [len(s) + 1 for s in en])
        flip = i % 2
        a, b = (" ".join(en), " ".join(fr)) if flip else (" ".join(fr), " ".join(en))
        rows.append(("chapters", i, 1000 + i, "en" if flip else "fr", "fr" if flip else "en", a, b))
        want |= {(i, int(sb[y]), int(sa[x])) if flip else (i, int(sa[x]), int(sb[y])) for x, y in links}
    rows += [("chapters", 900, 901, "fr", "en", None, "x."), ("chapters", 902, 903, "fr", "en", "", " ")]
    df = spark.createDataFrame(rows, "src string, key_a long, key_b long, lang_a string, lang_b string, text_a string, text_b string")
    docs = A.sentence_pairs(df, None).cache()
    got = {(r["key_a"], r["start_a"], r["start_b"]) for r in A.align(docs, A.fit_table(docs)).collect()}
    hit = len(got & want)
    assert hit / len(want) > 0.93 and hit / len(got) > 0.93, (hit, len(want), len(got))
    # a table too large to be broadcast is joined, with the same links
    joined = A.align(docs, A.fit_table(docs, rounds=1, local_pairs=0)).collect()
    local = A.align(docs, A.fit_table(docs, rounds=1)).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, local))


def test_alignment_offsets_of_odd_texts():
    text = "Il vit Capt​. Oak. Puis Éva partit."
    clean, places = A._clean(text, None)
    assert clean == text.replace("​", "") and text[places[clean.index("Puis")]] == "P"
    starts, words = A._tokens(text, None, A._Ids())
    assert [text[s:][:4] for s in starts] == ["Il v", "Puis"]


def test_edges(spark):
    chapters = spark.createDataFrame([(1, "fr_original", "Un deux trois quatre cinq six sept. Huit neuf dix onze douze treize quatorze. Fin du texte de ce jour ici."), (1, "en_human", None)], "run_id long, version string, text string")
    div = spark.createDataFrame([(5, 1, "fr_original", "en_human", "Huit neuf dix onze douze treize quatorze. Fin du texte", "")], "div_id long, run_id long, version_a string, version_b string, excerpt_a string, excerpt_b string")
    assert [tuple(r) for r in A.whole_edges(div, chapters).collect()] == [(5, "a", "S")]


LABELLED = {
    "en": "The cat was there, for it had been found by the children. Who lost the key, and why? He left the house with them and came back to it later that day.",
    "fr": "Le chat était là, car il avait été trouvé par les enfants. Qui perdit la clé, et pourquoi ? Il laissa la maison avec eux et y revint plus tard ce jour-là. C'est lui qui trouva la voiture.",
    "ES-mx": "El perro de la casa está en el patio con los niños. ¿Quién perdió la llave y por qué? Salió de la casa con ellos y volvió más tarde aquel día.",
    "ru": "Кошка была там, потому что дети нашли её в доме. Кто потерял ключ и почему? Он вышел из дома вместе с ними.",
    "zz top": None,
}


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(lang, t) for lang, t in LABELLED.items()] * 3 + [(None, "x"), ("", "y")]
    return fit_languages(spark.createDataFrame(rows, "lang string, t string"))


def test_languages(spark, languages):
    assert languages.names == ["en", "es", "fr", "ru"]
    assert languages.of("They found the house and the children there.") == "en"
    assert languages.of("Ils trouvèrent la maison et les enfants.") == "fr"
    assert languages.of("") is None and languages.of("12 !") is None
    assert fit_languages(spark.createDataFrame([], "lang string, t string")).of("The cat") is None


# phrasings written for this test, in none of the tables
REFUSALS = [
    "I cannot help you with that.", "I'm unable to do that.", "Unfortunately I can't assist with this request.", "I must respectfully decline to continue.",
    "I won’t be translating this passage.", "My guidelines don't permit this.", "No puedo ayudarte con eso.", "Lo siento, pero no puedo traducir este texto.",
    "Ich kann Ihnen dabei leider nicht helfen.", "Es tut mir leid, aber ich kann diesen Text nicht übersetzen.", "Извините, я не могу перевести этот текст.",
    "Я не могу вам с этим помочь.", "抱歉，我无法帮助您完成这个请求。", "申し訳ありませんが、このリクエストにはお応えできません。", "क्षमा करें, मैं इस पाठ का अनुवाद नहीं कर सकता।",
    "ขออภัย ฉันไม่สามารถแปลข้อความนี้ได้", "Je ne peux malheureusement pas vous aider.", "Orlo left.\n\n[Malheureusement, je ne peux pas traduire ce texte.]",
]
STORIES = [
    "“I cannot help you with that,” said Orlo.", "« Je ne peux pas vous aider en cela », dit Cécilde.", "He could not help her.", "— Je ne peux pas vous aider, dit-il.",
    "„Ich kann Ihnen nicht helfen“, sagte Odran.", "Er konnte nicht helfen.", "Он не мог помочь.", "Orlo left the boat and I cannot help you with that and the wind fell.", "他无法帮助她。", "",
]


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(text):
    assert D.is_refusal(text)


@pytest.mark.parametrize("text", STORIES)
def test_no_refusals(text):
    assert not D.is_refusal(text)


def test_open_ends():
    for text in ("He said (and then the", "“I will go to the", "- one is here.\n- two is here.\n- thr", "1. Salt.\n2. ", "```\nx = 1", "<b>bold", "see [the"):
        assert D.ends_open(text, 9.0, 0.0), text
    for text in ("He said (and then) left.", "“I will go.” He left.", "- one\n- two\n- three", "- one.\n- two.\n- three.", "1. Salt.\n2. Rope.\n\nThat is all", "“Go,” he said. “Now.", "```\nx\n```"):
        assert not D.ends_open(text, 9.0, 0.0), text


@pytest.fixture(scope="module")
def judged(spark, languages):
    good = "Orlo found the hat in the mill. “Who is there?” asked Fenna."
    talk = [
        ("Translate the passage into French:\n\nOrlo found the hat in the mill. He left the box there.", "Orlo trouva le chapeau dans le moulin. Il laissa la boîte là.", None),
        ("Translate the passage into French:\n\n" + good, "Voici la traduction :\n\nOrlo trouva le chapeau dans le moulin.", None),
        ("Translate the passage into French:\n\n" + good, good, "copy"),
        ("Translate the passage into French:\n\n" + good, "Here is the translation:\n\n" + good.lower(), "copy"),
        ("Repeat the following sentence word for word:\n" + good, good, None),
        ("Who found the hat, and why?", "It was Orlo who found the hat, for he was there.", None),
        ("Who found the hat, and why?", "C'est Orlo qui trouva le chapeau, car il était là.", "language"),
        ("Who found the hat, and why?", "Орло нашёл шляпу в саду.", "language"),
        ("Who found the hat, and why?", "It was Orlo who found the", "truncated"),
        ("Who found the hat, and why?", "It was Orlo who fou...", "truncated"),
        ("Write code.", "Here:\n```python\nprint(1)", "truncated"),
        ("Who found the hat, and why?", "I'm sorry, but I can't help with this request.", "refusal"),
        ("Traduisez ce passage en anglais :\n\nOrlo partit.", "Orlo left.\n\n[Malheureusement, je ne peux pas traduire ce texte.]", "refusal"),
        ("Continue the scene:\n\n" + good, "“I cannot help you with that,” said Orlo. The fox was in the barn.", None),
        ("Who found the hat, and why?", " ​", "empty"),
        ("Who found the hat, and why?", None, "empty"),
        (None, "It was Orlo who found the hat.", None),
    ]
    rows = [("conversations", i, a, q, None, None) for i, (q, a, _) in enumerate(talk)]
    chapters = [(good, "Orlo trouva le chapeau dans le moulin.", "fr", 7, None), (good, "Orlo trouva le chapeau dans le moulin.", "fr", 70, "truncated"), (good, good, "fr", None, "copy"), (good, "El perro de la casa está en el jardín con los otros.", "fr", None, "language")]
    rows += [("chapters", i, a, q, lang, n) for i, (q, a, lang, n, _) in enumerate(chapters)]
    df = spark.createDataFrame(rows, "src string, rec_id long, answer string, prompt string, lang string, words int")
    corpus = [(" ".join(f"{n} {v} the {w} {p}." for n, (w, _), (v, _), (p, _) in zip(NAMES, WORDS, VERBS, PLACES)) + "\n\nHe left.",)] * 3
    model = fit_ends(spark.createDataFrame(corpus + [(r[2],) for r in rows], "t string"))
    got = {(r["src"], r["rec_id"]): r["defect"] for r in D.flag_defects(df, model, E.train(["été, là, “so”"]), languages).collect()}
    want = {("conversations", i): d for i, (_, _, d) in enumerate(talk) if d} | {("chapters", i): d for i, (*_, d) in enumerate(chapters) if d}
    return got, want


def test_defects(judged):
    got, want = judged
    assert got == want


def test_answer_pairs(spark):
    conv = spark.createDataFrame([(1, 1, 0, "user", "q"), (2, 1, 1, "assistant", "a"), (3, 1, 1, "assistant", "a"), (4, 1, 0, "user", "other"), (5, 2, 5, "assistant", None), (6, None, 1, "assistant", "b")],
                                 "msg_id long, conv_id long, turn long, role string, text string")
    chap = spark.createDataFrame([(1, 1, 1, "fr_original", "o", "fr", 1), (2, 1, 1, "en_llm_bon5", "x", "en", 1), (3, 1, 2, "en_llm", "y", "en", None)],
                                 "chapter_id long, run_id long, number int, version string, text string, lang string, word_count int")
    got = sorted((r["src"], r["rec_id"], r["prompt"]) for r in D.answer_pairs(conv, chap).collect())
    assert got == [("chapters", 2, "o"), ("chapters", 3, None), ("conversations", 2, "q"), ("conversations", 3, "q"), ("conversations", 5, None), ("conversations", 6, None)]


def brute_tiles(a, b, least):
    """Greedy string tiling as first described: longest free match again and again."""
    ma, mb, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return covered
        for x in range(k):
            ma[i + x] = mb[j + x] = True
        covered += k


def test_tiling_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 30))]
        b = a[:]
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = "zz"
        rotate = rng.randrange(len(b))
        b = b[rotate:] + b[:rotate]
        assert abs(D.tiled(a, b) - brute_tiles(a, b, D.TILE)) <= 0.2 * len(a)
    assert D.tiled([], ["a"]) == 0 and D.tiled(["a"], ["a"]) == 1


def test_tiling_of_repeated_text():
    """Texts that repeat themselves cost no more than others of their length."""
    began = time.process_time()
    assert D.tiled("ab" * 10_000, "ba" * 10_000, 0.5, 6) == 19_999
    assert D.tiled(["x"] * 20_000, ["x"] * 10_000) == 10_000
    assert time.process_time() - began < 5


def test_packing_shard():
    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(0, 700, 3000), rng.integers(500, 9000, 60), [0, 512, 2048, 2049]])
    rows = P.pack_shard(np.sort(sizes)[::-1], [512, 2048])
    used = Counter()
    for item, piece, start, n, t, box in rows:
        used[t, box] += n
    assert all(v <= (512, 2048)[t] for (t, _), v in used.items())
    assert sum(r[3] for r in rows) == sizes.sum()
    room = sum((512, 2048)[t] for t, _ in used)
    assert sizes.sum() / room > 0.99
    split = Counter(r[0] for r in rows)
    ordered = np.sort(sizes)[::-1]
    assert all((n > 1) == (ordered[i] > 2048) for i, n in split.items())


def test_packing_table(spark):
    rows = [(i, i % 600) for i in range(500)] + [(1000, 5000), (1001, None), (7, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    got = P.pack(df, "doc_id", [("pack", 2048), ("pack_small", 512)], shard_items=100).toPandas()
    used = got.groupby(["container_id"]).agg(n=("n_tokens", "sum"), c=("capacity", "first"), tiers=("tier", "nunique"), groups=("step_group", "nunique"))
    assert (used.n <= used.c).all() and (used.tiers == 1).all() and (used.groups == 1).all()
    assert got.n_tokens.sum() == sum(n or 0 for _, n in rows)
    assert got[got.doc_id == 1000].token_start.tolist() is not None and len(got[got.doc_id == 1000]) == 3
    assert P.pack(df.limit(0), "doc_id", [("pack", 2048)]).count() == 0
    tiers = [(f"pack{i}", 50 * i + 50) for i in range(12)]
    many = P.pack(df, "doc_id", tiers, shard_items=100).groupBy("container_id").agg({"tier": "min", "capacity": "max", "n_tokens": "sum"}).toPandas()
    assert (many["sum(n_tokens)"] <= many["max(capacity)"]).all()
    hot = P.pack(spark.range(1000).selectExpr("cast(5 as long) as doc_id", "10 as n_tokens"), "doc_id", [("pack", 100)], shard_items=100)
    assert hot.count() == 1000 and hot.selectExpr("container_id div 4294967296 as s").distinct().count() > 5


def test_quotas():
    counts = np.array([1000, 10, 333, 0, 57])
    for shards in (1, 2, 7, 64):
        q = M.split_quotas(counts, shards)
        assert (q.sum(axis=0) == counts).all() and (q >= 0).all()
        assert q.sum(axis=1).max() - q.sum(axis=1).min() <= max(2, np.log2(shards) + 1)
    assert (M.split_quotas(counts, 7) == M.split_quotas(counts, 7)).all()


def test_shards_of_ranks(spark):
    """Executors draw the same tree as the driver, and every rank gets one shard."""
    counts = [400, 3, 0, 77]
    for shards in (1, 5, 150):
        got = M.shard_ranks(spark, list("abcd"), counts, shards).toPandas()
        assert got.groupby("source")["rank"].apply(sorted).to_dict() == {n: list(range(k)) for n, k in zip("abcd", counts) if k}
        want = M.split_quotas(np.array(counts), shards)
        assert all(((got.source == n) & (got.shard == s)).sum() == want[s, k] for k, n in enumerate("abcd") for s in range(shards))
    assert M.shard_ranks(spark, [], [], 1).count() == 0


def test_running_totals(spark):
    df = spark.createDataFrame([("s", i // 4, i, i * i) for i in range(20)] + [("t", 0, 0, 7)], "source string, bucket int, block int, v long")
    got = {(r["source"], r["block"]): r["before"] for r in M.running(df, "source", "bucket", ["block"], "v", "before").collect()}
    assert got == {("s", i): sum(k * k for k in range(i)) for i in range(20)} | {("t", 0): 0}


def test_mixing(spark):
    rng = random.Random(1)
    docs = [(i, "big", rng.randint(1, 50)) for i in range(4000)] + [(10_000 + i, "small", rng.randint(1, 50)) for i in range(100)]
    docs += [(20_000, None, 5), (20_001, "untargeted", 5), (20_002, "big", 0), (20_003, "small", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens int")
    goal = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = M.mix(df, goal, block_docs=50, shard_docs=300).toPandas()
    tokens = got.groupby("source").n_tokens.sum()
    assert set(tokens.index) == {"big", "small"}
    assert tokens["small"] / tokens.sum() == pytest.approx(1 / 3, abs=0.005)
    uses = got.groupby(["source", "doc_id"]).size()
    assert uses["small"].max() == 3 and uses["small"].min() >= 2 and uses["big"].max() == 1
    assert got.groupby(["doc_id", "pass_no"]).size().max() == 1
    assert got.groupby("shard").position.agg(lambda p: sorted(p) == list(range(len(p)))).all()
    assert got.shard.nunique() > 2
    assert M.mix(df.limit(0), goal).count() == 0 and M.mix(df, goal.limit(0)).count() == 0
    half = M.mix(df, goal, total_tokens=3000.0, block_docs=50).toPandas()
    assert half.n_tokens.sum() == pytest.approx(3000, abs=60)
