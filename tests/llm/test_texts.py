"""Problems 7 and 9 against brute force, with the awkward cases."""

import random

import numpy as np
import pytest

from vitrine.llm.abuse import Scorer, abuse_scores, rates_by_source
from vitrine.llm.folding import sentences
from vitrine.llm.leakage import ItemSet, leaked, shard_matches, suffix_array, without_leaks, words_of
from vitrine.llm.lexicon import EXCEPTIONS, LEXICON

WORDS = [f"w{i}" for i in range(400)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 300):
        t = rng.integers(0, 4, n)
        want = sorted(range(n), key=lambda i: t[i:].tolist())
        assert suffix_array(t, n + 1).tolist() == want


def test_words():
    assert words_of("<b>Two‑tone</b> &amp; Soft​ly, re-used!") == ["two", "tone", "softly", "re", "used"]


def brute(docs, items, seed=4, gap=2, passage=8, least=0.4):
    out = set()
    for i, d in docs:
        a = words_of(d or "")
        for k, t in items:
            b = words_of(t or "")
            if not b:
                continue
            covered = set()
            for diagonal in range(-len(b), len(a)):
                run = []
                same = [j for j in range(len(b)) if 0 <= j + diagonal < len(a) and a[j + diagonal] == b[j]]
                pieces, cur = [], []
                for j in same:
                    if cur and j != cur[-1] + 1:
                        pieces.append(cur)
                        cur = []
                    cur.append(j)
                pieces.append(cur)
                pieces = [p for p in pieces if len(p) >= min(seed, len(b))]
                for p in pieces:
                    if run and p[0] - run[-1] - 1 <= gap:
                        run = list(range(run[0], p[-1] + 1))
                    else:
                        if len(run) >= min(passage, len(b)):
                            covered |= set(run)
                        run = p
                if len(run) >= min(passage, len(b)):
                    covered |= set(run)
            if len(covered) >= least * len(b):
                out.add((i, k))
    return out


@pytest.mark.parametrize("shard_words,block_words", [(1_000_000, 200_000), (50, 60)])
def test_leaks_against_brute_force(spark, shard_words, block_words):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choices(WORDS, k=rng.randint(12, 40)))) for k in range(12)]
    docs = []
    for i in range(120):
        words = rng.choices(WORDS[:60], k=rng.randint(0, 80))
        for _, t in rng.sample(items, rng.randint(0, 2)):
            w = t.split()
            a, b = sorted(rng.sample(range(len(w) + 1), 2))
            part = [x if rng.random() > 0.08 else "changed" for x in w[a:b]]
            words[len(words) // 2 : len(words) // 2] = part
        docs.append((i, " ".join(words).upper().replace(" ", "  \n ")))
    d, e = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaked(d, e, shard_words=shard_words, block_words=block_words).collect()}
    want = brute(docs, items)
    assert want and got == want


def test_leak_edges(spark):
    text = " ".join(WORDS[:30])
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, text, "x"), (3, text, "x"), (None, text, "x"), (4, "pad " * 100_000 + text, "x"), (5, " ".join(WORDS[:9]), "x")], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(7, text), (7, "other words here now"), (8, None), (9, "too short"), (None, text)], "item_id long, text string")
    got = leaked(d, e)
    rows = sorted((r["doc_id"], r["item_id"], r["longest"], r["doc_word"]) for r in got.collect())
    assert rows == [(3, 7, 30, 0), (3, 7, 30, 0), (4, 7, 30, 100_000)]
    short = leaked(spark.createDataFrame([(1, "It is too, short!"), (2, "too long, short")], "doc_id long, text string"), e)
    assert [(r["doc_id"], r["item_id"], r["longest"]) for r in short.collect()] == [(1, 9, 2)]
    assert sorted(r["doc_id"] for r in without_leaks(d, got).collect() if r["doc_id"]) == [1, 2, 5]
    assert leaked(d.limit(0), e).count() == 0 and leaked(d, e.limit(0)).count() == 0


def test_leaks_in_a_rich_vocabulary_and_with_a_phrase_everywhere(spark):
    rng = random.Random(9)
    rich = [(k, " ".join(f"v{k * 500 + j}" for j in range(500))) for k in range(220)]
    items = rich + [(1000 + k, f"one of the best {' '.join(rng.choices(WORDS, k=14))}") for k in range(30)]
    docs = [(i, f"one of the best {' '.join(rng.choices(WORDS, k=10))} one of the best") for i in range(400)] + [(9000, "so " + rich[7][1]), (9001, items[-1][1])]
    got = leaked(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["longest"]) for r in got.collect()) == [(9000, 7, 500), (9001, 1029, 18)]


def test_places_in_parts_agree():
    rng = np.random.default_rng(3)
    test = ItemSet([(k, [f"w{x}" for x in rng.integers(0, 5, 30)]) for k in range(6)], 4)
    tokens = np.append(rng.integers(0, 6, 3000), 0)
    place, doc = np.arange(3001), np.zeros(3001, np.int64)
    whole = [np.concatenate(x) for x in zip(*shard_matches(tokens, place, doc, test, 2, 5))]
    parts = [np.concatenate(x) for x in zip(*shard_matches(tokens, place, doc, test, 2, 5, most=50))]
    assert len(whole[0]) and all((a == b).all() for a, b in zip(whole, parts))


@pytest.mark.parametrize(
    "text",
    ["Fuck you and your lamp.", "f u c k you", "You are a st*pid 1d10t, never touch a lamp again.", "Drop dеаd, all of you.", "drop d​ead", "Send n#des.", "Halt die Fresse!", "i-d-i-o-t, shut your mouth",
     "People of that faith are VERMIN!! and should be driven out of every shop.", "Hot s3x on camera, adults only, no taboo.", "ŤÍTS and B00BS"],
)
def test_abusive(spark, text):
    assert abuse_scores(spark.createDataFrame([(1, f"Nice lamp. {text} It works.", "a")], "doc_id long, text string, source string")).first()["n_hits"] >= 1


@pytest.mark.parametrize(
    "text",
    ["It is idiot-proof to assemble.", "I would kill for a second one.", "The nude shade of the lip salve is lovely.", "The rat trap works, the vermin problem is over.", "Dumb question: which way does it go?",
     "The dirty water runs off, no more filth.", "Sex: unisex, fits all.", "La bolsa de basura cabe bien.", "The pig-shaped money box and the bastard file arrived together."],
)
def test_harmless(spark, text):
    assert abuse_scores(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).first()["n_hits"] == 0


#: Sentences written after the lexicon, none of them from the test tables, to measure it on phrasings it wasn't made for.
ABUSIVE = [
    "You absolute morons can't even ship a box.",
    "What a bunch of lying crooks, I hope you rot.",
    "Go hang yourself, seller.",
    "That dumb bitch at the counter laughed at me.",
    "I'm going to kill you if this breaks again.",
"Whoever designed this handle is a complete idiot.",
    "Your customer service are useless clowns.",
    "This company is run by greedy pigs, you disgusting creeps.",
    "Eat shit and die.",
    "Refugees are parasites, throw them out.",
"Muslims are animals and should be deported.",
    "Those people are filth, exterminate them.",
    "Gays are a disease.",
    "Women are too stupid to use a drill.",
    "Jews are rats, get rid of them all.",
    "All foreigners are thieves and criminals.",
"Send me nudes and I'll give five stars.",
    "Watch me masturbate on webcam.",
    "She has huge boobs and wants it rough.",
    "Hot sluts near you, click here.",
    "Naked girls, adults only, uncensored porn.",
    "I will break your legs, you lying rat.",
"Du dummes Schwein, verpiss dich!",
    "Ihr seid alle Arschlöcher.",
    "Ausländer sind Abschaum, raus mit ihnen.",
    "Was für ein dummer Vollidiot.",
    "Halt's Maul, du Penner.",
    "Eres un cabrón y un inútil.",
    "Los inmigrantes son ratas, hay que echarlos.",
    "Chúpame la polla.",
"Sale connasse, casse-toi.",
    "Les étrangers sont de la racaille.",
    "T'es qu'un gros porc, ta gueule.",
    "Y0u 4re a st.u.p.i.d c*nt",
    "f u c k this shop",
    "You are all r3t4rd3d",
    "kіll yоurself",
    "What a pathetic loser you are.",
]
#: Harmless uses of the same words, likewise.
HARMLESS = [
    "My dog loves to lick the bowl clean.",
    "The pigs on the nursery print are adorable.",
    "It is stupid how good this pan is.",
    "The kettle died after a week and I was sick of waiting.",
    "Use it against rats, cockroaches and other vermin in your garage.",
"This mask kills bacteria and keeps your skin soft.",
    "The women's size runs small, the men's size is fine.",
    "A foolproof setup, even my grandmother managed.",
    "Dirty dishes pile up, so I bought two racks for you.",
    "The colour is an ugly green but you get used to it.",
"Beat the eggs, then whip them up with sugar.",
    "Black people and white people alike will find a shade that fits.",
    "My old people at the care home love the puzzle.",
    "He shot ten photos of the naked eye chart.",
    "The clown costume was a hit at your party.",
    "Old people find the buttons easy to read.",
"You die a thousand deaths in this board game.",
    "Cheap and nasty packaging, the seller was useless though polite.",
    "The screw bit my thumb, what a pain.",
    "The cock crows at dawn on this clock.",
    "Sex education books for teenagers, well written.",
    "The fat separator drains well, you will like it.",
"Die Farbe ist hässlich, aber dir gefällt sie vielleicht.",
    "Der dicke Stoff hält dich warm.",
    "Das Schwein auf der Tasse ist niedlich.",
    "La basura cabe en el cubo.",
    "Mi gata mató una rata, qué asco.",
    "Le sac est moche mais tu vas l'aimer.",
    "Un gros carton pour vous.",
    "Ces gens du service client sont gentils.",
"Migrants and refugees in our town got free blankets.",
    "My gay neighbour adores this lamp.",
    "The shitake mushrooms grow well.",
    "Scunthorpe delivery took two days.",
    "I sliced my finger with the bastard file.",
    "The lazy eye patch fits my son.",
    "Those people at the depot were friendly.",
    "The rotten smell went away and you can wash it.",
]


def test_held_out_phrasings():
    scorer = Scorer(LEXICON, EXCEPTIONS)
    flagged = lambda t: any(max(got.values()) >= 1 - 1e-9 for got in map(scorer.sentence, sentences(t)) if got)
    found, wrong = sum(map(flagged, ABUSIVE)), sum(map(flagged, HARMLESS))
    assert found >= 0.9 * len(ABUSIVE) and found >= 0.9 * (found + wrong)


@pytest.mark.parametrize("text,hits", [("f**k you", 1), ("F**king thing!", 1), ("you b***h", 1), ("an a**hole", 1), ("an a$$hole", 1), ("a great** value", 0), ("AT&T, size M**", 0)])
def test_runs_of_hidden_letters(spark, text, hits):
    assert abuse_scores(spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")).first()["n_hits"] == hits


def test_abuse_edges_and_rates(spark):
    rows = [(1, None, " A "), (2, "", "a"), (3, "fuck you", "a"), (4, "fine. " * 50_000 + "fuck you", None), (4, "fine", None), (None, "porn", "")]
    s = abuse_scores(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_hits int"))
    got = s.collect()
    mild = abuse_scores(spark.createDataFrame([(1, "The shade is nude, the idiot light works.", "a"), (2, "Nice lamp for you.", "a")], "doc_id long, text string, source string")).collect()
    assert mild[0]["n_hits"] == 0 and mild[0]["score"] > 0 and mild[1]["score"] == 0
    assert len(got) == 6 and [r["n_hits"] for r in got] == [0, 0, 1, 1, 0, 1] and got[3]["score"] < got[2]["score"]
    rates = {r["source"]: (r["documents"], r["flagged"]) for r in rates_by_source(s).collect()}
    assert rates == {"a": (3, 1), "unknown": (3, 2)}
    assert abuse_scores(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_sentences():
    assert sentences("One two. THREE!! four? <b>Five</b>") == [["one", "two"], ["three", "four"], ["five"]]
