import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import toxicity_decode as t

from .helpers import awkward, clashing, documents

BAD = ["stupid", "worthless", "pathetic", "loser", "trash"]
NICE = ["garden", "window", "letter", "summer", "planet", "worth", "path", "late", "stone", "pudding", "less", "idea"]


def sentence(seed, bad=(), n=30):
    rng = random.Random(seed)
    words = [rng.choice(NICE) for _ in range(n)]
    for word in bad:
        words[rng.randrange(n)] = word
    return " ".join(words) + "."


def corpus(spark):
    rows = [(i, sentence(i, [BAD[i % 5]] * 3 if i % 4 == 0 else ())) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (7, None, None)],
                                   "doc_id long, quality int, toxic int")
    return documents(spark, rows), labels


@pytest.fixture(scope="module")
def model(spark):
    return t.train(*corpus(spark))


def test_disguised_words_are_restored(model):
    decoder = t.Decoder(model.characters)
    for disguised, word in [("$tupid", "stupid"), ("w0rthl3ss", "worthless"), ("p4th3t1c", "pathetic"),
                            ("l0s3r", "loser"), ("tr@sh", "trash"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"),
                            ("t-r-a-s-h", "trash"), ("7r45h", "trash")]:
        assert word in decoder.words(disguised, t.READINGS), disguised
    assert decoder.words("garden,") == ["garden"] and decoder.words("well-known") == ["well", "known"]
    assert decoder.words("123") == [] and decoder.words("...") == []


def test_spaced_letters_are_one_token():
    assert t.tokens_of("you L O S E R now a b") == ["you", "loser", "now", "a", "b"]


def test_words_apart_and_in_uneven_parts_are_restored(model):
    features = t.TokenFeatures(t.Decoder(model.characters), None)
    for text, words in [("letter s t u p i d l o s e r garden", ["stupid", "loser"]), ("letter a l o s e r", ["loser"]),
                        ("st u pid", ["stupid"]), ("s tu pid.", ["stupid"]), ("stu.pid", ["stupid"]),
                        ("lo-ser", ["loser"]), ("l.o.s3r", ["loser"]), ("tr 4 sh", ["trash"]), ("stu p1d", ["stupid"])]:
        assert {f"^{w}$" for w in words} <= features.of(text), text


def test_uneven_parts_are_called_toxic(spark, model):
    _, labels = corpus(spark)
    forms = ["s t u p i d l o s e r", "a l o s e r", "st u pid", "stu.pid", "lo-ser", "l.o.s3r"]
    hidden = documents(spark, [(i, sentence(3000 + i, [f], n=300)) for i, f in enumerate(forms)])
    assert [r.predicted for r in t.score_toxicity(hidden, labels, model).orderBy("doc_id").collect()] == [1] * len(forms)


def test_a_word_at_any_place_of_a_long_run_is_restored(model):
    decoder = t.Decoder(model.characters)
    for n in range(40, 75):
        assert any("stupid" in word for word in decoder.words("x7" * (n // 2) + "x" * (n % 2) + "stup1d" + "7x" * 20, t.READINGS)), n


def test_long_lists_of_pieces_are_read_whole(model):
    decoder = t.Decoder(model.characters)
    for n in (470, 490, 505, 512, 530, 1000):
        assert "loser" in decoder.read(["a"] * n + list("loser") + ["a"] * 40), n
    assert any("stupid" in word for word in decoder.read(["stu", "pid" + "x" * 50_000, "lo", "ser"]))
    assert "loser" in decoder.read(["x" * 50_000, "lo", "ser"])


def test_held_out_and_disguised_texts(spark, model):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in t.score_toxicity(clashing(docs), labels, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == int(i % 4 == 0) for i, r in got.items() if r.held_out)
    forms = ["$tup1d", "w0rthless", "p@thetic", "l o s e r", "traaaash"]
    hidden = documents(spark, [(i, sentence(1000 + i, [f], n=300)) for i, f in enumerate(forms)])
    assert [r.predicted for r in t.score_toxicity(hidden, labels, model).orderBy("doc_id").collect()] == [1] * 5
    clean = documents(spark, [(i, sentence(2000 + i, [f])) for i, f in enumerate(["w1ndow", "g a r d e n", "summer!!"])])
    assert [r.predicted for r in t.score_toxicity(clean, labels, model).collect()] == [0] * 3


def test_lattice_search_is_exhaustive(model):
    decoder = t.Decoder(model.characters)

    def all_readings(steps):
        out = [("", 0.0)]
        for readings in steps:
            out = [(a + b, c + d) for a, c in out for b, d in readings]
        return out

    def cost(word):
        framed = f"\0{word}\0"
        return sum(decoder._cost(*framed[i:i + 3]) for i in range(len(framed) - 2)) - decoder.model.letter_cost * max(0, len(word) - 1)

    for run in ("l0s3r", "$t*p1d", "tr@@sh", "1l1"):
        best = min(((c + cost(w) if w else c), w) for w, c in all_readings(t.lattice(run)))
        assert decoder.restore(run)[0] == best[1]


def test_near_copies_count_once():
    assert t.independent([[1, 2], [3, 4], [1, 9], [8, 4], [2, 1]]) == [True, True, False, False, True]


def test_rules_find_what_goes_with_the_label():
    rng = np.random.default_rng(0)
    y = np.array([float(i % 5 == 0) for i in range(300)])
    # Feature 0 marks most toxic texts, 1 five others (too few against the whole, enough among the rest); 2 as many of
    # both kinds; the others are noise.
    rows = [([0] if i % 60 else [1]) if y[i] else [] for i in range(300)]
    rows = [r + [2] * (i % 2) for i, r in enumerate(rows)]
    rows = [sorted(set(r + [int(k) for k in rng.integers(3, 20, 3)])) for r in rows]
    strength, base = t.fit_rules(rows, y, ["^bad$", "nasty"] + [f"^word{i}$" for i in range(18)])
    assert strength[0] > 0.9 and strength[1] > 0.8 and not strength[2:].any() and base == 0


def test_awkward_rows_no_labels_and_empty(spark, model):
    docs = awkward(spark)
    _, labels = corpus(spark)
    got = t.score_toxicity(docs, labels, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = t.score_toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == docs.count()
    assert t.score_toxicity(docs.limit(0), labels).collect() == []
    assert t.restore_texts(docs, model.characters).count() == docs.count()
