import itertools
import random
import zlib

import numpy as np
import pytest

from ledgerline.llm import language_spans as l

from .helpers import awkward, clashing, documents

SYLLABLES = {"en": "th ing and er on st the wh".split(), "de": "sch ung ein keit er lich ß ü".split(),
             "fr": "eau é ou ent tion è que ç".split(), "ru": "ст ра но го ни ка".split()}


def text_in(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(spark):
    rows = [(i, text_in(lang, i, 60), lang, "s") for i, lang in enumerate(itertools.islice(itertools.cycle(SYLLABLES), 200))]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def model(spark):
    return l.train(corpus(spark))


def test_held_out_accuracy(spark, model):
    got = l.label_languages(clashing(corpus(spark)), model).collect()
    truth = {r.doc_id: r.lang for r in corpus(spark).collect()}
    out = [r for r in got if r.held_out]
    assert out and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) >= 0.95


def test_mixed_text_becomes_spans(model):
    parts = [("en", 40), ("ru", 25), ("de", 30), ("en", 40)]
    text = " ".join(text_in(lang, 999, n) for lang, n in parts)
    spans = l.Labeller(model).label([text])[0]
    assert [model.languages[s[2]] for s in spans] == [p[0] for p in parts]
    ends = np.cumsum([n for _, n in parts])
    assert all(abs(s[1] - e) <= 2 for s, e in zip(spans, ends))


def exhaustive(scores, switch):
    best, path = -np.inf, None
    for states in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        value = sum(scores[i, s] for i, s in enumerate(states)) - switch * sum(a != b for a, b in zip(states, states[1:]))
        if value > best + 1e-9:
            best, path = value, states
    return best, path


def test_viterbi_is_optimal_and_the_shortcut_agrees():
    rng = np.random.default_rng(0)
    batch = [rng.normal(0, 3, (n, 3)) for n in (1, 6, 3, 6, 5, 2)]
    for scores, path in zip(batch, l.viterbi(batch, 4.0)):
        value = sum(scores[i, s] for i, s in enumerate(path)) - 4.0 * np.count_nonzero(np.diff(path))
        assert value == pytest.approx(exhaustive(scores, 4.0)[0])
    for _ in range(300):
        scores = rng.normal(0, 1.5, (6, 3))
        best = int(scores.sum(axis=0).argmax())
        gain = np.vstack([np.zeros(3), np.cumsum(scores - scores[:, best:best + 1], axis=0)])
        if (gain - np.minimum.accumulate(gain, axis=0)).max() <= 4.0 / 2:
            assert exhaustive(scores, 4.0)[0] == pytest.approx(scores[:, best].sum())


def test_script_ranges_narrow_the_candidates(model):
    assert model.languages[l.Labeller(model).label(["раст ника"])[0][0][2]] == "ru"
    scores, letters = model.scores(["раст", "漢字", "ing"])
    ru = model.languages.index("ru")
    assert scores[0].argmax() == ru and (np.delete(scores[0], ru) < -30).all()
    assert letters.tolist()[1] == -2 and (scores[1] == 0).all() and scores[2, ru] < -30


def test_awkward_rows_no_labels_and_empty(spark, model):
    docs = awkward(spark)
    got = l.label_languages(docs, model).collect()
    assert len(got) == docs.count()
    texts = sorted((r.text or "") for r in docs.collect())
    assert sum(r.lang_pred == "und" for r in got) == sum(not any(map(str.isalpha, t)) for t in texts)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert {r.lang_pred for r in l.label_languages(docs.selectExpr("doc_id", "text", "string(null) lang")).collect()} == {"und"}
    assert l.label_languages(docs.limit(0)).collect() == []
