import random
from collections import Counter, defaultdict

import numpy as np

from ledgerline.llm import jaccard_forest as j

from .helpers import awkward, clashing, documents, prose, words_of


def shingle_set(words):
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_force(rows, threshold=0.8):
    """Links and the smallest known id of each row's class."""
    words = [tuple(words_of(text)) for _, text in rows]
    sets = [shingle_set(w) for w in words]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if words[a] == words[b] or both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[find(k)].append(i)
    known = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, known[find(k)], links[k]) for k, (i, _) in enumerate(rows)), key=str)


def joined(docs):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in j.near_duplicates(docs).collect()), key=str)


def near_copies(rng, text, n):
    out = []
    for _ in range(n):
        words = text.split()
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
        out.append(" ".join(words))
    return out


def corpus():
    rng = random.Random(2)
    texts = [prose(i, 60) for i in range(40)]
    for i in range(6):
        texts += near_copies(rng, texts[i], 6) + [texts[i]] * 3
    texts += [prose(900, 30) + " " + prose(i, 30, prefix="v") for i in range(20)]  # a shared passage
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_links_and_classes_match_brute_force(spark):
    rows = corpus()
    assert joined(clashing(documents(spark, rows))) == brute_force(rows)


def test_large_group_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(j, "CHUNK", 8)
    rng = random.Random(4)
    rows = list(enumerate(near_copies(rng, prose(1, 150), 70) + [prose(2, 50)] * 5))
    assert joined(documents(spark, rows)) == brute_force(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert joined(docs) == brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert j.near_duplicates(docs.limit(0)).collect() == []


def test_one_document_of_each_class_stays(spark):
    docs = clashing(documents(spark, corpus()))
    left = j.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    classes = {r[1] for r in brute_force(corpus())}
    assert sorted(r.doc_id for r in left.collect()) == sorted(classes)
    odd = j.drop_near_duplicates(awkward(spark)).collect()
    assert len(odd) == len({tuple(words_of(r.text)) for r in awkward(spark).collect()})


def test_prefixes_shorten_until_the_target(monkeypatch):
    assert j.planned_depth(0.99, 0.9) == j.DEPTH
    depths = [j.planned_depth(0.8, t) for t in (0.9, 0.9995, 0.9999999, 1.0)]
    assert depths == sorted(depths, reverse=True) and depths[-1] == 1
    assert j.expected_recall(0.8, j.planned_depth(0.8, j.TARGET_RECALL)) >= j.TARGET_RECALL


def test_a_low_estimate_makes_another_pass(spark, monkeypatch):
    used = []
    whole = j.verified_links
    monkeypatch.setattr(j, "planned_depth", lambda threshold, target: 4)
    monkeypatch.setattr(j, "verified_links", lambda d, r, t, depth: used.append(depth) or whole(d, r, t, depth))
    rows = corpus()
    j.near_duplicates(documents(spark, rows), target=0.9999999999).collect()
    assert used[0] == 4 and len(used) > 1 and used == sorted(used, reverse=True)


def test_intersections_and_roots():
    sets = [np.array(x, dtype=np.uint64) for x in ([1, 2, 3], [2, 3, 4], [9], [1, 2, 3, 4])]
    got = j._intersections(sets)
    assert [[int(got[a, b]) for b in range(4)] for a in range(4)][0][1] == 2 and got[0, 3] == 3 and got[2, 0] == 0
    linked = np.zeros((5, 5), dtype=bool)
    for a, b in ((4, 2), (2, 1), (3, 0)):
        linked[a, b] = linked[b, a] = True
    assert j._roots(linked).tolist() == [0, 1, 1, 0, 1]


def test_null_and_repeated_ids_meet_one_text_per_digest(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(None, text) for text in near_copies(rng, prose(3, 80), 40)]
    rows += [(7, text) for text in near_copies(rng, prose(4, 80), 20)] * 3
    met = []
    whole = j.written

    def watched(df, name):
        out = whole(df, name)
        if name == "forest-links":
            met.append(out.count())
        if name == "forest-blocks":
            met.append(out.select("trie", "node", "left", "right", "digest").distinct().count() - out.count())
        return out

    monkeypatch.setattr(j, "written", watched)
    assert joined(documents(spark, rows)) == brute_force(rows)
    assert met[0] == 0  # a text is in a block once, whatever its ids
