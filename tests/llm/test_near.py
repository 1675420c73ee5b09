"""The pipeline's near-dedup against brute-force Jaccard."""

import random

from stocktide.llm import near

from .conftest import ODD


def brute_shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))}


def brute_groups(texts):
    sets, root = [brute_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def _edited(r, base, vocabulary, edits):
    out = list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = r.choice(vocabulary)
    return " ".join(out)


def test_groups_equal_brute_jaccard(docs):
    """Copies with several changed words, which differ in more than 2 bits of a fingerprint."""
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)] + ["Ж", "ж", "É"]
    rows = list(ODD) + [(None, "One  two THREE")]
    base = [[r.choice(vocabulary) for _ in range(r.randint(60, 300))] for _ in range(25)]
    for _ in range(150):
        words = r.choice(base)
        rows.append((100 + r.randrange(200), _edited(r, words, vocabulary, r.choice([0, 1, 2, 4, 8]))))
    want = brute_groups([t for _, t in rows])
    kept = near.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    got = kept.collect()
    at = [rows.index((x.doc_id, x.text)) for x in got]
    assert len(got) == len(set(want)) and sorted(want[k] for k in at) == sorted(set(want))
    for k in at:
        ids = [i for (i, _), g in zip(rows, want) if g == want[k] and i is not None]
        assert rows[k][0] == min(ids, default=None)


def test_a_large_group_of_near_copies(docs):
    """More nodes on a key than are compared each with each."""
    r = random.Random(9)
    vocabulary = [f"v{k}" for k in range(500)]
    base = [r.choice(vocabulary) for _ in range(150)]
    rows = [(k, _edited(r, base, vocabulary, r.randint(0, 5))) for k in range(250)]
    assert near.keep_one(docs(rows)).count() == len(set(brute_groups([t for _, t in rows])))


def test_nothing(docs):
    assert near.keep_one(docs([]).limit(0)).count() == 0
