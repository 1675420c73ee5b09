"""Mixing, manifest and resampling against plain versions of their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from stocktide.llm import manifest, mixing, ordering, queries, resample
from stocktide.llm.common import documents

DOC = "doc_id long, source string, lang string, n_chars int, text string, position int, total int, key string, _part int, path string, weight string, src int"


def table(spark, rows):
    return spark.createDataFrame([(i, s, lang, n, t, 1, 2, "k", 3, "p", "w", 9) for i, s, lang, n, t in rows], DOC)


ODD = [
    (1, "a", "en", 5, None), (2, "a", None, None, ""), (3, "a", "en", 3, "x\ny\nz"), (3, "a", "en", 3, "x\ny\nz"), (3, "a", "en", 1, "other"), (4, None, "en", 7, "no source\nhere"), (None, "b", "en", 2, "no\nid"),
    (None, "b", "en", 2, "no\nid"), (5, "", "de", 1, "ß é 日本 x"), (6, "é", "de", 1, "one two " * 3000), (7, "b", "de", 1, " \t\n"), (8, "=", "de", 1, "A1b2 c-d\x00e F"), (-9, "b", "fr", -4, "minus\n\n"),
]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def plain_tree(nodes, fanout=3):
    """(root, siblings of each node)."""
    path, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a // fanout * fanout
            path[i].append(("".join(nodes[first:a]), "".join(nodes[a + 1 : first + fanout])))
        nodes = [H("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [a // fanout for a in at]
    return nodes[0], path


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        groups[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[4]), plain_leaf(r, r[4].replace("\n", "") if hit and r[4] else r[4]), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, upper, strict=True):
        for x, path in zip(sorted(groups[s]), trees[s][1], strict=True):
            folded = manifest.fold(x[3], path + up)
            out.append((x[4], x[2], trees[s][0], root, H("".join(a + b for a, b in path + up)), folded, folded == root))
    return out


def as_set(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_equals_plain_version(spark, sf, levels):
    real = [tuple(r) for r in documents(spark, sf).select("doc_id", "source", "lang", "n_chars", "text").collect()]
    for rows in (ODD, ODD[:1], real):
        got = manifest.proofs(table(spark, rows), claim=manifest.without_line_ends(), shape=manifest.Shape(3, levels)).collect()
        assert as_set(r[:7] for r in got) == as_set(plain_manifest(rows))
        assert all(manifest.fold(r.leaf, manifest.path_of(r.path)) == r.root for r in got)  # every original verifies by its own path
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing_and_without_a_claim(spark):
    assert manifest.proofs(table(spark, ODD).limit(0)).count() == 0
    assert all(r.verified for r in manifest.proofs(table(spark, ODD)).collect())


def test_any_other_field_breaks_the_proof(spark):
    from pyspark.sql import functions as F

    got = manifest.proofs(table(spark, ODD[:6]), claim={"n_chars": F.coalesce(F.col("n_chars"), F.lit(0)) + 1}).collect()
    assert len(got) == 6 and not any(r.verified for r in got)


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_targets(sizes):
    """sizes by source: poured by weight, the excess of full ones poured again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, cap = {s: 1 + i % 3 for i, s in enumerate(order)}, {s: 3 * sizes[s] for s in order}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while left > 1e-9 and open_:
        unit, left = left / sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += unit * w[s]
            if target[s] >= cap[s]:
                left, target[s] = left + target[s] - cap[s], float(cap[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("rows", [ODD, None])
def test_mix_meets_its_targets(spark, rows, sf):
    df = table(spark, rows) if rows else documents(spark, sf)
    got = mixing.mix(df).collect()
    want = Counter((r.doc_id, len(words(r.text)), r.source) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == want
    sizes = defaultdict(int)
    for (_, n, s), k in want.items():
        sizes[s] += n * k
    target, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        assert not r["size"] or math.floor(r.target / r.source_size) <= r.copies <= math.ceil(r.target / r.source_size)
        taken[r.source] += r.taken
    if not rows:
        assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in target)  # ten documents a source
    assert as_set(got) == as_set(mixing.mix(df.repartition(7)).collect())


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixing.mix(table(spark, ODD).limit(0)).count() == 0
    assert [(r["size"], r.target, r.taken) for r in mixing.mix(table(spark, ODD[:2])).collect()] == [(0, 0.0, 0)] * 2


def test_one_class_takes_its_number_in_pareto_order(spark):
    """Equal sizes and two weights: each document's chance is near its inclusion odds, and the number taken is fixed."""
    rows = [(i, "s" if i < 400 else "t", "en", 1, "w " * (8 if i < 400 else 24)) for i in range(800)]
    df = table(spark, rows).selectExpr("* except (weight)", "CASE WHEN doc_id % 2 = 0 THEN 3.0 ELSE 1.0 END AS weight")
    heavy = 0
    for seed in "abc":
        got = [r for r in mixing.mix(df, weights=(1, 7), seed=seed, weight_col="weight").collect() if r.source == "s"]
        expected = got[0].target / 8  # 1600 words of target at 8 words each, a rate of 1/2
        assert abs(sum(r.copies for r in got) - expected) <= 1
        heavy += sum(r.copies for r in got if r.doc_id % 2 == 0)
    assert abs(heavy / (3 * expected) - 0.75) < 0.06
    plain = mixing.mix(df, weights=(1, 7), seed="a")
    assert sum(r["count"] for r in mixing.mixed_texts(df, plain).groupBy("source").count().collect()) == sum(r.copies for r in plain.collect())


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_resample(rows, bench):
    def grams(text):
        w = plain_words(text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    own, target = Counter(bucket(g) for _, t in rows for g in grams(t)), Counter(bucket(g) for t in bench for g in grams(t))
    S, T = sum(own.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (S + 10000) / ((own[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for d, t in rows:
        f = grams(t)
        weight = sum(gain[bucket(g)] for g in f) // len(f) if f else 0
        h = int(H(f"7:{'null' if d is None else d}")[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(t)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resample_equals_plain_version(spark, sf):
    real = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for rows in ([(r[0], r[4]) for r in ODD], real):
        df = table(spark, [(i, "s", "l", 1, t) for i, t in rows])
        assert as_set(resample.resample(df, spark.createDataFrame([(t,) for t in bench], "text string")).collect()) == as_set(plain_resample(rows, bench))
        assert as_set(resample.features(df, block_bytes=500).collect()) == as_set(resample.features(df).collect())


def test_resample_of_nothing_and_towards_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(table(spark, ODD).limit(0), none).count() == 0
    assert resample.resample(table(spark, ODD), none).count() == len(ODD)


def test_features_of_longer_tuples():
    n_words, n_features, flat = resample.feature_buckets([b"a b a B c", b"", b"c a"], 3)
    want = [[b"a", b"b", b"a", b"b", b"c", b"a b", b"b a", b"a b", b"b c", b"a b a", b"b a b", b"a b c"], [], [b"c", b"a", b"c a"]]
    assert n_words.tolist() == [5, 0, 2] and n_features.tolist() == [12, 0, 3]
    assert flat.tolist() == [zlib.crc32(g) % 10000 for w in want for g in w]


def test_positions_of_ties(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", i % 3) for i in range(3000)] + [("b", 1)], "g string, x int").repartition(5)
    got = ordering.positions(df, ["g"], [F.col("x").desc()]).collect()
    a = sorted((r.position, r.x, r.total) for r in got if r.g == "a")
    assert [p for p, _, _ in a] == list(range(3000)) and [x for _, x, _ in a] == [2] * 1000 + [1] * 1000 + [0] * 1000 and {t for _, _, t in a} == {3000}
    assert [(r.position, r.total) for r in got if r.g == "b"] == [(0, 1)]


@pytest.mark.parametrize("name", ["op11_pareto_mixing", "op12_merkle_manifest", "op13_importance_resampling"])
def test_query_equals_sql(spark, sf, name):
    from tests.compare import connect, differences

    assert differences(queries.QUERIES[name](spark, sf).toPandas(), connect(sf).execute(queries.ORACLE_SQL[name]).df()) == ""
