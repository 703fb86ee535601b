"""Toxicity, clustering and divergence against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import centroids, divergence, toxicity
from tests.llm.conftest import awkward, put

# toxicity

BAD = ["vilest", "rotten", "wretch"]


def words_of(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 6))) for _ in range(n)]


def talk(seed, n, noise=0.03):
    draw = random.Random(seed)
    common = words_of(draw, 60)
    rows = []
    for k in range(n):
        w = [draw.choice(common) if draw.random() < 0.5 else words_of(draw, 1)[0] for _ in range(draw.randint(5, 120))]
        bad = draw.random() < 0.15
        for x in draw.sample(BAD, draw.randint(2, 3)) if bad else []:
            w[draw.randrange(len(w))] = draw.choice([x, x.title(), x.upper() + ","])
        rows.append((k, " ".join(w), bad, int(bad != (draw.random() < noise))))
    return rows


def docs_of(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def test_toxic_words_are_learned_from_noisy_labels(spark):
    rows = talk(1, 2500)
    docs, labels = docs_of(spark, rows)
    model = toxicity.learned(toxicity.sample(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, ["doc_id"], *model).collect()}
    apart = [r for r in rows if held(r[0])]
    bad, good = [r for r in apart if r[2]], [r for r in apart if not r[2]]
    assert sum(got[r[0]] >= toxicity.CUT for r in bad) >= 0.97 * len(bad)
    assert sum(got[r[0]] >= toxicity.CUT for r in good) <= 0.01 * len(good)
    assert len(model[0]) < 500  # sparse, of some 200,000 features


def test_held_out_labels_change_nothing(spark):
    rows = talk(2, 400)
    docs, labels = docs_of(spark, rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.learned(toxicity.sample(docs, x)) for x in (labels, flipped))
    assert list(one[0]) == list(two[0]) and list(one[1]) == list(two[1]) and one[2] == two[2]


def plain_ftrl(rows, l1):
    """One shard, features as they are, without any pruning."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        limit = 0.0 if i == toxicity.BIAS else l1
        return 0.0 if abs(z[i]) <= limit else (math.copysign(limit, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA)

    for _ in range(toxicity.ROUNDS):
        for found, y in rows:
            own = [toxicity.BIAS, *found]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
        for i in [i for i in z if i != toxicity.BIAS and abs(z[i]) < l1 / toxicity.SENT]:
            del z[i], n[i]
    return {i: weight(i) for i in z if weight(i)}


def test_weights_equal_a_plain_walk_over_the_rows(spark):
    rows = talk(3, 500)
    docs, labels = docs_of(spark, rows)
    sample = toxicity.sample(docs, labels)
    index, w, bias = toxicity.learned(sample)
    local = sorted(sample.collect(), key=lambda r: r.key)
    assert {r.shard for r in local} == {0} and len(local) == sum(not held(r[0]) for r in rows)
    want = plain_ftrl([(r.features, r.toxic) for r in local], toxicity.threshold(len(local), sum(r.toxic for r in local)))
    assert want.pop(toxicity.BIAS) == pytest.approx(bias)
    assert {int(i): pytest.approx(float(x)) for i, x in zip(index, w, strict=True)} == want


def test_shards_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 300)
    rows = talk(4, 2000)
    docs, labels = docs_of(spark, rows)
    sample = toxicity.sample(docs, labels)
    assert sample.select("shard").distinct().count() >= 5
    got = {r.doc_id: r.score for r in toxicity.scored(docs, ["doc_id"], *toxicity.learned(sample)).collect()}
    assert sum((got[r[0]] >= toxicity.CUT) == r[2] for r in rows) >= 0.97 * len(rows)


def test_copies_have_no_weight_and_ties_count_as_toxic(spark):
    docs = spark.createDataFrame([(k, "same text") for k in range(500)] + [(1000 + k, f"other {k}") for k in range(20)] + [(2000, "split"), (2001, "split"), (2003, "split"), (2004, "split"), (None, "no id")], "doc_id long, text string")
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = toxicity.sample(docs, labels.unionByName(spark.createDataFrame([(0, None), (3, 7), (None, 1), (999_999, 1)], "doc_id long, toxic int"))).collect()
    assert len(rows) == len({r.key for r in rows}) <= 22


def test_features_are_words_pairs_and_skip_pairs():
    assert len(toxicity.features("")) == len(toxicity.features(" .,; ")) == 0
    assert len(toxicity.features("one")) == 1 and len(toxicity.features("one two three four")) == 4 + 3 + 2
    one = set(toxicity.features("You IDIOT, you «Übel» a_b"))
    assert one == set(toxicity.features("you idiot you übel a b"))
    assert len(set(toxicity.features("a b")) & set(toxicity.features("a x b"))) == 2


def test_toxicity_of_awkward_rows(spark, tables, empty, rows):
    got = toxicity.op11_toxicity(spark, tables).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    by_text = defaultdict(set)
    for r, d in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        if r.doc_id is not None:
            by_text[d[1] or ""].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())
    assert toxicity.op11_toxicity(spark, empty).count() == 0


def test_without_labels_every_score_is_the_prior(spark, tmp_path):
    got = toxicity.op11_toxicity(spark, put(spark, tmp_path / "t", awkward())).collect()
    assert {r.score for r in got} == {toxicity.PRIOR} and {r.predicted for r in got} == {0}


# clustering


def plain_lloyd(vectors, k, rounds, seed):
    """vectors: (id, 64 floats). Whole numbers of any size."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z", c) for i, c in kept)
    centres = [c for _, c in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        at = [min((far(c, x), j) for j, x in enumerate(centres)) for _, c in kept]
        if turn < rounds:
            for j in range(len(centres)):
                own = [c for (_, c), (_, a) in zip(kept, at, strict=True) if a == j]
                if own:
                    centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    total = Counter()
    for d, j in at:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True))


def vectors_of(n, seed=5):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(6, 64))
    rows = [(k, [float(np.float32(x)) for x in middle[k % 6] + 0.4 * draw.normal(size=64)]) for k in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [1.0] * 63 + [None]), (n + 4, [1.0] * 63 + [float("nan")]), (n + 5, [float("-inf")] + [1.0] * 63)]
    return rows + rows[:3] + [(0, [0.5] * 64), (None, [-0.25] * 64), (None, [-0.25] * 64)]


@pytest.mark.parametrize(("n", "k", "chunk"), [(200, 12, 4096), (200, 40, 16), (5, 40, 4096)])
def test_clusters_equal_plain_rounds(spark, monkeypatch, n, k, chunk):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rows = vectors_of(n)
    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster long, cells string").repartition(3)
    got = Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clustered(df, k=k).collect())
    assert got == plain_lloyd(rows, k, centroids.ROUNDS, centroids.SEED)


def test_equal_vectors_share_the_first_cluster_and_empty_ones_stay(spark):
    df = spark.createDataFrame([(k, [1.0] * 64) for k in range(50)], "vec_id long, embedding array<float>")
    got = centroids.clustered(df).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 50


def test_no_vectors_and_too_large_ones(spark):
    assert centroids.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="no exact distance"):
        centroids.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


# divergence


def plain_divergence(rows):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)] for text, _, _ in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), own in zip(rows, terms, strict=True):
        df[lang].update(set(own))
        counts[lang, source].update(own)
    out = []
    for lang in df.keys() | {x[1] for x in rows}:
        kept = sorted(t for t, n in df[lang].items() if n >= 10)
        groups = sorted({(x[1], x[2]) for x in rows if x[1] == lang})
        v = len(kept)
        total = {g: sum(counts[g][t] for t in kept) for g in groups}
        share = lambda n, whole: 1 + 1_000_000_000 * (n + 2) // (whole + 2 * v)  # noqa: B023, E731
        p = {g: {t: share(counts[g][t], total[g]) for t in kept} for g in groups}
        q = {t: share(sum(counts[g][t] for g in groups), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in groups:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in groups if h != g]
            own = [(f(p[g][t], q[t]), t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, 10)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, k) for k, (value, item) in enumerate(ranked[:most], 1)]
    return Counter(out)


def papers(seed, n):
    draw = random.Random(seed)
    vocabulary = [draw.choice(["Wort", "été", "x", "ÄB", "naïve", "日本"]) + "".join(draw.choice("abcXYZ") for _ in range(draw.randint(0, 2))) for _ in range(60)]
    rows = [(" ".join(draw.choice(vocabulary) + draw.choice([" ", ". ", "1", "_", "\n"]) for _ in range(draw.randint(0, 40))), draw.choice(["en", "en", "de", "rare", None]), draw.choice(["a", "b", "c", "é", "z", None, "hot", "hot", "hot"])) for _ in range(n)]
    return rows + rows[:5] + [(None, "en", "quiet"), ("", "de", "quiet"), ("Wort", "single", "one"), (None, None, None), ("x " * 5000, "en", "a")]


@pytest.mark.parametrize(("shard", "panel", "flush"), [(20_000, 8, 300_000), (7, 2, 30)])
def test_divergence_equals_a_plain_count(spark, monkeypatch, shard, panel, flush):
    for name, value in (("SHARD_TERMS", shard), ("PANEL", panel), ("FLUSH", flush)):
        monkeypatch.setattr(divergence, name, value)
    rows = papers(7, 400)
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    got = Counter(tuple(r) for r in divergence.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows)
    assert {k[2] for k in got} == {"pair", "term"}


def test_divergence_of_nothing(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_galloping():
    at = np.array([3, 9, 12], np.int64)
    assert [list(x) for x in divergence.galloped(np.array([1, 9, 12, 40]), at)] == [[1, 2], [1, 2]]
    assert [list(x) for x in divergence.galloped(np.array([], np.int64), at)] == [[], []]


def test_large_counts(spark):
    n, total, v = 9_000_000_000_000, 9_000_000_000_123, 4_000
    row = spark.range(1).select(divergence.whole_share(F.lit(n), F.lit(total), F.lit(v)).alias("p"), divergence.distance(F.lit(1_000_000_001).cast("long"), F.lit(3).cast("long")).alias("d")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 2) // (total + 2 * v) and row.d == (1_000_000_001 - 3) ** 2 // 1_000_000_004


def test_forms_of_a_word_share_a_feature():
    """A form that was not learned is known by how it begins."""
    from ledgerlens.llm import toxicity

    one, other = (set(toxicity.features(w).tolist()) for w in ("loweischaft", "loweient"))
    assert one & other and not one & set(toxicity.features("garten").tolist())
