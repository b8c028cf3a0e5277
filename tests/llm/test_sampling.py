"""Source mixing, vector codes and importance resampling."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.llm import importance_sample, source_mix, vector_codes
from allelix.llm.common import repeated, with_totals


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ünder", "漢字", "x9", "w" * 70, "long" * 40, "end"]
    out = [(i, rng.choice((" ", ", ", "\n")).join(rng.choice(words) + str(rng.randrange(30)) for _ in range(rng.randrange(60)))) for i in range(n)]
    return [*out, (None, out[3][1]), (None, out[3][1]), (None, None), (7, out[7][1]), (7, out[7][1]), (n, None), (n + 1, ""), (n + 2, "-- ,"), (n + 3, "漢字 " * 3000)]


# ---------------------------------------------------------------- shared helpers


def test_totals_of_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "a" if i % 3 == 1 else f"k{i}") for i in range(300)], "id long, key string")
    totals = rows.groupBy("key").agg(F.count("*").alias("n"))
    for most in (1, 2, 10, 1000):
        got = {r.id: r.n for r in with_totals(rows, totals, "key", "n", most).select("id", "n").collect()}
        assert len(got) == 300 and all(n == (1 if i % 3 == 2 else 100) for i, n in got.items())
    assert with_totals(rows.limit(0), totals.limit(0), "key", "n").count() == 0


def test_repeated_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 25), ("c", 10), ("d", 0), ("e", 31)], "name string, times long")
    got = {}
    for r in repeated(rows, "times", "number", most=10).collect():
        got.setdefault(r.name, []).append(r.number)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [1], "b": list(range(1, 26)), "c": list(range(1, 11)), "e": list(range(1, 32))}


# ---------------------------------------------------------------- importance resampling


@pytest.mark.parametrize("percent, least", [(5, 20), (60, 1), (100, 0), (0, 0)])
def test_importance_sample_by_brute_force(spark, percent, least):
    rows, target = texts(150), [t for _, t in texts(20, 9)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    out = importance_sample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, least)
    assert sorted((tuple(r) for r in out.collect()), key=str) == importance_sample.brute_force(rows, target, percent, least)


def test_importance_sample_of_one_score(spark):
    """Rows of one score, by id and without one, each have a rank of their own."""
    rows = [(5, "a b c")] * 40 + [(None, "a b c")] * 10
    out = importance_sample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"), 50, 2)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == importance_sample.brute_force(rows, [], 50, 2)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 26))


def test_ranks_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(-50, 50) * 10 ** rng.randrange(4)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, score long")
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))[:150])}
    for ranges in (1, 2, 7, 100):
        assert {r.id: r["rank"] for r in importance_sample.ranked(df, F.col("id") >= 0, 30, ranges).collect()} == {i: want.get(i) for i, _ in rows}


def test_features_over_runs_of_words(monkeypatch):
    """However many words go through at once, features are the same."""
    import pyarrow as pa

    column = pa.array([t for _, t in texts(40)])
    found = lambda: sorted((int(r), int(b)) for rows, buckets in importance_sample.buckets_of(column) for r, b in zip(rows, buckets, strict=True))
    whole = found()
    for most in (1, 2, 3, 50):
        monkeypatch.setattr(importance_sample, "WORDS_AT_ONCE", most)
        assert found() == whole


# ---------------------------------------------------------------- vector codes


def vectors(n=60, size=16):
    rng = random.Random(5)
    near = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(near)], rng.choice((1, 2, None))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * size, 1), (n + 2, [float("nan")] * size, 2), (n + 3, [float("inf")] + [0.0] * (size - 1), 2)]
    rows += [(None, near[0], 1), (None, near[0], 1), (3, near[1], 2), (n + 4, [], 1), (n + 5, [0.0] * size, None)]
    return rows + [(100 + i, [rng.uniform(-1, 1) for _ in range(11)], 3) for i in range(20)] + [(200 + i, [0.5] * 3, 4) for i in range(3)]


def test_vector_codes_by_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, code string, size string").repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == vector_codes.brute_force(rows)


def test_codes_of_large_components_are_exact(spark):
    rows = [(i, [1e3 * (i % 7), -1e9 * i, 1e18 * (i % 3), 1e300 if i == 30 else 0.1 * i] * 2, 1 + (i >= 28)) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)
    assert got == vector_codes.brute_force(rows) and any(r[2] is None for r in got)


def test_annulus_finds_the_nearest_of_all():
    rng = np.random.default_rng(8)
    for width, spread in ((1, 3), (2, 4), (8, 5), (8, 4096), (3, 200_000)):
        book = rng.integers(-spread, spread + 1, (16, width))
        x = np.concatenate((rng.integers(-2 * spread, 2 * spread + 1, (500, width)), book, np.zeros((1, width), int)))
        d = ((x[:, None] - book) ** 2).sum(2)
        part = vector_codes.Part(book.tolist())
        code, away = part.nearest(x)
        assert (code == d.argmin(1)).all() and (away == d.min(1)).all()
        assert [part.nearest_wide(r) for r in x.tolist()] == list(zip(code.tolist(), away.tolist(), strict=True))


# ---------------------------------------------------------------- source mix


def mixed(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(parts)
    return sorted((tuple(r) for r in source_mix.mix(df, **how).select("doc_id", "size", "source_size", "target", "copies", "taken").collect()), key=str)


def plain_targets(by_source, weights=(5, 2, 1), most=3):
    names = sorted(by_source, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(by_source.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free)
        stop = {s for s in free if level * w[s] >= most * by_source[s]}
        if not stop:
            return out | {s: level * w[s] for s in free}
        out |= {s: float(most * by_source[s]) for s in stop}
        free -= stop
    return out


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_source_mix(spark, block):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 80))), rng.choice(("a", "b", "b", "b", "c", "dé", "z", None))) for i in range(400)]
    rows += [(i, None, "a") for i in range(5)] + [(None, "x y", "b")] * 3 + [(500, "", "only empty"), (501, "w " * 5000, "one"), (502, "w " * 10, "tiny")]
    rows += [(900, "w " * 3, "b")] * 50
    got = mixed(spark, rows, block=block)
    assert got == mixed(spark, rows, 5, block=block) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_source = {}
    for _, t, s in rows:
        by_source[s] = by_source.get(s, 0) + size(t)
    want = plain_targets(by_source)
    assert abs(sum(want.values()) - sum(by_source.values())) < 1e-6
    assert sorted(((i, size(t), by_source[s]) for i, t, s in rows), key=str) == sorted((r[:3] for r in got), key=str)
    assert all(0 <= r[4] <= 3 and r[5] == r[4] * r[1] and abs(r[5] - r[1] * r[3] / max(r[2], 1)) <= r[1] for r in got)
    for source, total in by_source.items():
        mine = [r for r in got if r[2] == total]
        assert abs(mine[0][3] - want[source]) < 1e-6 * max(1, want[source])
        assert abs(sum(r[5] for r in mine) - want[source]) <= max(r[1] for r in mine) / 2 + 1e-6
    assert {r[4] for r in got if r[0] == 900} <= {int(want["b"] / by_source["b"]), int(want["b"] / by_source["b"]) + 1}


def test_settled_documents_keep_size_and_chance():
    rng = np.random.default_rng(4)
    size, chance = np.sort(rng.integers(1, 500, 30))[::-1], rng.uniform(0.05, 0.95, 30)
    total, runs = np.zeros(30), 4000
    for _ in range(runs):
        out, left, p = source_mix.settle(size, chance, rng.random(30))
        found = out.astype(float)
        if left >= 0:
            found[left] = p
        assert ((found[np.arange(30) != left] % 1) == 0).all() and abs((found * size).sum() - (chance * size).sum()) < 1e-6
        total += found
    assert np.abs(total / runs - chance).max() < 0.04


def test_mixes_of_nothing(spark):
    assert mixed(spark, []) == [] and mixed(spark, [(1, None, None), (2, "", "a")]) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
