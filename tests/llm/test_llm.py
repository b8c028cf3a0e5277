import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from allelix.llm import decontaminate, language_id, near_dedup, pii, queries, sampled_pieces, shards, substring_dedup, token_files, url_filter, vector_dedup
from allelix.llm.common import components, new_path
from allelix.llm.queries import vocabulary

PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, label string, bands int, copy int"


def corpus(n=60):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "ünder", "漢字", "x+y", "end."]
    line = " ".join(rng.choice(words) + str(i) for i in range(30))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(rng.randrange(1, 90)))
        if i % 3 == 0:
            text = text + "\n" + line + " tail"
        rows.append(text)
    rows[7] = rows[5]
    rows[9] = rows[12].replace("alpha", "Alpha", 1)
    rows += ["", None, "one", "z" * 3000, "a\tb  c\n\n", rows[20]]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), "x", "y", "z", 1, 2) for i, t in corpus()]
    return spark.createDataFrame([*rows, rows[20]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (5, 9), (9, 7), (4, 4)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 9: 5}


def test_substrings(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(docs).collect()}
    want = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.brute_force(corpus()).itertuples()}
    assert got == want and sum(v[1] for v in want.values()) > 100
    packed = [r for part in substring_dedup.in_slices(pa.RecordBatch.from_pydict({"id": [i for i, _ in corpus()], "key": [i for i, _ in corpus()], "text": [t for _, t in corpus()]}), "text", 2000) for r in substring_dedup._pack(part, 13, 4, 1) if not r["local"]]
    whole = [x.tolist() for x in substring_dedup._count(packed, 13)]
    assert len(packed) > 5 and len(whole[0]) > 3 and [x.tolist() for x in substring_dedup._count(packed, 13, 1500)] == whole
    assert substring_dedup.dedup_substrings(docs).count() == docs.count()
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_tokens(docs, empty):
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.tokens)) for r in token_files.token_dataset(docs.dropDuplicates(["doc_id"]), BYTES).orderBy("start").collect()]
    assert got == token_files.brute_force(corpus(), BYTES)
    assert token_files.token_dataset(empty, BYTES).count() == 0


def test_tokens_of_added_tokens_and_null_ids(spark):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "x<|endoftext|><|endoftext|> y  ", "<|endoftext", "|>", None, "a <|endof", "text|> b", "plain  text\n\n end"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, (None, "one"), (None, None), (None, "two")], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.tokens)) for r in token_files.token_dataset(df, BYTES).orderBy("start").collect()]
    assert got[:9] == token_files.brute_force(rows, BYTES)
    assert token_files.encoder(BYTES)(pa.array(texts[:1]), 0)[0].tolist() == [31373, 220, 50256, 995, 0]
    assert [g[0] for g in got[9:]] == [None] * 3
    path = new_path(spark, "tokens")
    token_files.write_tokens(df, path, BYTES)
    s = token_files.Shard(path, next(r["shard"] for r in json.loads(Path(path.removeprefix("file://"), "manifest.json").read_text())["shards"]), 1, "<u2")
    assert isinstance(s.tokens, np.memmap)


def test_pieces_cut_where_the_tokenizer_cuts():
    rng, enc = random.Random(2), token_files.Encoder(BYTES)
    odd = ["".join(rng.choice(" \n\t'a!éZ3\x1c\x85  漢.-s") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, n = enc(pa.array(odd), 0)
    at = np.cumsum(n) - n
    assert all(ids[i : i + k - 1].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids for t, i, k in zip(odd, at, n, strict=True))


def test_near_duplicates(docs, empty):
    for weighted in (True, False):
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs, weighted=weighted).collect()}
        assert got == near_dedup.brute_force(corpus(), weighted=weighted)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_null_and_repeated_ids(spark):
    text = lambda k, tail="": " ".join(f"w{k}x{i}" for i in range(60)) + tail
    rows = [(5, text(0)), (None, text(0, " end")), (None, text(1)), (None, text(2)), (None, text(2, " end")), (7, text(3)), (7, text(4)), (3, text(4, " end")), (9, text(5)), (9, text(5, " end"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    copy = lambda t: hashlib.md5(t.encode()).hexdigest()
    got = {r["copy"]: (r.class_id, r.root) for r in near_dedup.near_duplicates(df).collect()}
    classes = {}
    for _, t in rows:
        classes.setdefault(got[copy(t)], []).append(t)
    assert [got[copy(t)][0] for _, t in rows] == [5, 5, None, None, None, 7, 3, 3, 9, 9]
    assert len(classes) == 6
    kept = [r.text for r in corpus_pipeline.one_of_each(spark, df, "").collect()]
    assert len(kept) == 6 and {text(0), text(1), text(3), text(4, " end")} < set(kept)


def test_dart_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.gamma(1, 2, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.gamma(1, 2, 300))
    e = near_dedup.mix(np.arange(300, dtype=np.uint64))
    s, _ = near_dedup.dart_minhash(np.concatenate([e, e]), np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 2048)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_vectors(spark, empty):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + 0.05 * rng.normal(size=16)).tolist(), int(i % 3)) for i in range(200)]
    rows += [(200, rows[3][1], rows[3][2]), (201, None, 1), (202, [0.0] * 16, 1), (203, [float("nan")] * 16, 1), (204, rows[5][1], None), (205, [None] * 16, 2)]
    rows += [(206, [1.0], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.001], 1), (209, [1.0, 2.0, 0.0], 1), (210, [3.0], 1), (211, [1e200, 2e200], 1), (212, [1e-300, 2e-300], 1), (213, [-1.0], 1)]
    rows += [(3, rows[8][1], rows[8][2]), (3, (-np.array(rows[9][1])).tolist(), rows[9][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    by = ["vec_id", "n_links", "component_id"]
    got = vector_dedup.near_vectors(df).toPandas().sort_values(by).reset_index(drop=True)
    want = vector_dedup.brute_force(rows).sort_values(by).reset_index(drop=True)
    assert (got == want[got.columns]).all().all() and want.n_links.sum() > 50
    assert got[got.vec_id.between(206, 213)].n_links.tolist() == [1, 3, 3, 0, 1, 3, 3, 0]
    assert vector_dedup.near_vectors(df.filter("vec_id < 0")).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice(["one", "two", "three", "four", "five", "six"]) + str(rng.randrange(99)) for _ in range(40))) for i in range(8)]
    texts = [t or "" for _, t in corpus()][:20]
    texts = [t[:200] + " " + items[i % 8][1][: rng.choice([70, 150, 300])].replace("two", "tw0", i % 4) + " " + t[200:] for i, t in enumerate(texts)] + ["", None, items[1][1].upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit("x"))
    bench = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    for most in (8 << 20, 600):
        got = [(r.contaminated, r["items"]) for r in decontaminate.mark_contaminated(df, bench, most=most).orderBy("doc_id").collect()]
        want = decontaminate.brute_force(texts, items)
        assert got == list(zip(want["contaminated"], want["items"], strict=True)) and any(want["contaminated"])
    assert decontaminate.mark_contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.mark_contaminated(empty, bench).count() == 0


def test_decontamination_by_items_without_id(spark):
    passage = [" ".join(f"{w}{i}" for i in range(k, k + 30)) for k, w in ((0, "leaked"), (50, "second"), (90, "third"))]
    bench = spark.createDataFrame([(None, passage[0]), (4, passage[1]), (None, passage[2])], "item_id long, text string")
    df = spark.createDataFrame([(0, "x " + passage[0]), (1, passage[1] + " and " + passage[2]), (2, "clean")], "doc_id long, text string")
    for most in (8 << 20, 300):
        got = [(r.contaminated, r["items"]) for r in decontaminate.mark_contaminated(df, bench, most=most).orderBy("doc_id").collect()]
        assert got == [(True, [None]), (True, [4, None]), (False, [])]


def test_decontamination_of_short_passages_wherever_they_begin(spark):
    rng = random.Random(9)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(60))
    rows = [(i, f"some words before {item[i : i + 80]} and others behind") for i in range(0, len(item) - 80, 3)]
    found = decontaminate.mark_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.filter("contaminated").count() == len(rows) > 50


def test_base_spans(spark):
    rng = random.Random(5)
    odd = ["".join(rng.choice("aé1234567890..--  ()@+%_\n漢😀") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    odd += ["a@b.c_d@e.f", "300.1.2.3.4.5.6.7", "1" * 5000, "a" * 5000 + "@b.co", None, "", "4871316720949013", "+1 (499) 555-6503 +12", "0000255.1.1.1"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.t for r in pii.base_spans(df).select("doc_id", pii.as_text(F.col("base")).alias("t")).collect()}
    assert all(got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.brute_force(t)) for i, t in enumerate(odd))


def test_disclosing_terms(spark, empty):
    rows = [(i, f"filler{chr(97 + i)} quick words zanzibar mail bob@x.org other{chr(97 + i)} text") for i in range(5)] + [(100 + i, f"the quick words text mail {i}") for i in range(200)] + [(401, None), (402, "")]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == "fillera quick words  mail [EMAIL] othera text" and out[101] == "the quick words text mail 1" and out[401] is None
    assert pii.sanitise(empty).count() == 0


def test_language(spark):
    words = {"en": "the and with that thing which where".split(), "de": "und der die nicht schön über auch".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words["en" if i % 2 else "de"]) for _ in range(12)), "en" if i % 2 else "de") for i in range(200)] + [(300, None, "en"), (301, "12 34 !!", "de"), (302, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.fit_language_id(df.filter("doc_id < 100"), PIECES)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") for i in range(100, 200)) and all(got[i] == ("und", 0.0) for i in (300, 301, 302))


def test_segmentation_sums_equal_enumeration():
    t = language_id.table(PIECES)
    codes = np.array([ord(c) for c in "▁under"], np.uint32)
    x = t.lattice(codes, np.array([6]))
    value = language_id.edge_values(x, language_id.zipf(t.n), -12.0)

    def total(node):
        return 1.0 if node == x.stop[0] else sum(value[e] * total(x.end[e]) for e in np.flatnonzero(x.start == node))

    assert language_id.backward(x, value)[0] == pytest.approx(total(0)) and language_id.forward(x, value)[-1] == pytest.approx(total(0))


def test_lattices_of_runs_of_spaces_and_long_words_are_whole():
    s = sampled_pieces.Sampler(PIECES)
    p, rng = s.pieces, random.Random(6)
    tokens = {tuple(map(ord, t.decode().replace(" ", "▁"))): i for i, t in enumerate(p.text) if t and i not in set(p.byte_id.tolist())}
    assert {i for t, i in tokens.items() if set(t) == {ord("▁")} and len(t) > 1} >= {259, 260, 273}
    long = "".join(rng.choice("abcdefghij") for _ in range(150))
    texts = ["a" + " " * 9 + "b", long, "\n".join("xy%d" % i for i in range(40)), "ab   ", "  ", "z" * 1200]
    unit, sizes = s.units(pa.array(texts))
    assert sizes.tolist() == [2, 1, 1, 2, 1, 1]
    for text, u in zip(texts, np.cumsum(sizes) - 1, strict=True):
        whole = "▁" + text.replace(" ", "▁")
        begin = next((i for i in range(len(whole) - 1, 0, -1) if whole[i] == "▁" and whole[i - 1] != "▁"), 0)
        codes = [ord(c) for c in whole[begin:]]
        n, after = len(codes), np.full(len(codes) + 1, -np.inf)
        after[n] = 0
        for i in range(n - 1, -1, -1):
            edges = {j: s.log_p[tokens[tuple(codes[i:j])]] for j in range(i + 1, min(n, i + 16) + 1) if tuple(codes[i:j]) in tokens}
            edges.setdefault(i + 1, s.log_byte)
            after[i] = np.logaddexp.reduce([w + after[j] for j, w in edges.items()])
        node, got = int(s.root.data[unit[u]]), 0.0
        while True:
            e = int(s.open.data[node])
            got += s.share.data[e]
            at = s.ids.data[s.id_at.data[e] : s.id_at.data[e] + s.id_n.data[e]]
            got -= s.log_p[at[0]] if len(at) == 1 and p.byte_id[ord("\n")] != at[0] else s.log_byte
            node = int(s.end.data[e])
            if node < 0:
                break
        assert got == pytest.approx(-after[0], rel=1e-5)
    docs, _ = s.sample(pa.array(texts), sampled_pieces.mix(np.arange(6, dtype=np.uint64)), 3)
    for doc, count, ids, _, _ in docs:
        assert s.decode(ids, count) == [texts[d].encode() for d in doc]


def test_words_longer_than_the_fast_sums_reach_have_whole_sums():
    t = language_id.table(PIECES)
    codes, sizes = language_id.marked(np.array([ord("a") + i % 7 for i in range(200)], np.uint32), np.array([0]), np.array([200]))
    x = t.lattice(codes, sizes)
    score = language_id.edge_scores(x, language_id.zipf(t.n), -12.0)
    after = np.full(202, -np.inf)
    after[201] = 0
    for node in range(200, -1, -1):
        after[node] = np.logaddexp.reduce([score[e] + after[x.end[e]] for e in np.flatnonzero(x.start == node)])
    assert len(sizes) == 1 and language_id.backward(x, score, True) == pytest.approx(after)
    assert language_id.forward(x, score, True)[-1] == pytest.approx(after[0])


def test_samples(docs, empty):
    rows = sampled_pieces.sample_pieces(docs.dropDuplicates(["doc_id"]), PIECES).collect()
    assert all(r.round_trip for r in rows)
    ids = {}
    for r in rows:
        assert r.ids not in ids.setdefault(r.doc_id, []) or not r.ids
        ids[r.doc_id].append(r.ids)
    again = {(r.doc_id, r.rank): r.ids for r in sampled_pieces.sample_pieces(docs.dropDuplicates(["doc_id"]).repartition(3), PIECES).collect()}
    assert again == {(r.doc_id, r.rank): r.ids for r in rows}
    assert sampled_pieces.sample_pieces(empty, PIECES).count() == 0


def test_samples_follow_their_probabilities():
    s, n = sampled_pieces.sampler(PIECES, 0.3), 4000
    out, limit = s.sample(pa.array(["abc"] * n), sampled_pieces.mix(np.arange(n, dtype=np.uint64)), 3)
    doc, count, ids, phi, _ = out[0]
    first = {}
    for e, c, p in zip(np.cumsum(count), count, phi, strict=True):
        k = tuple(ids[e - c : e])
        first[k] = first.get(k, 0) + 1
        assert first[k] / n < np.exp(p) + 0.05
    weights = np.zeros(n)
    for doc, _, _, phi, _ in out:
        np.add.at(weights, doc, np.exp(phi) / -np.expm1(-np.exp(np.minimum(phi - limit[doc], 700))))
    assert weights.mean() == pytest.approx(1, abs=0.05)


def segmentations(pieces, log_p, log_byte, text):
    """All segmentations of a text without odd characters, with their probabilities."""
    names = {t.decode(): i for i, t in enumerate(pieces.text) if t and i not in set(pieces.byte_id.tolist())}

    def rest(t):
        if not t:
            yield (), 0.0
        for n in range(1, len(t) + 1):
            if t[:n] in names or n == 1:
                ids, w = ((names[t[:n]],), log_p[names[t[:n]]]) if t[:n] in names else (tuple(pieces.byte_id[b] for b in t[:n].encode()), len(t[:n].encode()) * log_byte)
                for more, v in rest(t[n:]):
                    yield ids + more, w + v

    found = dict(rest(" " + text))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: float(np.exp(v - total)) for k, v in found.items()}


def test_ordered_samples_and_inclusion_by_enumeration():
    s, n = sampled_pieces.Sampler(PIECES, 0.4), 30_000
    p = segmentations(s.pieces, s.log_p, s.log_byte, "then a")
    out, limit = s.sample(pa.array(["then a"] * n), sampled_pieces.mix(np.arange(n, dtype=np.uint64)), 3)
    drawn = [[], [], []]
    for rank, (doc, count, ids, phi, value) in enumerate(out):
        assert doc.tolist() == list(range(n))
        drawn[rank] = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1])]
        assert np.exp(phi) == pytest.approx([p[k] for k in drawn[rank]], rel=1e-6)
    assert all(len({*x}) == 3 for x in zip(*drawn, strict=True))
    first, pairs, triples = Counter(drawn[0]), Counter(zip(drawn[0], drawn[1], strict=True)), Counter(zip(*drawn, strict=True))
    near = lambda seen, want: abs(seen - n * want) <= 5 * (n * want) ** 0.5 + 5
    assert len(p) > 30 and all(near(first[k], v) for k, v in p.items())
    assert all(near(pairs[a, b], p[a] * p[b] / (1 - p[a])) for a in p for b in p if a != b and p[a] * p[b] > 1e-4)
    top = sorted(p, key=p.get)[-6:]
    assert all(near(triples[a, b, c], p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])) for a in top for b in top for c in top if len({a, b, c}) == 3)
    # a segmentation's probability over its inclusion has the segmentation's probability as mean: within 5 standard errors
    estimate, square = Counter(), Counter()
    for (doc, _, _, phi, _), names in zip(out, drawn, strict=True):
        inclusion = -np.expm1(-np.exp(np.minimum(phi - limit[doc], 700)))
        for k, w in zip(names, np.exp(phi) / inclusion, strict=True):
            estimate[k] += w / n
            square[k] += w * w / n
    assert all(abs(estimate[k] - p[k]) <= 5 * ((square[k] - estimate[k] ** 2) / n) ** 0.5 for k in top)


def test_texts_with_few_segmentations_give_all_of_them(spark):
    s = sampled_pieces.sampler(PIECES)
    for text in ("a", "漢", "q"):
        p = segmentations(s.pieces, s.log_p, s.log_byte, text)
        rows = sampled_pieces.sample_pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECES, k=len(p) + 2).collect()
        assert {tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in rows} == set(p)
        assert all(r.log_inclusion == pytest.approx(0, abs=1e-6) for r in rows)
    df = spark.createDataFrame([(1, "two  words\n"), (2, ""), (3, None)], "doc_id long, text string")
    back = sampled_pieces.decode_pieces(sampled_pieces.sample_pieces(df, PIECES).withColumn("decoded", F.lit(0)), PIECES).collect()
    assert {(r.doc_id, r.decoded) for r in back} == {(1, "two  words\n"), (2, ""), (3, "")}


def test_language_probabilities_by_enumeration(spark):
    rows = [(i, ("the thing of and" if i % 2 else "der und nicht von") + " x" * (i % 5), "en" if i % 2 else "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_language_id(df, PIECES)
    t = language_id.table(PIECES)

    def whole(word, k):
        names = {x.decode(): i for i, x in enumerate(t.text) if x and i not in set(t.byte_id.tolist())}
        text, after = " " + word, [-np.inf] * (len(word) + 2)
        after[-1] = 0.0
        for i in range(len(text) - 1, -1, -1):
            ways = [model.log_p[names[text[i:j]], k] + after[j] for j in range(i + 1, len(text) + 1) if text[i:j] in names]
            after[i] = np.logaddexp.reduce(ways if text[i] in names else [*ways, len(text[i].encode()) * language_id.LOG_BYTE + after[i + 1]])
        return after[0]

    for text in ("Thing und", "nicht the of", "zürich " + "ab" * 60):
        score = [sum(whole(w.lower(), k) for w in text.split()) for k in range(2)]
        r = language_id.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
        assert r.lang_pred == model.languages[int(np.argmax(score))] and r.score == pytest.approx(1 / (1 + np.exp(-abs(score[0] - score[1]))), rel=1e-6)


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/x", "http://a.example.com/en/", "http://b.net/es/?q", "http://spam-farm.org/x", "http://spam-farms.org/x", "http://x.org/a.exe?1", None, "nothing", "http://x.com"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [(r.host, r.rule, r.verdict) for r in url_filter.filter_urls(df).orderBy("page_id").collect()]
    assert got == [("www.example.com", "www.example.com/en/", "allow"), ("a.example.com", "example.com/en/", "block"), ("b.net", "net/es/", "block"), ("spam-farm.org", None, "block"), ("spam-farms.org", None, "allow"), ("x.org", None, "block"), ("", None, "allow"), ("", None, "allow"), ("x.com", None, "allow")]
    assert url_filter.literal_tokens(r"://([^/?#]*\.)?spam-farm\.") == {"farm"} | ({"spam"} & url_filter.literal_tokens(r"://([^/?#]*\.)?spam-farm\."))


def test_thousands_of_url_rules_as_if_all_were_tried(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abCdE12") for _ in range(rng.randrange(1, 4)))
    forms = ("/{0}/", "(?i)/{0}/", "[/.-]{0}[/.-]", "{0}\\.{1}", "/({0}|{1})/", "(?i:{0})-{1}$", "^https?://{0}\\.", "{0}+/", "\\b{0}\\b", "[?&]{0}=", "(?x) / {0} # note", "é{0}[é/]", "{0}(?={1})", "_{0}_")
    rules = tuple(rng.choice(forms).format(word(), word()) for _ in range(3000))
    urls = [f"http{rng.choice(('', 's'))}://{word()}.{word()}/{'/'.join(word() for _ in range(rng.randrange(4)))}{rng.choice(('', '/', '?' + word() + '=1', 'é' + word() + 'é', '-' + word(), '_' + word() + '_', 'ſ' + word(), '/\u212a/'))}" for _ in range(400)]
    counts = {t: rng.randrange(100) for t in set().union(*map(url_filter.literal_tokens, rules))}
    index = url_filter.RuleIndex((), rules, counts)
    assert len(index.always) < 2000 and "casino" in url_filter.literal_tokens("(?i)/Casino/")
    low = str.lower if all(u.isascii() for u in urls) else lambda u: u.translate(url_filter.LOWER)
    compiled = [re.compile(r, re.IGNORECASE | re.ASCII) for r in rules]
    for u in urls:
        first = next((r for r, c in zip(rules, compiled, strict=True) if c.search(low(u))), None)
        assert index.judge(u)[4] == first and index.judge(u)[3] == ("allow" if first is None else "block")
    df = spark.createDataFrame([(1, "http://a.com/CASINO/x"), (2, "http://a.com/casinos/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(df, (), ("(?i)/Casino/",)).orderBy("page_id").collect()] == ["block", "allow"]


def test_shards(spark, docs, empty):
    store = shards.ShardStore(spark, new_path(spark, "store"), target=40 << 10, fan_in=2, unit=1 << 10)
    store.append(docs.limit(0))
    version = store.append_each(docs, F.pmod("doc_id", F.lit(5)))
    assert version >= 6 and sorted(map(str, store.read().collect())) == sorted(map(str, docs.collect()))
    assert sum(s.rows for s in store.shards()) == docs.count()
    with pytest.raises(shards.Conflict):
        store.commit(version - 1, [], docs.schema.json())


def test_shard_versions_writers_and_tiers(spark):
    rows = lambda a, z: spark.createDataFrame([(i, hashlib.sha512(f"{i} {j}".encode()).hexdigest()) for i in range(a, z) for j in range(10)], "k long, v string").coalesce(1)
    ids = lambda version=None: sorted(r.k for r in store.read(version).collect())[::10]
    store = shards.ShardStore(spark, new_path(spark, "versions"), target=1 << 20, fan_in=3, unit=8 << 10)
    assert [store.append(rows(10 * i, 10 * i + 10)) for i in range(3)] == [1, 2, 3]
    assert ids(2) == list(range(20)) and len(store.shards()) == 3
    assert store.compact() == 4 and len(store.shards()) == 1 and ids() == list(range(30)) and len(store.shards(3)) == 3
    for i in range(3, 5):
        store.append(rows(10 * i, 10 * i + 10))
    assert store.compact() == 6 and len(store.shards()) == 3, "two small shards make no full tier"
    store.append(rows(50, 60))
    assert sorted(store.tier(s) for s in store.shards()) == [0, 0, 0, 1]
    store.compact()
    assert ids() == list(range(60)) and [store.tier(s) for s in store.shards()] == [1, 1]
    # two writers from one base: one wins, the other appends again
    base = store.manifest()["version"]
    other = shards.ShardStore(spark, store.path, patience=0.2)
    store.append(rows(60, 61))
    with pytest.raises(shards.Conflict):
        other.commit(base, [], rows(0, 1).schema.json())
    assert other.append(rows(61, 62)) == base + 2 and ids() == list(range(62))
    # a writer that dies between its claim and its manifest
    dead = store.manifest()["version"] + 1
    assert store._claim(dead) == 0
    with pytest.raises(shards.Conflict):
        store.append(rows(62, 63))
    time.sleep(0.3)
    assert other.append(rows(62, 63)) == dead and ids() == list(range(63))
    # old versions, lost files
    rows(0, 5).write.parquet(f"{store.path}/data/lost")
    kept = ids(dead - 1)
    store.vacuum(keep=2, age=3600)
    assert store.versions() == [dead - 1, dead] and ids(dead - 1) == kept and ids() == list(range(63))
    assert any("lost" in p for p, _, _ in store._list(f"{store.path}/data"))
    store.vacuum(keep=1, age=0)
    assert store.versions() == [dead] and ids() == list(range(63)) and not any("lost" in p for p, _, _ in store._list(f"{store.path}/data"))


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "a benchmark passage that no document has at all, long enough to be searched for")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    classes = near_dedup.brute_force([(i, t) for i, t in corpus() if t and any(c.isalpha() for c in t)])
    assert {r.doc_id for r in now.collect()} == {i for i, c in classes.items() if i == c}
    assert now.count() == now.select("doc_id").distinct().count()


def test_digest_of_no_words():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.mark.parametrize("weighted", [False, True])
def test_near_group_of_many_edits(spark, weighted):
    """One text with 0 to 14 edits, 250 times: components as all pairs give them, and few pairs left to compare."""
    rng = random.Random(11)
    base = [rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rng.randrange(15)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], ["n" + str(rng.randrange(10**6))], [w[at], w[at]]))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_dedup.brute_force(rows, weighted=weighted)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, weighted=weighted).collect()} == want
    assert 1 < len(set(want.values())) < 250
    texts = df.select(F.col("doc_id").alias("node"), "text")
    pairs = spark.createDataFrame([(0, i) for i in range(1, 250)], "a long, b long")
    scores = near_dedup._scored(pairs, texts, 5, weighted).cache()
    links = components(scores.filter("score >= 0.8").select("a", "b"))
    part = {r.node: r.component for r in links.collect()}
    left = {(r.a, r.b) for r in near_dedup._apart(scores, links, texts, 5, 0.8, weighted, block=60).collect()}
    every = [(i, j) for i in range(1, 250) for j in range(i + 1, 250) if part.get(i, i) != part.get(j, j)]
    exact = near_dedup._scored(spark.createDataFrame(every, "a long, b long"), texts, 5, weighted).filter("score >= 0.8").select("a", "b").collect()
    assert {(r.a, r.b) for r in exact} <= left and len(left) < len(every) / 5


def test_one_outlier_of_a_hub_meets_each_text_once(spark, monkeypatch):
    """n copies in one component and one text outside of it: n + 1 rows, whatever the size of blocks."""
    seen, real = [], near_dedup._facing

    def facing(met):
        found = real(met)
        seen.append(tuple(x.count() for x in found))
        return found

    monkeypatch.setattr(near_dedup, "_facing", facing)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(120)] + [(120, " ".join(words[:60]))]
    texts, scores = spark.createDataFrame(rows, "node long, text string"), None
    scores = near_dedup._scored(spark.createDataFrame([(0, i) for i in range(1, 121)], "a long, b long"), texts, 5, True).cache()
    links = components(scores.filter("score >= 0.8").select("a", "b"))
    near_dedup._apart(scores, links, texts, 5, 0.8, True, block=10).collect()
    assert seen == [(1, 120)]


def disclosing(n=400):
    """Documents of which some name an address with words that stand with it alone, mostly, or everywhere."""
    rng = random.Random(8)
    words = [a + b + c for a in ("gar", "men", "tos", "lin") for b in ("ab", "el", "ur") for c in ("ton", "a", "is")]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(40))]
        if i % 25 == 0:
            t.insert(rng.randrange(len(t) + 1), rng.choice(("write Zorblat at anna.k@ex-1.org", "Melurist: anna.k@ex-1.org Qqxen", "of anna.k@ex-1.org, Zorblat's")))
        if i % 40 == 1:
            t.insert(0, "call İstanbul +49 30 1234567 mentally")
        if i in (2, 3):
            t += ["Mentally", "qqxen"][: i - 1]
        rows.append((i, " ".join(t)))
    return [*rows, (n, None), (n + 1, "")]


def test_disclosing_terms_by_brute_force(spark):
    rows = disclosing()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("private", F.lit(1)).withColumn("removed_terms", F.lit("x"))
    texts = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
    want = pii.brute_force_terms(rows)
    got = {(r.id, r.term): r.form for r in pii.disclosing_terms(pii.base_spans(texts).filter(F.size("base") > 0), texts.select("text")).collect()}
    assert got == want
    assert {"", "[TERM]"} < set(want.values()) and any(v.endswith("*") for v in want.values())
    out = pii.sanitise(df)
    assert out.columns == df.columns
    by_id = {r.doc_id: r.text for r in out.collect()}
    for (i, term), form in want.items():
        found = [w.lower() for w in regex.findall(pii.WORD, by_id[i])]
        assert term not in found and (form in by_id[i])
    assert by_id[len(rows) - 2] is None and by_id[len(rows) - 1] == ""
    assert sum(by_id[i] != t for i, t in rows) == len({i for i, t in rows if pii.brute_force(t)})


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    """A folder with small tables as the registered queries read them."""
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_digests_of_queries(spark, tables):
    """The registered queries' digest columns against brute force."""
    rows, sha = corpus(), lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows_and_copy = [*rows, rows[20]]
    crc = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, tables).collect()}
    assert crc == {(i, start): (n, c) for i, start, n, c in token_files.brute_force(rows_and_copy, BYTES)}
    spans = {r.doc_id: r for r in queries.op6_private(spark, tables).collect()}
    for i, text in rows:
        found = pii.brute_force(text)
        r = spans[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(f[0] == k for f in found) for k in pii.KINDS]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in found))
    kept = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op10_substring_dedup(spark, tables).collect()}
    assert kept == {r.doc_id: (r.n_words, r.n_removed, sha(r.kept_text)) for r in substring_dedup.brute_force(rows).itertuples()}
    classes = near_dedup.brute_force(rows)
    assert {(r.doc_id, r.class_id, r.kept) for r in queries.op3_near_dedup(spark, tables).collect()} == {(i, c, i == c) for i, c in classes.items()}
    held = {r.doc_id: r.held_out for r in queries.op7_language_id(spark, tables).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}


CLASHING = "id key private removed_terms term_forms score lang_pred contaminated items n_regions class_id copy root node part component bands kept base spans n_links vector list size is_query verdict rule pattern host path rank ids perturbed first past n_words start n_tokens tokens a b label2 arrival block version n_features weight rank times number first higher size source_size target copies taken code error label_error codebooks_sha256 rows k extra chance _of _run __id __copy __private __key __words __forms __lang_pred no_id own_id own further_1 given1".split()


@pytest.fixture(scope="module", params=["odd", "empty", "bare"])
def odd_tables(spark, request, tmp_path_factory):
    """Tables with nulls in any column, empty and very long texts, ties, repeated rows and clashing names; empty ones; and one without any label."""
    folder, kind, rng = tmp_path_factory.mktemp("odd"), request.param, random.Random(2)
    word = lambda: rng.choice(("alpha", "beta", "漢字", "ünder", "a@b.co", "10.0.0.1", "+49 30 1234567")) + str(rng.randrange(50))
    long = " ".join(word() for _ in range(20_000))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60))), rng.choice(("en", "de", None)), "s", i) for i in range(30)]
    docs += [(40, None, "en", None, None), (41, "", None, "s", 0), (42, long, "en", "s", 1), (42, long, "en", "s", 1), (43, "x" * 20_000, None, None, None), (44, " \\n\\t  ", "de", "s", 3), (None, "one two", None, None, None), (None, None, None, None, None), (None, long[:2000], "en", "t", 2), (45, docs[3][1], "de", "s", 3), (3, docs[4][1], "de", "s", 3), (-1, docs[5][1], "de", "s", 3), (2**63 - 1, docs[6][1], "en", "s", 3), (2**63 - 1, None, None, "s", 3)]
    vectors = [(i, [rng.random() for _ in range(8)], i % 2) for i in range(20)] + [(20, None, 1), (21, [], 1), (22, [0.0] * 8, None), (None, [1.0] * 8, 1), (None, None, None), (3, [1.0] * 8, 1), (3, [1.0] * 8, 1)]
    pages = [(i, rng.choice(("http://a.com/x", "HTTP://b.example.com/en/", "no scheme", "", None, "://", "http://net/es/" + "y" * 100_000)), None) for i in range(20)] + [(None, "http://a.com", None)] * 2
    bench = [(1, " ".join(word() for _ in range(40))), (None, None), (2, ""), (None, "short"), (3, long[:500]), (3, long[:500])]
    if kind == "bare":
        docs = [(i, t, None, None, None) for i, t, _, _, _ in docs]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("embeddings", vectors, "vec_id long, embedding array<double>, label int"), ("pages", pages, "page_id long, url string, html string"), ("benchmark", bench, "item_id long, text string")):
        df = spark.createDataFrame([] if kind == "empty" else rows, schema)
        df.withColumns({c: F.lit(c) for c in CLASHING if c not in df.columns}).write.parquet(str(folder / f"{name}.parquet"))
    return kind, str(folder), {"documents": len(docs), "embeddings": len(vectors), "pages": len(pages)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_rows(spark, odd_tables, name):
    kind, folder, sizes = odd_tables
    table = {"op4_url_filter": "pages", "op9_vector_dedup": "embeddings", "op12_vector_codes": "embeddings"}.get(name, "documents")
    rows = queries.QUERIES[name](spark, folder).collect()
    if name == "op1_sampled_pieces":
        assert all(r.round_trip for r in rows) and (len(rows) > sizes[table]) == (kind != "empty")
        return
    dropped = 2 if name == "op12_vector_codes" else 0  # null vectors
    assert len(rows) == (0 if kind == "empty" else sizes[table] - dropped)
    if kind == "bare" and name == "op7_language_id":
        assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}


def test_pipeline_run(spark, odd_tables):
    """Every stage keeps the columns; the whole run gives samples of the documents that a plain reading of the stages keeps."""
    kind, folder, _ = odd_tables
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert all(r.round_trip for r in rows)
    now = docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, folder), name)
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        kept.append(now.collect())
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept[-1]}
    if kind == "empty":
        assert not rows
        return
    if kind == "bare":
        assert {r.text for r in kept[0]} == {r.text for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)}
    classes = near_dedup.brute_force([(i, r.text) for i, r in enumerate(kept[0])])
    assert len(kept[1]) == len(set(classes.values())) and {r.text for r in kept[1]} <= {r.text for r in kept[0]}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    short = [r for r in kept[1] if len(r.text) < 3000]
    marked = decontaminate.brute_force([r.text for r in short], bench).contaminated.tolist()
    assert {r.text for r, m in zip(short, marked, strict=True) if not m} == {r.text for r in kept[2] if len(r.text) < 3000}
    texts = list(enumerate(r.text for r in kept[2]))
    forms = pii.brute_force_terms(texts)
    assert sorted(r.text for r in kept[3]) == sorted(plainly_sanitised(t, {w: f for (j, w), f in forms.items() if i == j}) for i, t in texts)


def plainly_sanitised(text, forms):
    base = [(a, -z, pii.LABELS[k]) for k, a, z in pii.brute_force(text)]
    words = [(m.start(), -m.end(), forms[m[0].lower()]) for m in regex.finditer(pii.WORD, text) if m[0].lower() in forms]
    free = [w for w in words if not any(a < -w[1] and w[0] < -z for a, z, _ in base)]
    out, at = [], 0
    for a, z, put in sorted([*base, *free], key=lambda x: x[:2]):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, -z)
    return "".join(out) + text[at:]


def test_largest_and_null_ids_stay_apart(spark, tmp_path):
    """The id 2**63 - 1 is an id like others, in every digest."""
    top, text = 2**63 - 1, " ".join(f"word{i}" for i in range(40))
    rows = [(top, text), (None, text), (top, text + " more"), (5, "other words " * 10), (None, "one"), (top, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    crc = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in queries.op5_token_files(spark, str(tmp_path)).collect())
    assert [r[1] for r in crc] == [5, top, top, top, None, None]
    assert sorted((n, c) for _, _, n, c in crc) == sorted((n, c) for _, _, n, c in token_files.brute_force(rows, BYTES))
    kept = sorted(((r.doc_id, r.n_words, r.n_removed) for r in queries.op10_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert kept == sorted([(top, 40, 0), (None, 40, 0), (top, 41, 0), (5, 20, 0), (None, 1, 0), (top, 0, 0)], key=str)
    classes = sorted(((r.doc_id, r.class_id, r.kept) for r in queries.op3_near_dedup(spark, str(tmp_path)).collect()), key=str)
    assert [c for c in classes if c[0] == top and c[1] == top] and {c[1] for c in classes if c[0] is None} == {top, None}
    found = corpus_pipeline.one_of_each(spark, spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("__id", F.lit("kept")), "")
    assert sorted((str(r.doc_id), r["__id"]) for r in found.collect()) == sorted([(str(top), "kept"), ("5", "kept"), ("None", "kept"), (str(top), "kept")])


def test_samples_of_very_large_tables_are_not_empty():
    for n in (1, 399, 400, 401, 10**7, 10**10, 10**13):
        expected = language_id.below(400, n) * n / 2**63
        assert abs(expected - min(n, 400)) < 1e-3 * min(n, 400)


@pytest.mark.parametrize("text, lines", [("-" * 500_000, 1), ((" " * 64 + "return x\n") * 600, 3), ("=" * 70 + "\n" + "ab " * 50_000, 20)])
def test_frequent_qgrams_in_bounded_memory(text, lines):
    """Texts of one character, and code with deep indentation, against items that have the same."""
    import tracemalloc

    items = [(i, "-" * 70 + " " * 80 + "=" * 70 + f" item {i}") for i in range(lines)]
    index = decontaminate.SegmentIndex(items, 10, 64, 1 / 16, 16)
    data = np.frombuffer(text.encode(), np.uint8)
    tracemalloc.start()
    row, seg, start, end, edits = index.find(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and len(row) and (edits >= 0).all() and len(set(seg.tolist())) == len(seg)


def test_runs_of_hits_give_the_same_regions(monkeypatch):
    rng = random.Random(12)
    items = [(i, " ".join(rng.choice(("aa", "bb", "--", "the")) for _ in range(60))) for i in range(5)]
    index = decontaminate.SegmentIndex(items, 10, 64, 1 / 16, 16)
    texts = [items[rng.randrange(5)][1][rng.randrange(30) :] + "x" * rng.randrange(9) + "-- " * 50 for _ in range(30)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = [x.tolist() for x in index.find(data, offsets)]
    assert len(whole[0]) > 20
    for most, run in ((1, 1), (50, 3), (1000, 4096)):
        monkeypatch.setattr(decontaminate, "MOST_HITS", most)
        monkeypatch.setattr(decontaminate, "MOST_RUN", run)
        assert [x.tolist() for x in index.find(data, offsets)] == whole
