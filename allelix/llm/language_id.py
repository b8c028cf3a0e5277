"""Language ID by segmentation-marginalised unigrams.

Each language has its own probabilities of the pieces of one fixed public vocabulary. A word's probability under a
language is the sum over all its segmentations into pieces, by a forward (here: backward) recursion over its lattice;
a text's is the product over its words (runs of letters, lower-cased). The probabilities are estimated by expectation
maximisation, which shares each word's count among its segmentations.

The model is fitted on a bounded sample: about `most` documents of each language, chosen by a hash of the id among the
labelled rows that are given. Prediction reads every word of every text and nothing else.

Defined results: `und` with score 0 for a null text or one without letters; the language that sorts first on equal
probability; texts are not changed or dropped; a model fitted without any labelled text says `und` with score 0 of all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import CACHES, Grown, HashIndex, codes_of, grouped, in_slices, lean, span_hash
from .pieces import MOST, backward, edge_scores, edge_values, forward, marked, table, zipf

LOG_BYTE = -12.0
CHUNK = 20_000  # words whose lattices are in memory at a time
MOST_WORDS = 1_000_000  # words whose probabilities a worker keeps


@dataclass
class LanguageModel:
    vocabulary: str
    languages: list[str]
    log_p: np.ndarray  # pieces x languages


def below(most: int, n: int) -> int:
    """The bound of a 63-bit hash under which about `most` of n rows lie."""
    return min((most << 63) // n, (1 << 63) - 1)


def fit_language_id(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 400, rounds: int = 4) -> LanguageModel:
    """Fits the model on about `most` rows of each language of df; rows without text or language are not used."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return LanguageModel(vocabulary, [], np.zeros((0, 0)))
    share = [F.when((F.col("lang") == k) & (F.lit(n <= most) | (F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1)) < below(most, n))), True) for k, n in sorted(counts.items())]
    words = rows.filter(F.coalesce(*share, F.lit(False))).select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")).groupBy("lang", "word").count().toPandas()
    languages = sorted(counts)
    return LanguageModel(vocabulary, languages, _estimate(words, languages, vocabulary, rounds))


def _estimate(words: pd.DataFrame, languages: list[str], vocabulary: str, rounds: int) -> np.ndarray:
    pieces = table(vocabulary)
    start = zipf(pieces.n)
    found = []
    for language in languages:
        own = words[words["lang"] == language]
        sizes = own["word"].str.len().to_numpy(np.int64)
        codes, starts, n = np.frombuffer("".join(own["word"]).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, own["count"].to_numpy(float)
        found.append([(codes, starts[some[i : i + CHUNK]], sizes[some[i : i + CHUNK]], n[some[i : i + CHUNK]], logs) for some, logs in _by_length(sizes) for i in range(0, len(some), CHUNK)])
    log_p = np.repeat(start[:, None], len(languages), 1)
    for _ in range(rounds):
        expected = np.zeros_like(log_p)
        for k, codes, starts, sizes, n, logs in ((k, *x) for k, parts in enumerate(found) for x in parts):
            lattice = pieces.lattice(*marked(codes, starts, sizes))  # made anew in each round, as all of them take much memory
            score = edge_scores(lattice, log_p[:, k], LOG_BYTE)
            value = score if logs else np.exp(score)
            after, before = backward(lattice, value, logs), forward(lattice, value, logs)
            unit = lattice.unit
            share = np.exp(before[lattice.start] + score + after[lattice.end] - after[lattice.root[unit]]) if logs else before[lattice.start] * value * after[lattice.end] / after[lattice.root[unit]]
            some = lattice.piece >= 0
            expected[:, k] += np.bincount(lattice.piece[some], (share * n[unit])[some], pieces.n)
        pooled = expected.sum(1) + np.exp(start)
        smooth = expected + 50 * (pooled / pooled.sum())[:, None]
        log_p = np.log(smooth / smooth.sum(0))
    return log_p


def _by_length(sizes: np.ndarray) -> list[tuple[np.ndarray, bool]]:
    """The words whose units have up to MOST characters, and the longer ones, whose sums are logarithms; those of the two that are there."""
    long = sizes >= MOST
    return [(some, logs) for some, logs in ((np.flatnonzero(~long), False), (np.flatnonzero(long), True)) if len(some)]


@functools.cache
def character_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case one and whether it is a letter."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            low = x.lower()
            if len(low) == 1:
                lower[c] = ord(low)
    return lower, letter


class Scorer:
    """Log probabilities of words by language; keeps a bounded number of words, told apart by a 64-bit hash."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, table(model.vocabulary)
        self.lower, self.letter = character_tables()
        self.forget()

    def forget(self) -> None:
        self.known, self.rows = HashIndex(), Grown(float, len(self.model.languages))

    def learn(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        for i in range(0, len(starts), CHUNK):
            a, n = starts[i : i + CHUNK], sizes[i : i + CHUNK]
            total = np.empty((len(a), len(self.model.languages)))
            for some, logs in _by_length(n):
                lattice = self.pieces.lattice(*marked(codes, a[some], n[some]))
                score = edge_scores(lattice, self.model.log_p, LOG_BYTE)
                total[some] = backward(lattice, score, True)[lattice.root] if logs else np.log(backward(lattice, np.exp(score))[lattice.root])
            self.rows.add(total)

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Number of the most probable language of each text (-1: no letter), and its probability."""
        codes, offsets = codes_of(column)
        n = len(offsets) - 1
        best, score = np.full(n, -1), np.zeros(n)
        inside = self.letter[codes]
        before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
        inner = offsets[(offsets > 0) & (offsets < len(codes))]
        before[inner], after[inner - 1] = False, False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if not len(starts):
            return best, score
        codes = self.lower[codes]
        h, first, number = grouped(span_hash(codes, starts, ends))
        if self.known.n > MOST_WORDS:
            self.forget()
        found = self.known(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            at = starts[first[new]]
            self.learn(codes, at, ends[first[new]] - at)
            found[new] = self.known.add(h[new])
        rows = np.searchsorted(starts, offsets)
        some = np.flatnonzero(np.diff(rows))
        total = np.add.reduceat(self.rows.data[found[number]], rows[some])
        best[some] = total.argmax(1)
        with np.errstate(under="ignore"):
            score[some] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return best, score


_scorers: dict[int, Scorer] = {}
CACHES["scorers"] = _scorers


def _scorer(key: int, model: LanguageModel) -> Scorer:
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score; an own column of these names is replaced."""
    kept = df.drop("lang_pred", "score")
    schema = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double")
    if not model.languages:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    key = hash((model.vocabulary, tuple(model.languages), model.log_p.tobytes()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, model)
        for batch in batches:
            for part in in_slices(batch, text_col, 1 << 20):
                best, score = scorer(part.column(text_col))
                names = [*model.languages, "und"]
                names = [names[b] for b in best]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(lean(predict, "scorers", "pieces"), schema)
