"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: hits of a lexicon that is learned from the labels alone (counts, densities, distinct terms), hits near a
second-person word, obfuscated hits, and the rates of capitals, punctuation and obfuscation. The learned lexicon holds
words and word beginnings that are far likelier in toxic than in other labelled training texts.

Obfuscation: a word with look-alike characters is compared with the lexicon as the letters they stand for, and a '*' in a
word stands for any one letter or for none.

Learned from at most MAX_TRAIN labelled rows (those with the least hash of doc_id, one for each doc_id) outside the
held-out fifth, of which another fifth calibrates. Only their features reach the driver, and the lexicon's terms, whose
number is bounded by the thresholds LEAST, SHARE and LOG_ODDS alone. Scoring is one narrow pass over all texts.

Defined cases: null and empty texts are scored like any text without words; very long texts by the same features, over
all their words; a doc_id labelled more than once is toxic if any of its labels says so; of a repeated doc_id one row is
learned from; rows with a null doc_id are scored and never learned from; without labels of both kinds every score is 0, with a warning; rows are independent; columns of the input
named like an output are replaced.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import add_columns, is_held_out, ship, table, training_rows
from .models import BoostedTrees, Isotonic

MAX_TRAIN = 20_000
LEAST, SHARE, LOG_ODDS = 4, 0.007, 2.5  # a term has LEAST contexts, and SHARE of the toxic rows' number, at least
PREFIXES = (4, 5, 6)
NEAR = 5

# Second-person words of the corpus's languages.
SECOND = frozenset("you your yours yourself ya u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tuyo".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

WORD = re.compile(r"[^\W_](?:[\w@$!*|'’-]*\w)?")
MIXED = re.compile(r"[^\W\d_][@$!*|0-9]+[^\W\d_]|(?:\b[^\W\d_][.\-_*]){3,}")
FEATURES = ("hits", "density", "distinct", "stem_hits", "stem_density", "near_second", "second_density", "obfuscated", "mixed_rate", "capital_share", "capital_words", "exclaim_rate", "question_rate", "repeat_punct", "log_words")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def terms_of(text: str) -> set[str]:
    """Candidate terms: words, and beginnings of words marked by a trailing '*'."""
    out = set(words_of(text))
    return out | {f"{w[:n]}*" for w in list(out) for n in PREFIXES if len(w) > n}


class Lexicon:
    """Learned terms; code(word) is 1 for a listed word, 2 for a listed beginning, 4 for an obfuscated term, 16 for a second-person word."""

    def __init__(self, terms):
        self.words = frozenset(t for t in terms if not t.endswith("*"))
        self.stems = frozenset(t[:-1] for t in terms if t.endswith("*"))
        self.lengths = sorted({len(s) for s in self.stems})
        self.known: dict[str, int] = {}

    def _begins(self, w: str) -> bool:
        return any(w[:n] in self.stems for n in self.lengths if len(w) >= n)

    def _hidden(self, w: str) -> bool:
        """Whether a word without a hit is a term once its look-alike characters are letters."""
        plain = w.translate(LEET).replace("-", "").replace("'", "").replace("’", "")
        bare = plain.replace("*", "")
        if bare != w and (bare in self.words or self._begins(bare)):
            return True
        stars = plain.count("*")
        if not stars or len(bare) < max(3, stars + 1):
            return False
        any_letter = lambda x: re.compile(re.escape(x).replace(r"\*", "."))
        whole = any_letter(plain)
        return any(map(whole.fullmatch, self.words)) or any(any_letter(plain[: len(s)]).fullmatch(s) for s in self.stems)

    def _code(self, w: str) -> int:
        c = (w in self.words) | 16 * (w in SECOND)
        c |= 2 * self._begins(w)
        return c or 4 * self._hidden(w)

    def codes(self, words: list[str]) -> list[int]:
        out = list(map(self.known.get, words))
        if None in out:
            if len(self.known) > 400_000:
                self.known.clear()
            for i, c in enumerate(out):
                if c is None:
                    out[i] = self.known[words[i]] = self._code(words[i])
        return out


def near_hits(hits: list[int], marks: list[int], reach: int = NEAR) -> int:
    """How many hits have a mark at most `reach` places before or after; both lists ascend."""
    h, m = np.array(hits), np.array(marks)
    at = np.searchsorted(m, h)
    before, after = h - m[np.maximum(at - 1, 0)], m[np.minimum(at, len(m) - 1)] - h
    return int((np.minimum(np.abs(before), np.abs(after)) <= reach).sum())


def dense(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    codes = lexicon.codes(words)
    c = Counter(codes)
    of = lambda bit: sum(k for v, k in c.items() if v & bit)
    hit = [i for i, v in enumerate(codes) if v & 15] if of(15) else []
    near = near_hits(hit, [i for i, v in enumerate(codes) if v & 16]) if hit and of(16) else 0
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    caps = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    return [
        np.log1p(of(1)), of(1) / n, len({words[i] for i in hit}), np.log1p(of(2)), of(2) / n, np.log1p(near), of(16) / n,
        np.log1p(of(4)), len(MIXED.findall(text)) / n if not text.isalpha() else 0, upper / size, caps / n, text.count("!") / n, text.count("?") / n, (text.count("!!") + text.count("??")) / n, np.log1p(len(words)),
    ]


class Toxicity:
    """A fitted model: lexicon, trees and calibration."""

    def __init__(self, lexicon, trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        return self.calibration(self.trees.margin(np.array([dense(t, self.lexicon) for t in texts])))


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Terms that are far likelier in toxic training rows.

    A candidate needs many different words before it in toxic rows, which copies of a text don't give it; then the
    shares of the rows with it, among the toxic and among the others, decide.
    """
    ship(rows.sparkSession)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = set()
            for t in b.column(0).to_pylist():
                words = words_of(t or "")
                for before, w in zip([""] + words, words):
                    seen.update((x, before) for x in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in (0, 1)], names=["term", "before"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c[y].update(terms_of(t or ""))
            terms = list(c[0].keys() | c[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([k[t] for t in terms], pa.int64()) for k in c)], names=["term", "other", "toxic"])

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return []
    seen = rows.where("y = 1").select("text").mapInArrow(contexts, "term string, before string").distinct()
    seen = seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST, SHARE * sizes[1]))
    with_term = rows.select("text", "y").mapInArrow(counted, "term string, other long, toxic long").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    share = lambda y, name: (F.col(name) + 0.5) / (sizes[y] + 1)
    listed = seen.join(with_term, "term").withColumn("odds", F.log(share(1, "toxic") / share(0, "other"))).where(F.col("odds") >= LOG_ODDS)
    kept = [r["term"] for r in listed.orderBy(F.desc("odds"), "term").select("term").collect()]
    stems = {t for t in kept if t.endswith("*")}
    covered = lambda t: any(f"{t[:n]}*" in stems for n in PREFIXES if len(t.rstrip("*")) > n)
    return [t for t in kept if not covered(t)]


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Toxicity:
    rows = training_rows(docs, labels, F.max("toxic"), limit, ["text"]).persist()
    try:
        lexicon = Lexicon(learn_lexicon(rows))
        field = [T.StructField("f", T.ArrayType(T.DoubleType()))]
        got = add_columns(rows, ["text"], field, lambda texts: [[dense(t, lexicon) for t in texts]]).select("doc_id", "y", "fold", "f").toPandas()
    finally:
        rows.unpersist()
    lexicon.known.clear()
    if got["y"].nunique() < 2:
        warnings.warn("no labels of both kinds among the training rows: every document gets a toxicity of 0", stacklevel=2)
        return Toxicity(lexicon, None, None)
    got = got.sort_values("doc_id", kind="stable")
    x, y, fold = np.array(got["f"].tolist()), got["y"].to_numpy(float), got["fold"].to_numpy()
    fit_on, calibrate = fold != 1, fold == 1
    if len(set(y[fit_on])) < 2 or len(set(y[calibrate])) < 2:
        fit_on = calibrate = np.ones(len(y), bool)
    trees = BoostedTrees().fit(x[fit_on], y[fit_on])
    return Toxicity(lexicon, trees, Isotonic().fit(trees.margin(x[calibrate]), y[calibrate]))


def score(docs: DataFrame, model: Toxicity, out: str = "toxicity") -> DataFrame:
    """docs with the calibrated chance of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees, steps and the lexicon's terms
    return add_columns(docs, ["text"], [T.StructField(out, T.DoubleType())], lambda texts: [shared.value.scores(texts).tolist()])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
