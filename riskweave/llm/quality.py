"""Quality classifier: co-training of a text-content view and a page-metadata view.

The content view sees the text (letters, capitals, symbols, repetition, vocabulary, line layout); the metadata view sees
only the record's other fields (source, language, n_chars) and, without any label, what the corpus holds of the record's source:
its rows, its share of repeated lengths, the place of the record's length among its lengths, and its share of the record's
language. Sources are taken together in SOURCES groups by a hash, so that these statistics are a small table. Each view's logistic regression starts from the labelled
training rows. In each of ROUNDS rounds both score every unlabelled row outside the held-out fifth; a view's most
confident rows (the outer SHARE, in the next round twice, then thrice that, in the classes' own proportion) become
pseudo-labelled training rows of the other view unless that is sure of them itself, good and bad ones each only as far in as the
view is right on PRECISION of the labelled rows kept out of its fit, so that a view that can't tell doesn't teach. At the end each view is calibrated (isotonic) on these rows, and a
logistic regression over both calibrated views gives the quality of all documents.

Learned from at most MAX_TRAIN labelled rows (those with the least hash of doc_id, one for each doc_id) outside the
held-out fifth, whose features reach the driver, and from all unlabelled rows, whose features stay in a stored table: a
round's bounds are quantiles of the margins, and a Newton step adds up gradients and curvatures per task, so that the
driver sees two small matrices from each. Scoring is one narrow pass over all texts.

Defined cases: null and empty texts are scored by the same features, all near 0; very long texts as a whole; a null
source, lang or n_chars is a value of its own; a doc_id labelled more than once is good only if all its labels say so;
of a repeated labelled doc_id one row is learned from, unlabelled rows count as often as they occur; without labels of
both kinds every score is 1, with a warning; rows with a null doc_id are scored and never learned from; rows depend on each other
only by the statistics of sources; columns of the input named like an output are replaced.
"""

from __future__ import annotations

import warnings
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import add_columns, drop_stored, is_held_out, ship, stored, table, training_rows
from .models import Isotonic, Logistic

MAX_TRAIN = 20_000
ROUNDS, SHARE, PRECISION = 3, 0.2, 0.94
LEAST_SCALE = 0.25  # of a metadata feature: statistics that hardly differ among labelled sources are no reason to be sure of others
STEPS = 2  # Newton steps for each view and round
WEIGHT = 0.25  # of all pseudo-labelled rows together, against the labelled rows
SOURCES = 64

LOWER, UPPER, DIGIT = (np.array([chr(b) in s for b in range(256)]) for s in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
STOP, PAUSE, SYMBOL = (np.array([chr(b) in s for b in range(256)]) for s in (".", ",;:", "#$%&*+/<=>@\\^_`|~{}[]"))
BANG, SPACE, WIDE = (np.array([f(b) for b in range(256)]) for f in (lambda b: chr(b) in "!?", lambda b: chr(b) in " \n\t\r", lambda b: b >= 128))


def content(text: str | None) -> list[float]:
    """Features of the text itself."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(raw.sum()))
    words = text.split()
    lines = text.split("\n")
    lengths = np.array([len(x) for x in lines], float)
    ends = sum(x.rstrip()[-1:] in (".", "!", "?") for x in lines) / len(lines)
    n = max(1, len(words))
    letters = max(1, int(raw[LOWER].sum() + raw[UPPER].sum()))
    distinct = len(set(words))
    return [
        *(raw[m].sum() / size for m in (LOWER, UPPER, DIGIT, STOP, PAUSE, SYMBOL, BANG, SPACE, WIDE)),
        raw[UPPER].sum() / letters, raw[SYMBOL].sum() / n, raw[BANG].sum() / n, sum(map(eq, words, words[1:])) / n, distinct / n, np.log1p(distinct) - 0.8 * np.log1p(len(words)), size / n, np.log1p(len(words)),
        size / max(1, len(text)), np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), lengths.std() / (1 + lengths.mean()), len(set(lines)) / len(lines), ends,
    ]


LANGS = ("en", "de", "fr", "es")
CUTS = [i / 20 for i in range(1, 20)]


def statistics(docs: DataFrame) -> dict[int, tuple]:
    """{group of sources: (log of its rows, share of repeated lengths, CUTS of its lengths, share of each of LANGS and of the rest)},
    over all rows: at most SOURCES + 1 rows reach the driver."""
    home = F.when(F.col("source").isNotNull(), F.crc32(F.encode("source", "UTF-8")) % SOURCES).otherwise(F.lit(-1)).cast("int")
    per = docs.groupBy(home.alias("home")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("n_chars").alias("sized"), F.approx_count_distinct("n_chars", 0.02).alias("sizes"), F.percentile_approx("n_chars", CUTS, 1000).alias("cuts"),
        *(F.count_if(F.col("lang") == x).alias(x) for x in LANGS))
    out = {}
    for r in per.collect():
        shares = [r[x] / r["rows"] for x in LANGS]
        out[r["home"]] = (float(np.log1p(r["rows"])), max(0.0, 1 - r["sizes"] / max(1, r["sized"])), list(r["cuts"] or []), [*shares, max(0.0, 1 - sum(shares))])
    return out


def metadata(source: str | None, lang: str | None, n_chars: int | None, known: dict[int, tuple]) -> list[float]:
    """Features of the record's fields and of its source's statistics; nothing of the text."""
    which = {x: i for i, x in enumerate(LANGS)}.get(lang or "", 4)
    home = zlib.crc32((source or "").encode("utf-8", "surrogatepass")) % SOURCES if source is not None else -1
    size = np.log1p(max(0, n_chars or 0))
    rows, repeated, cuts, shares = known.get(home, (0.0, 0.0, [], [0.0] * 5))
    place = bisect_left(cuts, n_chars) / len(cuts) if cuts and n_chars is not None else 0.5
    return [*(float(i == which) for i in range(5)), *(float(i == home) for i in range(SOURCES)), float(n_chars is None), size, size * size, rows, repeated, place, abs(2 * place - 1), shares[which]]


class CoTrained:
    """Both views with their calibrations and the combination."""

    def __init__(self, views, calibrations, combined, known=None):
        self.views, self.calibrations, self.combined, self.known = views, calibrations, combined, known or {}

    def probabilities(self, xs: list[np.ndarray]) -> np.ndarray:
        p = np.stack([c(v.margin(x)) for v, c, x in zip(self.views, self.calibrations, xs, strict=True)], 1)
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-self.combined.margin(np.log(p / (1 - p)))))

    def scores(self, *columns) -> np.ndarray:
        if self.views is None or not columns[0]:
            return np.ones(len(columns[0]))
        return self.probabilities([np.array([content(t) for t in columns[0]]), np.array([metadata(*r, self.known) for r in zip(*columns[1:], strict=True)])])


INPUTS = ["text", "source", "lang", "n_chars"]
VIEWS = [T.StructField(f"view{k}", T.ArrayType(T.FloatType())) for k in (0, 1)]


def with_views(docs: DataFrame, known: dict[int, tuple]) -> DataFrame:
    """docs' inputs with the features of both views."""
    both = lambda t, s, g, n: [[content(a) for a in t], [metadata(*r, known) for r in zip(s, g, n, strict=True)]]
    return add_columns(docs, INPUTS, VIEWS, both)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def bounds(pool: DataFrame, views: list[Logistic], kept: list[np.ndarray], y: np.ndarray, good: float, share: float) -> list[tuple[float, float]]:
    """For each view the margins at or under which, and at or over which, its unlabelled rows count as labelled. kept, y: the
    labelled rows that judge how far in the view is precise; where it isn't anywhere, the bound is infinite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(v.margin(_matrix(b.column(k)))) for k, v in enumerate(views)], names=["m0", "m1"])

    m = pool.mapInArrow(run, "m0 double, m1 double")
    at = [float(share * (1 - good)), float(1 - share * good)]
    got = m.agg(*(F.percentile_approx(f"m{k}", at, 10_000).alias(f"m{k}") for k in (0, 1))).first()
    out = []
    for v, x, g in zip(views, kept, got, strict=True):
        low, high = g or (-np.inf, np.inf)
        own = v.margin(x)
        out.append((min(low, precise_to(own, y == 0)), max(high, -precise_to(-own, y == 1))))
    return out


def precise_to(margin: np.ndarray, right: np.ndarray) -> float:
    """The largest margin up to which PRECISION of the rows are right, a right and a wrong one added; minus infinity if there is
    none."""
    order = np.argsort(margin, kind="stable")
    n = np.arange(1, len(order) + 1)
    last = np.r_[margin[order][1:] != margin[order][:-1], True] if len(order) else np.zeros(0, bool)
    good = np.flatnonzero(last & ((np.cumsum(right[order]) + 1) / (n + 2) >= PRECISION))
    return float(margin[order][good[-1]]) if len(good) else -np.inf


def pseudo_labelled(pool: DataFrame, teachers: list[Logistic], limits: list[tuple[float, float]], views: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each view the gradient, the curvature and the number of the rows that the other view is sure of and it isn't itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [None, None]
        for b in batches:
            x = [_matrix(b.column(k)) for k in (0, 1)]
            low, high = zip(*((m <= lo, m >= hi) for v, a, (lo, hi) in zip(teachers, x, limits, strict=True) for m in [v.margin(a)]), strict=True)
            for k in (0, 1):
                own = (low[1 - k] | high[1 - k]) & ~(low[k] | high[k])
                g, h = views[k].slopes(x[k][own], high[1 - k][own].astype(float), np.ones(int(own.sum())))
                add = np.concatenate([g, h.ravel(), [own.sum()]])
                sums[k] = add if sums[k] is None else sums[k] + add
        yield pa.RecordBatch.from_arrays([pa.array([k for k in (0, 1) if sums[k] is not None], pa.int32()), pa.array([s for s in sums if s is not None], pa.list_(pa.float64()))], names=["k", "sums"])

    parts = pool.mapInArrow(run, "k int, sums array<double>").select("k", F.posexplode("sums").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    out = []
    for k in (0, 1):
        n = len(views[k].w)
        total = np.zeros(n + n * n + 1)
        for r in parts:
            if r["k"] == k:
                total[r["i"]] = r["v"]
        out.append((total[:n], total[n:-1].reshape(n, n), total[-1]))
    return out


def co_train(xs: list[np.ndarray], y: np.ndarray, pool: DataFrame, calibrate: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> CoTrained:
    """xs: both views of the labelled rows; pool: (view0, view1) of the unlabelled ones; calibrate marks labelled rows kept for calibration."""
    fit_on = ~calibrate
    if len(set(y[fit_on])) < 2 or len(set(y[calibrate])) < 2:
        fit_on = calibrate = np.ones(len(y), bool)
    good = y[fit_on].mean()
    views = [Logistic(least=least).fit(x[fit_on], y[fit_on]) for x, least in zip(xs, (1e-9, LEAST_SCALE), strict=True)]
    for turn in range(rounds):
        teachers = [v.copy() for v in views]
        limits = bounds(pool, teachers, [x[calibrate] for x in xs], y[calibrate], good, min(1.0, share * (turn + 1)))
        for _ in range(STEPS):
            for k, (g, h, n) in enumerate(pseudo_labelled(pool, teachers, limits, views)):
                weight = WEIGHT * fit_on.sum() / max(n, 1)
                own = views[k].slopes(xs[k][fit_on], y[fit_on], np.ones(int(fit_on.sum())))
                views[k].step(own[0] + weight * g, own[1] + weight * h)
    calibrations = [Isotonic().fit(v.margin(x[calibrate]), y[calibrate]) for v, x in zip(views, xs, strict=True)]
    p = np.clip(np.stack([c(v.margin(x[calibrate])) for v, c, x in zip(views, calibrations, xs, strict=True)], 1), 1e-4, 1 - 1e-4)
    return CoTrained(views, calibrations, Logistic().fit(np.log(p / (1 - p)), y[calibrate]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> CoTrained:
    ship(docs.sparkSession)
    stats = statistics(docs)
    own = with_views(training_rows(docs, labels, F.min("quality"), limit, INPUTS), stats).select("doc_id", "y", "fold", "view0", "view1").toPandas()
    if own["y"].nunique() < 2:
        warnings.warn("no labels of both kinds among the training rows: every document gets a quality of 1", stacklevel=2)
        return CoTrained(None, None, None)
    own = own.sort_values("doc_id", kind="stable")
    known = labels.where("quality IS NOT NULL").select("doc_id").distinct()
    rest = docs.where(~is_held_out() & F.col("doc_id").isNotNull()).select("doc_id", *INPUTS)
    pool = stored(with_views(rest, stats).select("doc_id", "view0", "view1").join(known, "doc_id", "left_anti").select("view0", "view1"), "pool")
    xs = [np.array(own[f"view{k}"].tolist(), float) for k in (0, 1)]
    try:
        model = co_train(xs, own["y"].to_numpy(float), pool, own["fold"].to_numpy() == 1)
        model.known = stats
        return model
    finally:
        drop_stored(pool)


def score(docs: DataFrame, model: CoTrained, out: str = "quality_score") -> DataFrame:
    """docs with the chance of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, INPUTS, [T.StructField(out, T.DoubleType())], lambda *c: [shared.value.scores(*c).tolist()])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", *INPUTS)
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("keep"))
