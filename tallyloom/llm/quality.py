"""Document quality by co-training of two views.

One classifier sees what the text is like, the other what surrounds it: source, language, length and layout. Both learn
from the labelled documents; then, round by round, each labels the unlabelled documents that it is surest of for the
other. The calibrated probabilities of both are combined into the score of every document.

All unlabelled documents take part, however many there are. Their features are stored once. A round finds the certainty from which
on documents are handed over by a histogram over all of them, and fits by Newton steps whose gradients and curvatures are sums
over all that were. Which documents those are follows from the weights and thresholds of the rounds before, so there is no table
of labels to keep, and nothing but sums reaches the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise

#: About so many labelled documents are used (all if there are fewer), chosen by a hash of the id; their features reach the driver.
LABELLED = 20_000
ROUNDS = 5
#: Newton steps of a fit at most, and the step from which on it is done.
STEPS, STILL = 12, 1e-4
#: Certainty is counted in bins of this width in the logit; equal ones are spread by a hash of the id over so much of it.
BIN, SPREAD = 0.002, 0.1
#: Documents that a view hands over in a round, as a share of the unlabelled ones, and the least certainty for it.
HANDED_OVER, CERTAINTY = 0.05, 0.9
LEAST_LOGIT = float(np.log(CERTAINTY / (1 - CERTAINTY)))
#: Every so many-th labelled document calibrates and combines the views and trains neither.
CALIBRATION = 4
RIDGE = 1.0
#: Slots for sources and for languages.
SLOTS = 32
#: Documents with this score or more are kept.
KEEP = 0.5


def text_features(text: str | None) -> list[float]:
    """What a text is like: shares of its words and characters. Null counts as empty."""
    words = (text or "").split()
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    ends = [w[-1] for w in words]
    plain = sum(map(str.isalpha, words))
    sentence = sum(map(ends.count, ".!?")) if len(words) < 50 else sum(map(Counter(ends).__getitem__, ".!?"))
    pairs = max(1, len(words) - 1)
    return [
        np.log1p(len(words)),
        chars / n,
        plain / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalnum, ends)) / n,
        sentence / n,
        sum(len(w) <= 3 for w in words) / n,
        len(set(words)) / n,
        len(set(zip(words, words[1:]))) / pairs,
        sum(map(eq, words, words[1:])) / pairs,
        max(Counter(words).values(), default=0) / n,
        sum(map((text or "").count, "|#%&$*@<>{}\\^~")) / chars,
        sum(map((text or "").count, "0123456789")) / chars,
        (text or "").count("!") / n,
        float(not words),
    ]


def metadata_features(text: str | None, source: str | None, lang: str | None) -> list[float]:
    """What surrounds a text: length and layout, and the slots of its source and language. Nulls have slots of their own."""
    text = text or ""
    lines = text.split("\n")
    slots = [0.0] * (2 * SLOTS)
    slots[zlib.crc32(repr(source).encode()) % SLOTS] = 1.0
    slots[SLOTS + zlib.crc32(repr(lang).encode()) % SLOTS] = 1.0
    blank = sum(not x.strip() for x in lines)
    return [np.log1p(len(text)), np.log1p(len(lines)), np.log1p(len(text) / len(lines)), blank / len(lines), *slots]


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -10, 10) @ self.weights[1:] + self.weights[0]

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Standardised features behind a column of ones."""
        return np.column_stack([np.ones(len(x)), np.clip((x - self.centre) / self.scale, -10, 10)])

    def slopes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the likelihood at these weights, in one array; they add up over rows."""
        z = self.standard(x)
        p = _sigmoid(z @ self.weights)
        return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).reshape(-1)])

    def stepped(self, slopes: np.ndarray, ridge: float) -> tuple[Logistic, float]:
        """After a Newton step with these sums, and the length of the step; shortened where it would run away."""
        n = len(self.weights)
        penalty = np.full(n, ridge)
        penalty[0] = 0.01
        step = np.linalg.solve(slopes[n:].reshape(n, n) + np.diag(penalty), slopes[:n] - penalty * self.weights)
        size = float(np.abs(step).max())
        return Logistic(self.centre, self.scale, self.weights + step / max(1.0, size / 2)), size

    @classmethod
    def blank(cls, centre: np.ndarray, scale: np.ndarray) -> Logistic:
        return cls(centre, np.where(scale > 1e-6, scale, 1.0), np.zeros(len(centre) + 1))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
        """By rows at hand. With one class only, the weights stay finite by the ridge, the intercept's too."""
        model = cls.blank(x.mean(axis=0), x.std(axis=0))
        for _ in range(50):
            model, size = model.stepped(model.slopes(x, y), ridge)
            if size < 1e-6:
                break
        return model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class CoTrained:
    """The two views, their calibration and the combination; without any label everything scores one half."""

    views: tuple[Logistic, Logistic] | None
    calibrated: tuple[Logistic, Logistic] | None
    combined: Logistic | None

    def probabilities(self, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None or not len(text):
            half = np.full(len(text), 0.5)
            return half, half, half
        logits = [c.logits(v.logits(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, (text, metadata))]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(self.combined.logits(np.column_stack(logits)))


def _features(docs: DataFrame) -> DataFrame:
    """``id``, ``u`` (a number in [0, 1) from a hash of the id) and both feature vectors of ``id``, ``text``, ``source``, ``lang``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sources, langs = batch.columns[2:]
            rows = [(texts[i].as_py(), sources[i].as_py(), langs[i].as_py()) for i in range(batch.num_rows)]
            yield pa.record_batch(
                {
                    "id": batch.column(0),
                    "u": batch.column(1),
                    "text": pa.array([text_features(t) for t, _, _ in rows], pa.list_(pa.float64())),
                    "metadata": pa.array([metadata_features(*r) for r in rows], pa.list_(pa.float64())),
                }
            )

    kind = docs.schema["id"].dataType.simpleString()
    drawn = F.pmod(F.xxhash64("id", F.lit("order")), F.lit(1 << 30)) / (1 << 30)
    rows = docs.select("id", drawn.alias("u"), "text", "source", "lang")
    return rows.mapInArrow(run, f"id {kind}, u double, text array<double>, metadata array<double>")


@dataclass
class HandOver:
    """One view labels for the other: the documents of either class that no earlier one took, from a certainty on."""

    giver: int
    view: Logistic
    least: tuple[float, float]


def _certainty(logits: np.ndarray, u: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(logits), 50.0) + SPREAD * u


def _taught(x: list[np.ndarray], u: np.ndarray, history: list[HandOver]) -> tuple[list[np.ndarray], np.ndarray]:
    """The label that each view has been given for each row (NaN: none), and which rows nobody has taken."""
    given, free = [np.full(len(u), np.nan) for _ in x], np.ones(len(u), bool)
    for h in history:
        logits = h.view.logits(x[h.giver])
        good = logits >= 0
        taken = free & (np.abs(logits) >= LEAST_LOGIT) & (_certainty(logits, u) >= np.where(good, h.least[1], h.least[0]))
        given[1 - h.giver][taken] = good[taken]
        free &= ~taken
    return given, free


def _summed(pool: DataFrame, work: Callable[[list[np.ndarray], np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """``work`` of all batches of the pool, added up; an array of the given length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                x = [batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("text", "metadata")]
                total += work(x, batch.column("u").to_numpy())
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(at, pa.int32()), "s": pa.array(total[at])})

    found = np.zeros(length)
    rows = pool.select("u", "text", "metadata").mapInArrow(run, "at int, s double")
    for row in rows.groupBy("at").agg(F.sum("s").alias("s")).collect():
        found[row["at"]] = row["s"]
    return found


def _least_certain(pool: DataFrame, giver: int, view: Logistic, history: list[HandOver], wanted: tuple[int, int]) -> tuple[float, float]:
    """For either class the certainty from which on the wanted number of free documents lies, by a histogram over all."""
    bins = int(np.ceil((50.0 + SPREAD) / BIN)) + 1

    def count(x: list[np.ndarray], u: np.ndarray) -> np.ndarray:
        _, free = _taught(x, u, history)
        logits = view.logits(x[giver])
        sure = free & (np.abs(logits) >= LEAST_LOGIT)
        at = (_certainty(logits, u) / BIN).astype(int) + bins * (logits >= 0)
        return np.bincount(at[sure], minlength=2 * bins).astype(float)

    counts = _summed(pool, count, 2 * bins).reshape(2, bins)
    least = []
    for held, n in zip(counts, wanted):
        above = np.cumsum(held[::-1])[::-1]
        enough = np.flatnonzero(above >= n)
        least.append(float(enough[-1] * BIN) if len(enough) else 0.0)
    return tuple(least)


def _refit(pool: DataFrame, views: list[Logistic], history: list[HandOver], x: list[np.ndarray], y: np.ndarray) -> list[Logistic]:
    """Both views after what they have been taught, from the labelled rows at hand and the pool; both in the same passes."""
    sizes = [len(v.weights) * (len(v.weights) + 1) for v in views]
    for _ in range(STEPS):

        def slopes(features: list[np.ndarray], u: np.ndarray, views=tuple(views)) -> np.ndarray:
            given, _ = _taught(features, u, history)
            parts = []
            for v, f, g in zip(views, features, given):
                known = ~np.isnan(g)
                parts.append(v.slopes(f[known], g[known]))
            return np.concatenate(parts)

        sums = np.split(_summed(pool, slopes, sum(sizes)), [sizes[0]])
        moved = [v.stepped(s + v.slopes(a, y), RIDGE) for v, s, a in zip(views, sums, x)]
        views = [v for v, _ in moved]
        if max(size for _, size in moved) < STILL:
            break
    return views


def co_train(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> CoTrained:
    """Learn from ``documents`` (id, text, source, lang) and ``labels`` (id and 1 for good or 0 for bad).

    Rows without an id or with another label are ignored; a document that is labelled more than once takes the lowest. All
    documents without a label are candidates of every round.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    docs = documents.select(F.col(id_col).alias("id"), "text", "source", "lang").where("id IS NOT NULL")
    features = materialise(_features(docs), "quality-features")
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
    asked = known.where(draw < min(1.0, LABELLED / max(1, known.count())))
    given = features.join(F.broadcast(asked), "id").select("label", "text", "metadata").toPandas()
    given = given.sort_values("label", kind="stable")
    if given.empty:
        return CoTrained(None, None, None)
    pool = materialise(features.join(known, "id", "left_anti").select("u", "text", "metadata"), "quality-pool")
    n_pool = pool.count()

    y = given.label.to_numpy(float)
    x = [np.stack(given[c].to_numpy()) for c in ("text", "metadata")]
    # The order of rows says nothing about them; their own features decide which calibrate.
    order = np.lexsort(x[0].T)
    y, x = y[order], [v[order] for v in x]
    held = np.arange(len(y)) % CALIBRATION == 0
    if len(y) < 2 * CALIBRATION:
        held[:] = True
    train = ~held if (~held).any() else held
    own, own_y = [v[train] for v in x], y[train]

    # Features are put on the scale of all documents, which later rounds don't change.
    widths = [v.shape[1] for v in own]
    sums = _summed(pool, lambda f, u: np.concatenate([np.concatenate([a.sum(axis=0), (a * a).sum(axis=0)]) for a in f]), 2 * sum(widths))
    views = []
    for a, total in zip(own, np.split(sums, [2 * widths[0]])):
        n, width = n_pool + len(a), a.shape[1]
        mean = (total[:width] + a.sum(axis=0)) / n
        views.append(Logistic.blank(mean, np.sqrt(np.maximum((total[width:] + (a * a).sum(axis=0)) / n - mean * mean, 0.0))))
    for _ in range(50):
        views = [v.stepped(v.slopes(a, own_y), RIDGE)[0] for v, a in zip(views, own)]

    history: list[HandOver] = []
    wanted = [int(np.ceil(HANDED_OVER * n_pool * share)) for share in (1 - y.mean(), y.mean())]
    for _ in range(ROUNDS if n_pool else 0):
        for giver in (0, 1):
            least = _least_certain(pool, giver, views[giver], history, tuple(wanted))
            # A class that the labels don't have is not handed over.
            history.append(HandOver(giver, views[giver], tuple(at if n else np.inf for at, n in zip(least, wanted))))
        views = _refit(pool, views, history, own, own_y)
    raw = [v.logits(a[held])[:, None] for v, a in zip(views, x)]
    calibrated = tuple(Logistic.fit(r, y[held], 0.1) for r in raw)
    both = np.column_stack([c.logits(r) for c, r in zip(calibrated, raw)])
    return CoTrained(tuple(views), calibrated, Logistic.fit(both, y[held], 0.1))


def score(
    documents: DataFrame, model: CoTrained, id_col: str = "doc_id", keep: float = KEEP
) -> DataFrame:
    """``id``, ``text_score``, ``metadata_score``, ``score`` (0 to 1) and ``keep`` for each row of ``documents``.

    Null and empty texts have features like any other. Repeated rows each give a row; other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, texts, sources, langs = batch.columns
            rows = [(texts[i].as_py(), sources[i].as_py(), langs[i].as_py()) for i in range(batch.num_rows)]
            text = np.array([text_features(t) for t, _, _ in rows])
            metadata = np.array([metadata_features(*r) for r in rows])
            a, b, c = known.probabilities(text, metadata)
            yield pa.record_batch({"id": ids, "text_score": a, "metadata_score": b, "score": c, "keep": pa.array(c >= keep)})

    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), "text", "source", "lang")
    return rows.mapInArrow(run, f"id {kind}, text_score double, metadata_score double, score double, keep boolean")
