"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is a linear score of its own features and those of the lines before and after
it; a 2 x 2 table scores the step from line to line. Forward-backward gives each line's marginal, and the mean of the
marginals, weighted by line length, is the document's quality, calibrated by a two-parameter sigmoid.

Training uses a bounded sample: ``SAMPLE_DOCS`` labelled documents outside the held-out third, least by a hash of their
id, cut into windows of ``WINDOW`` lines, of which ``SAMPLE_WINDOWS`` are used; each line of a document has its label.
Only text enters a score.

Defined cases: null text is one empty line; every document gets a score, whatever its id; a null id isn't held out;
without labels the score is 0.5. Repeated rows are scored one by one. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bucketwise.llm.textkit import byte_rows, only, pieces, table, word_hashes, word_starts

SAMPLE_DOCS = 4000
SAMPLE_WINDOWS = 6000
WINDOW = 64
STEPS = 160

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "mark": b"#$%&*@^~<>={}[]\\_",
    "pipe": b"|",
    "shout": b"!",
    "stop": b".,;:?",
    "wide": bytes(range(128, 256)),
}
OWN = 17
FEATURES = 3 * OWN


def line_bounds(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte of each line, lines before each row and in all); every row has a line at least."""
    breaks = np.flatnonzero(flat == 10)
    row = np.searchsorted(offsets, breaks, side="right") - 1
    owner = np.concatenate([np.arange(len(offsets) - 1), row])
    first = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((first, owner))
    owner, first = owner[order], first[order]
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    end = np.empty_like(first)
    end[:-1] = first[1:] - 1
    end[bounds[1:] - 1] = offsets[1:]
    return first, end, bounds


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with those of its neighbours, line lengths in bytes, lines before each row)."""
    flat, offsets = byte_rows(column)
    first, end, bounds = line_bounds(flat, offsets)
    size = (end - first).astype(np.float64)
    count = {}
    for name, members in _CLASSES.items():
        wanted = np.zeros(256, dtype=bool)
        wanted[list(members)] = True
        total = np.concatenate([[0], np.cumsum(wanted[flat], dtype=np.int64)])
        count[name] = (total[end] - total[first]).astype(np.float64)
    words, _ = word_hashes(flat, offsets)
    line = np.searchsorted(first, word_starts(flat, offsets), side="right") - 1
    n_words = np.bincount(line, minlength=len(first)).astype(np.float64)
    same = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[1:][same], minlength=len(first)).astype(np.float64)
    per_word, per_byte = 1 / np.maximum(n_words, 1), 1 / np.maximum(size, 1)
    letters = count["upper"] + count["lower"]
    upper = count["upper"] / np.maximum(letters, 1)
    last = np.where(size > 0, flat[np.maximum(end - 1, 0)] if len(flat) else 0, 0)
    own = np.column_stack([
        np.ones_like(size), np.log1p(size) / 8, size == 0,
        np.minimum(count["mark"] * per_word, 4) / 4, count["mark"] * per_word > 0.3,
        upper, (upper > 0.6) & (letters > 3), count["digit"] * per_byte,
        np.minimum(count["pipe"] * per_word, 1), count["pipe"] * per_word > 0.15,
        np.minimum(count["shout"] * per_word, 1), repeats * per_word, repeats * per_word > 0.4,
        np.minimum(size * per_word, 40) / 40, np.minimum(count["stop"] * per_word, 1), count["wide"] * per_byte,
        np.isin(last, list(b".!?")),
    ]).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.hstack([own, before, after]), size, bounds


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    step: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


def blank() -> Model:
    return Model(np.zeros(FEATURES), np.zeros((2, 2)))


def forward_backward(evidence: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" (chains x lines, padded) and the expected counts of the four steps.

    ``evidence``: log-odds of each line, chains in rows; entries past a chain's length do not matter.
    """
    chains, width = evidence.shape
    a, tiny = np.exp(step), 1e-12
    psi = np.exp(np.clip(evidence, -30, 30))
    alpha = np.empty_like(psi)
    alpha[:, 0] = psi[:, 0] / (1 + psi[:, 0])
    for t in range(1, width):
        p = alpha[:, t - 1]
        good = (p * a[1, 1] + (1 - p) * a[0, 1]) * psi[:, t]
        alpha[:, t] = np.clip(good / (good + p * a[1, 0] + (1 - p) * a[0, 0]), tiny, 1 - tiny)
    beta = np.full_like(psi, 0.5)
    counts = np.zeros((2, 2))
    for t in range(width - 2, -1, -1):
        inside = t < lengths - 1
        good, bad = psi[:, t + 1] * beta[:, t + 1], 1 - beta[:, t + 1]
        up, down = a[1, 1] * good + a[1, 0] * bad, a[0, 1] * good + a[0, 0] * bad
        beta[:, t] = np.where(inside, np.clip(up / (up + down), tiny, 1 - tiny), 0.5)
        p = alpha[:, t]
        both = np.stack([(1 - p) * a[0, 0] * bad, (1 - p) * a[0, 1] * good, p * a[1, 0] * bad, p * a[1, 1] * good])
        counts += ((both / both.sum(axis=0)) * inside).sum(axis=1).reshape(2, 2)
    good, bad = alpha * beta, (1 - alpha) * (1 - beta)
    return good / np.maximum(good + bad, 1e-300), counts


def marginals(features: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """P(good) of every line; chains of like length run together, so padding at most doubles the work."""
    evidence, lengths = features @ model.weights, np.diff(bounds)
    out = np.empty(len(evidence))
    tier = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(tier):
        rows = np.flatnonzero(tier == k)
        at = np.minimum(bounds[rows][:, None] + np.arange(lengths[rows].max()), bounds[rows + 1][:, None] - 1)
        good, _ = forward_backward(evidence[at], lengths[rows], model.step)
        inside = np.arange(at.shape[1]) < lengths[rows][:, None]
        out[at[inside]] = good[inside]
    return out


def _means(good: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    weight = np.maximum(size, 1)
    return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(features: np.ndarray, size: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum conditional likelihood of the labels, one per chain, by Adam; deterministic."""
    if not len(labels):
        return blank()
    lengths, width = np.diff(bounds), int(np.diff(bounds).max())
    at = np.minimum(bounds[:-1][:, None] + np.arange(width), bounds[1:][:, None] - 1)
    inside = np.arange(width) < lengths[:, None]
    truth = np.repeat(labels.astype(float), lengths)
    seen = np.diag([(lengths - 1)[labels == 0].sum(), (lengths - 1)[labels == 1].sum()]).astype(float)
    theta, scale = np.zeros(FEATURES + 4), 1 / len(size)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, STEPS + 1):
        step = theta[FEATURES:].reshape(2, 2)
        good, counts = forward_backward((features @ theta[:FEATURES])[at], lengths, step)
        own = np.empty(len(size))
        own[at[inside]] = good[inside]
        slope = np.concatenate([features.T @ (truth - own), (seen - counts).ravel()]) * scale - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    model = Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))
    x = _logit(_means(marginals(features, bounds, model), size, bounds))
    a, b = 1.0, 0.0
    for _ in range(200):
        gap = labels - 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        a, b = max(0.01, a + 0.05 * ((gap * x).mean() - 1e-3 * a)), b + 0.5 * gap.mean()
    return Model(model.weights, model.step, a, b)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        features, size, bounds = line_features(batch.column("text"))
        row, number, chains, sizes = [], [], [], []
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            for k, at in enumerate(range(a, b, WINDOW)):
                end = min(b, at + WINDOW)
                row.append(i)
                number.append(k)
                chains.append(features[at:end].astype(np.float32).tobytes())
                sizes.append(size[at:end].astype(np.float32).tobytes())
        own = batch.select(["key", "label"]).take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*own.columns, pa.array(number, pa.int32()), pa.array(chains, pa.binary()), pa.array(sizes, pa.binary())],
            names=["key", "label", "number", "features", "sizes"],
        )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_id: str = "doc_id", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS,
) -> Model:
    """A model from a bounded sample of the labelled rows outside the held-out third."""
    marked = (
        only(labels, id=label_id, label=label_col).where("id is not null and label in (0, 1)")
        .where(~held_out(F.col("id"))).select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("key"))
        .distinct().orderBy("key", "id", "label").limit(sample_docs)
    )
    texts = only(docs, id=id_col, text=text_col).join(marked, "id").select("key", "label", "text")
    windows = (
        texts.mapInArrow(_sample_rows, "key long, label int, number int, features binary, sizes binary")
        .orderBy(F.xxhash64("key", "number"), "features").limit(sample_windows).toArrow()
    )
    if not windows.num_rows:
        return blank()
    chains = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x in windows.column("features").to_pylist()]
    sizes = [np.frombuffer(x, np.float32) for x in windows.column("sizes").to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
    return fit(
        np.concatenate(chains).astype(np.float64), np.concatenate(sizes).astype(np.float64), bounds,
        windows.column("label").to_numpy(),
    )


def _score_rows(model: Model, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            features, size, bounds = line_features(batch.column("text"))
            mean = _means(marginals(features, bounds, model), size, bounds)
            score = 1 / (1 + np.exp(-np.clip(model.slope * _logit(mean) + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(score)], names=[*keep, "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row of ``docs``."""
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score_rows(model, ["id"]), f"id {kind}, score double").select(
        "id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_poor(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted good, in one pass and without a shuffle."""
    names = ["text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)]
    wrapped = docs.toDF(*names)
    schema = T.StructType([*wrapped.schema.fields, T.StructField("score", T.DoubleType())])
    return wrapped.mapInArrow(_score_rows(model, names), schema).where("score >= 0.5").select(*names).toDF(*docs.columns)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
