"""Toxicity scores from subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many labelled documents train the model (clean, toxic); further labels are not used.
TRAIN_LIMITS = (3000, 1500)
#: Documents with at least this score are predicted toxic.
THRESHOLD = 0.3
#: A text is scored in windows of so many words, so that a long text is not diluted.
WINDOW = 96
#: A window of fewer distinct words counts as filled up to this many by words that say nothing.
LEAST_WORDS = 64
#: Characters of a word with its marked ends that are taken at once; longer ones are cut into overlapping pieces.
PIECE = 42
BUCKETS, DIM = 1 << 18, 4
#: Word scores a worker keeps; a fuller store starts anew.
CACHED_WORDS = 300_000

#: Averages over windows are small; SCALE keeps their gradients in range. SHARP: of the soft maximum over windows.
SCALE, SHARP = 50.0, 2.0
#: Of training; FLOOR keeps n-grams with small gradients, the rare ones, from large steps.
BATCH, EPOCHS, RATE, FLOOR = 32, 6, 1.0, 1e-4

_WORDS = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Words of a text with their ends marked; longer runs of word characters (phrases without spaces) as pieces of PIECE characters.

    Pieces overlap by four characters, so that every n-gram of a run is in one.
    """
    found = []
    for word in _WORDS.findall(text.lower()):
        raw = f"<{word}>"
        found += [raw] if len(raw) <= PIECE else [raw[i : i + PIECE] for i in range(0, len(raw) - 4, PIECE - 4)]
    return found


def grams(raw: str, buckets: int) -> list[int]:
    """Buckets of the character 3- to 5-grams of a word or piece as ``words_of`` gives it."""
    found = [raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)] or [raw]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in found]


@dataclass
class Model:
    embedding: np.ndarray  # buckets x dim
    weight: np.ndarray  # dim x 2
    bias: np.ndarray  # 2
    shift: float = 0.0

    def gram_scores(self) -> np.ndarray:
        """How far each n-gram moves the log-odds; averages are linear, so words and texts need only these."""
        return (self.embedding @ (self.weight[:, 1] - self.weight[:, 0])).astype(np.float32)

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0]) + self.shift


def _windows(n: int, window: int) -> list[slice]:
    """Equal parts of at most about ``window`` words that cover all of them."""
    parts = max(1, math.ceil(n / window))
    return [slice(n * i // parts, n * (i + 1) // parts) for i in range(parts)] if n else []


def train(texts: list[str], labels: np.ndarray, window: int = WINDOW, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Model:
    """Fit n-gram embeddings and softmax jointly by mini-batch adaptive gradient descent.

    A window's embedding is the average over its distinct words (one word repeated endlessly says no more than once)
    of the average over each word's n-grams. The largest log-odds of its windows are a text's: one abusive passage
    makes a text toxic however long it is. In training windows share the step by a soft maximum. Classes weigh the same. Steps shrink as gradients add up.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    documents = []
    for text in texts:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], np.int32)
        documents.append([np.unique(ids[part]) for part in _windows(len(ids), window)])
    labels = np.asarray(labels, np.float64)
    embedding = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    weight, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight[:, 1] = rng.normal(0, 1 / math.sqrt(dim), dim)
    weight[:, 0] = -weight[:, 1]
    usable = np.array([d for d, w in enumerate(documents) if w], np.int64)
    if not len(usable) or labels[usable].min() == labels[usable].max():
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros_like(embedding), weight, np.array([0, math.log(share / (1 - share))]))
    counts = np.array([len(grams(w, buckets)) for w in vocabulary])
    gram_ends = np.cumsum(counts)
    gram_ids = np.fromiter((g for w in vocabulary for g in grams(w, buckets)), np.int32, int(gram_ends[-1]))
    positive = labels[usable].mean()
    balance = np.where(labels > 0, 0.5 / positive, 0.5 / (1 - positive))
    seen, seen_w, seen_b = np.zeros_like(embedding), np.zeros_like(weight), np.zeros_like(bias)
    steps, step = epochs * -(-len(usable) // BATCH), 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(usable), -(-len(usable) // BATCH)):
            parts = [(d, w) for d in batch for w in documents[d]]
            sizes = np.array([len(documents[d]) for d in batch])
            starts = np.cumsum(sizes) - sizes
            words, word_at = np.unique(np.concatenate([w for _, w in parts]), return_inverse=True)
            n = np.array([len(w) for _, w in parts])
            of_window = Segments(np.cumsum(n) - n, word_at, len(words), LEAST_WORDS)
            m = counts[words]
            inside = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            known, gram_at = np.unique(gram_ids[np.repeat(gram_ends[words] - m, m) + inside], return_inverse=True)
            of_word = Segments(np.cumsum(m) - m, gram_at, len(known))
            pooled = of_window.mean(of_word.mean(embedding[known])) * SCALE
            odds = (pooled @ (weight[:, 1] - weight[:, 0]) + bias[1] - bias[0]).astype(np.float64)
            top = np.maximum.reduceat(odds, starts)
            soft = np.exp(SHARP * (odds - np.repeat(top, sizes)))
            total = np.add.reduceat(soft, starts)
            p = 1 / (1 + np.exp(-np.clip(top, -30, 30)))
            push = (np.repeat((p - labels[batch]) * balance[batch] / len(batch) / total, sizes) * soft).astype(np.float32)
            grad = np.stack([-push, push], 1)
            back = of_word.spread(of_window.spread((grad @ weight.T) * SCALE))
            now = np.float32(rate * (1 - step / steps))
            seen[known] += back * back
            embedding[known] -= now * back / (np.sqrt(seen[known]) + FLOOR)
            push_w, push_b = pooled.T @ grad, grad.sum(0)
            seen_w += push_w * push_w
            seen_b += push_b * push_b
            weight -= now * push_w / (np.sqrt(seen_w) + FLOOR)
            bias -= now * push_b / (np.sqrt(seen_b) + FLOOR)
            step += 1
    return Model(embedding * np.float32(SCALE), weight, bias)


class Segments:
    """Averages of rows over consecutive segments of an index, and the gradient of that."""

    def __init__(self, starts: np.ndarray, index: np.ndarray, rows: int, least: int = 1):
        self.starts, self.index, self.rows = starts, index, rows
        self.sizes = np.diff([*starts, len(index)])
        self.share = (1.0 / np.maximum(self.sizes, least)).astype(np.float32)
        self.order = np.argsort(index, kind="stable")
        self.used, self.used_starts = np.unique(index[self.order], return_index=True)
        self.back = np.repeat(np.arange(len(starts), dtype=np.int32), self.sizes)[self.order]

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(x[self.index, k], self.starts) * self.share for k in range(x.shape[1])], 1)

    def spread(self, grad: np.ndarray) -> np.ndarray:
        grad, out = grad * self.share[:, None], np.zeros((self.rows, grad.shape[1]), np.float32)
        for k in range(grad.shape[1]):
            out[self.used, k] = np.add.reduceat(grad[self.back, k], self.used_starts)
        return out




def text_odds(text: str, scores: np.ndarray, offset: float, cache: dict[str, float], window: int = WINDOW) -> float:
    """Log-odds of a whole text; one without words has those of the bias."""
    words, odds = words_of(text), []
    for part in _windows(len(words), window):
        some, total = set(words[part]), 0.0
        for word in some:
            known = cache.get(word)
            if known is None:
                known = cache[word] = float(scores[grams(word, len(scores))].mean())
            total += known
        odds.append(total / max(len(some), LEAST_WORDS))
    if len(cache) > CACHED_WORDS:
        cache.clear()
    if not odds:
        return offset
    return offset + max(odds)


def fit(texts: list[str], labels: np.ndarray, seed: int = 3) -> Model:
    """Train on four fifths of a sample and shift the log-odds so that the threshold serves the last fifth best (F1)."""
    labels = np.asarray(labels)
    order = np.random.default_rng(seed).permutation(len(texts))
    held, rest = order[: len(texts) // 5], order[len(texts) // 5 :]
    model = train([texts[i] for i in rest], labels[rest], seed=seed)
    y = labels[held]
    if 0 < y.sum() < len(y):
        scores, cache = model.gram_scores(), {}
        odds = np.array([text_odds(texts[i], scores, model.offset, cache) for i in held])
        at = np.unique(odds)
        cuts = np.concatenate([at[:1], (at[1:] + at[:-1]) / 2])
        f1 = [2 * (y[odds >= c] > 0).sum() / max(1, (odds >= c).sum() + y.sum()) for c in cuts]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        model.shift = math.log(THRESHOLD / (1 - THRESHOLD)) - float(np.median(cuts[best]))
    return model


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, limits: tuple[int, int] = TRAIN_LIMITS) -> tuple[list[str], np.ndarray]:
    """At most ``limits`` labelled texts (clean, toxic), the smallest by a hash of the id; ``usable`` tells which ids may serve."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = [marks.where((F.col("toxic") > 0) == bool(k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in enumerate(limits)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # no more rows than the limits
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = sorted((r.doc_id, r.text or "", r.toxic) for r in rows.collect())
    return [t for _, t, _ in found], np.array([int(y > 0) for *_, y in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the toxicity of every whole text to all columns of ``docs``; null counts as empty, repeated rows stay."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.gram_scores(), model.offset))  # BUCKETS numbers, whatever the input

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, offset = shared.value
        cache: dict[str, float] = {}
        for part in parts:
            odds = [text_odds(x.as_py() or "", scores, offset, cache) for x in part.column(text_col)]
            p = 1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -500, 500)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*part.schema.names, score_col])

    base = docs.drop(score_col)
    return base.mapInArrow(batches, T.StructType([*base.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Ids that never train a model: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Learn toxicity from ``labels`` (``doc_id``, ``toxic``) and score every document.

    Returns the columns ``keep`` of ``docs`` (all by default) with ``held_out``, ``score`` (0 to 1) and ``predicted``. Training takes a
    bounded sample of the labelled documents that aren't held out; with none of either class every text has the
    same score. Only texts are inputs. A null text counts as empty, a null id is not held out, repeated rows are
    scored each, an empty table gives no rows; columns of ``docs`` named like a result are replaced.
    """
    model = fit(*training_sample(docs, labels, ~held_out(F.col("doc_id"))))
    names = [c for c in (keep or docs.columns) if c not in ("held_out", "score", "predicted")]
    scored = score(docs.select(*dict.fromkeys([*names, "text"])), model)
    return scored.select(*names, F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
