"""Quality of documents by random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cambium.llm.bytesplit import mixed, runs, span_hashes
from cambium.llm.common import hashed_share

#: Hashed vocabulary, length of word vectors, non-zero places of an index vector, words to each side that make the context.
BUCKETS = 2**14
SIZE = 32
PLACES = 4
REACH = 2
#: Bytes of text taken at a time.
GROUP_BYTES = 2_000_000
_CAPITALS = BUCKETS - 1

_BYTES = np.arange(256)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWER = (_BYTES >= ord("a")) & (_BYTES <= ord("z"))
_DIGIT = (_BYTES >= ord("0")) & (_BYTES <= ord("9"))
_KIND = np.where(_UPPER | _LOWER | (_BYTES >= 128), 1, np.where(_DIGIT, 2, np.where(_BYTES > 32, 3, 0))).astype(np.uint8)
_SYMBOL = mixed(np.where(_DIGIT, ord("0"), np.where(_UPPER, _BYTES + 32, _BYTES)).astype(np.uint64) + np.uint64(1))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word of the texts, in order.

    A word is a run of letters, of digits or of other signs. Case and the values of digits don't matter, but a word in capitals
    only has a bucket of its own kind.
    """
    spans = runs(texts, _KIND)
    bucket = (span_hashes(_SYMBOL[spans.buffer], spans.start, spans.stop) % np.uint64(BUCKETS - 1)).astype(np.int64)
    upper, lower = (np.concatenate([[0], np.cumsum(x[spans.buffer], dtype=np.int64)]) for x in (_UPPER, _LOWER))
    capitals = (upper[spans.stop] - upper[spans.start] > 1) & (lower[spans.stop] == lower[spans.start])
    bucket[capitals] = _CAPITALS
    return bucket, spans.text


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket the PLACES places of its index vector that are not zero, and their values, +1 or -1."""
    rng = np.random.default_rng(seed)
    place = rng.permuted(np.tile(np.arange(SIZE), (BUCKETS, 1)), axis=1)[:, :PLACES]
    return place, rng.choice(np.array([-1.0, 1.0]), (BUCKETS, PLACES))


def add_contexts(total: np.ndarray, index: tuple[np.ndarray, np.ndarray], bucket: np.ndarray, text: np.ndarray) -> None:
    """Add to the vector of every word (row of ``total``) its own index vector and those of the words within REACH of it in the same text."""
    place, value = index
    pairs = [(bucket, bucket)]
    for reach in range(1, REACH + 1):
        same = text[reach:] == text[:-reach]
        left, right = bucket[:-reach][same], bucket[reach:][same]
        pairs += [(left, right), (right, left)]
    for word, near in pairs:
        spot = place[near] + word[:, None] * SIZE
        total += np.bincount(spot.ravel(), value[near].ravel(), total.size).astype(np.int64).reshape(total.shape)


def pooled(vectors: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """For each text the mean and the variance of its words' vectors, and the logarithm of their number; zeros without words."""
    out = np.zeros((len(texts), 2 * SIZE + 1), np.float32)
    bucket, text = words(texts)
    if len(bucket):
        own = vectors[bucket]
        squares = own * own
        ones = np.ones(len(bucket), np.float32)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        for lo, hi in zip(first, np.append(first[1:], len(text)), strict=True):
            mean = ones[lo:hi] @ own[lo:hi] / (hi - lo)
            out[text[lo]] = [*mean, *(ones[lo:hi] @ squares[lo:hi] / (hi - lo) - mean**2), np.log1p(hi - lo)]
    return out


def groups(texts: list[bytes]) -> Iterator[slice]:
    """Slices of the list of about GROUP_BYTES each; a longer text is one by itself."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(texts):
        yield slice(lo, len(texts))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in column]


def word_vectors(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Random-indexing vectors of all words of all documents, each of length 1 (or 0 for a bucket that never occurs).

    Every task adds up the contexts of its own words; the sums are whole numbers and are added per bucket, so the result doesn't
    depend on the order. BUCKETS vectors come back, however large the input.
    """
    names = [f"v{i}" for i in range(SIZE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, index = np.zeros((BUCKETS, SIZE), np.int64), index_vectors()
        for batch in batches:
            texts = _bytes(batch.column(0))
            for part in groups(texts):
                add_contexts(total, index, *words(texts[part]))
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, i]) for i in range(SIZE))], ["bucket", *names])

    sums = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"bucket long, {', '.join(f'{n} long' for n in names)}")
    vectors = np.zeros((BUCKETS, SIZE))
    for row in sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).collect():
        vectors[row["bucket"]] = row[1:]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)


@dataclass
class Classifier:
    """Two layers over standardised features; ``temperature`` divides the logit. Without layers, every score is ``base``."""

    base: float = 0.5
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.center) / self.spread @ w + b) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""
    loss = lambda t: float(np.logaddexp(0, np.where(y == 1, -logits, logits) / np.exp(t)).mean())
    lo, hi, part = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - part * (hi - lo), lo + part * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, steps: int = 400, batch: int = 512, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Classifier:
    """A classifier fitted by Adam to four fifths of the rows, its temperature to the rest."""
    base = float((y.sum() + 1) / (len(y) + 2))
    if len(np.unique(y)) < 2 or len(y) < 10:
        return Classifier(base)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    order = rng.permutation(len(y))
    rest, own = order[: len(y) // 5], order[len(y) // 5 :]
    model = Classifier(base, x[own].mean(0), x[own].std(0) + 1e-6)
    z = (x - model.center) / model.spread
    model.layers = [rng.standard_normal((x.shape[1], hidden)) / x.shape[1] ** 0.5, np.zeros(hidden), np.zeros(hidden), np.array([np.log(base / (1 - base))])]
    first, second = [np.zeros_like(w) for w in model.layers], [np.zeros_like(w) for w in model.layers]
    for step in range(1, steps + 1):
        at = own[rng.integers(len(own), size=min(batch, len(own)))]
        w, b, v, c = model.layers
        h = np.tanh(z[at] @ w + b)
        d = (1 / (1 + np.exp(-(h @ v + c[0]))) - y[at]) / len(at)
        dh = d[:, None] * v * (1 - h * h)
        grads = [z[at].T @ dh + decay * w, dh.sum(0), h.T @ d + decay * v, np.array([d.sum()])]
        now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
        for weight, g, m, s in zip(model.layers, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            weight -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    model.temperature = calibrated(model.logits(x[rest]), y[rest]) if len(rest) else 1.0
    return model


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = 20_000,
    threshold: float = 0.3,
    fold: tuple[int, int] = (5, 0),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) plus ``quality_of``, a struct of ``held_out``, ``score`` and ``predicted`` for each whole text.

    Word vectors are gathered from all documents by random indexing, pooled per document (mean and variance), and classified by
    two layers. The network learns labels from at most ``sample_rows`` documents (least hash first) with crc32(id as text) mod
    fold[0] other than fold[1]: only their features come to the driver. Its probabilities are calibrated by temperature.

    A null or empty text is scored like any other, by features of zero. Labels other than 0 and 1 are left out; without two kinds
    of label every score is the share of label 1 among those there are (0.5 without any). A row without an id is held out.
    Repeated rows are scored alike; an empty table gives an empty result.
    """
    vectors = word_vectors(docs, text_col=text_col)
    fold_of = F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(fold[0]))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(fold_of == fold[1], F.lit(True)).alias("held_out"),
        F.col(f"`{text_col}`").alias("text"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS * SIZE * 4 bytes

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(2))
            found = [pooled(sent.value, texts[part]) for part in groups(texts)]
            flat = np.concatenate(found).ravel() if found else np.zeros(0, np.float32)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(flat), 2 * SIZE + 1).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), listed], ["id", "held_out", "features"])

    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    marked = marked.where("label in (0, 1)").where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(fold[0])) != fold[1])
    # a tenth more than wanted by hash, then the least hashes of those
    marked = marked.where(hashed_share(F.col("id")) < 1.1 * sample_rows / max(1, marked.count()))
    known = rows.where("not held_out").select("id", "held_out", "text").join(marked.select("id").distinct(), "id", "left_semi")
    pooled_known = known.mapInArrow(features, "id long, held_out boolean, features array<float>")
    sample = pooled_known.join(marked, "id").orderBy(hashed_share(F.col("id")), "id", "label").limit(sample_rows).select("features", "label").collect()
    x = np.array([r["features"] for r in sample], np.float64).reshape(-1, 2 * SIZE + 1)
    model = fit(x, np.array([r["label"] for r in sample], np.int64))
    kind = StructType().add("row", rows.schema["row"].dataType).add("quality_of", StructType.fromDDL("held_out boolean, score double, predicted int"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(2))
            found = [model.scores(pooled(sent.value, texts[part]).astype(np.float64)) for part in groups(texts)]
            scores = np.concatenate(found) if found else np.zeros(0)
            parts = [batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(parts, ["held_out", "score", "predicted"])], ["row", "quality_of"])

    return rows.select("row", "held_out", "text").mapInArrow(score, kind).select("row.*", "quality_of")
