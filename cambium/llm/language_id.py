"""Language of documents by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cambium.llm.common import hashed_share, settle

UNDETERMINED = "und"
#: Bytes of a segment; the network runs over every segment of a text in both directions.
SEGMENT = 256
#: Segments that are run side by side.
TILE = 2048
log = logging.getLogger(__name__)


@dataclass
class Network:
    """Weights for both directions (first axis): byte table, recurrent matrix, recurrent bias of the candidate, output, output bias.

    Gates are ordered update, reset, candidate. The byte table holds the input weights' products with one-hot bytes and the biases.
    """

    labels: list[str]
    table: np.ndarray  # 2, 256, 3H
    inner: np.ndarray  # 2, H, 3H
    shift: np.ndarray  # 2, H
    out: np.ndarray  # 2, H, L
    bias: np.ndarray  # L

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls(
            labels,
            draw(2, 256, 3 * hidden, scale=0.3),
            draw(2, hidden, 3 * hidden, scale=hidden**-0.5),
            np.zeros((2, hidden), np.float32),
            draw(2, hidden, len(labels), scale=hidden**-0.5),
            np.zeros(len(labels), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.shift, self.out, self.bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def loss_and_gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over every position of the segments ``x`` (T, B) with labels ``y`` (B), and its gradients by BPTT."""
    steps, batch = x.shape
    hidden = net.shift.shape[1]
    logits = np.broadcast_to(net.bias, (steps, batch, len(net.labels))).copy()
    kept = []
    for d in range(2):
        h, trace = np.zeros((batch, hidden), np.float32), {}
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            g, u = net.table[d][x[t]], h @ net.inner[d]
            gates = _sigmoid(g[:, : 2 * hidden] + u[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            c = u[:, 2 * hidden :] + net.shift[d]
            n = np.tanh(g[:, 2 * hidden :] + r * c)
            before, h = h, n + z * (h - n)
            trace[t] = (before, z, r, c, n, h)
            logits[t] += h @ net.out[d]
        kept.append(trace)
    p = softmax(logits)
    at = (np.arange(steps)[:, None], np.arange(batch)[None], y[None])
    loss = -float(np.log(p[at] + 1e-12).mean())
    p[at] -= 1
    p /= steps * batch
    grads = [np.zeros_like(w) for w in net.weights()]
    d_table, d_inner, d_shift, d_out, d_bias = grads
    d_bias += p.sum((0, 1))
    for d in range(2):
        carry = np.zeros((batch, hidden), np.float32)
        d_gates = np.empty((steps, batch, 3 * hidden), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            before, z, r, c, n, h = kept[d][t]
            d_out[d] += h.T @ p[t]
            dh = carry + p[t] @ net.out[d].T
            dn = dh * (1 - z) * (1 - n * n)
            gate = d_gates[t]
            gate[:, :hidden] = dh * (before - n) * z * (1 - z)
            gate[:, hidden : 2 * hidden] = dn * c * r * (1 - r)
            gate[:, 2 * hidden :] = dn
            du = gate.copy()
            du[:, 2 * hidden :] *= r
            d_shift[d] += du[:, 2 * hidden :].sum(0)
            d_inner[d] += before.T @ du
            carry = dh * z + du @ net.inner[d].T
        flat = np.bincount(
            (x.reshape(-1, 1).astype(np.int64) * 3 * hidden + np.arange(3 * hidden)).ravel(), d_gates.ravel(), minlength=256 * 3 * hidden
        )
        d_table[d] += flat.reshape(256, 3 * hidden).astype(np.float32)
    return loss, grads


def train(texts: list[bytes], langs: list[str], *, hidden: int = 12, length: int = 48, batch: int = 256, steps: int = 240, rate: float = 0.02, seed: int = 7) -> Network:
    """A network fitted by backpropagation through time (Adam, clipped gradients) to random segments; labels drawn evenly."""
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    net = Network.fresh(labels, hidden, rng)
    by_label = [[np.frombuffer(t * (-(-length // len(t))), np.uint8) for t, s in zip(texts, langs, strict=True) if s == label and t] for label in labels]
    by_label = [(i, group) for i, group in enumerate(by_label) if group]
    if len(by_label) < 2:
        return net
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        x, y = np.empty((length, batch), np.uint8), np.empty(batch, np.int64)
        for b in range(batch):
            label, group = by_label[b % len(by_label)]
            text = group[rng.integers(len(group))]
            at = rng.integers(len(text) - length + 1)
            x[:, b], y[b] = text[at : at + length], label
        loss, grads = loss_and_gradients(net, x, y)
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads)))
        now = rate * min(1.0, step / 20) * 0.5 * (1 + np.cos(np.pi * step / steps))
        for w, g, m, v in zip(net.weights(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if step % 40 == 0:
            log.info("step %d loss %.4f", step, loss)
    return net


def label_positions(net: Network, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities (T, B, L) of every position of segments ``x`` (T, B), longest first; those beyond a segment's length are 0."""
    steps, batch = x.shape
    hidden = net.shift.shape[1]
    active = (lengths[None, :] > np.arange(steps)[:, None]).sum(1)
    logits = np.zeros((steps, batch, len(net.labels)), np.float32)
    for d in range(2):
        h = np.zeros((batch, hidden), np.float32)
        table, inner, out = net.table[d].copy(), net.inner[d].copy(), net.out[d]
        table[:, : 2 * hidden] *= 0.5  # for the logistic function as a tangent
        inner[:, : 2 * hidden] *= 0.5
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            n = active[t]
            if not n:
                continue
            state = h[:n]
            g = table.take(x[t, :n], axis=0)
            u = state @ inner
            gates = np.add(g[:, : 2 * hidden], u[:, : 2 * hidden])
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            c = u[:, 2 * hidden :] + net.shift[d]
            c *= gates[:, hidden:]
            c += g[:, 2 * hidden :]
            np.tanh(c, out=c)
            state -= c
            state *= gates[:, :hidden]
            state += c
            logits[t, :n] += state @ out
    logits += net.bias
    np.exp(np.minimum(logits, 80, out=logits), out=logits)
    logits /= logits.sum(-1, keepdims=True)
    logits *= (lengths[None, :] > np.arange(steps)[:, None])[:, :, None]
    return logits


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean of the position probabilities over each whole text (rows of zeros for empty ones), segment by segment."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(b"".join(texts) + b"\0" * SEGMENT, np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    count = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[doc] + nth * SEGMENT
    length = np.minimum(SEGMENT, sizes[doc] - nth * SEGMENT)
    order = np.argsort(-length, kind="stable")
    total = np.zeros((len(texts), len(net.labels)))
    for lo in range(0, len(order), TILE):
        part = order[lo : lo + TILE]
        reach = int(length[part[0]])
        x = buffer[begin[part][None, :] + np.arange(reach)[:, None]]
        np.add.at(total, doc[part], label_positions(net, x, length[part]).sum(0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def training_sample(labelled: DataFrame, per_label: int, chars: int, listed: int = 1000) -> list:
    """Rows (label, text): for each label at most ``per_label`` documents by hash order, ``chars`` characters from a hashed place of each.

    Labels are counted first, so that only about twice as many rows as wanted leave their task, however many there are. Up to
    ``listed`` labels their counts come to the driver and are part of the plan. Of more labels the counts are joined, and the
    documents of each are fewer, so that the sample stays as large as that of ``listed`` labels (one of each at least).
    """
    counts = settle(labelled.groupBy("label").agg(F.count("*").alias("n")))
    labels = counts.count()
    if not labels:
        return []
    share = hashed_share(F.col("id"))
    per_label = max(1, per_label * min(listed, labels) // labels)
    wanted = 2.0 * per_label + 100
    if labels <= listed:
        rate = F.create_map(*[F.lit(x) for r in counts.collect() for x in (r["label"], wanted / r["n"])])
        few = labelled.where(share < F.element_at(rate, F.col("label")))
    else:
        few = labelled.join(counts, "label").where(share < wanted / F.col("n"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(share, "id"))
    spot = F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.char_length("text") - chars + 1)) + 1
    piece = F.substring("text", spot.cast("int"), F.lit(chars)).alias("text")
    return few.select("label", "id", piece).withColumn("nth", nth).where(F.col("nth") <= per_label).orderBy("label", "id").collect()


def identify_languages(
    docs: DataFrame,
    *,
    per_label: int = 400,
    chars: int = 1500,
    fold: tuple[int, int] = (4, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: list[str] | None = None,
    **training,
) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) plus ``language``, a struct of ``held_out``, ``lang_pred`` and ``score`` for each whole text.

    The network learns from at most ``per_label`` documents of each language (``chars`` characters each) among those with
    crc32(id as text) mod fold[0] other than fold[1]; the rest, and rows without an id, are held out. It is trained on the driver,
    where nothing but that sample arrives, and sent to the tasks (some 100 KB). Every byte gets probabilities from a forward and
    a backward pass over its segment of 256 bytes; their mean over the text gives label and score.

    A text that is null or has no letter is `und` with score 0, and so is every text if no language can be learned. Repeated rows
    are predicted alike; an empty table gives an empty result.
    """
    text, fold_of = F.col(f"`{text_col}`"), F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string")), F.lit(fold[0]))
    held_out = F.coalesce(fold_of == fold[1], F.lit(True))
    known = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.col(f"`{lang_col}`").cast("string").alias("label"), held_out.alias("out"))
    sample = training_sample(known.where(~F.col("out") & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")), per_label, chars)
    sample = [(r["text"].encode("utf-8", "replace"), r["label"]) for r in sample if r["text"]]
    net = train([t for t, _ in sample], [s for _, s in sample], **training) if sample else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            worded = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            group: list[int] = []
            size = 0
            for i in [*worded, None]:
                if i is not None:
                    group.append(i)
                    size += len(texts[i])
                if group and (i is None or size > 2_000_000):
                    p = document_probabilities(net, [texts[k].encode("utf-8", "surrogatepass") for k in group])
                    for k, row in zip(group, p, strict=True):
                        best = int(row.argmax())
                        pred[k], score[k] = net.labels[best], float(min(1.0, row[best]))
                    group, size = [], 0
            found = pa.StructArray.from_arrays([batch.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["held_out", "lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["row", "language"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), text.alias("text"), held_out.alias("held_out"))
    kind = StructType().add("row", rows.schema["row"].dataType).add("language", StructType.fromDDL("held_out boolean, lang_pred string, score double"))
    return rows.mapInArrow(run, kind).select("row.*", "language")
