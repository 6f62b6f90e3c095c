"""Language identification by a small byte convolutional network, trained in numpy.

Bytes are embedded, convolved with filters of several widths, rectified, pooled by their maximum
over a fixed-length window and classified by softmax. A whole text is cut into windows that follow
each other (the last one ends with the text); windows of many texts go through the network as one
batch. A text's class probabilities are the mean over its windows, weighted by the letters in each.

Training: at most TRAIN_ROWS rows with a language, those with the smallest hash of their id; of each
row DRAWS windows that lie anywhere in the whole text; STEPS steps, whatever the rows. Rows, window
starts and initial weights follow from fixed seeds and sorted input, so a model is the same for the
same table. Only text and language are looked at.

Edge cases: null texts and texts without a letter are `und` with score 0; short texts are padded
with spaces; long texts are read whole; equal texts get equal results; with one language, or none,
to learn from, every text with letters gets it, or `und`; rows that repeat an id are rows of their
own; null ids are held out from nothing and keep their null; other columns are ignored (or carried,
in keep_identified); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import by_chunk, ship, sliced, trimmed, utf8

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4)
FILTERS = 24
TRAIN_ROWS = 6000
DRAWS = 8
STEPS = 600
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
NOT_ASCII_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))


def lowered() -> np.ndarray:
    """Bytes to symbols: ASCII letters without case, white space as a space, digits as one; the rest stays."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[9:14] = 32
    t[48:58] = 48
    return t


FOLD = lowered()


@dataclass
class ByteNet:
    """embed (256, E); filters by width (w * E, F) with bias; dense (all filters, classes) with bias."""

    classes: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, classes: list[str], seed: int = 7) -> ByteNet:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        return cls(classes, draw(256, EMBED, scale=0.5), [draw(w * EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(len(WIDTHS) * FILTERS, len(classes), scale=0.1), np.zeros(len(classes), np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.filter_bias, self.dense, self.bias]

    def pooled(self, windows: np.ndarray, where: bool = False):
        """Maxima of the rectified filters over each window (n, filters); with where also their places."""
        x = self.embed[windows]  # n, L, E
        n, size, _ = x.shape
        out, at = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.filter_bias):
            y = x[:, : size - w + 1] @ f[:EMBED]
            for k in range(1, w):
                y += x[:, k : size - w + 1 + k] @ f[k * EMBED : (k + 1) * EMBED]
            if where:
                at.append(y.argmax(1))
            out.append(np.maximum(y.max(1) + b, 0))
        return (np.concatenate(out, 1), at, x) if where else np.concatenate(out, 1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.dense + self.bias)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gradients(net: ByteNet, windows: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross-entropy, in the order of params()."""
    h, at, x = net.pooled(windows, where=True)
    p = softmax(h @ net.dense + net.bias)
    n = len(windows)
    loss = float(-np.log(p[np.arange(n), labels] + 1e-9).mean())
    p[np.arange(n), labels] -= 1
    p /= n
    dh = p @ net.dense.T * (h > 0)
    d_embed, d_filters, d_bias = np.zeros_like(net.embed), [], []
    rows = np.arange(n)[:, None]
    for i, w in enumerate(WIDTHS):
        g = dh[:, i * FILTERS : (i + 1) * FILTERS]
        df = np.empty_like(net.filters[i])
        for k in range(w):  # only the place of each maximum passes the gradient on
            place = at[i] + k
            f = net.filters[i][k * EMBED : (k + 1) * EMBED]
            df[k * EMBED : (k + 1) * EMBED] = np.einsum("nfe,nf->ef", x[rows, place], g)
            np.add.at(d_embed, windows[rows, place].ravel(), (g[:, :, None] * f.T[None]).reshape(-1, EMBED))
        d_filters.append(df)
        d_bias.append(g.sum(0))
    return [d_embed, *d_filters, *d_bias, h.T @ p, p.sum(0)], loss


def fit(samples: list[tuple[list[bytes], str]], steps: int = STEPS, seed: int = 7, batch: int = 128) -> ByteNet:
    """Adam on windows of the samples (windows of a text, language): a batch takes one window of each of its samples."""
    classes = sorted({c for _, c in samples})
    net = ByteNet.fresh(classes or [UND], seed)
    if len(classes) < 2:
        return net
    samples = sorted(samples)
    label = {c: i for i, c in enumerate(classes)}
    y = np.array([label[c] for _, c in samples])
    coded = [[FOLD[np.frombuffer(w, np.uint8)] for w in own] for own, _ in samples]
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        while len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(samples))])
        own, order = order[:batch], order[batch:]
        windows = np.full((len(own), WINDOW), 32, np.uint8)
        for j, i in enumerate(own):
            part = coded[i][rng.integers(len(coded[i]))]
            if rng.random() < 0.3:  # short texts are learnt too
                size = int(WINDOW * rng.uniform(0.1, 1))
                start = rng.integers(0, max(1, len(part) - size + 1))
                part = part[start : start + size]
            windows[j, : len(part)] = part
        grads, _ = gradients(net, windows, y[own])
        rate = 4e-3 * (1 - step / (steps + 1))
        for p, g, a1, a2 in zip(net.params(), grads, m, v):
            a1 += 0.1 * (g - a1)
            a2 += 0.001 * (g * g - a2)
            p -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> list[tuple[list[bytes], str]]:
    """At most `most` (windows of the text, language) of the rows that are not held out. Windows start anywhere in the text."""
    body = utf8(text_col)
    last = F.greatest(F.length(body) - WINDOW, F.lit(0)) + 1
    at = lambda i: F.pmod(F.xxhash64(F.lit(17), F.col(id_col), i), last).cast("int")
    windows = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda i: F.substring(body, at(i) + 1, F.lit(WINDOW)))
    open_ = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col)), F.lit(1 << 30))
    share = min(1.0, 1.1 * most / max(1, open_.count()))  # so that all tasks together hand on about `most` rows, not each
    rows = open_.where(draw < int(share * (1 << 30))).select(F.col(lang_col).cast("string").alias("lang"), windows.alias("windows"), draw.alias("h"), F.col(id_col).alias("i"))
    return [([bytes(w) for w in r.windows], r.lang) for r in rows.orderBy("h", "i").limit(most).select("windows", "lang").collect()]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows_of(text: bytes) -> np.ndarray:
    """The text as windows that cover every byte of it; the last one ends with the text."""
    data = FOLD[np.frombuffer(text, np.uint8)]
    if len(data) <= WINDOW:
        out = np.full((1, WINDOW), 32, np.uint8)
        out[0, : len(data)] = data
        return out
    n = -(-len(data) // WINDOW)
    out = np.empty((n, WINDOW), np.uint8)
    out[: n - 1] = data[: (n - 1) * WINDOW].reshape(n - 1, WINDOW)
    out[n - 1] = data[-WINDOW:]
    return out


def has_letter(text: bytes) -> bool:
    return bool(text.translate(None, NOT_ASCII_LETTER)) or (not text.isascii() and bool(LETTER.search(text.decode())))


def predict(net: ByteNet, texts: list[bytes], batch: int = 512) -> tuple[list[str], list[float]]:
    lang, score = [UND] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if has_letter(t)]
    if not own or net.classes == [UND]:
        return lang, score
    parts = [windows_of(texts[i]) for i in own]
    flat = np.concatenate(parts)
    p = np.concatenate([net.probabilities(flat[a : a + batch]) for a in range(0, len(flat), batch)])
    letters = ((flat >= 97) & (flat <= 122) | (flat >= 128)).sum(1) + 1e-3
    starts = np.cumsum([0] + [len(x) for x in parts])[:-1]
    mean = np.add.reduceat(p * letters[:, None], starts) / np.add.reduceat(letters, starts)[:, None]
    for i, row in zip(own, mean):
        k = int(row.argmax())
        lang[i], score[i] = net.classes[k], min(1.0, float(row[k]))
    return lang, score


def identify(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, lang_pred, score."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(net)  # a few tens of kB, whatever the input

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, score = predict(model.value, [t.as_buffer().to_pybytes() for t in batch.column(1)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return by_chunk(rows, run, "doc_id long, held_out boolean, lang_pred string, score double", limit=1 << 20).withColumnRenamed("doc_id", id_col)


def keep_identified(docs: DataFrame, net: ByteNet, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text has letters and whose best language scores `least` or more, with all their columns."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch, place, 1 << 20):
                texts = [t.as_buffer().to_pybytes() for t in piece.column(place).cast(pa.binary()).fill_null(b"")]
                lang, score = predict(model.value, texts)
                yield piece.filter(pa.array([x != UND and y >= least for x, y in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def train_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> DataFrame:
    return identify(docs, fit(training_rows(docs, id_col, text_col, lang_col, most)), id_col, text_col)
