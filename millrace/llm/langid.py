"""Language identification with a byte convolutional network.

A text is cut into windows of ``window`` bytes. Filters of several widths slide over the bytes, each
filter keeps its maximum over the window, and a softmax over these maxima gives the probabilities of
the languages; a text's probabilities are the mean over all its windows, weighted by their bytes.

The network is trained in numpy on windows of a sample of labelled texts: at most ``per_label``
texts of each language and ``windows_per_text`` windows of each, chosen by hash. That bound is the
only sampling; predictions read every byte of every text. A byte is one of 256 symbols, so a
filter's response to two neighbouring bytes is a table of 65,536 rows, and a window costs a few table
lookups per byte.

Defined results: the language is ``und`` with score 0 if the text is null or has no letter, and if
no labelled text was there to learn from. Only the text is read for a prediction, so rows that repeat
get equal results, whatever their other columns hold. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.util import col, fresh

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 256  # windows at a time, so that the responses stay in the processor's cache


@dataclass
class ByteNetwork:
    """Filters (per width: offset x byte x filter), their biases, and the softmax layer."""
    labels: list[str]
    window: int
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    tables: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "tables": {}}

    def _pairs(self, width: int, offset: int) -> np.ndarray:
        """The filter's response to the bytes at ``offset`` and the next, for all 65,536 pairs."""
        if (width, offset) not in self.tables:
            f = self.filters[width]
            both = f[offset][:, None, :] + f[offset + 1][None, :, :]
            self.tables[width, offset] = np.ascontiguousarray(both.reshape(65536, -1))
        return self.tables[width, offset]

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each window."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        found = []
        for width, f in self.filters.items():
            n = self.window - width + 1
            total = self._pairs(width, 0)[pairs[:, :n]]
            for offset in range(2, width - 1, 2):
                total += self._pairs(width, offset)[pairs[:, offset:offset + n]]
            if width % 2:
                total += f[width - 1][windows[:, width - 1:]]
            found.append(total.max(axis=1))
        return np.concatenate(found, axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [np.zeros((0, len(self.labels)), np.float32)]
        for at in range(0, len(windows), _CHUNK):
            hidden = np.maximum(self.responses(windows[at:at + _CHUNK]) + self.bias, 0)
            parts.append(_softmax(hidden @ self.out + self.out_bias))
        return np.concatenate(parts)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: bytes, window: int) -> np.ndarray:
    """The windows of a text, the last one filled up with zeros."""
    n = max(1, -(-len(data) // window))
    flat = np.zeros(n * window, dtype=np.uint8)
    flat[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return flat.reshape(n, window)


def train(windows: np.ndarray, labels: list[str], widths=(2, 3, 4), filters: int = 16,
          epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> ByteNetwork:
    """Fit the network with Adam. ``windows`` is (n, window) bytes; the same input gives the same
    network."""
    random = np.random.default_rng(seed)
    names = sorted(set(labels))
    target = np.searchsorted(names, labels)
    n, window = windows.shape
    total = filters * len(widths)
    net = ByteNetwork(
        names, window,
        {w: random.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in widths},
        np.zeros(total, np.float32), random.normal(0, 0.1, (total, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32))
    parameters = [*net.filters.values(), net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for _ in range(epochs):
        order = random.permutation(n)
        for at in range(0, n, batch):
            chosen = order[at:at + batch]
            gradients = _gradients(net, windows[chosen], target[chosen])
            step += 1
            for p, g, (m, v) in zip(parameters, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def _gradients(net: ByteNetwork, x: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    rows = np.arange(len(x))
    pooled, places = [], []
    for width, f in net.filters.items():
        n = net.window - width + 1
        total = f[0][x[:, :n]]
        for offset in range(1, width):
            total = total + f[offset][x[:, offset:offset + n]]
        best = total.argmax(axis=1)
        places.append(best)
        pooled.append(np.take_along_axis(total, best[:, None, :], axis=1)[:, 0])
    raw = np.concatenate(pooled, axis=1) + net.bias
    hidden = np.maximum(raw, 0)
    d = _softmax(hidden @ net.out + net.out_bias)
    d[rows, target] -= 1
    d /= len(x)
    d_raw = (d @ net.out.T) * (raw > 0)
    out, at = [], 0
    for (width, f), best in zip(net.filters.items(), places):
        count = f.shape[2]
        part, grad = d_raw[:, at:at + count], np.zeros_like(f)
        for offset in range(width):
            symbol = x[rows[:, None], best + offset]
            np.add.at(grad[offset], (symbol, np.arange(count)[None, :]), part)
        out.append(grad)
        at += count
    return [*out, d_raw.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


# --- On the cluster ---------------------------------------------------------

def sample_windows(df: DataFrame, text: str, label: str, identifier: str, per_label: int,
                   windows_per_text: int, window: int) -> list:
    """At most ``per_label`` texts per label, by hash, and some windows of each: (bytes, label).

    Labels are counted first, so that a hash limit leaves little more than ``per_label`` rows of
    each before they are ranked; no task ranks all rows of a frequent label.
    """
    share = F.pmod(F.xxhash64(col(identifier).cast("string"), F.lit("sample")),
                   F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = df.where(col(label).isNotNull() & col(text).isNotNull()).select(
        col(label).alias("label"), col(text).alias("text"), share.alias("share"))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # One row per language, as many as the network has outputs.
    near = known.join(F.broadcast(counts), "label").where(F.col("share") < 1.3 * per_label / F.col("n"))
    ranked = near.withColumn("rank", F.row_number().over(
        Window.partitionBy("label").orderBy("share", F.xxhash64("text"))))
    few = ranked.where(F.col("rank") <= per_label).select("label", "text")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, words in zip(*(batch.column(c).to_pylist() for c in ("label", "text"))):
                data = words.encode()
                if not _LETTER.search(words):
                    continue
                starts = np.linspace(0, max(0, len(data) - window), windows_per_text).astype(int)
                for i, start in enumerate(sorted(set(starts.tolist()))):
                    # Some windows are shorter and some in capitals: both occur in texts.
                    length = window if i % 3 else max(16, window // 4)
                    piece = data[start:start + length]
                    rows.append({"bytes": piece, "label": name})
                    if i == 1:
                        upper = piece.decode(errors="ignore").upper().encode()[:window]
                        rows.append({"bytes": upper, "label": name})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("bytes", pa.binary()), ("label", pa.string())]))

    found = few.mapInArrow(windows, "bytes binary, label string").collect()
    return sorted((bytes(r["bytes"]), r["label"]) for r in found)


def fit(df: DataFrame, text: str = "text", label: str = "lang", identifier: str = "doc_id",
        per_label: int = 400, windows_per_text: int = 6, window: int = 256, **options
        ) -> ByteNetwork | None:
    """A network learned from the labelled rows of ``df``; None if there are none."""
    found = sample_windows(df, text, label, identifier, per_label, windows_per_text, window)
    if not found:
        return None
    return train(np.concatenate([cut(b, window) for b, _ in found]), [n for _, n in found],
                 **options)


def predict(df: DataFrame, net: ByteNetwork | None, text: str = "text", language: str = "lang_pred",
            score: str = "score", into: tuple[str, ...] | None = None) -> DataFrame:
    """Add the language of each text and its score; ``into`` names the columns to keep."""
    kept = [c for c in (into if into is not None else df.columns) if c not in (language, score)]
    hidden = fresh(df, "_text")
    source = df.select(*[col(c) for c in kept], col(text).alias(hidden))
    schema = source.drop(hidden).withColumns(
        {language: F.lit("").cast("string"), score: F.lit(0.0)}).schema

    def judge(texts: list) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if net is None:
            return names, scores
        lettered = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)]
        for part in _portions(lettered, texts):
            data = [texts[i].encode() for i in part]
            windows = [cut(d, net.window) for d in data]
            p = net.probabilities(np.concatenate(windows))
            sizes = np.array([len(w) for w in windows])
            ends = np.cumsum(sizes)
            weight = np.full(len(p), net.window, dtype=np.float64)
            weight[ends - 1] = [len(d) - (len(w) - 1) * net.window for d, w in zip(data, windows)]
            summed = np.add.reduceat(p * weight[:, None], ends - sizes, axis=0)
            mean = summed / np.add.reduceat(weight, ends - sizes)[:, None]
            for i, row in zip(part, mean):
                best = int(row.argmax())
                names[i], scores[i] = net.labels[best], float(min(1.0, max(0.0, row[best])))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(batch.column(hidden).to_pylist())
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, language, score])

    return source.mapInArrow(run, schema)


def _portions(chosen: list[int], texts: list, most: int = 1 << 20) -> Iterator[list[int]]:
    """Groups of texts of about a million characters, so that their windows take little memory."""
    part, held = [], 0
    for i in chosen:
        part.append(i)
        held += len(texts[i])
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


def is_held_out(identifier: Column) -> Column:
    """One row in four, by the CRC of its id as text."""
    return F.coalesce(F.crc32(identifier.cast("string")) % 4 == 2, F.lit(False))
