"""Language identification by a byte convolutional network, trained with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadlab.llm.tokens import runs

WINDOW = 256
EMBED = 8
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
#: Bound of the sample the network learns from: windows a language, and languages.
SAMPLE_WINDOWS = 1500
MAX_LANGUAGES = 200
EPOCHS = 6
BATCH = 64
UNKNOWN = "und"
#: Windows that go through the network together.
CHUNK = 48


@dataclass
class Network:
    """Embedding of bytes, filters of several widths, maximum over the window, softmax.

    All filters stand in one matrix as wide as the widest; a mask keeps the rest of a narrower
    filter at zero.
    """

    embedding: np.ndarray
    filters: np.ndarray
    biases: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    labels: list[str]

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        mask = filter_mask()
        return cls(
            draw(257, EMBED) * np.float32(0.5),
            draw(*mask.shape) * mask * np.sqrt(2 / mask.sum(axis=0, keepdims=True)).astype(np.float32),
            np.zeros(mask.shape[1], np.float32),
            draw(mask.shape[1], len(labels)) * np.float32(0.1),
            np.zeros(len(labels), np.float32),
            labels,
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.biases, self.out, self.out_bias]

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """(n, places, filters) of windows (n, WINDOW) of bytes; 256 stands for no byte."""
        n, length = windows.shape
        flat = self.embedding[windows].reshape(n, length * EMBED)
        places, wide = length - max(WIDTHS) + 1, max(WIDTHS) * EMBED
        view = np.lib.stride_tricks.as_strided(flat, (n, places, wide), (flat.strides[0], EMBED * 4, 4))
        return (view.reshape(n * places, wide) @ self.filters).reshape(n, places, -1)

    def chances(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        features = np.maximum(best + self.biases, 0)
        scores = features @ self.out + self.out_bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True), features

    def predict(self, windows: np.ndarray) -> np.ndarray:
        return self.chances(self.responses(windows).max(axis=1))[0]

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        n = len(windows)
        response = self.responses(windows)
        at = response.argmax(axis=1)
        error, features = self.chances(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        error[np.arange(n), target] -= 1
        error /= n
        back = (error @ self.out.T) * (features > 0)
        taken = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        vectors = self.embedding[taken].reshape(*at.shape, -1)
        g_filters = np.einsum("nf,nfd->df", back, vectors) * filter_mask()
        pulled = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        g_embedding = np.stack([np.bincount(taken.ravel(), pulled[:, d], len(self.embedding)) for d in range(EMBED)], axis=1)
        return [g_embedding.astype(np.float32), g_filters, back.sum(axis=0), features.T @ error, error.sum(axis=0)]

    def fit(self, windows: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 11, rate: float = 0.005) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        params = self.parameters()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), BATCH):
                part = order[start : start + BATCH]
                step += 1
                for p, g, m, v in zip(params, self.gradients(windows[part], target[part]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def filter_mask() -> np.ndarray:
    """1 where a filter reaches: (bytes of the widest filter, filters)."""
    return np.concatenate([np.repeat(np.arange(max(WIDTHS)) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)


def window_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of every window: side by side over the whole of each text.

    The last window of a longer text ends with the text; a shorter text has one window.
    """
    lengths = np.diff(bounds)
    counts = np.maximum(1, -(-lengths // WINDOW))
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, np.minimum(nth * WINDOW, np.maximum(lengths[owner] - WINDOW, 0))


def cut_windows(data: np.ndarray, bounds: np.ndarray, owner: np.ndarray, start: np.ndarray) -> np.ndarray:
    place = start[:, None] + np.arange(WINDOW)
    inside = place < np.diff(bounds)[owner][:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    windows = padded[np.where(inside, bounds[owner][:, None] + place, 0)].astype(np.int16)
    windows[~inside] = 256
    return windows


def sample(docs: DataFrame, id_text, text: str, lang: str) -> tuple[list[bytes], list[str]]:
    """One window each of about SAMPLE_WINDOWS rows a language, drawn by hash over all rows.

    A language with fewer rows gives several windows of a row. Windows start at hashed places
    of the whole text. Only the windows come to the driver: 256 bytes each, bounded as above.
    """
    seen = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in seen.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES).collect()}
    if not counts:
        return [], []
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, SAMPLE_WINDOWS / n)]), F.col(lang))
    draws = F.explode(F.sequence(F.lit(1), F.least(F.greatest(F.ceil(share), F.lit(1)), F.lit(20)).cast("int")))
    drawn = seen.select(F.col(lang).alias("_lang"), F.encode(text, "utf-8").alias("_b"), share.alias("_share"), id_text.alias("_id"), draws.alias("_draw"))
    chance = F.pmod(F.xxhash64("_id", "_draw", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    at = F.pmod(F.xxhash64("_id", "_draw", F.lit("place")), F.greatest(F.length("_b") - WINDOW, F.lit(0)) + 1) + 1
    rows = (
        drawn.where(chance < F.col("_share") / F.greatest(F.ceil("_share"), F.lit(1)))
        .select("_lang", "_id", "_draw", F.expr("_b").alias("_b"), at.cast("int").alias("_at"))
        .select("_lang", "_id", "_draw", F.substring("_b", F.col("_at"), F.lit(WINDOW)).alias("_w"))
        .orderBy("_lang", "_id", "_draw")
        .limit(2 * SAMPLE_WINDOWS * len(counts))
        .collect()
    )
    return [bytes(r["_w"]) for r in rows], [r["_lang"] for r in rows]


def train(docs: DataFrame, id_text, text: str = "text", lang: str = "lang") -> Network | None:
    """Network from labelled rows; None when no row has a language and a letter."""
    texts, langs = sample(docs, id_text, text, lang)
    if not texts:
        return None
    labels = sorted(set(langs))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    windows = cut_windows(np.frombuffer(b"".join(texts), np.uint8), bounds, *window_starts(bounds))
    network = Network.fresh(labels)
    network.fit(windows, np.array([labels.index(x) for x in langs]))
    return network


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score; from every window of the whole text.

    The score is the mean of a language's chances over the text's windows. A null text, one
    without a letter, and every text when nothing was learned give `und` with score 0. The
    network (some ten kilobytes) goes to the tasks with the function; rows are not shuffled.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            names = np.full(len(column), UNKNOWN, dtype=object)
            scores = np.zeros(len(column))
            known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)) if network else []
            if len(known):
                mean = np.zeros((len(column), len(network.labels)))
                for first, _, data, bounds in runs(column):
                    owner, start = window_starts(bounds)
                    for a in range(0, len(owner), CHUNK):
                        part = owner[a : a + CHUNK]
                        np.add.at(mean, first + part, network.predict(cut_windows(data, bounds, part, start[a : a + CHUNK])))
                mean = mean[known] / mean[known].sum(axis=1, keepdims=True)
                names[known] = np.array(network.labels, dtype=object)[mean.argmax(axis=1)]
                scores[known] = np.clip(mean.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(apply, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on rows whose crc32(id as text) mod 5 is not 0, predict every row: doc_id, held_out, lang_pred, score.

    A null id has the checksum of the empty text. Repeated rows get equal predictions, an
    empty table stays empty, other columns are not read.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    network = train(docs.where(~held), id_text, text_col, lang_col)
    rows = predict(docs, network, id_col, text_col)
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
