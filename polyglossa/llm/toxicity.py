"""Toxicity by compression distance.

Two dictionaries come from a bounded sample of labelled rows: one of ordinary texts, trained by zstandard, and one of what tells toxic texts:
beginnings of words that toxic rows hold far more often, and the words that begin so (otherwise both would mostly hold the same ordinary
language; see the README). Beginnings gather the rare forms of a word, none of which is frequent by itself. They stand nearest to the text, the
commonest last, so that zstandard names them in the fewest bits.
Every text is cut into windows of about `window` bytes at white space. A window is compressed with the ordinary dictionary alone and with
the toxic one beside it; the difference of the two lengths is its gain. A logistic curve turns a text's gains into its score. It is calibrated by
cross-fitting: the gains of each half of the sample come from dictionaries trained on the other half, so no text was seen by its own dictionary.
The sample is halved HALVINGS times, each time by another hash of the texts, so the result does not hang on the order of rows.

Inputs of a score: the text alone. Null and empty texts have no windows and get the curve's value at zero. Rows are scored one
by one, so repeated rows get equal scores; a null doc_id is scored and is not held out. With no labels of either kind the score is
the share of toxic rows in the sample (near 0 without any). Other columns are not read; labels are taken as their largest per doc_id.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep, raw_texts


# Share, words of a beginning and GAIN were chosen by cross-validation inside the fitted rows of check_s, the others before inside those of sf0.1.
#: Bytes of the two dictionaries; bytes of entropy tables at the head of a trained one, which only its content follows.
TOXIC_BYTES, ORDINARY_BYTES, HEAD = 4_096, 32_768, 300
#: The beginning of a word is telling if so many words with it for each toxic row, and so many times as many as for an ordinary row, are found; a word counts once in a text.
LEAST_SHARE, LEAST_RATIO = 0.03, 32.0
#: Bytes of a beginning; a longer one is taken if it has this share of the words.
BEGINNING, SAME = range(4, 17), 0.9
#: Texts that hold a word of a telling beginning; bytes of such a word.
LEAST_TEXTS, FORM = 3, 64
#: Bytes that a window must gain to count as toxic.
GAIN = 2
HALVINGS = 3


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    window: int
    mean: list[float]
    scale: list[float]
    weights: list[float]  # the first is the constant


def cut(text: bytes, size: int) -> list[bytes]:
    out, held, n = [], [], 0
    for w in text.lower().split():
        held.append(w)
        n += len(w) + 1
        if n >= size:
            out.append(b" " + b" ".join(held))
            held, n = [], 0
    if held:
        out.append(b" " + b" ".join(held))
    return out


def held(texts: list[bytes]) -> Counter:
    """In how many texts each word stands, with a blank behind it."""
    return Counter(w for t in texts for w in {w.strip(b".,;:!?*$#%\"'()") + b" " for w in t.lower().split()})


def beginnings(words: Counter, of: Container[bytes] | None = None) -> Counter:
    """Words for each beginning, one of `of` if given."""
    out: Counter = Counter()
    for w, n in words.items():
        for k in range(BEGINNING.start, min(len(w) + 1, BEGINNING.stop)):
            if of is None or w[:k] in of:
                out[w[:k]] += n
    return out


def typical(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of telling beginnings, then these, the commonest last."""
    words = held(toxic)
    least = max(5, LEAST_SHARE * len(toxic))
    counts = {p: n for p, n in beginnings(words).items() if n >= least}
    against = beginnings(held(ordinary), counts)
    telling = {p for p, n in counts.items() if n * len(ordinary) > LEAST_RATIO * against[p] * len(toxic)}
    longer: dict[bytes, list[bytes]] = {}
    for p in sorted(counts):
        longer.setdefault(p[:-1], []).append(p)
    stems = {}
    for p in telling:
        if not any(p[:k] in telling for k in range(BEGINNING.start, len(p))):
            stem = p
            while more := [x for x in longer.get(stem, ()) if counts[x] >= SAME * counts[p]]:
                stem = more[0]
            stems[stem] = counts[p]
    forms = sorted((n, w) for w, n in words.items() if n >= LEAST_TEXTS and w not in stems and any(w[:k] in stems for k in BEGINNING))
    return [w[:FORM] for _, w in forms] + [p for _, p in sorted((n, p) for p, n in stems.items())]


def trained(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """Content of a dictionary that zstandard trains on the samples; the samples' own end where they are too few to train on."""
    try:
        made = zstd.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b" "
    return made[-max(size - HEAD, 1) :]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary and toxic content, ordinary content before as many zero bytes)."""
    special = b"".join(b" " + w for w in typical(toxic, ordinary))[-TOXIC_BYTES:]
    common = trained(ORDINARY_BYTES, ordinary, 64, 8)
    return common + special, common + bytes(len(special))


class Scorer:
    def __init__(self, toxic: bytes, ordinary: bytes, window: int):
        self.window = window
        kind = zstd.ZstdCompressionParameters.from_level(3, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False, source_size=window, dict_size=len(toxic))
        self.pair = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=kind) for d in (ordinary, toxic)]

    def sizes(self, which: int, windows: list[bytes]) -> np.ndarray:
        table = np.zeros((len(windows), 2), "<u8")
        table[:, 1] = [len(w) for w in windows]
        table[1:, 0] = np.cumsum(table[:-1, 1])
        out = self.pair[which].multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(windows), table.tobytes()), threads=1)
        return np.array([len(x) for x in out], np.int64)

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), 6))
        parts = [cut(t, self.window) for t in texts]
        windows = [w for p in parts for w in p]
        if not windows:
            return out
        gain = np.maximum(self.sizes(0, windows) - self.sizes(1, windows), 0).astype(float)
        counts = np.array([len(p) for p in parts])
        rows = np.flatnonzero(counts)
        at = (np.cumsum(counts) - counts)[rows]
        n = counts[rows]
        total, high = np.add.reduceat(gain, at), np.add.reduceat((gain >= GAIN).astype(float), at)
        out[rows] = np.stack([np.log1p(total), np.maximum.reduceat(gain, at), total / n, np.log1p(n), high / n, np.log1p(high)], 1)
        return out


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (the first is the constant), by Newton steps with a small ridge."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (y - p) - 0.1 * w)
    return mean, scale, w


def halves(texts: list[bytes], turn: int) -> tuple[list[bytes], list[bytes]]:
    ordered = sorted(texts, key=lambda t: hashlib.sha256(bytes([turn]) + t).digest())
    return ordered[::2], ordered[1::2]


def train(toxic: list[bytes], ordinary: list[bytes], window: int) -> Model:
    if len(toxic) < 2 or len(ordinary) < 2:
        share = len(toxic) / max(1, len(toxic) + len(ordinary))
        return Model(b" ", b" ", window, [0] * 6, [1] * 6, [math.log((share + 1e-3) / (1 - share + 1e-3)), *[0] * 6])
    x, y = [], []
    for turn in range(HALVINGS):
        bad, good = halves(toxic, turn), halves(ordinary, turn)
        for half in (0, 1):
            scorer = Scorer(*dictionaries(bad[1 - half], good[1 - half]), window)
            for texts, label in ((bad[half], 1.0), (good[half], 0.0)):
                x.append(scorer.features(texts))
                y.append(np.full(len(texts), label))
    mean, scale, w = logistic(np.concatenate(x), np.concatenate(y))
    return Model(*dictionaries(toxic, ordinary), window, mean.tolist(), scale.tolist(), w.tolist())


def fold(c):
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3, F.lit(0))


def score_documents(docs: DataFrame, labels: DataFrame, window: int = 32, most_toxic: int = 3_000, most_ordinary: int = 6_000, most_bytes: int = 16 << 20, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted.

    At most most_toxic and most_ordinary labelled doc_ids, by hash, are fitted on, each with one text, its smallest; of either kind as
    many as fit into most_bytes, whole texts.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = marked.filter("toxic = 1").orderBy(order, "doc_id").limit(most_toxic).unionByName(marked.filter("toxic = 0").orderBy(order, "doc_id").limit(most_ordinary))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).cast("binary").alias("text"))
    texts = keep(docs.sparkSession, texts, "labelled")  # as many rows as are chosen
    size = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(order, "doc_id"))
    rows = texts.withColumn("size", size).filter(F.col("size") <= most_bytes).select("toxic", "text").collect()
    discard(docs.sparkSession, texts)
    found = {k: sorted({bytes(r["text"]) for r in rows if r["toxic"] == k}) for k in (0, 1)}
    model = train(found[1], found[0], window)

    def run(batches):
        scorer = Scorer(model.toxic, model.ordinary, model.window)
        weights = np.array(model.weights)
        for b in batches:
            for at, texts in raw_texts(b.column(1)):
                x = (scorer.features(texts) - np.array(model.mean)) / np.array(model.scale)
                score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(texts)], pa.array(score)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
