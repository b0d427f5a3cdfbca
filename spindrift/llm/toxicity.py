"""Toxicity by compression distance to two zstandard dictionaries.

Two dictionaries are trained by zstandard: one on the windows of ordinary
documents, one on the telling words of toxic documents, each as often as it
occurs. A toxic document is ordinary text but for a few words, and the trainer
keeps what is frequent: trained on whole toxic windows it learns ordinary text
once more. Telling are words with character n-grams that are met in many
contexts in toxic documents and hardly in ordinary ones. A document is cut
into windows of ten words. A window's distance is its compressed length with
the ordinary dictionary less that with the toxic one beside it; windows whose
distance is above a small threshold speak for toxicity. A logistic curve,
calibrated on the labelled documents, turns the share and the strength of such
windows into a score between 0 and 1.

Training uses a bounded sample of labelled rows: ``sample`` documents, those
with the smallest hash of their id, their whole texts; nothing else goes
through the driver, and the model (two dictionaries of a few kilobytes) goes
back. Scoring covers every whole text and needs no shuffle.

Defined results: null and empty texts have one empty window and get the score
of a text without evidence; without labelled documents of both kinds every
score is 0; repeated rows get equal scores; several labels of one doc_id
count as toxic if any is; null labels and null doc_ids train nothing; an
empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import documents, mapped, text_of

#: Labelled documents that training looks at, at most about this many.
SAMPLE = 4000
WINDOW = 10
LEVEL = 6
ORDINARY_BYTES = 8192
TOXIC_BYTES = 4096
THRESHOLD = 0.3
#: Bytes that a window's distance must exceed to count.
NOISE = 2
HELD_OUT = 2
#: Fixed value of the dictionary format: three offsets (1, 4 and 8) end the header, and the dictionary's text follows.
HEADER_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"

WORDS = re.compile(r"[^\W_]+")


def windows(text: str, width: int = WINDOW) -> list[bytes]:
    words = WORDS.findall(text.lower())
    return [f" {' '.join(words[i:i + width])} ".encode() for i in range(0, len(words), width)] or [b" "]


def _pieces(word: str) -> set[str]:
    word = f" {word} "
    return {word[i:i + k] for k in (4, 5, 6) for i in range(len(word) - k + 1)}


def _met_in(texts: list[str], among: frozenset | None = None) -> Counter:
    """In how many of the texts each n-gram occurs."""
    met: Counter = Counter()
    for text in texts:
        pieces = set().union(*map(_pieces, set(WORDS.findall(text.lower()))))
        met.update(pieces if among is None else pieces & among)
    return met


def telling_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words of the toxic texts that hold a telling n-gram, each as often as it occurs, by threes.

    An n-gram is telling if a share of the toxic texts holds it, of the
    ordinary ones a fraction of that share at most, and if it stands in words
    between several pairs of neighbours, so that copies of one text count once.
    """
    least = max(2, min(7, len(toxic) // 5), len(toxic) // 100)
    met = {p: n for p, n in _met_in(toxic).items() if n >= least}
    plain = _met_in(ordinary, frozenset(met))
    telling = {p for p, n in met.items() if n / len(toxic) > 40 * (plain[p] + 1) / len(ordinary)}
    contexts = defaultdict(set)
    texts = [WORDS.findall(text.lower()) for text in toxic]
    for words in texts:
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            for piece in _pieces(word) & telling:
                contexts[piece].add((before, after))
    telling = {p for p in telling if len(contexts[p]) >= 2 * least}
    held = {w for words in texts for w in words if _pieces(w) & telling}
    found = [w for words in texts for w in words if w in held]
    return [f" {' '.join(found[i:i + 3])} ".encode() for i in range(0, len(found), 3)]  # the trainer skips samples below eight bytes


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """The text of a dictionary of about size bytes trained on the samples, which are repeated where they are too few to train on."""
    import zstandard

    while samples and sum(map(len, samples)) < 100 * size:
        samples = samples * 2
    if not samples:
        return b""
    return zstandard.train_dictionary(size + 1200, samples, **how).as_bytes().partition(HEADER_END)[2][-size:]


class CompressionModel:
    """Two dictionaries and a calibrated curve."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights = np.zeros(5)

    def compressors(self):
        import zstandard

        made = []
        for content in (self.ordinary, self.toxic):
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=trained, level=LEVEL, write_content_size=False,
                                                 write_dict_id=False).compress)
        return made

    def features(self, text: str, compressors) -> list[float]:
        plain, toxic = compressors
        over = [max(0, len(plain(w)) - len(toxic(w)) - NOISE) for w in windows(text)]
        share = sum(over) / len(over)
        return [share ** 0.5, share, max(over) / 4, sum(x >= 2 for x in over) / len(over)]

    def calibrate(self, rows: np.ndarray, labels: np.ndarray, steps: int = 60) -> None:
        """Logistic regression with a little shrinkage, by Newton's method."""
        x = np.c_[rows, np.ones(len(rows))]
        w = np.zeros(x.shape[1])
        ridge = np.diag([0.05] * rows.shape[1] + [1e-6])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - labels) + ridge @ w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, text: str, compressors) -> float:
        z = float(np.dot([*self.features(text, compressors), 1.0], self.weights))
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z)))))


def train(toxic: list[str], ordinary: list[str]) -> CompressionModel | None:
    if not toxic or not ordinary:
        return None
    shared = trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES)
    own = trained(telling_words(toxic, ordinary), TOXIC_BYTES, k=50, d=8)
    model = CompressionModel(shared, shared + b" " + own + b" ")
    compressors = model.compressors()
    model.calibrate(np.array([model.features(t, compressors) for t in (*toxic, *ordinary)]),
                    np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel | None:
    """Train on at most ``sample`` labelled documents outside the held-out quarter."""
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` ids and marks
    rows = (docs.select("doc_id", text_of().alias("text"))
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic"), F.min("text")).orderBy("doc_id").collect())
    return train([r[2] for r in rows if r[1] == 1], [r[2] for r in rows if r[1] == 0])


def score(docs: DataFrame, model: CompressionModel | None, keep_text: bool = False) -> DataFrame:
    """docs with score, the probability that a document is toxic, and their text if asked for."""
    made: list = []  # filled once a task

    def run(batch):
        if model and not made:
            made.extend(model.compressors())
        return [pa.array([model.score(t, made) if model else 0.0 for t in batch.column(0).to_pylist()], pa.float64())]

    return mapped(docs, {"text": text_of()}, run, "score double", without=[] if keep_text else ["text"])


def toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with score, from a model trained on the labelled documents of corpus (docs by default)."""
    return score(docs, fit(docs if corpus is None else corpus, labels, sample), keep_text=True)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
