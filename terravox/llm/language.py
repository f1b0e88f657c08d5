"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's n-grams of one to four characters, with a space at its ends, are hashed to ``BUCKETS`` embeddings. A text is the
average of the embeddings of all n-grams of all its words; a linear softmax on it names the language. Both layers are trained by
stochastic gradient descent on a bounded sample (``per_language`` rows of each language, ``most_rows`` in all), and a temperature
fitted on a fifth of it, kept out of training, makes the probability of the best language a calibrated confidence. ``threshold``
gives the confidence that reaches an accuracy on that fifth; texts below it are marked as not accepted. Below ``least`` the text is
rejected as ``und`` altogether.

As the model is linear after the average, a text's bucket counts times one table of logits give its prediction.

Edge cases: null, empty and letterless texts are ``und`` with score 0; rows whose language is null are not learned from; with no
row to learn from, all texts are ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terravox.llm.common import small, texts, written
from terravox.ship import ship

BUCKETS, DIM, PER_LANGUAGE, MOST_ROWS, EPOCHS, SLICE = 8192, 16, 400, 16_000, 12, 1 << 18
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
UNKNOWN = "und"


def counts(text: str) -> np.ndarray:
    """Occurrences of each n-gram bucket in a whole text, taken slice by slice."""
    out = np.zeros(BUCKETS, np.int64)
    marked = f" {' '.join(text.lower().split())} "
    for lo in range(0, len(marked), SLICE):
        code = np.frombuffer(marked[lo : lo + SLICE + 3].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        gap = code == 32
        starts = min(SLICE, len(code))
        h, inner = np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
        for n in range(1, 5):
            # Letters n of the n-grams that start at each place; a space may only be first or last.
            if n > len(code):
                break
            if n > 2:
                inner = inner[:-1] | gap[n - 2 : -1]
            else:
                inner = inner[: len(code) - n + 1]
            h = h[: len(code) - n + 1] * _STEP + code[n - 1 :] + np.uint64(n)
            good = ~inner[:starts] if n > 1 else ~gap[:starts]
            mixed = (h[:starts][good[: len(h)]] * _SPREAD) >> np.uint64(51)
            out += np.bincount(mixed.astype(np.int64), minlength=BUCKETS)
    return out


def shares(text: str) -> np.ndarray:
    got = counts(text)
    return (got / max(1, got.sum())).astype(np.float32)


class Model:
    """Embeddings, softmax layer and temperature."""

    def __init__(self, x: np.ndarray, names: list[str], seed: int = 0):
        self.languages = sorted(set(names))
        y = np.array([self.languages.index(n) for n in names], np.int64)
        c, rng = len(self.languages), np.random.default_rng(seed)
        self.temperature, self.held = 1.0, (np.zeros(0), np.zeros(0, bool))
        self.table, self.bias = np.zeros((BUCKETS, c), np.float32), np.zeros(c, np.float32)
        if not len(y):
            return
        order = rng.permutation(len(y))
        kept, train = order[: len(y) // 5], order[len(y) // 5 :]
        # Rows of one n-gram share scale: frequent n-grams would otherwise drown the telling ones.
        scale = 1 / np.sqrt(x[train].mean(axis=0) + 1e-5)
        e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, c), np.float32), np.zeros(c, np.float32)
        x = x * scale.astype(np.float32)
        for epoch in range(EPOCHS):
            rate = 0.5 * (1 - epoch / EPOCHS)
            rng.shuffle(train)
            for i in range(0, len(train), 32):
                at = train[i : i + 32]
                h = x[at] @ e
                p = self._softmax(h @ w + b)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                back = p @ w.T
                w -= rate * h.T @ p
                b -= rate * p.sum(axis=0)
                e -= rate * x[at].T @ back
        self.table = (scale[:, None] * (e @ w)).astype(np.float32)
        self.bias = b
        logits = x[kept] @ (e @ w) + b
        if len(kept):
            grid = np.exp(np.linspace(-4, 3, 57))
            loss = [-np.log(self._softmax(logits / t)[np.arange(len(kept)), y[kept]] + 1e-9).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
            p = self._softmax(logits / self.temperature)
            self.held = p.max(axis=1), p.argmax(axis=1) == y[kept]

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages for rows of n-gram shares."""
        return self._softmax((x @ self.table + self.bias) / self.temperature)

    def threshold(self, accuracy: float) -> float:
        """The least confidence above which held-back rows reach an accuracy."""
        order = np.argsort(self.held[0])
        confidence, right = self.held[0][order], self.held[1][order]
        for i in range(len(right)):
            if right[i:].mean() >= accuracy:
                return float(confidence[i])
        return 1.0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_rows: int = MOST_ROWS):
    """A broadcast Model of the texts' languages.

    At most ``per_language`` ids of each are chosen by their hash, fewer where there are so many languages that ``most_rows`` would be
    exceeded; of several texts under one id and language the smallest is learned from.
    """
    ship(docs.sparkSession)
    known = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("h")).filter("lang IS NOT NULL")
    ranked = known.groupBy("lang", "h").count().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= per_language)
    bounds = written(ranked.groupBy("lang").agg(F.sort_array(F.collect_list("h")).alias("hs")), "languages")
    each = max(1, min(per_language, most_rows // max(1, bounds.count())))
    bound = bounds.select("lang", F.element_at("hs", F.least(F.lit(each), F.size("hs"))).alias("top"))
    sample = known.join(F.broadcast(bound), "lang").filter("h <= top").groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")

    def run(batches):
        for batch in small(batches):
            x = [zstandard.compress(shares(t).tobytes(), 1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "lang"])

    got = sorted(sample.mapInArrow(run, "x binary, lang string").collect(), key=lambda r: (r["lang"], r["x"]))
    x = np.array([np.frombuffer(zstandard.decompress(r["x"]), np.float32) for r in got], np.float32).reshape(-1, BUCKETS)
    return docs.sparkSession.sparkContext.broadcast(Model(x, [r["lang"] for r in got]))


def predict(docs: DataFrame, model, least: float = 0.0, accuracy: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) per row, for the whole text.

    accepted: the confidence is one above which held-back rows reach ``accuracy``; never true where lang_pred is ``und``.
    """
    sure_from = max(least, model.value.threshold(accuracy))

    def run(batches):
        known = model.value
        names = known.languages
        for batch in small(batches):
            out, sure = [], []
            for text in batch.column(1).to_pylist():
                if not names or not any(map(str.isalpha, text)):
                    out.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                p = known.probabilities(shares(text)[None, :])[0]
                best = int(p.argmax())
                out.append(names[best] if p[best] >= least else UNKNOWN)
                sure.append(float(p[best]))
            accepted = [s >= sure_from and o != UNKNOWN for o, s in zip(out, sure)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(sure, pa.float64()), pa.array(accepted, pa.bool_())], names=["id", "lang_pred", "score", "accepted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "id long, lang_pred string, score double, accepted boolean")
