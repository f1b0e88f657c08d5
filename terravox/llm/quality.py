"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

Words, their shapes (case, script, length, signs at their ends), pairs of neighbouring shapes and repetition are counted
over the whole text in hashed groups; each group is normalised, so that none outweighs the others. A truncated
singular value decomposition of a bounded labelled sample gives the latent space. Its labelled vectors, at most ``per_class`` for
each label, are broadcast: ``2 * per_class * DIM`` floats, whatever the corpus. Every document is compared with all of them
by exact cosine products, block by block, and its nearest ``neighbours`` vote with the square of their similarity. Votes are
weighted back to the labels' true shares, since the sample holds both labels alike.

Edge cases: an empty text or one that resembles no labelled text scores 0; labels that are null or have no document are left out before the
sample is bounded; of several labels for one id the largest counts; with no labels of one kind, all scores are the other kind's label. A null id is scored as any other.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.common import begin, keeps, texts, written
from terravox.ship import ship

WORDS, SHAPES, PAIRS, RATIOS, DIM = 1024, 256, 512, 16, 64
WIDTH = WORDS + SHAPES + PAIRS + RATIOS
PER_CLASS, NEIGHBOURS, BLOCK, SLICE = 2500, 15, 256, 1 << 18
_LETTER = re.compile(r"\w")


def ends(word: str) -> tuple[str, str, str]:
    """A word as the signs before its first letter or digit, what lies between, and the signs behind its last, in linear time."""
    first = _LETTER.search(word)
    if first is None:
        return word, "", ""
    lo, hi = first.start(), len(word) - _LETTER.search(word[::-1]).start()
    return word[:lo], word[lo:hi], word[hi:]


class _Memo(dict):
    """word -> its hashed word and shape, packed into one integer."""

    LIMIT = 100_000

    def __missing__(self, word: str) -> int:
        head, core, tail = ends(word)
        first, rest = core[:1], core[1:]
        kind = ("U" if first.isupper() else "l" if first.islower() else "d" if first.isdigit() else "x") + ("U" if rest.isupper() else "l" if rest.islower() else "d" if rest.isdigit() else "" if not rest else "m")
        shape = f"{kind}{min(len(core), 18) // 4}{head[:3]}|{tail[:4]}"
        code = zlib.crc32(core.lower().encode("utf-8", "replace")) % WORDS | zlib.crc32(shape.encode("utf-8", "replace")) % SHAPES << 12
        if len(self) < self.LIMIT:
            self[word] = code
        return code


_MEMO = _Memo()
keeps("quality", _MEMO.clear)


def _scaled(x: np.ndarray) -> np.ndarray:
    x = np.sqrt(x)
    n = np.sqrt((x * x).sum())
    return x / n if n else x


def features(text: str) -> np.ndarray:
    """Hashed counts of a whole text, each group of unit length."""
    out = np.zeros(WIDTH, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        return out
    codes = np.fromiter(map(_MEMO.__getitem__, words), np.int32, n)
    word, shape = codes & 0xFFF, codes >> 12
    out[:WORDS] = 0.5 * _scaled(np.bincount(word, minlength=WORDS))
    out[WORDS : WORDS + SHAPES] = _scaled(np.bincount(shape, minlength=SHAPES))
    if n > 1:
        pair = (shape[:-1].astype(np.int64) * 40503 + shape[1:]) % PAIRS
        out[WORDS + SHAPES : WORDS + SHAPES + PAIRS] = 0.7 * _scaled(np.bincount(pair, minlength=PAIRS))
    ratios = out[WORDS + SHAPES + PAIRS :]
    ratios[0] = (codes[1:] == codes[:-1]).mean() if n > 1 else 0
    ratios[1] = (codes[2:] == codes[:-2]).mean() if n > 2 else 0
    distinct = len(np.unique(codes)) / n
    ratios[2], ratios[3] = distinct, 1 - distinct
    letters = sum(sum(map(str.isalpha, text[lo : lo + SLICE])) for lo in range(0, len(text), SLICE))
    ratios[4] = letters / len(text)
    ratios[5] = 1 - ratios[4]
    ratios[6 + min(9, int(np.log2(n)) // 2)] = 0.2
    return out


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """(features, labels, shares): at most ``per_class`` documents of each label, chosen by a hash of their id.

    Only labels of documents that exist are counted and chosen; of several texts under one id the smallest is learned from.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("label").alias("label"))
    marks = written(marks.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi"), "labelled")
    shares = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = None
    for label in (0, 1):
        part = marks.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = texts(docs, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")

    def run(batches):
        for batch in batches:
            rows = [zstandard.compress(features(t).astype("<f4").tobytes(), 1) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["x", "label"])

    got = sample.mapInArrow(run, "x binary, label int").collect()
    x = np.array([np.frombuffer(zstandard.decompress(r["x"]), "<f4") for r in got], np.float32).reshape(-1, WIDTH)
    return x, np.array([r["label"] for r in got], np.int64), shares


class Voters:
    """Latent space and labelled vectors in it."""

    def __init__(self, x: np.ndarray, label: np.ndarray, shares: dict[int, int], dim: int = DIM):
        self.label = label
        rng = np.random.default_rng(0)
        df = (x > 0).sum(axis=0)
        self.idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32)
        self.idf[WORDS:] = 1
        self.idf[:WORDS] /= max(1e-6, self.idf[:WORDS].mean())
        a = x * self.idf
        k = min(dim, *a.shape) if len(a) else 0
        basis = rng.normal(size=(WIDTH, min(k + 16, WIDTH))).astype(np.float32) if k else np.zeros((WIDTH, 0), np.float32)
        for _ in range(3 if k else 0):
            basis, _ = np.linalg.qr(a.T @ (a @ basis))
        if k:
            _, _, turn = np.linalg.svd(a @ basis, full_matrices=False)
            basis = basis @ turn[:k].T
        self.basis = basis
        self.vectors = self.latent(x)
        counts = np.bincount(label, minlength=2) if len(label) else np.array([0, 0])
        self.weight = np.array([shares.get(c, 0) / max(1, counts[c]) for c in (0, 1)])
        self.weight /= max(self.weight.max(), 1e-12)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.basis
        n = np.sqrt((z * z).sum(axis=1, keepdims=True))
        return np.divide(z, n, out=np.zeros_like(z), where=n > 1e-9)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the weighted vote."""
        if not len(self.label):
            return np.zeros(len(x))
        z = self.latent(x)
        cosine = z @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(np.negative(cosine, out=cosine), k - 1, axis=1)[:, :k]
        weight = np.maximum(-np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** 2 * self.weight[self.label[near]]
        total = weight.sum(axis=1)
        return np.divide((weight * self.label[near]).sum(axis=1), total, out=np.zeros(len(x)), where=total > 0)


def scorer(voters, neighbours: int = NEIGHBOURS):
    """A column function text -> score, for whole texts; ``voters`` is a broadcast Voters."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        begin("quality")
        # Texts become Python strings a block at a time.
        out = [np.zeros(0)]
        for lo in range(0, len(text), BLOCK):
            words = text.slice(lo, BLOCK).to_pylist()
            x = np.empty((len(words), WIDTH), np.float32)
            for i, t in enumerate(words):
                x[i] = features(t)
            out.append(voters.value.score(x, neighbours))
        return pa.array(np.clip(np.concatenate(out), 0, 1))

    return score


def scores(docs: DataFrame, voters, id_col: str = "doc_id", text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, score) per row."""
    return texts(docs, id_col, text_col).select("id", scorer(voters, neighbours)("text").alias("score"))


def accepted(docs: DataFrame, voters, least: float = 0.7, text_col: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of docs, all columns, that score ``least`` or more."""
    ship(docs.sparkSession)
    return docs.filter(scorer(voters, neighbours)(F.coalesce(F.col(text_col), F.lit(""))) >= least)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """Broadcast voters, learned from the labels given."""
    return docs.sparkSession.sparkContext.broadcast(Voters(*labelled(docs, labels, per_class, id_col, text_col, label_col)))
