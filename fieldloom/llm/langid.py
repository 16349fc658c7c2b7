"""Language identification by error-correcting output codes.

Every language has a codeword; one binary classifier for each bit sees hashed
character n-grams of the whole text. The classifiers are regularised least
squares, solved at once, whose leave-one-out residuals come with the solution.
Decoding sums the squared hinge loss of every bit against every codeword, each
bit weighted by how often it is right when left out, and takes the nearest
codeword. A text whose runner-up is about as near, or whose nearest codeword is
farther away than it is for left-out texts, is ambiguous.

The classifiers are fitted on at most ``per_language`` labelled rows of a language;
everything else runs over all rows, map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import col, fresh

DIMS = 4096
ORDERS = (1, 2, 3)


def codewords(classes: int, seed: int = 5) -> np.ndarray:
    """A matrix of +1 and -1, a row for each class; exhaustive up to 6 classes, else the best of random ones."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        bits = [[1 if c == 0 or (b >> (c - 1)) & 1 else -1 for b in range(2 ** (classes - 1) - 1)] for c in range(classes)]
        return np.array(bits, float)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    best, far = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (classes, length))
        apart = min(int((m[i] != m[j]).sum()) for i in range(classes) for j in range(i))
        if apart > far and (np.abs(m.sum(0)) < classes).all():
            best, far = m, apart
    return best


def features(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the square roots of hashed n-gram counts, and the letters of each text.

    All but letters and marks count as one separator; runs of it count once.
    """
    c, at = tv.codes(b, o)
    n_docs = len(o) - 1
    c = c.astype(np.uint64)
    letter = ((c >= 97) & (c <= 122)) | ((c >= 192) & (c != 215) & (c != 247) & ~((c >= 0x2000) & (c <= 0x2BFF)) & ~((c >= 0x3000) & (c <= 0x303F)))
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    if len(keep):
        keep[0] = True
    c, doc, letters = np.where(letter, c, np.uint64(32))[keep], doc[keep], np.bincount(doc[letter], minlength=n_docs)
    counts = np.zeros(n_docs * DIMS, np.float32)
    h = np.zeros(len(c), np.uint64)
    for k in ORDERS:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h[k - 1 :] += c[: len(c) - k + 1]  # the window of k characters that ends here, newest factor last
        whole = np.zeros(len(c), bool)
        whole[k - 1 :] = doc[k - 1 :] == doc[: len(c) - k + 1]
        key = (tv.mix(h + np.uint64(k)) >> np.uint64(52)).astype(np.int64)
        counts += np.bincount((doc * DIMS + key)[whole], minlength=n_docs * DIMS)
    x = np.sqrt(counts.reshape(n_docs, DIMS))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9), letters


@dataclass
class Model:
    """``names`` of the languages, their codewords, the bits' weights, the matrix of the classifiers, the limits."""

    names: list[str]
    code: np.ndarray
    bits: np.ndarray
    matrix: np.ndarray
    far: float
    min_margin: float

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest class, its loss and the runner-up's lead over it, both per unit of weight."""
        loss = np.maximum(0, 1 - margins[:, None, :] * self.code[None]) ** 2 @ self.bits
        best = loss.argmin(1)
        order = np.sort(loss, 1)
        return best, order[:, 0], order[:, 1] - order[:, 0]


def fit(docs: DataFrame, per_language: int = 400, ridge: float = 0.1, far_factor: float = 3.0, min_margin: float = 0.15, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Fit the classifiers on the labelled rows; None if fewer than two languages are labelled.

    Of each language the ``per_language`` rows that come first in the order of a
    hash of id and text are used, whole. Rows with a null label, or a null or
    empty text, are not used.
    """
    rows = docs.select(col(docs, lang_col).cast("string").alias("lang"), col(docs, text_col).alias("text"), F.xxhash64(col(docs, id_col), col(docs, text_col)).alias("h"))
    rows = rows.filter("lang IS NOT NULL AND length(text) > 0")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2.0 * per_language / n + 20.0 / n))) for k, n in sorted(counts.items())])
    likely = rows.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    chosen = likely.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= per_language)

    def vectors(batches):
        for batch in batches:
            b_all, o_all = tv.buffers(pc.utf8_lower(batch.column(1)))
            for i, j in tv.slices(o_all, rows=256):
                x, letters = features(b_all[o_all[i] : o_all[j]], o_all[i : j + 1] - o_all[i])
                has = np.flatnonzero(letters)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(has)), pa.array([x[k].astype(np.float16).tobytes() for k in has], pa.binary())], names=["lang", "x"])

    found = chosen.select("lang", "text").mapInArrow(vectors, "lang string, x binary").toArrow()
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(v.as_py() for v in found.column("x")), np.float16).reshape(-1, DIMS).astype(np.float64)
    langs = np.array(found.column("lang").to_pylist())
    order = np.lexsort((x @ np.arange(DIMS), langs))  # rows arrive in any order; sums must not depend on it
    x, langs = x[order], langs[order]
    names = sorted(set(langs.tolist()))
    if len(names) < 2:
        return None
    code = codewords(len(names))
    which = np.searchsorted(names, langs)
    y = code[which]
    inverse = np.linalg.inv(x @ x.T + ridge * np.eye(len(x)))
    dual = inverse @ y
    left_out = y - dual / np.diag(inverse)[:, None]
    bits = np.maximum((np.sign(left_out) == y).mean(0) - 0.5, 0.0)
    bits = bits / bits.sum() if bits.sum() > 0 else np.full(len(bits), 1 / len(bits))
    model = Model(names, code, bits, np.round(x.T @ dual, 6).astype(np.float32), np.inf, min_margin)
    best, near, _ = model.decode(left_out)
    right = near[best == which]
    model.far = far_factor * float(np.quantile(right, 0.99)) if len(right) else np.inf
    return model


def identify(docs: DataFrame, model: Model | None = None, min_letters: int = 12, result: str = "language", id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """Add a struct column ``result``: ``predicted, loss, margin, ambiguous``.

    ``model`` defaults to one fitted on these rows (``options`` go to ``fit``).
    A text is ambiguous if the runner-up's loss is within the model's margin, or
    if the nearest codeword is too far. A null text, an empty one, or one of fewer
    than ``min_letters`` letters gives no evidence: ``predicted`` is null and
    ``ambiguous`` is false. With fewer than two labelled languages nothing can be
    told apart and all rows come out so. Rows are kept as they are, repeated ones
    too; all columns pass through, and ``result`` takes another name where it
    clashes (underscores before it). An empty table gives an empty one.
    """
    if model is None:
        model = fit(docs, id_col=id_col, lang_col=lang_col, text_col=text_col, **options)
    (name,) = fresh(docs, result)
    kind = "predicted string, loss double, margin double, ambiguous boolean"
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("margin"), F.lit(False).alias("ambiguous")))

    def judge(text: pa.Array) -> pa.Array:
        b_all, o_all = tv.buffers(pc.utf8_lower(text))
        parts = []
        for i, j in tv.slices(o_all, rows=256):
            x, letters = features(b_all[o_all[i] : o_all[j]], o_all[i : j + 1] - o_all[i])
            best, near, lead = model.decode((x @ model.matrix).astype(float))
            none = letters < min_letters
            parts.append((best, np.round(near, 6), np.round(lead, 6), none))
        best, near, lead, none = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, bool))
        unclear = ~none & ((lead < model.min_margin) | (near > model.far))
        predicted = pa.DictionaryArray.from_arrays(pa.array(best.astype(np.int32), mask=none), pa.array(model.names)).cast(pa.string())
        return pa.StructArray.from_arrays([predicted, pa.array(near, mask=none), pa.array(lead, mask=none), pa.array(unclear)], names=["predicted", "loss", "margin", "ambiguous"])

    judge.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return docs.withColumn(name, F.arrow_udf(judge, kind)(col(docs, text_col)))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """The rows that ``identify`` does not find ambiguous, with the columns of ``docs``."""
    (name,) = fresh(docs, "language")
    judged = identify(docs, result=name, id_col=id_col, lang_col=lang_col, text_col=text_col, **options)
    return judged.filter(~F.col(name)["ambiguous"]).select(*[col(judged, c) for c in docs.columns])
