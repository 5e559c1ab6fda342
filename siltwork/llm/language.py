"""Hierarchical language identification with linear support vector machines.

First the family (Germanic, Romance, ...), by one-versus-one machines between families, then the language,
by one-versus-one machines within the family. Features are hashed byte n-grams of lower-cased letters, as
means over the text, so whole texts of any length are scored in one pass over their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.bytehash import blocks, column_bytes
from siltwork.llm.common import bound_batches, release_caches, save, tidy

# Families of languages by code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt",
    "indic": "hi bn ur pa mr gu ne",
    "baltic": "lt lv",
}
DIM = 1 << 12
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three bytes of a block, and where each document's begin.

    Each document is read as letters and single spaces, with a space before and after.
    """
    b = _FOLD[data]
    high = np.r_[False, data[:-1] == 0xC3]
    b = np.where(high & (data >= 0x80) & (data <= 0x9E), b + np.uint8(32), b)
    n = len(off) - 1
    b = np.insert(b, np.concatenate([off[:-1], off[1:]]), np.uint8(32))
    start = off + 2 * np.arange(n + 1)
    # one space stands for several; a document's first stays
    drop = np.r_[False, (b[1:] == 32) & (b[:-1] == 32)]
    drop[start[:-1]] = False
    keep = ~drop
    first = np.r_[0, np.cumsum(keep)][start]
    b = b[keep].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(first))
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    h2 = (two * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
    h3 = (three * np.uint32(2246822519) >> np.uint32(20)).astype(np.int64)
    ok2, ok3 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    h2, h3 = h2[ok2], h3[ok3]
    at2 = np.r_[0, np.cumsum(ok2)][np.minimum(first, len(ok2))]
    at3 = np.r_[0, np.cumsum(ok3)][np.minimum(first, len(ok3))]
    return (h2, at2), (h3, at3)


def features(column) -> np.ndarray:
    """``[documents, 2 * DIM]`` float32: mean of the n-grams of each size."""
    data, off = column_bytes(column)
    out = np.zeros((len(off) - 1, 2 * DIM), np.float32)
    for i, j in blocks(off):
        for k, (h, at) in enumerate(grams(data[off[i] : off[j]], off[i : j + 1] - off[i])):
            for r in range(j - i):
                x = h[at[r] : at[r + 1]]
                if len(x):
                    out[i + r, k * DIM : (k + 1) * DIM] = np.bincount(x, minlength=DIM) / len(x)
    return out


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, c: float = 10.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; ``y`` is -1 or 1. The bias is a weight."""
    weight = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1
    alpha, w, bias, rng = np.zeros(len(x)), np.zeros(x.shape[1]), 0.0, np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0), weight[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w, float(bias)


@dataclass
class Model:
    """The machines between each two classes of a node: the root, "", has the families, a family its languages."""

    languages: list[str]
    families: dict[str, list[str]]
    machines: list[tuple[str, str, str]] = field(default_factory=list)  # node, class for > 0, class for < 0
    weights: np.ndarray | None = None  # [2 * DIM, machines]
    bias: np.ndarray | None = None

    def votes(self, margin: np.ndarray, node: str, classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning class and its least certainty against the others, by row."""
        n = len(margin)
        won, sure = np.zeros((n, len(classes))), np.ones((n, len(classes)))
        for k, (at, a, b) in enumerate(self.machines):
            if at == node:
                i, j = classes.index(a), classes.index(b)
                p = 1 / (1 + np.exp(-np.clip(2 * margin[:, k], -30, 30)))
                won[:, i] += p > 0.5
                won[:, j] += p <= 0.5
                sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = np.argmax(won + sure * 0.5, axis=1)
        return best, sure[np.arange(n), best]

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        data, off = column_bytes(column)
        labels, scores = [], []
        for i, j in blocks(off):
            margin = np.tile(self.bias, (j - i, 1)) if len(self.machines) else np.zeros((j - i, 0))
            for k, (h, at) in enumerate(grams(data[off[i] : off[j]], off[i : j + 1] - off[i])):
                if not len(self.machines) or not len(h):
                    continue
                count = np.maximum(np.diff(at), 1)[:, None]
                for m in range(len(self.machines)):
                    total = np.r_[0.0, np.cumsum(self.weights[k * DIM : (k + 1) * DIM, m][h])]
                    margin[:, m : m + 1] += (total[at[1:]] - total[at[:-1]])[:, None] / count
            names = sorted(self.families)
            best, sure = self.votes(margin, "", names)
            lang, score = np.empty(j - i, object), np.zeros(j - i)
            for f, name in enumerate(names):
                rows = np.flatnonzero(best == f)
                inner, s = self.votes(margin[rows], name, self.families[name])
                lang[rows] = np.array(self.families[name], object)[inner]
                score[rows] = np.minimum(sure[rows], s)
            labels += lang.tolist()
            scores.append(score)
        return labels, np.concatenate(scores) if scores else np.zeros(0)


def sample(labelled: DataFrame, text: str, lang: str, per_language: int) -> DataFrame:
    """``per_language`` distinct texts of each language, or all where it has fewer: those with the smallest text hash: the same at every run."""
    # copies are learned once, so the rate is of distinct texts; it leaves a few times the bound, so that no task sorts a whole language
    texts = labelled.select(F.col(lang).alias("__lang"), F.xxhash64(text).alias("__h")).distinct()
    rates = save(texts.groupBy("__lang").agg((F.lit(3.0 * per_language + 200) / F.count("*")).alias("__rate")), "rates")
    x = labelled.withColumn("__h", F.xxhash64(text)).join(rates, F.col(lang) == F.col("__lang")).where(F.pmod("__h", F.lit(1 << 30)) / (1 << 30) < F.col("__rate"))
    x = x.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col("__h").alias("h"))
    # copies of one text have one hash: each text once
    x = x.groupBy("lang", "h").agg(F.any_value("text").alias("text"))
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    return r.where(F.col("r") <= per_language).select("lang", "text")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 300, most: int = 6000) -> Model:
    """Learn from ``labelled`` rows with a language and a letter in the text.

    ``per_language`` bounds the rows learned from, less where there are very many languages: ``most`` rows in all, but 10 of each. Their
    features are computed on executors, and so a bounded number of rows of fixed width reaches the driver. No labelled row: the model
    knows no language. Columns other than ``text`` and ``lang`` are ignored.
    """
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    per_language = max(10, min(per_language, most // max(1, rows.select("lang").distinct().count())))

    def run(batches):
        for b in batches:
            # most n-grams do not occur in a text: places and values of the others
            part = [(np.flatnonzero(r).astype(np.uint16), r) for r in features(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.tobytes() + r[k].tobytes() for k, r in part], pa.binary())], names=["lang", "x"])

    got = sample(rows, "text", "lang", per_language).mapInArrow(run, "lang string, x binary").toArrow()
    found = sorted(zip(got["lang"].to_pylist(), got["x"].to_pylist(), strict=True))  # not the order of arrival
    del got
    x = np.zeros((len(found), 2 * DIM), np.float32)
    for i, (_, body) in enumerate(found):
        n = len(body) // 6
        x[i, np.frombuffer(body, np.uint16, n)] = np.frombuffer(body, np.float32, n, 2 * n)
    y = np.array([v for v, _ in found], object)
    del found
    names = sorted(set(y.tolist()))
    model = Model(names, {})
    for name in names:
        model.families.setdefault(family(name), []).append(name)
    # means of n-grams are small: brought to a norm of about 1
    scale = 1.0 / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)).mean() if len(x) else 1.0, 1e-9)
    x *= np.float32(scale)
    of = np.array([family(v) for v in y], object)
    jobs = [("", a, b, of) for a, b in combinations(sorted(model.families), 2)]
    jobs += [(f, a, b, y) for f, members in sorted(model.families.items()) for a, b in combinations(members, 2)]
    weights, bias = [], []
    for node, a, b, tag in jobs:
        take = (tag == a) | (tag == b)
        w, c = train_svm(x[take], np.where(tag[take] == a, 1.0, -1.0))
        model.machines.append((node, a, b))
        weights.append(w * scale)
        bias.append(c)
    del x
    tidy()
    model.weights = np.stack(weights, axis=1) if weights else np.zeros((2 * DIM, 0))
    model.bias = np.array(bias)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1; no shuffle.

    Null texts and texts without a letter are ``und`` with score 0; so are all where no language is known.
    Other columns stay as they are, whatever their names; columns named like the two results are replaced. Equal texts get equal
    results; an empty table returns no rows.
    """
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    schema = docs.select(kept).withColumn(lang_pred, F.lit("").cast("string")).withColumn(score, F.lit(0.0)).schema

    def run(batches):
        release_caches()
        m = known.value
        for b in batches:
            column = b.column(at)
            labels, scores = m.predict(column) if m.languages else ([UNDETERMINED] * b.num_rows, np.zeros(b.num_rows))
            letters = b.column(len(kept)).to_pylist()
            labels = [x if ok else UNDETERMINED for x, ok in zip(labels, letters, strict=True)]
            scores = np.where(np.array(letters, bool), scores, 0.0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*kept, lang_pred, score])
        tidy()

    t = F.col(text).cast("string")
    # a string column travels once
    extra = [] if docs.schema[text].dataType.simpleString() == "string" and text in kept else [t.alias("__text")]
    at = len(kept) + 1 if extra else kept.index(text)
    d = docs.select(*kept, F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("__letters"), *extra)
    return d.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", parts: int = 5):
    """Whether a document is kept from training: crc32 of its id as text, mod ``parts``, is 0. Null id: held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == 0, F.lit(True))
