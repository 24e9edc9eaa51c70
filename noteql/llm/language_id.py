"""Language identification by hierarchical discrimination.

A document's hashed character n-gram profile goes through two levels of linear support vector machines: one-versus-one
machines among language families choose the family, then one-versus-one machines among the family's languages choose
the language. The machines are trained here, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_columns, read

#: Families of common languages by code; any other language is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "pa", "ur"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UNKNOWN = "und"
DIM = 1 << 12
#: The bound of the training sample: documents of each language, by hash order.
PER_LANGUAGE = 400
ORDERS = (1, 2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_SPACES = regex.compile(rb" {2,}")
_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def profile(text: str) -> np.ndarray | None:
    """Square roots of hashed n-gram shares over the whole text, of unit length; None if it has no letter."""
    if not _LETTER.search(text):
        return None
    data = b" " + _SPACES.sub(b" ", text.lower().encode("utf-8", "replace").translate(_PLAIN)) + b" "
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    total = np.zeros(DIM)
    gram = np.zeros(len(x), np.uint32)
    for order, m in zip(ORDERS, _MULTIPLIERS):
        if len(x) < order:
            break
        gram = (gram[: len(x) - order + 1] << np.uint32(8)) | x[order - 1 :]
        hashed = ((gram ^ (gram >> np.uint32(15))) * m) >> np.uint32(20)
        total += np.bincount(hashed, minlength=DIM) / len(hashed)
    out = np.sqrt(total)
    return out / np.linalg.norm(out)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 20.0, passes: int = 30) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by dual coordinate descent; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square = np.einsum("nd,nd->n", x, x) + 0.5 / c
    rng = np.random.default_rng(42)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / c) / square[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


@dataclass
class OneVersusOne:
    """A machine for every pair of classes; most votes win, then the greatest sum of margins."""

    classes: list[str]
    weights: np.ndarray
    pairs: list[tuple[int, int]]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray) -> OneVersusOne:
        classes = sorted(set(labels.tolist()))
        pairs = list(combinations(range(len(classes)), 2))
        weights = []
        for a, b in pairs:
            at = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
            weights.append(train_svm(x[at], np.where(labels[at] == classes[a], 1.0, -1.0)))
        return cls(classes, np.array(weights) if weights else np.zeros((0, x.shape[1] + 1)), pairs)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and the least margin by which each class won."""
        if not self.pairs:
            return np.zeros(len(x), int), np.full(len(x), 4.0)
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes = np.zeros((len(x), len(self.classes)))
        least = np.full((len(x), len(self.classes)), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        return best, least[np.arange(len(x)), best]


@dataclass
class Model:
    families: OneVersusOne
    languages: dict[str, OneVersusOne]

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str]) -> Model:
        langs = np.array(langs, object)
        families = np.array([FAMILY_OF.get(v, v) for v in langs], object)
        return cls(OneVersusOne.fit(x, families), {f: OneVersusOne.fit(x[families == f], langs[families == f]) for f in set(families.tolist())})

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and scores: the logistic function of twice the narrowest margin on the way."""
        family, margin = self.families.predict(x)
        out = np.empty(len(x), object)
        for f in np.unique(family):
            at = np.flatnonzero(family == f)
            level = self.languages[self.families.classes[f]]
            best, m = level.predict(x[at])
            out[at] = [level.classes[b] for b in best]
            margin[at] = np.minimum(margin[at], m)
        return out.tolist(), 1 / (1 + np.exp(-2 * margin))


def held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from at most ``per_language`` documents of each language, those of least hash (of id and text) among the
    documents that are not held out, with a language and a letter in their text; equal rows count once. None if there
    are no such documents."""
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit(42), id_col, text_col).alias("pick"))
    picks = known.select("lang", "pick").distinct()
    # Ranks within a salt, and then within fewer salts, come first, so that no language's rows go to one task.
    for salts in (64, 8, 1):
        few = Window.partitionBy("lang", F.pmod("pick", F.lit(salts))).orderBy("pick")
        picks = picks.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= per_language).drop("rank")
    # Bounded: per_language hashes a language. Of equal rows one goes on.
    chosen = known.join(F.broadcast(picks), ["lang", "pick"], "left_semi").groupBy("lang", "pick").agg(F.first("id").alias("id"), F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            rows = [(i, v, profile(t)) for i, v, t in zip(*(b.column(k).to_pylist() for k in range(3)))]
            rows = [(i, v, p.astype(np.float32).tobytes()) for i, v, p in rows if p is not None]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.binary()))], ["id", "lang", "x"])

    rows = chosen.select("id", "lang", "text").mapInArrow(run, "id long, lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.id is not None, r.id, r.lang, r.x))
    return Model.fit(np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(float), [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score for each row, with the columns named in ``keep`` before them; one that is named like a
    result gives way to it.

    A null text or one without a letter gets ``und`` and score 0, as does every text if there is no model. The whole
    text counts. Languages and ids are not looked at. Repeated rows come out alike; an empty table gives an empty result.
    """
    columns = kept_columns(keep, ("lang_pred", "score")) if keep is not None else [id_col]
    picked = docs.select(*columns, F.col(text_col).alias("__text"))
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for b in batches:
            names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 1024):
                texts = b.column(b.num_columns - 1).slice(at, 1024).to_pylist()
                found = [(at + k, p) for k, t in enumerate(texts) if t is not None and model is not None and (p := profile(t)) is not None]
                if found:
                    langs, s = model.predict(np.stack([p for _, p in found]))
                    for (k, _), v in zip(found, langs):
                        names[k] = v
                    scores[[k for k, _ in found]] = s
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names), pa.array(scores)], [*b.schema.names[:-1], "lang_pred", "score"])

    return picked.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
