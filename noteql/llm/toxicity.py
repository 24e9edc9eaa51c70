"""Toxicity scores by a counterfactually regularised classifier.

A sentence scores by a linear model of its words and their beginnings, and a document by its sentence of highest score,
so a few toxic sentences count the same in a short text and in a long one, and many harmless words do not add up. The
labels are of documents: training looks for the sentence that makes a document toxic as it goes.

Words that merely name a group come along with abuse in the labelled texts, and a plain classifier would learn them as
signs of it. So the identity terms of labelled sentences are swapped for every other term of their kind, and the
squared change of the score is added to the loss. What is left to such a term is what it has in common with its kind,
which is shrunk as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept_columns, read, text_bytes

#: The bound of the training sample: labelled documents of each class, by hash order.
PER_CLASS = 800
#: Beginnings of words that are features beside the word, by length, so that inflected forms share them.
PREFIXES = range(3, 11)
#: A feature is learned if so many documents of the sample have it.
LEAST_DOCUMENTS = 3
#: And if it goes with a class by so many standard deviations.
ASSOCIATION = 3.0
COUNTERFACTUAL = 4.0
DECAY = 2e-3
STEPS = 300
#: Terms that name groups of people, by kind and form, in the languages that are looked at.
IDENTITY = {
    "religion": "atheist buddhist catholic christian hindu jewish mormon muslim protestant sikh",
    "religion, people": "atheists buddhists catholics christians hindus jews mormons muslims protestants sikhs",
    "origin": "african american arab asian chinese european indian irish jamaican mexican nigerian polish russian turkish",
    "origin, people": "africans americans arabs asians europeans immigrants indians mexicans refugees russians turks",
    "colour": "black brown latino white",
    "orientation": "bisexual gay heterosexual homosexual lesbian queer straight transgender",
    "gender": "boy girl man woman",
    "gender, people": "boys girls men women",
    "age and health": "blind deaf disabled elderly old young",
    "religion, de": "atheistisch buddhistisch christlich hinduistisch jüdisch katholisch muslimisch",
    "people, de": "afrikaner asiaten ausländer christen flüchtlinge frauen juden männer muslime türken",
    "religion, fr": "athée bouddhiste catholique chrétien hindou juif musulman",
    "people, fr": "africains arabes asiatiques chrétiens femmes hommes immigrés juifs musulmans réfugiés",
    "religion, es": "ateo budista católico cristiano hindú judío musulmán",
    "people, es": "africanos asiáticos cristianos hombres inmigrantes judíos mujeres musulmanes refugiados árabes",
}
KIND_OF = {term: kind for kind, terms in IDENTITY.items() for term in terms.split()}
_SENTENCE = re.compile(r"[.!?;\n\r]+")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[set[str]]:
    """The distinct words of each sentence of the whole text, lower-cased; sentences without a word are left out."""
    return [set(found) for s in _SENTENCE.split(text.lower()) if (found := _WORD.findall(s))]


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] + "*" for n in PREFIXES if n <= len(word))]


@dataclass
class Model:
    """Weights of features, and the line that turns a document's highest sentence into log-odds."""

    weights: dict[str, float]
    slope: float
    offset: float

    def word(self, word: str) -> float:
        weights = self.weights
        return sum(weights.get(f, 0.0) for f in features(word))

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -500, 500)))


class WordScores(dict):
    """Words to their scores, remembered while the table is small."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.heads = {f.rstrip("*")[: PREFIXES[0]] for f in model.weights}

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.model.word(word) if word[: PREFIXES[0]] in self.heads else 0.0
        return value

    def highest(self, text: str) -> float:
        """Of the text's sentences; no sentence scores 0."""
        get = self.__getitem__
        return max((sum(map(get, s)) for s in sentences(text)), default=0.0)


def swaps(documents: list[list[set[str]]]) -> dict[tuple[str, str], int]:
    """(term, other) to the number of sentences that have the term and could have the other in its place."""
    found: dict[tuple[str, str], int] = {}
    for doc in documents:
        for s in doc:
            for term in s & KIND_OF.keys():
                for other in IDENTITY[KIND_OF[term]].split():
                    if other not in s:
                        found[term, other] = found.get((term, other), 0) + 1
    return found


def fit(documents: list[list[set[str]]], toxic: list[int], shares: tuple[float, float] | None = None, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model of labelled documents, given as their sentences. ``shares`` are the classes' shares among all labelled
    documents, if other than in the sample. Without documents of both classes every score is 0.5."""
    y = np.array(toxic, float)
    if not 0 < y.sum() < len(y):
        return Model({}, 0.0, 0.0)
    counts: dict[str, list[int]] = {}
    for doc, label in zip(documents, toxic):
        for f in {f for s in doc for w in s for f in features(w)}:
            counts.setdefault(f, [0, 0])[label] += 1
    pairs = swaps(documents)
    met = {f for pair in pairs for term in pair for f in features(term)}
    sure = {f: association(n[1], n[0], y.sum(), len(y) - y.sum()) for f, n in counts.items() if sum(n) >= LEAST_DOCUMENTS}
    # Besides, whatever begins like a sign of toxicity, as the word may be harmless and only some of its forms abusive.
    stems = {f[:-1] for f, x in sure.items() if x >= ASSOCIATION and f[-1] == "*"}
    forms = {f for f in sure if any(f[:n] in stems for n in PREFIXES)}
    names = sorted({f for f, x in sure.items() if abs(x) >= ASSOCIATION} | forms | met)
    number = {f: k for k, f in enumerate(names)}
    known: dict[str, list[int]] = {}
    cols, per_doc = [], []
    for doc in documents:
        for s in doc or [()]:  # a document without words has one sentence without any
            for w in s:
                if w not in known:
                    known[w] = [number[f] for f in features(w) if f in number]
            cols.append(np.array([k for w in s for k in known[w]], np.int32))
        per_doc.append(max(1, len(doc)))
    sizes = np.array([len(c) for c in cols])
    col, ends, m = np.concatenate(cols), np.cumsum(sizes), len(names)
    begins, of = np.cumsum(per_doc) - per_doc, np.repeat(np.arange(len(per_doc)), per_doc)
    # A swap moves the score by the difference of the two words' features.
    moves = [(k, number[f], sign) for k, (a, b) in enumerate(pairs) for term, sign in ((a, 1.0), (b, -1.0)) for f in features(term)]
    of_pair, moved_col, sign = (np.array(x) for x in zip(*moves)) if moves else (np.empty(0, int),) * 3
    often = np.array(list(pairs.values()), float) / len(documents)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def highest(w):
        """Every document's highest score, and the first sentence that has it."""
        total = np.concatenate([[0.0], np.cumsum(w[col])])
        z = total[ends] - total[ends - sizes]
        top = np.maximum.reduceat(z, begins)
        at = np.flatnonzero(z >= top[of])
        return top, at[np.unique(of[at], return_index=True)[1]]

    def members(chosen):
        """The features of the chosen sentences, and the number of each one's document."""
        n = sizes[chosen]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return col[np.repeat(ends[chosen] - n, n) + inside], np.repeat(np.arange(len(chosen)), n)

    # The search for the sentences begins with what each feature says by itself.
    w = np.array([np.sign(sure.get(f, 0.0)) * min(1.0, abs(sure.get(f, 0.0)) / 10) for f in names])
    w, bias = w if m else np.zeros(0), 0.0
    before, before_bias, speed = w, bias, 0.0
    used, doc = members(highest(w)[1])
    # The curvature is at most a fourth of the greatest squared length of a document, besides the penalties.
    longest = np.bincount(doc, np.bincount(used, minlength=m)[used] / max(1, len(documents))).max(initial=0.0)
    rate = 1 / (0.25 * (1 + longest) + DECAY + 4 * counterfactual * often.sum() * (1 + len(PREFIXES)))
    for step in range(STEPS):
        ahead, ahead_bias = w + speed * (w - before), bias + speed * (bias - before_bias)
        top, chosen = highest(ahead)
        g = balance * (1 / (1 + np.exp(-np.clip(top + ahead_bias, -500, 500))) - y)
        used, doc = members(chosen)
        grad = np.bincount(used, g[doc], minlength=m) + DECAY * ahead
        if moves:
            moved = often * np.bincount(of_pair, sign * ahead[moved_col], minlength=len(pairs))
            grad += 2 * counterfactual * np.bincount(moved_col, sign * moved[of_pair], minlength=m)
        before, before_bias = w, bias
        w, bias = ahead - rate * grad, ahead_bias - rate * g.sum()
        speed = step / (step + 3)
    slope, offset = calibrate(highest(w)[0], y, shares)
    return Model({f: float(v) for f, v in zip(names, w) if abs(v) > 1e-3}, slope, offset)


def association(ones: int, zeros: int, toxic: float, clean: float) -> float:
    """How sure it is that a feature, in so many toxic and clean documents, goes with either: the signed root of the
    chi-squared statistic."""
    n, total = ones + zeros, toxic + clean
    want = n * toxic / total
    return (ones - want) / max(1e-9, (want * clean / total * (1 - n / total)) ** 0.5) if n < total else 0.0


def calibrate(z: np.ndarray, y: np.ndarray, shares: tuple[float, float] | None = None) -> tuple[float, float]:
    """Slope and offset of the logistic curve from scores to labels, by Newton's method on targets drawn in from 0 and 1."""
    ones = y.sum()
    zeros = len(y) - ones
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.ones(len(y))
    if shares:
        weight = np.where(y == 1, shares[1] * len(y) / ones, shares[0] * len(y) / zeros)
    x = np.stack([z, np.ones(len(z))], 1)
    b = np.array([1.0, -float(z.mean())])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (p - target)))
        b -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(b[0], 0.0)), float(b[1])


def held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", per_class: int = PER_CLASS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """A model from at most ``per_class`` documents of each class: those of least hash of their ids among the labelled
    that are not held out. An id with labels of both kinds counts as toxic; a null id or label teaches nothing; of rows
    that share an id all do. Without labels of both kinds every document scores 0.5."""
    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.max(F.col(label_col).cast("int")) > 0).cast("int").alias("y"))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = known.join(texts.select("id").distinct(), "id", "left_semi").withColumn("pick", F.xxhash64(F.lit(42), "id"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, 0.0, 0.0)
    # Ranks within a salt come first, so that no class goes to one task.
    for salts in (64, 8, 1):
        few = Window.partitionBy("y", F.pmod("pick", F.lit(salts))).orderBy("pick", "id")
        known = known.withColumn("rank", F.row_number().over(few)).where(F.col("rank") <= per_class).drop("rank")
    # Bounded: per_class ids a class. Of rows that share an id the one of least hash teaches.
    chosen = texts.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = sorted(chosen.select("id", "y", "text").collect())
    if len({r.y for r in rows}) < 2:
        return Model({}, 0.0, 0.0)
    total = sizes[0] + sizes[1]
    return fit([sentences(r.text) for r in rows], [r.y for r in rows], (sizes[0] / total, sizes[1] / total), counterfactual)


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """id_col and ``score`` (0 to 1) for each row, with the columns named in ``keep`` in the place of id_col; one that is
    named like the result gives way to it.

    The whole text counts, of any length. A null text or one without words scores like a sentence without words.
    Labels, languages and ids are not looked at. Repeated rows score alike; an empty table gives an empty result."""
    columns = kept_columns(keep, ("score",)) if keep is not None else [id_col]
    picked = docs.select(*columns, F.col(text_col).alias("__text"))
    schema = docs.select(*columns).schema.add("score", "double")

    def run(batches):
        words = WordScores(model)
        for b in batches:
            z = np.array([words.highest(t.decode()) for t in text_bytes(b.column(b.num_columns - 1))], float)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(z))], schema.fieldNames())

    return picked.mapInArrow(run, schema)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
