"""A counterfactual-regularised toxicity classifier.

Labelled sentences give word and word-beginning features. A logistic model is fitted to them with a second
penalty: each labelled text that names a group is rewritten with the next identity term of its kind, and a neutral
sentence about each group with a neutral word; the squared change of the score between the two is added to the loss.
What the model learns about a group's name is pulled towards what it learns about other groups' names and about
people at large, and a neutral mention doesn't raise the score.

The fit uses at most `per_class` rows of each label, the first by a hash of the id (the bound is a parameter);
all rows are scored, whole texts. Long texts do not drift and harmless words cannot hide others: only features several
times as frequent under label 1 are kept, and the identity terms whatever their counts; a text has each feature once.

Edge cases: a null or empty text is scored by the intercept; labels that are null take no part; several labels
of one document count as their largest; without labels of both kinds every score is 0; repeated rows get equal
scores; a null id is never a training row and is not held out; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text

#: Identity terms in the languages of the texts; a term is swapped for the next of its line, the last for the first.
IDENTITY = (
    "christian muslim jewish hindu buddhist atheist person",
    "christians muslims jews hindus buddhists atheists people",
    "black white asian latino arab human",
    "man woman someone",
    "men women persons",
    "boys girls children",
    "gay straight lesbian bisexual individual",
    "old young adult",
    "disabled blind deaf patient",
    "immigrant refugee native citizen",
    "immigrants refugees natives citizens",
    "american chinese indian african european mexican local",
    "cristiano musulmán judío hindú budista ateo persona",
    "hombre mujer alguien",
    "hombres mujeres personas",
    "inmigrante refugiado ciudadano",
    "christ muslim jude hinduist buddhist atheist mensch",
    "mann frau jemand",
    "männer frauen menschen",
    "einwanderer flüchtling bürger",
    "chrétien musulman juif hindou bouddhiste athée personne",
    "homme femme quelqu",
    "hommes femmes gens",
    "immigré réfugié citoyen",
)
SWAP: dict[str, str] = {}
PLAIN: dict[str, str] = {}  # a group's name -> the neutral word of its line
for _line in map(str.split, IDENTITY):
    for _a, _b in zip(_line, [*_line[1:], _line[0]]):
        SWAP.setdefault(_a, _b)  # a word of two lines keeps its first
    for _a in _line[:-1]:
        PLAIN.setdefault(_a, _line[-1])

#: Fixed value: a neutral sentence, for each identity term in turn.
NEUTRAL = "here is a note on one {} among others"
WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (3, 4, 5, 6)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def features_of_word(word: str) -> list[int]:
    """Hashes of the word and of its beginnings, as signed 64-bit numbers; an identity term is known by itself alone."""
    names = [f"w {word}", *(f"{n} {word[:n]}" for n in BEGINNINGS if len(word) >= n and word not in SWAP)]
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in names]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[int]:
    return {f for w in words for f in features_of_word(w)}


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    fitted: bool = False
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def score(self, text: str) -> float:
        if not self.fitted:
            return 0.0
        seen, weights, found = self.seen, self.weights, set()
        for w in words_of(text):
            ids = seen.get(w)
            if ids is None:
                ids = tuple(f for f in features_of_word(w) if f in weights)
                if len(seen) > 200_000:
                    seen.clear()
                if len(w) <= 64:
                    seen[w] = ids
            if ids:
                found.update(ids)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(weights[f] for f in sorted(found)), -500, 500))))


class Rows:
    """A sparse 0/1/-1 matrix: enough of one to fit a linear model."""

    def __init__(self, rows: list[list[tuple[int, float]]], width: int):
        self.n, self.width = len(rows), width
        self.r = np.repeat(np.arange(self.n), [len(x) for x in rows])
        self.c = np.array([c for x in rows for c, _ in x], dtype=np.int64)
        self.v = np.array([v for x in rows for _, v in x], dtype=float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.r, self.v * w[self.c], self.n) if self.n else np.zeros(0)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.c, self.v * r[self.r], self.width) if self.n else np.zeros(self.width)


def choose(ids: np.ndarray, a: np.ndarray, b: np.ndarray, n1: int, n0: int, lift: float = 4.0, seen_least: int = 3) -> np.ndarray:
    """The features kept, besides the identity terms: a, b count their texts with label 1 and 0. Ordered by evidence, then id."""
    up = np.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1)))
    sure = (a / n1 - b / n0) * np.sqrt(n1 * n0 / (n1 + n0)) > 2 * np.sqrt((a + b) / (n1 + n0))
    keep = np.flatnonzero((a + b >= seen_least) & (up >= np.log(lift)) & sure)
    return ids[keep[np.lexsort((ids[keep], -up[keep] * np.sqrt(a + b)[keep]))]]


def identity_features() -> list[int]:
    """Of the groups' names; a neutral word is a feature only if the labels make it one."""
    return [features_of_word(w)[0] for w in PLAIN]


def rewritten(words: set[str]) -> set[str]:
    return {SWAP.get(w, w) for w in words}


def neutral_pairs(place: dict[int, int]) -> list[tuple[list[int], list[int]]]:
    """Places of the features of each neutral sentence, with a group's name and with the neutral word."""
    of = lambda word: sorted(place[f] for f in features_of(words_of(NEUTRAL.format(word))) if f in place)
    return [(of(a), of(b)) for a, b in PLAIN.items()]


def fit(plain: list[list[int]], swapped: list[list[int] | None], labels: list[int], features: np.ndarray, neutral: list[tuple[list[int], list[int]]] = (), pull: float = 10.0, each_neutral: float = 0.2, l2: float = 2e-5, steps: int = 600, floor: float = -3.0) -> Model:
    """plain, swapped: places in `features` of what each text and its rewritten form have (None without identity terms).
    neutral: the same of sentences without a label, which only take part in the counterfactual term.

    pull: weight of the counterfactual term, a mean over labelled texts and each_neutral of it for each other sentence; floor: the least intercept, so that one strong word is enough.
    """
    y = np.array(labels, dtype=float)
    n1, n0, width = int(y.sum()), int((1 - y).sum()), len(features)
    if not n1 or not n0:
        return Model()
    x = Rows([[(f, 1.0) for f in sorted(s)] for s in plain], width)
    labelled = [(set(p), set(s)) for p, s in zip(plain, swapped) if s is not None]
    change = [*labelled, *((set(p), set(s)) for p, s in neutral)]
    strength = np.array([pull / max(1, len(labelled))] * len(labelled) + [pull * each_neutral] * len(neutral))
    d = Rows([[*((f, 1.0) for f in sorted(p - s)), *((f, -1.0) for f in sorted(s - p))] for p, s in change], width)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, bias, g2, gb2 = np.zeros(width), 0.0, np.full(width, 1e-12), 1e-12
    vw, vb = np.zeros(width), 0.0
    for t in range(1, steps + 1):  # Adam, full batch: the rows are bounded
        r = weight * (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -500, 500))) - y)
        gw, gb = x.back(r) + l2 * w + (2 * d.back(strength * d.dot(w)) if change else 0), r.sum()
        vw, vb = 0.9 * vw + 0.1 * gw, 0.9 * vb + 0.1 * gb
        g2, gb2 = 0.999 * g2 + 0.001 * gw**2, 0.999 * gb2 + 0.001 * gb**2
        rate = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, bias = w - rate * vw / (np.sqrt(g2) + 1e-9), max(floor, bias - rate * vb / (np.sqrt(gb2) + 1e-9))
    return Model(float(bias), {int(f): float(v) for f, v in zip(features, w)}, True)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lift: float = 4.0, seen_least: int = 3, **how) -> Model:
    """Fits on at most per_class rows of each label whose crc32 remainder isn't 1.

    Features are counted and chosen where the texts are; the driver gets the chosen ones and their places in each text.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    chosen = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class).collect()]
    if not chosen:
        return Model()
    small_batches(spark)
    rows = spark.createDataFrame(chosen, known.schema)
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(rows), "id").select("y", "text")

    def count(batches):
        for b in batches:
            for y in (0, 1):
                found = [list(features_of(words_of(t))) for t, v in zip(b.column(1).to_pylist(), b.column(0).to_pylist()) if v == y]
                ids, n = np.unique(np.array([f for x in found for f in x], np.int64), return_counts=True)
                a, z = (n, n * 0) if y else (n * 0, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a.astype(np.int64)), pa.array(z.astype(np.int64)), pa.array(np.zeros(len(ids), np.int64))], ["f", "a", "b", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(found) * y]), pa.array([len(found) * (1 - y)]), pa.array([1])], ["f", "a", "b", "n"])

    counts = texts.mapInArrow(count, "f long, a long, b long, n long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = counts.where(f"f IS NULL OR (a + b >= {seen_least} AND a > b)").collect()
    n1, n0 = next(((r.a, r.b) for r in found if r.f is None), (0, 0))
    if not n1 or not n0:
        return Model()
    known_f = sorted((r.f, r.a, r.b) for r in found if r.f is not None)
    ids, a, b = (np.array([x[i] for x in known_f], np.int64) for i in range(3))
    chosen_f = choose(ids, a, b, n1, n0, lift, seen_least)
    features = np.array(list(dict.fromkeys([*chosen_f.tolist(), *identity_features()])), np.int64)
    places = spark.sparkContext.broadcast({int(f): i for i, f in enumerate(features)})

    def place(batches):
        at = places.value
        of = lambda words: sorted(at[f] for f in features_of(words) if f in at)
        for b in batches:
            words = [words_of(t) for t in b.column(1).to_pylist()]
            other = [of(rewritten(ws)) if not ws.isdisjoint(SWAP) else None for ws in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(ws) for ws in words], pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], ["y", "plain", "swapped"])

    seen = texts.mapInArrow(place, "y int, plain array<int>, swapped array<int>").collect()
    seen = sorted(((list(r.plain), None if r.swapped is None else list(r.swapped), r.y) for r in seen), key=repr)
    return fit([x[0] for x in seen], [x[1] for x in seen], [x[2] for x in seen], features, neutral_pairs(places.value), **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            scores = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    return score(docs, train(docs, labels, **how))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows that score under the threshold, with their columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels))
    small_batches(spark)

    def run(batches):
        m = shared.value
        for b in batches:
            at = b.schema.get_field_index("text")
            keep = [m.score(t or "") < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
