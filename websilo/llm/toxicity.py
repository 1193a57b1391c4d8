"""Toxicity: a counterfactually regularised classifier of texts.

A logistic model over the presence of words.  Word counts by class choose the
vocabulary (Spark), the bounded training rows carry only chosen words to the
driver, and NumPy fits the weights.  Every training text has counterfactual copies: if
it names groups, with each name swapped for others of its kind or for a neutral word; if
it names none, with a name put in.  A copy has its text's label, and the squared change
of score between a text and its copies is part of the loss, too.  So a mention by
itself can't raise a score, whether or not the training texts hold any.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, sliced
from .lineage import quoted, spare

#: Fixed lists: names of groups that a sentence may mention neutrally, by kind, and the neutral word.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "muslims", "christians", "jews", "hindus"),
    ("black", "white", "asian", "latino", "african", "arab", "indigenous", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("disabled", "deaf", "blind", "autistic", "old", "young", "immigrant", "refugee", "immigrants", "refugees"),
)
NEUTRAL = "person"
#: At most about so many labelled rows are learned from (all, if there are fewer), chosen by a hash of their ids.
MAX_ROWS = 20_000
VOCABULARY, LEAST_DOCS = 4096, 5


def word_hash(words: list[str]) -> np.ndarray:
    """The hashes that texts' words get."""
    w = Words(pa.array(words, pa.string()))
    return w.hashes()


def presence(column) -> tuple[np.ndarray, np.ndarray]:
    """(text, word hash) pairs of a column of texts, each once."""
    w = Words(column)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = w.hashes()
    order = np.lexsort((h, w.doc))
    doc, h = w.doc[order], h[order]
    once = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))
    return doc[once], h[once]


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        doc, h = presence(column)
        logit = np.full(len(column), self.bias)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            known = self.words[at] == h
            logit += np.bincount(doc[known], self.weights[at[known]], len(column))
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -500, 500)))


@dataclass
class Examples:
    """Labelled rows as (row, word) pairs, and their copies: in copy k of row copy_of[k], word out[k] (-1: none) gives way to word into[k]."""

    y: np.ndarray
    owner: np.ndarray
    word: np.ndarray
    copy_of: np.ndarray
    out: np.ndarray
    into: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, np.ndarray]], swaps: dict[int, list[int]]) -> Examples:
        y = np.array([label for label, _ in rows], float)
        owner = np.repeat(np.arange(len(rows)), [len(x) for _, x in rows])
        word = np.concatenate([x for _, x in rows]).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
        names, copies = sorted(swaps), []
        for i, (_, x) in enumerate(rows):
            mine = [int(a) for a in x if int(a) in swaps]
            copies += [(i, a, b) for a in mine for b in swaps[a]]
            if not mine and names:
                copies.append((i, -1, names[i % len(names)]))
        at = np.array(copies, np.int64).reshape(-1, 3)
        return cls(y, owner, word, at[:, 0], at[:, 1], at[:, 2])

    def loss(self, w: np.ndarray, c: float, penalty: float, ridge: float) -> tuple[float, np.ndarray]:
        """Loss and gradient (of the bias at last): mean log loss of rows and of copies, the penalty, and a ridge."""
        n, k, n_words = len(self.y), max(len(self.copy_of), 1), len(w)
        kept = self.out >= 0
        change = w[self.into] - np.where(kept, w[np.maximum(self.out, 0)], 0.0)
        z = c + np.bincount(self.owner, w[self.word], n)
        z_copy, y_copy = z[self.copy_of] + change, self.y[self.copy_of]
        loss = (np.logaddexp(0, z) - self.y * z).mean() + (np.logaddexp(0, z_copy) - y_copy * z_copy).sum() / k
        loss += penalty * (change**2).sum() / k + ridge / 2 * (w**2).sum() / n**0.5
        off_copy = (_logistic(z_copy) - y_copy) / k
        off = (_logistic(z) - self.y) / n + np.bincount(self.copy_of, off_copy, n)
        moved = off_copy + 2 * penalty * change / k
        g = np.bincount(self.word, off[self.owner], n_words) + ridge * w / n**0.5
        g += np.bincount(self.into, moved, n_words) - np.bincount(self.out[kept], moved[kept], n_words)
        return float(loss), np.append(g, off.sum())


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: list[tuple[int, np.ndarray]], n_words: int, swaps: dict[int, list[int]],
        penalty: float = 4.0, ridge: float = 0.02, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """(weights, bias) for (label, word numbers) rows; swaps: identity word number -> the words it is swapped for."""
    x = Examples.of(rows, swaps)
    if not len(x.y):
        return np.zeros(n_words), -4.0
    w, c = np.zeros(n_words), float(np.log((x.y.sum() + 0.5) / (len(x.y) - x.y.sum() + 0.5)))
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        g = x.loss(w, c, penalty, ridge)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, c = w - step[:-1], c - step[-1]
    return w, float(c)


def _learning_rows(docs: DataFrame, labels: DataFrame, fold: int, max_rows: int) -> DataFrame:
    """(doc_id, toxic, text) of at most about max_rows labelled rows outside the held-out fold."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    if n > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("rows")), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    # a bounded number of short rows, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")


def train(docs: DataFrame, labels: DataFrame, fold: int = 5, max_rows: int = MAX_ROWS,
          terms=IDENTITY_TERMS, neutral: str = NEUTRAL, penalty: float = 4.0) -> Model:
    """A model of labels.toxic from labelled rows whose crc32(doc_id as text) mod fold isn't 0.

    Labels of the same document count once, as 1 if any is; other labels than 0 and 1, and
    null ids, don't count.  Without labels, all texts score alike, and low.
    """
    rows = _learning_rows(docs, labels, fold, max_rows)

    def words_of(batches):
        for batch in sliced(batches, "text"):
            doc, h = presence(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[doc].astype(np.int64)
            order = np.argsort(h, kind="stable")
            h, toxic = h[order], toxic[order]
            if len(h):
                heads = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(h)))),
                    pa.array(np.add.reduceat(toxic, heads)),
                ], names=["word", "n", "toxic"])

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = float(totals["n"]), float(totals["t"])
    by_word = rows.mapInArrow(words_of, "word long, n long, toxic long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= LEAST_DOCS)
    # log-likelihood ratio of a word's presence against the label
    part = lambda x, of, by: F.when(x > 0, x * F.log(x * n / (of * by))).otherwise(0.0)
    x, k = F.col("n"), F.col("t")
    clean = max(n - t, 1.0)
    gain = (part(k, x, F.lit(max(t, 1.0))) + part(x - k, x, F.lit(clean)) + part(t - k, n - x, F.lit(max(t, 1.0)))
            + part(n - x - t + k, n - x, F.lit(clean)))
    chosen = by_word.orderBy(gain.desc(), "word").limit(VOCABULARY).select("word").collect()
    names = [*[w for group in terms for w in group], neutral]
    special = word_hash(names)
    vocabulary = np.unique(np.append(np.array([r[0] for r in chosen], np.int64).view(np.uint64), special))
    number = dict(zip(names, np.searchsorted(vocabulary, special).tolist()))
    swaps = {number[a]: [number[b] for b in (*group, neutral) if b != a] for group in terms for a in group}

    def chosen_of(batches):
        for batch in sliced(batches, "text"):
            doc, h = presence(batch.column("text"))
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            known = vocabulary[at] == h
            parts = np.split(at[known].astype(np.int32), np.searchsorted(doc[known], np.arange(1, batch.num_rows)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["doc_id", "toxic", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "toxic", "text").mapInArrow(chosen_of, f"doc_id {kind}, toxic int, words binary").collect()
    got.sort(key=lambda r: (str(r["doc_id"]), r["toxic"], bytes(r["words"])))
    weights, bias = fit([(r["toxic"], np.frombuffer(r["words"], np.int32)) for r in got], len(vocabulary), swaps, penalty)
    return Model(vocabulary, weights, bias)


def with_scores(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs and the model's score of the text (0 to 1; null and empty texts get the bias's)."""
    from pyspark.sql import types as T

    keep = [c for c in (keep if keep is not None else docs.columns) if c != name]
    given = docs.select(*["`" + c.replace("`", "``") + "`" for c in keep], F.col("text"))
    plain = [f"c{i}" for i in range(len(keep))]  # mapInArrow takes no names with dots
    kinds = [f.dataType for f in given.schema][: len(keep)]
    schema = T.StructType([*map(T.StructField, plain, kinds), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in sliced(batches, "text"):
            scores = model.scores(batch.column(len(plain)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(plain)], pa.array(scores)], names=[*plain, "score"])

    return given.toDF(*plain, "text").mapInArrow(run, schema).toDF(*keep, name)


def toxicity_report(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; held_out: crc32(doc_id as text) mod fold is 0 (null id: no).

    Texts are taken whole, repeated rows score alike; null and empty texts get the score of
    no words.  A score of 0.5 is predicted as 1.  Other columns than doc_id and text play no
    part, whatever their names.  An empty table gives no rows.
    """
    scored = with_scores(docs, train(docs, labels, fold), keep=["doc_id"])
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """The rows whose score is under 0.5, with the columns of docs as they are, whatever their names."""
    name = spare(docs, "score")
    return with_scores(docs, train(docs, labels, fold), name=name).where(F.col(name) < 0.5).select(*quoted(docs))
