"""Language identification by partial matching.

Each language has a tree of byte contexts, of up to four bytes, with the counts of what
follows them in its learning texts (A-Z count as a-z).  A text's code length under a language is the sum over
its bytes: the longest context that the tree knows codes the byte, or else an escape, by
which the next shorter context takes over, without the bytes that the longer one has seen
(escapes as many as different bytes seen, full exclusion; bytes that were never seen share
what is left).  So the probabilities of all bytes sum to one in every context.  Counts are
frozen: a text doesn't change them.  The language of the shortest code is predicted.

Spark counts grams of five bytes over all learning texts, and those of shorter contexts
follow by sums.  A tree keeps the grams that make up a fixed share of a language's bytes, so
its size is bounded however much there is to learn from; what a context keeps, the shorter
ones keep, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import flat, sliced
from .columns import with_text_columns

#: Bytes of context, and a byte that UTF-8 never has, which stands before each text.
ORDER, BORDER = 4, 0xFF
#: Grams that all trees together keep for each order, at most; a language of L gets an L-th of them.
ENTRIES = 100_000
#: Bytes scored at once, and code lengths as whole numbers: so many to a bit.
PIECE, UNIT = 1 << 21, 1 << 20
#: Grams that a task holds for a language before it adds up equal ones.
HELD = 1 << 21


def grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each byte of each text (A-Z in lower case) with the four before it as one number, and the bounds of each text's part."""
    raw, offsets = flat(column)
    n = len(offsets) - 1
    data = np.full(len(raw) + ORDER * n, BORDER, np.uint8)
    own = np.ones(len(data), bool)
    heads = offsets[:-1] + ORDER * np.arange(n)
    for k in range(ORDER):
        own[heads + k] = False
    data[own] = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90))
    gram = np.zeros(len(data), np.uint64)
    for k in range(ORDER + 1):
        gram[ORDER:] |= data[k : len(data) - ORDER + k].astype(np.uint64) << np.uint64(8 * (ORDER - k))
    return gram[own], offsets[:-1], offsets[1:]


def added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each stands there."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[heads], np.diff(np.append(heads, len(keys)))
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


@dataclass
class Tree:
    """Contexts and what follows them, by order: arrays sorted by context, and by context and byte."""

    contexts: list[np.ndarray]
    total: list[np.ndarray]  # of counts in the context
    kinds: list[np.ndarray]  # of bytes seen in it
    above: list[np.ndarray]  # counts of those bytes in the context a byte shorter
    entries: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of(cls, entries: list[np.ndarray], counts: list[np.ndarray]) -> Tree:
        """entries[k]: sorted numbers of k + 1 bytes, the context and then the byte."""
        tree = cls([], [], [], [], entries, counts)
        for k, (e, n) in enumerate(zip(entries, counts)):
            context = e >> np.uint64(8)
            heads = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(e) else np.zeros(0, np.int64)
            tree.contexts.append(context[heads])
            tree.kinds.append(np.diff(np.append(heads, len(e))))
            tree.total.append(np.add.reduceat(n, heads) if len(heads) else n)
            shorter = counts[k - 1][np.searchsorted(entries[k - 1], e & np.uint64((1 << 8 * k) - 1))] if k and len(e) else np.zeros(len(e), np.int64)
            tree.above.append(np.add.reduceat(shorter, heads) if len(heads) else shorter)
        return tree

    def lengths(self, gram: np.ndarray) -> np.ndarray:
        """Bits that the last of the five bytes takes after the others, for each gram."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))  # not coded yet
        gone, seen = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)  # counts and kinds that longer contexts exclude
        for k in range(ORDER, -1, -1):
            if not len(self.contexts[k]):
                continue
            g = gram[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, known = _found(self.contexts[k], g >> np.uint64(8))
            entry, here = _found(self.entries[k], g)
            here &= known
            new = self.kinds[k][at] - seen[left]
            size = self.total[k][at] - gone[left] + new
            hit = left[here]
            out[hit] -= np.log2(self.counts[k][entry[here]] / size[here])
            on = known & ~here
            escape = on & (new > 0)  # where there is nothing new to say, an escape is sure
            out[left[escape]] -= np.log2(new[escape] / size[escape])
            gone[left[on]], seen[left[on]] = self.above[k][at[on]], self.kinds[k][at[on]]
            left = left[~here]
        out[left] += np.log2(256 - (len(self.entries[0]) if self.entries else 0))
        return out


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, column) -> np.ndarray:
        """Each text's whole code length under each language, in 1/UNIT bits."""
        gram, starts, ends = grams(column)
        out = np.zeros((len(starts), len(self.trees)), np.int64)
        for low in range(0, len(gram), PIECE):
            part = gram[low : low + PIECE]
            # a gram has 40 bits and a place 21, so one sort of numbers finds the different grams and where they stand
            packed = np.sort(part << np.uint64(21) | np.arange(len(part), dtype=np.uint64))
            key = packed >> np.uint64(21)
            new = np.append(True, key[1:] != key[:-1])
            which = np.empty(len(part), np.int32)
            which[(packed & np.uint64(PIECE - 1)).astype(np.int64)] = np.cumsum(new, dtype=np.int32) - 1
            kinds = key[new]
            first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(part))
            a, b = np.clip(starts[first:last] - low, 0, len(part)), np.clip(ends[first:last] - low, 0, len(part))
            for i, tree in enumerate(self.trees):
                so_far = np.append(0, np.cumsum(np.rint(tree.lengths(kinds) * UNIT).astype(np.int64)[which]))
                out[first:last, i] += so_far[b] - so_far[a]
        return out

    def predict(self, column) -> list[pa.Array]:
        """The language of each text and the probability that the code lengths give it among the languages."""
        bits = self.code_lengths(column)
        voiced = letters(column)
        if not self.trees:
            voiced[:] = False
            bits = np.zeros((len(bits), 1), np.int64)
        best = bits.argmin(1)
        share = 1.0 / np.exp2(-np.minimum((bits - bits.min(1, keepdims=True)) / UNIT, 1000.0)).sum(1)
        names = [*self.languages, "und"]
        return [pa.array([names[i] for i in np.where(voiced, best, len(names) - 1)], pa.string()), pa.array(np.where(voiced, share, 0.0))]


def letters(column) -> np.ndarray:
    """Whether each text holds a letter."""
    return np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)


def learn(docs: DataFrame, entries: int = ENTRIES) -> Model:
    """Trees of the languages named in ``lang``, from all texts of docs whose ``lang`` isn't null.

    ``entries`` bounds the grams of each order that are kept, over all languages: one of L
    languages keeps those that make up ``L / entries`` of its bytes, or more.
    """

    def counted(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list] = {}

        def given(lang, key, count):
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in sliced(batches, "text"):
            for lang in batch.column("lang").unique().to_pylist():
                own = held.setdefault(lang, [])
                own.append(added(grams(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))[0]))
                if sum(len(k) for k, _ in own) > HELD:
                    own[:] = [added(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))]
            while sum(len(k) for own in held.values() for k, _ in own) > 2 * HELD:  # few equal ones, or many languages
                lang = max(held, key=lambda x: sum(len(k) for k, _ in held[x]))
                for key, count in held.pop(lang):
                    yield given(lang, key, count)
        for lang, own in held.items():
            yield given(lang, *added(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own])))

    texts = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), "text")
    whole = texts.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")) for k in range(ORDER + 1)]))
    by_order = whole.select("lang", "n", orders.alias("o")).groupBy("lang", F.col("o.k").alias("k"), F.col("o.gram").alias("gram")).agg(F.sum("n").alias("n"))
    of_lang = texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"))
    share = F.col("bytes") * (of_lang.count() / entries)
    got = by_order.join(of_lang, "lang").where(F.col("n") >= share).select("lang", "k", "gram", "n").toArrow()
    langs = np.array(got.column("lang").to_pylist(), object)
    k, gram, n = (got.column(c).to_numpy() for c in ("k", "gram", "n"))
    names = sorted(set(langs.tolist()))
    trees = []
    for name in names:
        tables = []
        for order in range(ORDER + 1):
            own = np.flatnonzero((langs == name) & (k == order))
            own = own[np.argsort(gram[own])]
            tables.append((gram[own].view(np.uint64), n[own]))
        trees.append(Tree.of([e for e, _ in tables], [c for _, c in tables]))
    return Model(names, trees)


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of docs, and lang_pred and score: the language of the shortest code, ties to the smaller name.

    The score is the language's probability if all were equally likely before (0 to 1).  A
    null text, one without a letter, or a model of no languages gives ``und`` and 0.  Texts
    are coded whole, however long.  An empty table gives no rows.  Columns of any names are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ENTRIES
    return with_text_columns(docs, [F.col(text_col)], {"lang_pred": T.StringType(), "score": T.DoubleType()}, lambda text: shared.value.predict(text))


def predict_languages(docs: DataFrame, fold: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    held_out: crc32(doc_id as text) mod fold is ``remainder`` (a null id: no).  Learns from
    the text and language of the other rows with both, repeated rows each for itself.
    """
    own = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == remainder, F.lit(False))
    model = learn(docs.where(~own).select("lang", "text"))
    return with_language(docs.select("doc_id", own.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
