"""LM scoring: unigram counts of words, and a causal self-attention model over subword ids.

Learning texts are those whose crc32(doc_id as text) mod 10 isn't 0.

Texts are dealt into blocks of about BLOCK_BYTES by a hash of the row; blocks follow
from the table alone, not from its partitions.

Texts are encoded once, by block, into a table of subword ids.  Each word follows a
blank, with which its first subword begins, so ids give the words back, and equal words
have equal ids.

Word counts.  A block asks for each of its distinct words (as 64-bit hashes of ids, formed
once for each as the texts are encoded), with its own count: a row for each bucket of hashes.  A bucket adds up the counts of all
blocks, and answers each block in the order that it asked in, by hash; bucket and block together
hold as many words as the block has, so a frequent word costs one entry for each block,
and no table of all words is held anywhere.  A bucket's sums of all learning tokens and
distinct words go to every block with its answer.

Model.  Ids of learning texts are counted (a table as long as the tokenizer's vocabulary), and pairs of
neighbours by group (a table of fixed size).  Each block then trains once, over every
token of its learning texts in order of their hashes: a first eighth of the blocks from
common parameters, the others from the average of those, and the average of the others
is the model.  Averages and counts are summed in fixed groups of blocks, in order, level
by level, so scores depend on the rows alone, and not on how they are partitioned.
"""

from __future__ import annotations

import base64
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import AFTER, BACK, CLASSES, INPUTS, Scorer, Vocabulary, initial, train_locally, windows
from .blocks import SPACE, Words, sliced
from .lineage import cut_table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How a text is split before byte-pair encoding: letters, digits and other characters apart, in pieces of bounded length.  A blank only begins a piece.
PIECES = r"[^\s\p{L}\p{N}]{1,64}|\s?\p{L}{1,64}|\s?\p{N}{1,3}|[^\S ]+| "
RATES = (0.03, 0.02)
BLOCK_BYTES = 8 << 20
#: Blocks that there is a bucket of words for, and blocks whose sums meet in one group.
SPREAD, GROUP = 4, 256
_TABLE = np.frombuffer(bytes(SPACE if b in (9, 10, 11, 12, 13, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256)), np.uint8)

_encoders: dict = {}


def encoder(path: str):
    """The tokenizer of a file of ranks, loaded once in a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        opens = np.zeros(max(ranks.values()) + 1, bool)
        opens[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        _encoders[path] = (tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), len(opens), opens)
    return _encoders[path]


def words_of(column) -> tuple[Words, np.ndarray]:
    """Words (runs of other than white space, A-Z lower-cased) and their hashes."""
    w = Words(column, _TABLE, collapse=False)
    return w, w.hashes(9)


class Encoded:
    """Subword ids of the distinct words of a block of texts."""

    def __init__(self, path: str):
        self.encoding, _, self.opens = encoder(path)

    def _ids(self, text: bytes) -> np.ndarray:
        return self.encoding.encode_to_numpy(text.decode("utf-8"), disallowed_special=()).astype(np.int32)

    def _one(self, text: bytes) -> np.ndarray:
        try:
            return self._ids(text)
        except UnicodeDecodeError:  # byte by byte
            return np.array([self.encoding.encode_single_token(bytes([b])) for b in text], np.int32)

    def words(self, w: Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words in turn, how many each has), in one call: each word follows a blank, with which its first subword begins."""
        size = ends - starts + 1  # with the blank before it
        at = np.arange(int(size.sum())) + np.repeat(starts - 1 - (np.cumsum(size) - size), size)
        try:
            flat = self._ids(w.data[at].tobytes())
            heads = np.flatnonzero(self.opens[flat])
            return flat, np.diff(np.append(heads, len(flat)))
        except UnicodeDecodeError:
            raw = w.data.tobytes()
            each = [self._one(b" " + raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            return np.concatenate(each), np.array([len(x) for x in each])

    def distinct(self, w: Words, hashes: np.ndarray):
        """(subword ids of the distinct words in turn, how many each has, each word's number)."""
        back, distinct = pd.factorize(hashes)
        once = np.empty(len(distinct), np.int64)
        once[back[::-1]] = np.arange(len(back))[::-1]
        return *self.words(w, w.starts[once], w.ends[once]), back


_MIX = np.random.default_rng(5).integers(0, 1 << 64, 1 << 17, np.uint64)
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(tokens: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and ends that ids make up, how many each text has); opens: of each id, and at last of ends."""
    heads = np.flatnonzero(opens[tokens])
    size = np.diff(np.append(heads, len(tokens)))
    powers = np.full(int(size.max(initial=1)), _STEP)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    terms = _MIX[tokens] if len(opens) <= len(_MIX) else (tokens.astype(np.uint64) + np.uint64(1)) * _LAST
    terms *= powers[np.arange(len(tokens), dtype=np.int32) - np.repeat(heads.astype(np.int32), size)]
    upto = np.cumsum(terms, dtype=np.uint64)
    h = np.diff(upto[heads + size - 1], prepend=np.uint64(0))
    h ^= h >> np.uint64(32)
    h *= _LAST
    h ^= h >> np.uint64(29)
    return h, np.diff(np.flatnonzero(tokens[heads] == len(opens) - 1), prepend=-1)


def bucket_bounds(h: np.ndarray, n: int) -> np.ndarray:
    """Where each bucket of n begins in rising hashes, and the last one ends."""
    return np.searchsorted((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def counted_words(flat: np.ndarray, back: np.ndarray, n_words: np.ndarray, learn: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rising hashes of the distinct words and of the end, their counts in learning texts), of the distinct words' ids in turn, each word's number and the words of each text."""
    h, _ = word_hashes(np.append(flat, np.int32(len(opens) - 1)), opens)
    c = np.bincount(back, np.repeat(learn, n_words), len(h)).astype(np.int64)
    c[-1] = learn.sum(dtype=np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[at], np.add.reduceat(c, at)


def tokens_of(column, encoded: Encoded, end: int):
    """(tokens, tokens of each text, ids of the distinct words in turn, each word's number, words of each text): each text's subword ids, then its end."""
    w, h = words_of(column)
    if not len(w):
        return np.full(w.n_docs, end, np.int32), np.ones(w.n_docs, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), w.count
    flat, size, back = encoded.distinct(w, h)
    begin, n = (np.cumsum(size) - size).astype(np.int32), size[back].astype(np.int32)
    stop = np.cumsum(n, dtype=np.int32)
    tokens = flat[np.repeat(begin[back] - (stop - n), n) + np.arange(stop[-1], dtype=np.int32)]
    last = np.append(0, stop)[np.append(w.first[1:], len(w))]  # tokens up to each text's end
    return np.insert(tokens, last, end), np.diff(last, prepend=0) + 1, flat, back, w.count


def _packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)


def _unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


_SUMS = "part int, block int, n long, at binary, sums binary"


def _row(part: int, block: int, n: int, sums: np.ndarray) -> list:
    """Sums as a row, without the places that are 0."""
    at = np.flatnonzero(sums)
    return [part, block, n, at.astype(np.int32).tobytes(), sums[at].tobytes()]


def _added(table: pa.Table) -> pa.Table:
    """The sum of a group's rows, in order of their blocks."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    places = [np.frombuffer(r["at"], np.int32) for r in rows]
    total = np.zeros(max(int(x.max(initial=-1)) for x in places) + 1)
    for x, r in zip(places, rows):
        total[x] += np.frombuffer(r["sums"], np.float64)
    out = _row(rows[0]["part"], rows[0]["block"], sum(r["n"] for r in rows), total)
    return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                names=["part", "block", "n", "at", "sums"])


def summed(rows: DataFrame, n_blocks: int) -> list:
    """(part, n, at, sums) of each part over all blocks, added up in fixed groups of GROUP blocks, level by level."""
    group = GROUP
    while True:
        rows = rows.groupBy("part", F.floor(F.col("block") / group).alias("g")).applyInArrow(lambda key, t: _added(t), _SUMS)
        if group >= n_blocks:
            return rows.collect()
        group *= GROUP


PARTS = 8  # of the counts of pairs
PIECE = 1 << 16  # parameters that are summed in one group
_IDS = "block int, pos long, learn binary, sizes binary, tokens binary, held binary, doc_ids array<{}>, h binary, c binary"


def in_order(table: pa.Table) -> pa.Table:
    """A block's texts in a fixed order, in which they are numbered, learned from and scored."""
    return table.sort_by([("h", "ascending"), ("text", "ascending")]).combine_chunks()


def encoded_texts(dealt: DataFrame, path: str) -> DataFrame:
    """_IDS of texts (block, h, doc_id, held_out, learn, text), whose blocks are whole partitions: a row for each block, or each part of a very large one."""
    end, opens = encoder(path)[1], np.append(encoder(path)[2], True)
    out = _IDS.format(dealt.schema["doc_id"].dataType.simpleString())

    def run(key, table):
        pos, rows, doc_ids, encoded = 0, [], [], Encoded(path)
        for part in sliced(in_order(table).to_batches(), "text", 2 * BLOCK_BYTES):
            tokens, size, *words = tokens_of(part.column("text"), encoded, end)
            learn, held = (part.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("learn", "held_out"))
            h, c = counted_words(*words, learn, opens)
            of = part.column("doc_id")
            of = pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of)
            rows.append((key[0].as_py(), pos, learn.tobytes(), size.astype(np.int32).tobytes(), tokens.astype(np.uint16 if end < 1 << 16 else np.int32).tobytes(), held.tobytes(),
                         h.tobytes(), c.astype(np.int32).tobytes()))
            doc_ids.append(of)
            pos += part.num_rows
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 6)
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
        columns.insert(6, pa.chunked_array(doc_ids))
        return pa.Table.from_arrays(columns, names=["block", "pos", "learn", "sizes", "tokens", "held", "doc_ids", "h", "c"])

    return dealt.groupBy("block").applyInArrow(run, out)


def _parts(batches, end: int, learning: bool = True):  # of the columns block, pos, learn, sizes, tokens
    """(block, pos, tokens, sizes) of each row of _IDS, of learning texts alone if so asked; else also which texts those are."""
    for batch in batches:
        for block, pos, learn, sizes, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
            sizes = np.frombuffer(sizes, np.int32)
            tokens = np.frombuffer(tokens, np.uint16 if end < 1 << 16 else np.int32)
            on = np.frombuffer(learn, np.uint8) > 0
            if not learning:
                yield block, pos, tokens, sizes, on
            elif on.any():
                yield block, pos, tokens[np.repeat(on, sizes)], sizes[on]


def _sums(rows: list):
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["part", "block", "n", "at", "sums"])


def _whole(rows: list, sizes: list[int]) -> list[np.ndarray]:
    """The sums of each part, of these lengths."""
    out = [np.zeros(n) for n in sizes]
    for r in rows:
        out[r["part"]][np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["sums"], np.float64)
    return out


def train(ids: DataFrame, n_blocks: int, path: str = TOKENIZER):
    """(parameters, broadcast of the Vocabulary) from the learning texts of a table of _IDS."""
    end = encoder(path)[1]
    ids = ids.select("block", "pos", "learn", "sizes", "tokens")

    def counted(batches):
        total, first = np.zeros(end + 1), None
        for block, _, tokens, _ in _parts(batches, end):
            total += np.bincount(tokens, minlength=len(total))
            first = block if first is None else min(first, block)
        if first is not None:
            yield _sums([_row(0, first, 0, total)])

    vocabulary = Vocabulary.of(_whole(summed(ids.mapInArrow(counted, _SUMS), n_blocks), [end + 1])[0])
    sc = ids.sparkSession.sparkContext
    shared, wide = sc.broadcast(vocabulary), AFTER * INPUTS // PARTS

    def paired(batches, shared=shared):
        v, first = shared.value, None
        pairs, classes = np.zeros(AFTER * INPUTS), np.zeros(AFTER * CLASSES)
        for block, _, tokens, sizes in _parts(batches, end):
            before = np.append(0, tokens[:-1]).astype(np.int64)
            before[np.cumsum(sizes) - sizes] = end + 1
            at = v.place(before, tokens)
            pairs += np.bincount(at[at >= 0], minlength=len(pairs))
            classes += np.bincount(v.groups[before].astype(np.int64) * CLASSES + v.outputs[tokens], minlength=len(classes))
            first = block if first is None else min(first, block)
        if first is not None:
            yield _sums([_row(k, first, 0, pairs[k * wide : (k + 1) * wide]) for k in range(PARTS)] + [_row(PARTS, first, 0, classes)])

    *pairs, classes = _whole(summed(ids.mapInArrow(paired, _SUMS), n_blocks), [wide] * PARTS + [AFTER * CLASSES])
    vocabulary = vocabulary.with_pairs(np.concatenate(pairs).reshape(AFTER, INPUTS), classes.reshape(AFTER, CLASSES))
    p, known = initial(vocabulary), sc.broadcast(vocabulary)
    first = F.col("block") % 8 == 0
    for some, rate in ((first, RATES[0]), (~first, RATES[1])):
        shared = sc.broadcast(p)

        def learned(batches, shared=shared, rate=rate):
            start, v = shared.value, known.value
            for block, _, tokens, sizes in _parts(batches, end):
                x, y, _ = windows(tokens, sizes, end + 1)
                q, n = train_locally(start, v, x, y, rate)
                flat = _packed(q) * n
                yield _sums([_row(k, block, n, flat[at : at + PIECE]) for k, at in enumerate(range(0, len(flat), PIECE))])

        got = summed(ids.where(some).mapInArrow(learned, _SUMS), n_blocks)
        n = sum(r["n"] for r in got if r["part"] == 0)
        if n:
            sizes = [len(x) for x in np.split(_packed(p), range(PIECE, len(_packed(p)), PIECE))]
            p = _unpacked(np.concatenate(_whole(got, sizes)) / n, p)
    return p, known


def score_texts(docs: DataFrame, path: str = TOKENIZER, fold: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens: words, then one end.  base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1)))
    over tokens; score is the model's log10 probability of the lower-cased words'
    subwords and the end.  A null text is empty (its end alone); a row without an
    id is neither held out nor learned from; repeated rows count each time and get
    equal scores.  Texts are taken whole, in parts of about 2 MB; one longer text
    stands alone, in its block's task.  Other columns of docs play no part, whatever
    their names.  An empty table gives no rows.
    """
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % fold
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                       F.coalesce(remainder == 0, F.lit(False)).alias("held_out"),
                       F.coalesce(remainder != 0, F.lit(False)).alias("learn"))
    spark = docs.sparkSession
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    dealt = rows.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("block", F.pmod(F.col("h"), F.lit(n_blocks)).cast("int"))
    dealt = dealt.repartition(n_blocks, "block")
    ids = cut_table(encoded_texts(dealt.select("block", "h", "doc_id", "held_out", "learn", "text"), path))
    p, vocabulary = train(ids, n_blocks, path)
    shared = spark.sparkContext.broadcast(p)
    end, opens = encoder(path)[1], np.append(encoder(path)[2], True)
    n_buckets = -(-n_blocks // SPREAD)

    def asked(batches):
        for block, pos, h, c in (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns))):
            h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int32)
            at = bucket_bounds(h, n_buckets)
            pick = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n_buckets, block, np.int32)), pa.array(np.full(n_buckets, pos)),
                                              pa.array(np.arange(n_buckets, dtype=np.int32)), pick(h), pick(c)], names=["block", "pos", "bucket", "h", "c"])

    def answered(key, table):
        """Each row's counts in all blocks, and the bucket's sums of counts and of known words."""
        h, c = (np.concatenate([np.frombuffer(x, t) for x in table.column(n).to_pylist()]) for n, t in (("h", np.uint64), ("c", np.int32)))
        back, distinct = pd.factorize(h)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, c)
        n, v, total = int(c.sum(dtype=np.int64)), int((total > 0).sum()), total[back]
        at = np.append(0, np.cumsum([len(x) // 8 for x in table.column("h").to_pylist()]))
        told = pa.array([total[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        both = (pa.array(np.full(table.num_rows, x)) for x in (n, v))
        return pa.Table.from_arrays([table.column("block"), table.column("pos"), table.column("bucket"), told, *both],
                                    names=["block", "pos", "bucket", "c", "n", "v"])

    asks = ids.select("block", "pos", "h", "c").mapInArrow(asked, "block int, pos long, bucket int, h binary, c binary")
    answers = asks.groupBy("bucket").applyInArrow(answered, "block int, pos long, bucket int, c binary, n long, v long")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(key, texts: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("bucket")
        n, v = (int(counts.column(x).to_numpy().sum()) for x in ("n", "v"))
        told = np.concatenate([np.frombuffer(x, np.int64) for x in counts.column("c").to_pylist()])
        (_, _, tokens, sizes, _), = _parts(texts.combine_chunks().to_batches(), end, False)
        h, of_text = word_hashes(tokens, opens)
        back, h = pd.factorize(h)
        c = np.empty(len(h), np.int64)
        c[np.argsort(h)] = told
        first = np.cumsum(of_text) - of_text
        base = np.add.reduceat(np.log10(c + 0.1)[back], first) - of_text * np.log10(n + 0.1 * (v + 1))
        known = np.add.reduceat((c > 0).astype(np.int64)[back], first)
        score = Scorer(shared.value, vocabulary.value).texts(tokens, sizes) / np.log(10)
        held = np.frombuffer(texts.column("held")[0].as_py(), np.uint8) > 0
        return pa.Table.from_arrays(
            [texts.column("doc_ids").combine_chunks().flatten(), pa.array(held), pa.array(of_text), pa.array(known),
             pa.array(np.full(len(held), n)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    keys = ["block", "pos"]
    return ids.drop("h", "c").groupBy(*keys).cogroup(answers.groupBy(*keys)).applyInArrow(scored, out)
