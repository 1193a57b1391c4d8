"""MinHash near-dedup: BagMinHash signatures, banding, and exact multiset overlap.

A text is the multiset of its shingles of five words.  BagMinHash gives each
shingle of weight w a Poisson process over the weights (0, w]: the weights are
cut into the intervals (0, 1], (1, 2], (2, 4], ..., each has a process of its own
whose points carry a time, a register and a weight, and the points of weight up
to w count.  A register keeps its earliest time, so two texts agree in a register
with the probability of their weighted Jaccard similarity.  Times are only drawn
up to a bound by which all registers are full with near certainty; texts with an
empty register are drawn again with a larger bound.

Texts of the same words are one representative first.  Representatives meet in
bands of registers (32 bands of 6: a pair of similarity 0.8 misses all with
probability 0.00006), in rounds.  The first round makes a number of pairs that grows
with the rows: in order of signature, rows meet their part's first row and their two
predecessors, and the ends of a large bucket's parts meet its first row.  Pairs whose
signatures agree enough are verified on the texts, and verified links are joined into
classes by label propagation with pointer jumping.

A second round compares the signatures of all rows of a bucket whose classes differ.
Buckets of one class drop out; of a large one, parts meet each other, but for those of
its largest class.  Every pair of rows of different classes that agree enough is
verified.  Where a meeting of two parts has more than MANY such pairs a row, as among
many texts that are not quite similar enough, no pairs leave it: the rows' shingles come
to the meeting, all its pairs are verified there, and a link for each class that is joined
to another leaves it.  So classes are those of all pairs that share a band and agree enough,
whatever the size of the bucket.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, mix, sliced
from .lineage import cut, cut_table, discard, quoted, spare

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
BUCKET, MANY = 256, 4
#: A byte of so many registers travels with a row; pairs that agree in less than this share of them
#: (five deviations under 0.8) aren't verified.
TRAVELS, LEAST_AGREEMENT = 96, 0.6
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, size: int = SHINGLE, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle; a text of fewer words, but not none, has one."""
    n = np.where(words.count == 0, 0, np.maximum(1, words.count - size + 1))
    doc = np.repeat(np.arange(words.n_docs), n)
    head = words.first[doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    if not len(doc):
        return doc, np.zeros(0, np.uint64)
    return doc, words.runs(head, np.minimum(words.count, size)[doc], words.hashes(seed))


def bags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times) of each text's distinct shingles, in order."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]))) if len(doc) else np.zeros(0, np.int64)
    return doc[heads], h[heads], np.diff(np.append(heads, len(doc)))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Registers (earliest times) of each text; inf for texts without shingles."""
    total = np.bincount(doc, weight, n_docs)
    # an element for each interval (0, 1], (1, 2], (2, 4], ... that a weight reaches into
    n_levels = np.ceil(np.log2(weight.astype(float))).astype(np.int64) + 1
    level = np.arange(int(n_levels.sum())) - np.repeat(np.cumsum(n_levels) - n_levels, n_levels)
    e_doc, e_hash, e_weight = (np.repeat(x, n_levels) for x in (doc, h, weight.astype(float)))
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    size = np.where(level == 0, 1.0, low)
    with np.errstate(over="ignore"):
        seed = mix(e_hash + _GOLD * (level.astype(np.uint64) + np.uint64(1)))
    sig = np.full((n_docs, m), np.inf)
    flat = sig.reshape(-1)
    left = np.flatnonzero(total > 0)
    reach = m * (np.log(m) + 8.0)
    while len(left):
        mine = np.zeros(n_docs, bool)
        mine[left] = True
        bound = np.where(mine, reach / np.maximum(total, 1e-300), 0.0)
        at = np.flatnonzero(mine[e_doc])
        time, step = np.zeros(len(at)), 0
        while len(at):
            step += 1
            with np.errstate(over="ignore"):
                r = mix(seed[at] + _GOLD * np.uint64(2 * step))
                s = mix(r + _GOLD)
            time = time - np.log(_unit(r)) / size[at]
            on = time < bound[e_doc[at]]
            at, time, s = at[on], time[on], s[on]
            # a point counts if its weight is within the text's
            inside = low[at] + size[at] * _unit(mix(s)) <= e_weight[at]
            inside |= level[at] == 0
            register = (s >> np.uint64(32)).astype(np.int64) % m
            np.minimum.at(flat, e_doc[at[inside]] * m + register[inside], time[inside])
        left = left[np.isinf(sig[left]).any(axis=1)]
        reach *= 2
    return sig


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, d1, d2, bands, sig): the BLAKE2 digest of all words in turn, hashes of each band, and bytes of registers.

    Texts without words (null ones too) have null bands.
    """
    m = BANDS * ROWS
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in sliced(batches, text_col, 2 << 20):
            w = Words(batch.column(text_col))
            some = w.count > 0
            d1, d2 = np.zeros(w.n_docs, np.int64), np.zeros(w.n_docs, np.int64)
            if some.any():
                a, b = w.starts[w.first[some]], w.ends[(w.first + w.count)[some] - 1]
                raw = w.data.tobytes()
                digests = b"".join(hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), b.tolist()))
                d1[some], d2[some] = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            sig = bag_minhash(*bags(*shingles(w)), w.n_docs, m).view(np.uint64)
            with np.errstate(over="ignore"):
                band = np.full((w.n_docs, BANDS), np.uint64(7)) + np.arange(BANDS, dtype=np.uint64) * _GOLD
                for r in range(ROWS):
                    band = mix(band ^ sig[:, r::ROWS])
            low = (mix(sig[:, :TRAVELS]) & np.uint64(255)).astype(np.uint8)
            null = ~some
            offsets = pa.array(np.arange(0, (w.n_docs + 1) * BANDS, BANDS, dtype=np.int32), mask=np.append(null, False))
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), pa.array(d1), pa.array(d2),
                pa.ListArray.from_arrays(offsets, pa.array(band.view(np.int64).ravel())),
                pa.array([None if n else row.tobytes() for n, row in zip(null, low)], pa.binary()),
            ], names=[id_col, "d1", "d2", "bands", "sig"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, d1 long, d2 long, bands array<bigint>, sig binary")


def _meet(batches):
    """Rows (key, salt, rep, sig), ordered; pairs with the part's first row and the two rows before."""
    head: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*head, batch]).combine_chunks()
        n_old = sum(b.num_rows for b in head)
        key, salt, rep = (table.column(c).to_numpy() for c in ("key", "salt", "rep"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(key), -1)
        new_part = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(new_part, at, 0))
        out = []
        for other in (first, at - 1, at - 2):
            ok = (other >= first) & (other != at) & (at >= n_old) & (rep != rep[other])
            a, b = at[ok], other[ok]
            near = np.zeros(len(a), bool)
            for i in range(0, len(a), 8192):
                near[i : i + 8192] = (sig[a[i : i + 8192]] == sig[b[i : i + 8192]]).mean(axis=1) >= LEAST_AGREEMENT
            out.append((np.minimum(rep[a[near]], rep[b[near]]), np.maximum(rep[a[near]], rep[b[near]])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b"])
        # the last part's first row and its last two go on to the next batch
        keep = sorted({int(first[-1]), *range(max(int(first[-1]), len(key) - 2), len(key))})
        head = table.take(pa.array(keep)).combine_chunks().to_batches()


def _overlap(batches):
    """Rows (a, b, text_a, text_b) -> (a, b, good): whether their weighted Jaccard similarity is at least SIMILAR."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            sides = [bags(*shingles(Words(part.column(c)))) for c in ("text_a", "text_b")]
            n = part.num_rows
            total = sum(np.bincount(d, t, n) for d, _, t in sides)
            doc, h, times = (np.concatenate(x) for x in zip(*sides))
            order = np.lexsort((h, doc))
            doc, h, times = doc[order], h[order], times[order]
            same = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
            common = np.bincount(doc[same], np.minimum(times[same], times[same + 1]), n)
            good = pa.array((common > 0) & (common >= SIMILAR * (total - common) - 1e-9))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), good], names=["a", "b", "good"])


def bucket_rows(reps: DataFrame) -> DataFrame:
    """(key, rep, n, lo): the rows of buckets of more than one, with the bucket's size and smallest rep."""
    rows = reps.select("rep", F.explode("bands").alias("key"))
    multi = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("rep").alias("lo")).where(F.col("n") > 1)
    return rows.join(multi, "key").select("key", "rep", "n", "lo")


def first_pairs(reps: DataFrame, met: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the first round, from representatives (rep, sig) and bucket_rows."""
    # parts double with the bucket and don't depend on the band, so that a large group of copies, which fills a
    # bucket of every band, gives much the same pairs in all of them
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / BUCKET, F.lit(1.0))))).cast("int")
    met = met.withColumn("parts", parts).withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    near = (
        met.select("key", "salt", "rep").join(reps.select("rep", "sig"), "rep")  # signatures of rows that meet any other
        .repartition("key", "salt").sortWithinPartitions("key", "salt", "sig", "rep")
        .mapInArrow(_meet, "a long, b long")
    )
    # the parts of a large bucket are linked by their smallest and largest rows
    ends = met.where(F.col("parts") > 1).groupBy("key", "salt").agg(F.min("lo").alias("lo"), F.min("rep").alias("x"), F.max("rep").alias("y"))
    to_first = ends.select("lo", F.explode(F.array("x", "y")).alias("b")).where(F.col("lo") != F.col("b")).select(F.col("lo").alias("a"), "b")
    return near.union(to_first).distinct()


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each row of x equals each row of y."""
    if len(x) * len(y) <= 4096:
        return (x[:, None] == y[None]).sum(axis=2)
    out = np.zeros((len(x), len(y)), np.uint8)
    for u, v in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)):
        out += u[:, None] == v[None]
    return out


def _cells(batches):
    """(columns, rows) of each cell, in which rows (key, i, j, side, rep, label, data) stand in order of (key, i, j)."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is None and not held:
            return
        table = pa.Table.from_batches([*held, *([] if batch is None else [batch])]).combine_chunks()
        key, i, j, side, rep, label = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "rep", "label"))
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        # the last cell may go on in the next batch
        done = len(key) if batch is None else int(heads[-1])
        held = table.slice(done).to_batches()
        data = table.column("data").slice(0, done).to_pylist()
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(key)]):
            if hi <= done and hi - lo > 1 and not (label[lo:hi] == label[lo]).all():
                cross = i[lo] != j[lo]
                left, right = (np.flatnonzero(side[lo:hi] == k) for k in (0, 1)) if cross else (np.arange(hi - lo),) * 2
                if len(left) and len(right):
                    yield int(key[lo]), rep[lo:hi], label[lo:hi], data[lo:hi], left, right


def _pairs_out(a, b, dense):
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if not dense else np.stack([a, b])
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.full(pairs.shape[1], dense))], names=["a", "b", "dense"])


def _agreeing(batches, step: int = 256):
    """Pairs of rows of other classes whose signatures agree enough; of a cell with too many, its key instead (dense)."""
    for key, rep, label, data, left, right in _cells(batches):
        sig = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        most, some = MANY * (len(left) + len(right)), []
        for lo in range(0, len(left), step):
            mine = left[lo : lo + step]
            n = _agree(sig[mine], sig[right])
            x, y = np.nonzero((label[mine][:, None] != label[right]) & (n >= LEAST_AGREEMENT * TRAVELS))
            some.append((rep[mine[x]], rep[right[y]]))
            most -= len(x)
            if most < 0:
                break
        if most < 0:
            yield _pairs_out(np.array([key]), np.array([0]), True)
        else:
            a, b = (np.concatenate(x) for x in zip(*some))
            if len(a):
                yield _pairs_out(a, b, False)


def _elements(batches):
    """(id, text) -> (rep, data): hashes of the shingles of a text, an element for each time that one occurs."""
    for batch in sliced(batches, "text", 2 << 20):
        doc, h, times = bags(*shingles(Words(batch.column("text"))))
        owner, of = np.repeat(doc, times), np.repeat(h, times)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        with np.errstate(over="ignore"):
            e = mix(of + _GOLD * turn.astype(np.uint64))
        cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        raw = e.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[8 * a : 8 * b] for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["rep", "data"])


def _linking(batches, step: int = 64):
    """Links between classes of a cell, from the rows' shingles: of those that are joined, each to the one of the smallest label."""
    for _, _, label, data, left, right in _cells(batches):
        size = np.array([len(d) // 8 for d in data])
        code = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)[1]
        parent = {int(x): int(x) for x in np.unique(label)}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        # what all rows have counts for every pair, and what one has for none
        n = np.bincount(code)
        shared = int((n == len(data)).sum())
        tell = (n > 1) & (n < len(data))
        on = tell[code]
        code, owner = (np.cumsum(tell) - 1)[code[on]], np.repeat(np.arange(len(data)), size)[on]
        begin = np.searchsorted(owner, np.arange(len(data) + 1))
        rows = right
        some = np.flatnonzero(begin[rows + 1] > begin[rows])
        given = np.concatenate([code[begin[r] : begin[r + 1]] for r in rows[some]]) if len(some) else code[:0]
        width = (begin[1:] - begin[:-1])[rows[some]]
        heads = np.cumsum(width) - width
        for lo in range(0, len(left), step):
            mine = left[lo : lo + step]
            common = np.full((len(mine), len(rows)), shared, np.int64)
            if len(some):
                has = np.zeros((len(mine), int(tell.sum())), np.uint8)
                for k, r in enumerate(mine):
                    has[k, code[begin[r] : begin[r + 1]]] = 1
                common[:, some] += np.add.reduceat(has[:, given], heads, axis=1, dtype=np.int32)
            good = (common > 0) & (common >= SIMILAR * (size[mine][:, None] + size[rows] - common) - 1e-9)
            x, y = np.nonzero(good & (label[mine][:, None] != label[rows]))
            linked_classes = np.unique(np.stack([label[mine[x]], label[rows[y]]]), axis=1)
            for u, v in linked_classes.T.tolist():
                p, q = root(u), root(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        joined = [(root(x), x) for x in parent if root(x) != x]
        if joined:
            yield _pairs_out(*np.array(joined).T, False)


def cells(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, i, j, side, rep, label): the rows of each meeting of two parts of a bucket (of one with itself, i = j) of different classes."""
    rows = met.select("key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("label", "rep").alias("label"))
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main")).where(F.col("classes") > 1)
    size = BUCKET * 8
    small = F.col("n") <= size
    # parts: first those of the smaller classes, then those of the largest, which needn't meet each other
    few = F.when(small, 1).otherwise(F.ceil((F.col("n") - F.col("main")["n"]) / size)).cast("int")
    many = F.when(small, 0).otherwise(F.ceil(F.col("main")["n"] / size)).cast("int")
    spread = F.xxhash64("rep")
    rows = rows.join(mixed, "key").withColumn("few", few).withColumn("many", many)
    part = F.when((F.col("many") > 0) & (F.col("label") == F.col("main")["label"]), F.col("few") + F.pmod(spread, F.greatest("many", F.lit(1))))
    rows = rows.withColumn("g", F.coalesce(part, F.pmod(spread, F.col("few"))).cast("int"))
    last = F.when(F.col("g") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1
    return rows.select("key", "rep", "label", "g", F.explode(F.sequence(F.lit(0), last)).alias("o")).select(
        "key", F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), (F.col("g") > F.col("o")).cast("int").alias("side"), "rep", "label")


def met_with(data: DataFrame, placed: DataFrame, judge, schema: str) -> DataFrame:
    """What judge makes of cells, whose rows have the data (rep, data)."""
    return (
        placed.join(data, "rep").select("key", "i", "j", "side", "rep", "label", "data")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(judge, schema)
    )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, good) of pairs (a, b), by their texts (id, text)."""
    met = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return met.mapInArrow(_overlap, "a long, b long, good boolean")


def linked(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, label) of representatives that are linked to any other; label: the smallest of their class."""
    met = cut(bucket_rows(reps))
    texts = cut_table(texts.join(met.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    tried = cut(verified(first_pairs(reps, met), texts))
    labels = components(tried.where("good").select("a", "b"))
    placed = cells(met, labels)
    kind = "a long, b long, dense boolean"
    unlike = cut(met_with(reps.select("rep", F.col("sig").alias("data")), placed, _agreeing, kind).distinct())
    untried = unlike.where("not dense").select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    dense = placed.join(unlike.where("dense").select(F.col("a").alias("key")).distinct(), "key", "left_semi")
    bags_of = texts.join(dense.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").mapInArrow(_elements, "rep long, data binary")
    within = met_with(bags_of, dense, _linking, kind).select("a", "b")
    more = verified(untried, texts).where("good").select("a", "b").union(within)
    for end in ("a", "b"):  # between classes
        more = more.join(labels.select(F.col("id").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    more = cut(more.select("a", "b").where("a <> b").distinct())
    discard(texts)
    if not more.limit(1).count():
        return labels
    outer = components(more).select(F.col("id").alias("class"), F.col("label").alias("whole"))
    alone = outer.join(labels, outer["class"] == labels["id"], "left_anti").select(F.col("class").alias("id"), F.col("whole").alias("label"))
    inner = labels.join(outer, labels["label"] == outer["class"], "left").select("id", F.coalesce("whole", "label").alias("label"))
    return cut(inner.union(alone))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every node of (a, b) edges; label: the smallest id of its component."""
    # both ways from one pass: a union would compute the edges twice
    ways = F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(seen, labels["id"] == seen["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        further = labels.select(F.col("id").alias("mid"), F.col("label").alias("far"))
        labels_new = cut(new.join(further, "mid").select("id", "old", F.least("mid", "far").alias("label")))
        moved = labels_new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = labels_new.select("id", "label")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the smallest doc_id of its class.

    Classes are the connected components of links of weighted Jaccard similarity
    of at least 0.8 over shingles of five words, copies (the same words, by a digest of
    128 bits) included.  Texts without words, null ones too, are classes of their own.
    A row without an id has no class (null).  Rows that repeat an id share its class.
    Texts are taken whole, however long.  Other columns play no part, whatever their
    names.  An empty table gives no rows.
    """
    signed = cut(signatures(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))))
    reps = signed.where(F.col("bands").isNotNull()).groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    reps = cut(reps)
    labels = linked(reps, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    named = reps.select("d1", "d2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "d1", "d2", F.coalesce("label", "rep").alias("label"))
    by_row = signed.select("doc_id", "d1", "d2", F.col("bands").isNotNull().alias("some"))
    with_words = by_row.where("some").join(named, ["d1", "d2"]).select("doc_id", F.col("label").alias("class_id"))
    without = by_row.where(~F.col("some")).select("doc_id", F.col("doc_id").alias("class_id"))
    unnamed = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return with_words.union(without).union(unnamed)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class: that of its smallest doc_id (one of them if the id repeats); rows without an id stay.

    The columns of docs come back as they are, whatever their names.
    """
    classes = near_duplicates(docs)
    one, n = spare(docs, "first_id"), spare(docs, "rows")
    ids = classes.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("rows")).where(F.col("class_id") == F.col("doc_id"))
    kept = docs.join(ids.select(F.col("doc_id").alias(one), F.col("rows").alias(n)), docs["doc_id"].cast("long") == F.col(one))
    once = kept.where(F.col(n) == 1).select(*quoted(docs))
    more = kept.where(F.col(n) > 1).dropDuplicates(["doc_id"]).select(*quoted(docs))
    return once.union(more).union(docs.where(F.col("doc_id").isNull()))
