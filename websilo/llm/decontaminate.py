"""Benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are all windows of 13 consecutive words of the benchmark items
(a shorter item is one window), as bytes with single blanks between words.  They
are grouped by length; for each group a shift table over hashed blocks of up to
eight bytes says how far a search window can move on, buckets by the hash of a
window's last block list the strings that may end the search there, and a direct
comparison of bytes and word borders confirms.  NumPy moves many search windows
(lanes) over a block of texts at once.

The benchmark goes to the executors in chunks of about ``CHUNK_BYTES`` of text;
documents pass through one search after another without a shuffle.  What the first
``LIVE`` chunks have found is written before the next ones are sent, so that only so
many chunks are held at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Words, sliced
from .lineage import cut_table, quoted, spare

WINDOW = 13
CHUNK_BYTES, LIVE = 1 << 20, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Lower ends of the length groups.
_GROUPS = (1, 4, 16, 40)


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place, as unaligned 64-bit numbers (data must be padded by seven bytes)."""
    return np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


class WuManber:
    """Search for byte strings given as ranges of one array."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data = np.append(data, np.zeros(8, np.uint8))
        self.starts, self.ends = starts, ends
        lengths = ends - starts
        group = np.searchsorted(_GROUPS, lengths, "right") - 1
        self.groups = [self._tables(np.flatnonzero(group == g), lengths) for g in np.unique(group)]

    def _tables(self, own: np.ndarray, lengths: np.ndarray) -> dict:
        m = int(lengths[own].min())
        block = max(1, min(8, m // 2 + 1))
        bits = int(np.clip(np.ceil(np.log2(len(own) * (m - block + 1) + 1)) + 3, 12, 22))
        table = {"m": m, "block": block, "mask": np.uint64((1 << (8 * block)) - 1), "down": np.uint64(64 - bits)}
        shift = np.full(1 << bits, m - block + 1, np.int64)
        view = _eight(self.data)
        for end in range(block, m + 1):  # the block that ends after `end` bytes
            np.minimum.at(shift, self._code(view[self.starts[own] + end - block], table), m - end)
        last = self._code(view[self.starts[own] + m - block], table)
        order = np.argsort(last, kind="stable")
        table["shift"], table["members"] = shift, own[order]
        table["heads"] = np.searchsorted(last[order], np.arange((1 << bits) + 1))
        return table

    @staticmethod
    def _code(blocks: np.ndarray, table: dict) -> np.ndarray:
        return ((blocks & table["mask"]) * _ODD >> table["down"]).astype(np.int64)

    def candidates(self, data: np.ndarray, lanes: int = 4096):
        """(places, string numbers) that pass shift and suffix tables; data without padding."""
        view, n = _eight(np.append(data, np.zeros(8, np.uint8))), len(data)
        for t in self.groups:
            m, block = t["m"], t["block"]
            if n < m:
                continue
            borders = np.linspace(m, n + 1, min(lanes, n + 1 - m) + 1).astype(np.int64)
            at, stop, found, codes = borders[:-1].copy(), borders[1:], [], []  # at: ends of search windows
            while len(at):
                code = self._code(view[at - block], t)
                move = t["shift"][code]
                hit = move == 0
                if hit.any():
                    found.append(at[hit] - m)
                    codes.append(code[hit])
                at = at + np.maximum(move, 1)
                go = at < stop
                at, stop = at[go], stop[go]
            if found:
                place, code = np.concatenate(found), np.concatenate(codes)
                width = t["heads"][code + 1] - t["heads"][code]
                first = np.repeat(t["heads"][code] - (np.cumsum(width) - width), width)
                yield np.repeat(place, width), t["members"][first + np.arange(len(first))]


class Benchmark:
    """Windows of a chunk of items, ready to be searched."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int = WINDOW):
        self.items = [i for i, _ in rows]
        words = Words(pa.array([t for _, t in rows], pa.string()))
        n_windows = np.where(words.count == 0, 0, np.maximum(1, words.count - window + 1))
        item = np.repeat(np.arange(words.n_docs), n_windows)
        head = words.first[item] + np.arange(len(item)) - (np.cumsum(n_windows) - n_windows)[item]
        n_words = np.minimum(words.count, window)[item]
        starts, ends = words.starts[head], words.ends[head + n_words - 1] if len(head) else words.ends[:0]
        numbers: dict[bytes, int] = {}
        raw = words.data.tobytes()
        string = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
        _, once = np.unique(string, return_index=True)
        order = np.argsort(string, kind="stable")
        self.owners = item[order]  # items of string s: owners[heads[s]:heads[s + 1]]
        self.heads = np.searchsorted(string[order], np.arange(len(numbers) + 1))
        self.n_words = n_words[once]
        self.search = WuManber(words.data, starts[once], ends[once]) if len(once) else None

    def find(self, column):
        """(words, first hit word, one past the last, its text, string) of all occurrences in a column of texts."""
        words = Words(column)
        none = np.zeros(0, np.int64)
        if self.search is None or not len(words):
            return words, none, none, none, none
        data, strings = words.data, self.search
        out = []
        for place, s in strings.candidates(data):
            w = np.minimum(np.searchsorted(words.starts, place), len(words) - 1)
            end = w + self.n_words[s] - 1
            ok = (words.starts[w] == place) & (end < len(words))
            end = np.minimum(end, len(words) - 1)
            ok &= (words.doc[end] == words.doc[w]) & (words.ends[end] - place == strings.ends[s] - strings.starts[s])
            place, s, w, end = place[ok], s[ok], w[ok], end[ok]
            same = np.zeros(len(place), bool)
            for i in range(0, len(place), 4096):  # bounded blocks of the byte-wise comparison
                p, q = place[i : i + 4096], s[i : i + 4096]
                size = strings.ends[q] - strings.starts[q]
                own = np.repeat(np.arange(len(p)), size)
                step = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
                equal = data[p[own] + step] == strings.data[strings.starts[q][own] + step]
                same[i : i + 4096] = np.bincount(own, equal, len(p)) == size
            out.append((w[same], end[same] + 1, s[same]))
        if not out:
            return words, none, none, none, none
        lo, hi, s = (np.concatenate(x) for x in zip(*out))
        return words, lo, hi, words.doc[lo], s


def _join(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _chunks(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (item id, text) of bounded size, split by a hash of the row."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(1, -(-(total[0] + 16 * total[1]) // CHUNK_BYTES))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield k == n - 1, [(r["i"], r["t"]) for r in part.collect()]


_FOUND = ("n_words", "n_hit", "ranges", "items")
_KINDS = (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType()))


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", keep: list[str] | None = None, names: tuple[str, ...] = _FOUND) -> DataFrame:
    """docs with n_words, n_hit, ranges (word ranges [lo, hi) in turn) and items (sorted item ids), under ``names``.

    A word is hit if it lies in an occurrence of a benchmark window; occurrences
    may overlap.  Null texts have no words; items without words occur nowhere;
    items with the same id count once, an item without an id is named null; without
    items, nothing is hit.  Texts are taken whole, repeated rows alike; an empty table
    gives no rows.  ``keep``: the columns of docs to return; those of ``names`` are replaced.
    """
    docs = docs.drop(*names)
    wanted = list(keep if keep is not None else docs.columns)
    plain = [f"c{i}" for i in range(len(wanted))]  # mapInArrow takes no names with dots
    out = docs.select(*["`" + c.replace("`", "``") + "`" for c in wanted], F.col(text_col)).toDF(*plain, "text")
    sc = docs.sparkSession.sparkContext
    shared_now = []
    for last, rows in _chunks(benchmark, item_col, item_text):
        if len(shared_now) == LIVE:
            out = cut_table(out)
            for old in shared_now:
                old.unpersist()
            shared_now = []
        shared = sc.broadcast(Benchmark(rows))
        shared_now.append(shared)
        given = plain if last else [*plain, "text"]
        schema = T.StructType([f for n in given for f in out.schema if f.name == n] + [T.StructField(n, k) for n, k in zip(_FOUND, _KINDS)])

        def run(batches, shared=shared, given=given):
            bench = shared.value
            for batch in sliced(batches, "text"):
                at = batch.schema.get_field_index
                words, lo, hi, doc, string = bench.find(batch.column(at("text")))
                n, old = batch.num_rows, at("ranges") >= 0
                ranges: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                if old:  # what the chunks before have found
                    for i, (r, x) in enumerate(zip(batch.column(at("ranges")).to_pylist(), batch.column(at("items")).to_pylist())):
                        ranges[i] = list(zip(r[::2], r[1::2]))
                        items[i] = set(x)
                first = words.first[doc]
                for d, a, b, s in zip(doc.tolist(), (lo - first).tolist(), (hi - first).tolist(), string.tolist()):
                    ranges[d].append((a, b))
                    items[d].update(bench.items[o] for o in bench.owners[bench.heads[s] : bench.heads[s + 1]])
                ranges = [_join(r) for r in ranges]
                new = [
                    pa.array(words.count, pa.int64()),
                    pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
                    pa.array([[x for ab in r for x in ab] for r in ranges], pa.list_(pa.int64())),
                    pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(at(c)) for c in given] + new, names=[*given, *_FOUND])

        out = out.mapInArrow(run, schema)
    return out.toDF(*wanted, *names)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", one_in: int = 20):
    return (F.col(n_hit) > 0) & (F.lit(one_in) * F.col(n_hit) >= F.col(n_words))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row; see find_windows."""
    found = find_windows(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with the columns of docs as they are, whatever their names."""
    names = tuple(spare(docs, n) for n in _FOUND)
    return find_windows(docs, benchmark, names=names).where(~contaminated(names[1], names[0])).select(*quoted(docs))


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW):
    """The same by comparing lists of words, for tests: (n_words, n_hit, sorted ids) for each text."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    strings = [(i, w[k : k + window]) for i, t in items if (w := split(t)) for k in range(max(1, len(w) - window + 1))]
    out = []
    for text in texts:
        words, hit, ids = split(text), set(), set()
        for i, s in strings:
            for k in range(len(words) - len(s) + 1):
                if words[k : k + len(s)] == s:
                    hit.update(range(k, k + len(s)))
                    ids.add(i)
        out.append((len(words), len(hit), sorted(ids)))
    return out


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
