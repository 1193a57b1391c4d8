"""Suffix-array dedup: removal of bytes covered by long strings that occurred earlier.

All strings of ``SPAN`` bytes are judged, but few travel.  In every window of
SPAN bytes the gram of ``GRAM`` bytes with the least hash is its anchor; a
fragment is a run of windows with one anchor, about 40 windows long.  Equal
windows have equal anchors, so they lie in fragments of the same gram:

1. Each task reduces equal fragments (by a BLAKE2 digest of 128 bits of their bytes)
   to the first and keeps the rest as removed runs; the remaining rows meet by gram.
   All but the first of equal fragments are removed runs; a gram with several
   different fragments needs their bytes ("mixed", a few in a hundred).
2. Mixed fragments fetch their bytes.  Those of one gram meet in a block, whose
   suffixes are sorted in two stages (``suffixes``); neighbours with a common
   prefix of SPAN bytes are equal windows, and all but the first are removed.
3. Grams with over ``CROWD`` different fragments (the borders of a passage that
   many documents share) would fill a block: their windows spread over all tasks
   by digests of 128 bits, and all but the first of equal ones are removed.

A row may hold any share of the text: a task sends at most ``CROWDED`` rows of a
gram to that gram's task, and tells it that there are more, which are then mixed
and go by fragment digest.  Rows are told apart by id and a 64-bit hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Rolling, flat, mix, sliced
from .lineage import cut_table
from .suffixes import common_prefixes, suffix_array

SPAN, GRAM = 100, 24
CROWD, CROWDED = 1024, 8
#: Fragments are reduced over about so much text in a task, and suffixes sorted in blocks of about so many bytes.
REDUCE_BYTES, SORT_BYTES = 32 << 20, 1 << 20
PLAIN, CROWDED_ROW, RUN, MARK = 0, 1, 2, 3  # kinds of rows
_LAST = (1 << 63) - 1
_ROW = "h long, f long, g long, k1 long, at long, k2 long, m long"
_NAMES = ["h", "f", "g", "k1", "at", "k2", "m"]  # gram; digest; row, start and row; windows and kind


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit BLAKE2 digests of ranges of bytes, in two halves."""
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    f, g = np.frombuffer(made, np.int64).reshape(-1, 2).T
    return f, g


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of a width, by doubling."""
    out, size, n = x, 1, len(x) - width + 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


def fragments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, gram: int = GRAM):
    """(text, start in the text, windows, gram hash, two halves of the digest) of all fragments of a block of texts."""
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return (none,) * 6
    grams = Rolling(data, 5).all(gram)
    position = np.uint64((1 << max(28, len(grams).bit_length())) - 1)
    keys = (grams & ~position) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first place
    anchor = (_least(keys, span - gram + 1) & position).astype(np.int64)
    n_windows = np.maximum(np.diff(offsets) - span + 1, 0)
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    if not len(doc):
        return (none,) * 6
    at = offsets[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    mine = anchor[at]
    heads = np.flatnonzero(np.append(True, (mine[1:] != mine[:-1]) | (doc[1:] != doc[:-1])))
    n = np.diff(np.append(heads, len(at)))
    start = at[heads]
    return (doc[heads], start - offsets[doc[heads]], n, mix(grams[mine[heads]]).view(np.int64),
            *digests(data.tobytes(), start, start + n - 1 + span))


def _batches(columns: list[np.ndarray], names=_NAMES):
    for lo in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)].astype(np.int64, copy=False)) for c in columns], names=names)


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any of the keys; the first does."""
    out = np.zeros(len(keys[0]), bool)
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    out[:1] = True
    return out


def _reduce(h, f, g, k1, at, k2, n, crowding: bool):
    """Rows to send on: firsts of equal (h, f, g), removed runs, marks of crowded grams."""
    o = _order(h, f, g, k1, at, k2)
    h, f, g, k1, at, k2, n = (x[o] for x in (h, f, g, k1, at, k2, n))
    new_h = _changes(h)
    new = new_h | _changes(f, g)
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    # rows of repeated ids at the same place aren't earlier than each other
    kind = np.where(~new & _earlier(k1, at, k1[first], at[first]), RUN, PLAIN)
    out = [h, f, g, k1, at, k2, n * 4 + kind]
    if crowding:
        group = np.cumsum(new_h) - 1
        many = np.bincount(group, new)[group] > CROWDED
        out[6] = np.where(many & (kind == PLAIN), n * 4 + CROWDED_ROW, out[6])
        marks = np.flatnonzero(many & new_h)
        extra = [h[marks], ~f[marks], g[marks], k1[marks], at[marks], k2[marks], np.full(len(marks), MARK)]
        out = [np.append(a, b) for a, b in zip(out, extra)]
    run = (out[6] & 3) == RUN
    out[0] = np.where(run, mix(out[3].astype(np.uint64) ^ out[4].astype(np.uint64)).view(np.int64), out[0])  # spread
    out[1], out[2] = np.where(run, 0, out[1]), np.where(run, 0, out[2])
    return out


def _fragment_rows(batches):
    """(k1, k2, text) -> rows by gram."""
    held, size = [], 0

    def let_go():
        yield from _batches(_reduce(*(np.concatenate(x) for x in zip(*held)), crowding=True))

    for batch in sliced(batches, "text", 2 << 20):
        data, offsets = flat(batch.column("text"))
        doc, start, n, h, f, g = fragments(data, offsets)
        if len(doc):
            k1, k2 = (batch.column(c).to_numpy()[doc] for c in ("k1", "k2"))
            held.append((h, f, g, k1, start, k2, n))
        size += len(data)
        if size >= REDUCE_BYTES and held:
            yield from let_go()
            held, size = [], 0
    if held:
        yield from let_go()


def _earlier(k1, at, k1_first, at_first):
    return (k1 != k1_first) | (at != at_first)


def _by_gram(batches):
    """Rows in order of (h, f, g, k1, at, k2) -> removed runs, and the first fragments of mixed grams (as CROWDED_ROW)."""
    head = None  # rows of the open gram: its first, the first of its last fragment; and whether they are sent
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in _NAMES]
        run = (cols[6] & 3) == RUN
        if run.any():
            yield from _batches([c[run] for c in cols])
            cols = [c[~run] for c in cols]
            if not len(cols[0]):
                continue
        old = 0 if head is None else len(head[0])
        sent = np.zeros(len(cols[0]), bool)
        if old:
            cols = [np.append(a, b) for a, b in zip(head[:7], cols)]
            sent = np.append(head[7], sent)
        h, f, g, k1, at, k2, m = cols
        new_h = _changes(h)
        new = new_h | _changes(f, g)
        index = np.arange(len(h))
        first = np.maximum.accumulate(np.where(new, index, 0))
        gram = np.cumsum(new_h) - 1
        mixed = np.bincount(gram, new)[gram] >= 2
        kind = m & 3
        removed = ~new & _earlier(k1, at, k1[first], at[first]) & (index >= old) & (kind != MARK)
        send = ~removed & (mixed | (kind == CROWDED_ROW)) & ~sent & (kind != MARK)
        sent |= send
        out_m = np.where(removed, (m & ~3) | RUN, (m & ~3) | CROWDED_ROW)
        keep = removed | send
        yield from _batches([*(c[keep] for c in cols[:6]), out_m[keep]])
        last = [np.flatnonzero(new_h)[-1], first[-1]]
        last = sorted(set(int(x) for x in last))
        head = [c[last] for c in cols] + [sent[last]]


def _bytes_of(batches):
    """(k1, k2, text, parts) -> rows with the bytes of mixed fragments, or digests of the windows of crowded ones."""
    names = [*_NAMES, "bytes"]

    def without_bytes(cols):
        for b in _batches(cols):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], names=names)

    held, size = [], 0
    for batch in sliced(batches, "text", 2 << 20):
        data, offsets = flat(batch.column("text"))
        parts = batch.column("parts")
        n_parts = parts.value_lengths().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(batch.num_rows), n_parts)
        p = parts.flatten()
        h, at, n, crowd = (p.field(c).to_numpy(zero_copy_only=False) for c in ("h", "at", "n", "crowd"))
        k1, k2 = (batch.column(c).to_numpy()[doc] for c in ("k1", "k2"))
        begin = offsets[doc] + at
        cold = np.flatnonzero(~crowd)
        raw = data.tobytes()
        if len(cold):
            texts = [raw[a:b] for a, b in zip(begin[cold].tolist(), (begin + n - 1 + SPAN)[cold].tolist())]
            none = np.zeros(len(cold), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (h[cold], none, none, k1[cold], at[cold], k2[cold], n[cold] * 4 + PLAIN)] + [pa.array(texts, pa.binary())], names=names)
        hot = np.flatnonzero(crowd)
        if len(hot):
            own = np.repeat(hot, n[hot])
            step = np.arange(len(own)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            w = begin[own] + step
            one, two = digests(raw, w, w + SPAN)
            held.append((one, two, two, k1[own], at[own] + step, k2[own], np.ones(len(own), np.int64)))
            size += len(own)
            if size >= 1 << 20:
                yield from without_bytes(_reduce(*(np.concatenate(x) for x in zip(*held)), crowding=False))
                held, size = [], 0
    if held:
        yield from without_bytes(_reduce(*(np.concatenate(x) for x in zip(*held)), crowding=False))


def _equal_windows(k1, at, k2, n, texts: list[bytes]):
    """Removed (k1, at, k2): windows of the fragments that equal an earlier one's, by suffix sorting."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"\xff".join(texts), np.uint8)  # 0xFF is in no UTF-8 text
    begin = np.cumsum(size + 1) - size - 1
    sa = suffix_array(data, SPAN + 4)
    same = common_prefixes(data, sa, SPAN) >= SPAN
    owner = np.searchsorted(begin, sa, "right") - 1
    step = sa - begin[owner]
    window = step < n[owner]  # with SPAN bytes of its own fragment from there
    group = np.cumsum(~(same & window & np.append(False, window[:-1])))
    pick = np.flatnonzero(window)
    owner, g = owner[pick], group[pick]
    wk, wa, w2 = k1[owner], at[owner] + step[pick], k2[owner]
    o = _order(g, wk, wa)
    wk, wa, w2, g = (x[o] for x in (wk, wa, w2, g))
    first = np.maximum.accumulate(np.where(_changes(g), np.arange(len(g)), 0))
    gone = _earlier(wk, wa, wk[first], wa[first])
    return wk[gone], wa[gone], w2[gone]


def _runs(k1, at, k2):
    """Single windows joined into runs: (k1, at, k2, windows)."""
    o = _order(k1, k2, at)
    k1, at, k2 = (x[o] for x in (k1, at, k2))
    if not len(k1):
        return k1, at, k2, k1
    new = _changes(k1, k2)
    new[1:] |= at[1:] > at[:-1] + 1
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(k1)) - 1
    return k1[heads], at[heads], k2[heads], at[last] - at[heads] + 1


def _sorted_blocks(batches):
    """Rows in order of (h, f, g, k1, at, k2) with bytes or window digests -> removed runs (k1, at, k2, n)."""
    names = ["k1", "at", "k2", "n"]
    held: list[tuple] = []  # rows with bytes; whole grams leave together
    size = 0

    def block(rows):
        k1, at, k2, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
        return _batches(list(_runs(*_equal_windows(k1, at, k2, n, [r[5] for r in rows]))), names)

    before = None  # the first row of the open window digest
    for batch in batches:
        if not batch.num_rows:
            continue
        h, f, g, k1, at, k2, m = (batch.column(c).to_numpy() for c in _NAMES)
        kind, n = m & 3, m >> 2
        run = kind == RUN
        if run.any():
            yield from _batches([k1[run], at[run], k2[run], n[run]], names)
        has = batch.column("bytes").is_valid().to_numpy(zero_copy_only=False)
        w = np.flatnonzero(~has & ~run)
        if len(w):
            rows = [x[w] for x in (h, f, k1, at, k2)]
            if before is not None:
                rows = [np.append(a, b) for a, b in zip(before, rows)]
            wh, wf, wk, wa, w2 = rows
            first = np.maximum.accumulate(np.where(_changes(wh, wf), np.arange(len(wh)), 0))
            gone = _earlier(wk, wa, wk[first], wa[first])
            yield from _batches(list(_runs(wk[gone], wa[gone], w2[gone])), names)
            before = [x[first[-1] : first[-1] + 1] for x in rows]
        c = np.flatnonzero(has)
        if len(c):
            texts = batch.column("bytes").take(pa.array(c)).to_pylist()
            for row in zip(h[c].tolist(), k1[c].tolist(), at[c].tolist(), k2[c].tolist(), n[c].tolist(), texts):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield from block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 1
    if held:
        yield from block(held)


def _apply(batches, keep_text: bool):
    for batch in sliced(batches, "text", 8 << 20):
        texts = batch.column("text").fill_null("").cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
        n_bytes, n_removed, n_spans, kept, shas = [], [], [], [], []
        runs = batch.column("runs")
        for text, spans in zip(texts, runs.to_pylist()):
            parts, end, removed, count = [], 0, 0, 0
            for a, n in sorted((s["start"], s["n"]) for s in spans or ()):
                b = a + n - 1 + SPAN
                if count and a <= end:
                    removed += max(0, b - end)
                    end = max(end, b)
                    continue
                parts.append(text[end:a])
                end, count, removed = b, count + 1, removed + b - a
            rest = b"".join([*parts, text[end:]]) if count else text
            n_bytes.append(len(text))
            n_removed.append(removed)
            n_spans.append(count)
            shas.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                kept.append(rest)
        columns = [batch.column("k1"), batch.column("named"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                   pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())]
        names = ["k1", "named", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a
    document of smaller id, or earlier in the same one.  Strings are judged on the
    input.  ``kept`` is binary, as a removed run may cut a character.  Null texts
    are empty; a row without an id comes after all others; rows of one id and
    text are alike and not earlier than each other, and of rows of one id (or of none) and
    other texts neither is earlier at the same start.  Texts are taken whole; other
    columns play no part, whatever their names.  An empty table gives no rows.
    """
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k1"), F.xxhash64(F.col(text_col)).alias("k2"),
                        F.col(id_col).isNotNull().alias("named"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = given.select("k1", "k2", "text").mapInArrow(_fragment_rows, _ROW)
    crowded = F.col("m").bitwiseAND(F.lit(3)) == CROWDED_ROW
    met = rows.repartition(F.when(crowded, F.xxhash64("h", "f")).otherwise(F.col("h"))).sortWithinPartitions(*_NAMES[:6])
    judged = cut_table(met.mapInArrow(_by_gram, _ROW))
    is_run = F.col("m").bitwiseAND(F.lit(3)) == RUN
    n = F.shiftright("m", 2)
    mixed = judged.where(~is_run)
    crowd = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).select("h", F.lit(True).alias("crowd"))
    wanted = mixed.join(crowd, "h", "left").groupBy("k1", "k2").agg(F.collect_list(
        F.struct("h", "at", n.alias("n"), F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("parts"))
    fetched = given.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "parts").mapInArrow(_bytes_of, _ROW + ", bytes binary")
    blocks = fetched.repartition("h").sortWithinPartitions(*_NAMES[:6])
    found = blocks.mapInArrow(_sorted_blocks, "k1 long, at long, k2 long, n long")
    runs = judged.where(is_run).select("k1", "at", "k2", n.alias("n")).union(found)
    by_doc = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.col("at").alias("start"), "n")).alias("runs"))
    done = given.join(by_doc, ["k1", "k2"], "left").select("k1", "named", "text", "runs").mapInArrow(
        lambda b: _apply(b, keep_text),
        "k1 long, named boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
    name = F.when(F.col("named"), F.col("k1")).alias(id_col)
    return done.select(name, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))


def brute_force(rows: list[tuple[int, str | None]], span: int = SPAN) -> dict[int, tuple[int, int, int, str]]:
    """For tests: the same from a dictionary of all strings."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - span + 1):
            s = data[i : i + span]
            if s in seen:
                gone[i : i + span] = True
            seen.add(s)
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(data) else 0
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out
