"""Fill-in-the-middle examples from whole texts, cut between lines.

A byte automaton, given as one table, reads a block of texts once.  Its states know how many
bytes of a code point are still to come, whether a unit (a line) has begun, and how much of
a sentinel has been read; each transition has a code of what it completes (a code point, a
unit, a sentinel).  The state after a byte depends on the few bytes before it alone, so many
lanes of a block are read at once, each from a few bytes before its own.  Counts of the
codes give each text's units and sentinels; a second pass goes through the codes to the
places of the chosen units, where the text is cut.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import flat
from .columns import with_text_columns

CHAR, UNIT, SENTINEL = 1, 2, 4
#: A byte that UTF-8 never has stands before the first text and after each.
BORDER = 0xFF
#: Bytes that one call of the automaton reads, and its lanes.
WINDOW, LANES = 1 << 22, 2048


@cache
def automaton(sentinels: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """(next, codes, memory): tables by 256 * state + byte; next holds 256 * state.  The state follows from the last ``memory`` bytes."""
    marks = [s.encode() for s in sentinels]
    if not all(marks) or any(b"\n" in m or any(m[:k] == m[-k:] for k in range(1, len(m))) for m in marks):
        raise ValueError("a sentinel has at least a character, no line end, and doesn't end as it begins")
    start = (0, False, b"")
    number, rows, queue = {start: 0}, [], [start]
    while queue:
        left, begun, read = queue.pop(0)
        row = []
        for byte in range(256):
            code = 0
            if byte == BORDER:
                code, to = UNIT * begun, start
            else:
                more = 3 if 0xF0 <= byte < 0xF8 else 2 if 0xE0 <= byte < 0xF0 else 1 if 0xC0 <= byte < 0xE0 else 0
                if 0x80 <= byte < 0xC0 and left:
                    more = left - 1
                code |= CHAR * (more == 0) | UNIT * (byte == 10)
                tail = read + bytes([byte])
                code |= SENTINEL * any(tail.endswith(m) for m in marks)
                while tail and not any(m.startswith(tail) and m != tail for m in marks):
                    tail = tail[1:]
                to = (more, byte != 10, tail)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append((number[to], code))
        rows.append(row)
    table = np.array(rows)
    return (table[:, :, 0] * 256).astype(np.int32).ravel(), table[:, :, 1].astype(np.uint8).ravel(), max(3, *map(len, marks))


def codes(data: np.ndarray, sentinels: tuple[str, ...]) -> np.ndarray:
    """What the automaton completes at each byte."""
    step, code, memory = automaton(sentinels)
    out = np.empty(len(data), np.uint8)
    for low in range(0, len(data), WINDOW):
        high = min(low + WINDOW, len(data))
        size = -(-(high - low) // min(LANES, high - low))
        lanes = -(-(high - low) // size)
        held = np.full(memory + lanes * size, BORDER, np.uint8)
        before = data[max(0, low - memory) : high]
        held[memory + high - low - len(before) : memory + high - low] = before
        lane = np.lib.stride_tricks.as_strided(held, (lanes, memory + size), (size, 1)).T.astype(np.int32, order="C")
        state, seen = np.zeros(lanes, np.int32), np.empty((size, lanes), np.uint8)
        for t in range(memory):
            state = step[state + lane[t]]
        for t in range(size):
            at = state + lane[memory + t]
            seen[t] = code[at]
            state = step[at]
        out[low:high] = seen.T.ravel()[: high - low]
    return out


class Units:
    """The units of a block of texts: ``count`` and ``marked`` (sentinels in it) of each text, and where units end."""

    def __init__(self, column, sentinels: tuple[str, ...]):
        raw, offsets = flat(column)
        n = len(offsets) - 1
        self.data = np.full(len(raw) + n + 1, BORDER, np.uint8)
        inside = np.ones(len(self.data), bool)
        borders = offsets + np.arange(n + 1)
        inside[borders] = False
        self.data[inside] = raw
        self.start, self.end = borders[:-1] + 1, borders[1:]
        self.codes = codes(self.data, sentinels)
        self._ends = np.flatnonzero(self.codes & UNIT)
        edge = np.searchsorted(self._ends, borders, "right")  # the last line's end may be the border itself
        self.count, self._first = np.diff(edge), edge[:-1]
        self.marked = np.diff(np.searchsorted(np.flatnonzero(self.codes & SENTINEL), borders))

    def cuts(self, units: np.ndarray) -> np.ndarray:
        """Where in ``data`` each text's first so many units end."""
        at = self._ends[np.maximum(self._first + units - 1, 0)] if len(self._ends) else np.zeros(len(units), np.int64)
        return np.where(units == 0, self.start, np.where(self.data[at] == BORDER, at, at + 1))

    def chars(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Code points between places of each text."""
        if not len(low):
            return np.zeros(0, np.int64)
        edges = np.stack([low, high], 1).ravel()
        return np.where(high > low, np.add.reduceat(self.codes & CHAR, edges, dtype=np.int64)[::2], 0)


def draws(seed: int, ids: list) -> np.ndarray:
    """The first four 8-digit groups of the hex sha256 of "seed:id", as numbers; a null id is no digits."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def transformed(column, ids: list, seed: int, rate: int, spm: int, sentinels: tuple[str, ...]) -> list[pa.Array]:
    """Units, form, code points of prefix and middle, and output of each text."""
    units, h = Units(column, sentinels), draws(seed, ids)
    first, second = h[:, 0] % (units.count + 1), h[:, 1] % (units.count + 1)
    one, two = units.cuts(np.minimum(first, second)), units.cuts(np.maximum(first, second))
    plain = (units.count == 0) | (units.marked > 0) | (h[:, 2] % 100 >= rate)
    suffix_first = h[:, 3] % 100 < spm
    data, outputs = units.data, []
    p, s, m = (x.encode() for x in sentinels)
    for i in range(len(one)):
        a, b, c, d = (int(x[i]) for x in (units.start, one, two, units.end))
        if plain[i]:
            outputs.append(data[a:d].tobytes())
            continue
        prefix, middle, suffix = data[a:b].tobytes(), data[b:c].tobytes(), data[c:d].tobytes()
        outputs.append(b"".join((s, suffix, p, prefix, m, middle) if suffix_first[i] else (p, prefix, s, suffix, m, middle)))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    return [pa.array(units.count.astype(np.int64)), pa.array(form.tolist(), pa.string()), pa.array(units.chars(units.start, one), mask=plain),
            pa.array(units.chars(one, two), mask=plain), pa.array(outputs, pa.binary()).view(pa.string())]


NEW = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, and n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    ``rate``: of a hundred texts that could be cut, so many are; ``spm``: of a hundred that
    are cut, so many have the suffix first.  Draws hang on the seed and the row's id alone, so
    repeated rows come out alike; a null id draws as the empty one.  A null text counts as
    empty; empty texts, and those that hold a sentinel, stay plain and have no prefix or
    middle.  Texts are taken whole, however long; a unit is a line with its line feed, or
    what stands after the last one.  An empty table gives no rows.  Columns of any names are
    kept; those named like the new ones stand before these.
    """
    if not (0 <= rate <= 100 and 0 <= spm <= 100 and len(set(sentinels)) == 3):
        raise ValueError("rate and spm are percentages, and the three sentinels differ")
    marks = tuple(sentinels)
    automaton(marks)
    compute = lambda text, ids: transformed(text, ids.to_pylist(), seed, rate, spm, marks)
    return with_text_columns(docs, [F.col(text_col), F.col(id_col).cast("string")], NEW, compute)


def restored(output, form, sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")):
    """The text again, from the columns output and form of ``fill_in_middle`` alone (a column; SQL functions only).

    A text that was cut holds no sentinel, and no sentinel ends as it begins, so the first of
    each kind is the one put in.
    """
    p, s, m = sentinels

    def between(rest, mark):
        part = F.substring_index(rest, mark, 1)
        return part, F.substr(rest, F.length(part) + len(mark) + 1)

    def parts(opening, mark):
        left, rest = between(F.substr(output, F.lit(len(opening) + 1)), mark)
        return (left, *between(rest, m))

    prefix, suffix, middle = parts(p, s)
    suffix2, prefix2, middle2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` of documents with digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text")).drop("text")
    again = restored(F.col("output"), F.col("form"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(again).alias("restored_sha256"))


FIM_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, s, regexp_extract_all(s, '[^\n]*\n|[^\n]+') AS u, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS h FROM t),
c AS (SELECT doc_id, s, u, len(u) AS n, h, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
  WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(s) AS restored_sha256 FROM p
"""
