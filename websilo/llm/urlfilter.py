"""URL filters: many glob rules simulated at once by a bit-parallel automaton.

All rules are packed into one string of state bits, 64 to a word.  A rule of m
characters has states 0..m; for each byte c of a URL the new states are
``((D << 1) & step[c]) | (D & stay[c])``: step has the bit of state j + 1 where
the rule's j-th character is c, stay has the bits of states that a wildcard
holds on c.  NumPy runs this over a block of URLs, one column of bytes at a time.

Globs: ``*`` stands for any characters but a slash, ``**`` for any characters,
``?`` for one character but a slash; all else stands for itself.  A rule must
match the whole canonical URL (lower-cased host, then the path).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A verdict for URLs that match any of the globs; the longest name wins, then the first."""

    name: str
    verdict: str
    globs: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and the paths that start with ``path``."""
    return Rule(host + path, verdict, (f"{host}{path}**", f"*.{host}{path}**"))


#: Rules of the engine's own for URLs that no site rule fits.
OWN_RULES = (
    Rule("spam-farm host", "block", ("spam-farm.**", "*.spam-farm.**")),
    Rule("advert host", "block", ("ads.**", "*.ads.**", "adserver.**", "*.adserver.**")),
    Rule("advert path", "block", ("**/ads/**", "**/adserver/**", "**/doubleclick/**")),
    Rule("tracking pixel", "block", ("**/pixel.gif", "**/track.gif", "**/beacon/**")),
    Rule("executable", "block", ("**.exe", "**.msi", "**.apk")),
    Rule("login page", "block", ("**/wp-login.php", "**/wp-admin/**")),
)
SITE_RULES = (
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
)


class GlobAutomaton:
    """Multiword Shift-And masks of a list of globs; which globs match each text."""

    def __init__(self, globs):
        tokens = [self._tokens(g) for g in globs]
        self.starts = np.cumsum([0] + [len(t) + 1 for t in tokens])
        bits = int(self.starts[-1])
        self.n_words = max(1, -(-bits // 64))
        step = np.zeros((256, self.n_words * 64), bool)
        stay = np.zeros((256, self.n_words * 64), bool)
        begin = np.zeros(self.n_words * 64, bool)
        self.final = np.zeros(len(tokens), np.int64)
        any_, not_slash = np.ones(256, bool), np.ones(256, bool)
        not_slash[ord("/")] = False
        for first, toks in zip(self.starts, tokens):
            state = int(first)
            begin[state] = True
            for kind, byte in toks:
                if kind == "star":
                    stay[:, state] |= not_slash
                elif kind == "all":
                    stay[:, state] |= any_
                else:
                    state += 1
                    step[:, state] = not_slash if kind == "one" else np.arange(256) == byte
            self.final[int(np.searchsorted(self.starts, first, "left"))] = state
        self.step, self.stay, self.begin = self._pack(step), self._pack(stay), self._pack(begin[None])[0]

    @staticmethod
    def _tokens(glob: str):
        data, out, i = glob.encode(), [], 0
        while i < len(data):
            if data[i : i + 2] == b"**":
                out.append(("all", 0))
                i += 2
                continue
            out.append(("star", 0) if data[i] == 42 else ("one", 0) if data[i] == 63 else ("byte", data[i]))
            i += 1
        return out

    @staticmethod
    def _pack(bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits, axis=1, bitorder="little")
        return np.ascontiguousarray(packed).view("<u8")

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text, a column for each glob."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        state = np.tile(self.begin, (len(texts), 1))
        if len(texts):
            data = np.frombuffer(b"".join(texts), np.uint8)
            at = (np.cumsum(lengths) - lengths)[order]
            # active[i]: how many texts, longest first, have a byte i
            active = len(texts) - np.searchsorted(lengths[order][::-1], np.arange(int(lengths.max(initial=0))), "right")
            for i, n in enumerate(active):
                c = data[at[:n] + i]
                d = state[:n]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.step[c]) | (d & self.stay[c])
        out = np.zeros((len(texts), len(self.final)), bool)
        bit = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        out[order] = bit.astype(bool)
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` with A-Z lower-cased, path up to ? or #; else both empty."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def judge_urls(pages: DataFrame, site_rules=SITE_RULES, own_rules=OWN_RULES, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, own_rule, verdict) for every row.

    ``rule``: the name of the longest site rule that fits, without regard to the
    URL's scheme, query and fragment; null if none does, and then the verdict is
    that of the first own rule that fits (``own_rule``), or the default.  A null
    URL or one without ``://`` has empty host and path and gets the default.
    Repeated rows are judged alike; URLs of any length are read whole.  Other columns play
    no part, whatever their names; an empty table gives no rows.
    """
    site = sorted(site_rules, key=lambda r: -len(r.name))  # stable: the first of equal length wins
    rules = [*site, *own_rules]
    globs = [g for r in rules for g in r.globs]
    owner = np.repeat(np.arange(len(rules)), [len(r.globs) for r in rules])
    n_site = len(site)

    def run(batches):
        automaton = GlobAutomaton(globs)
        for batch in batches:
            ids, urls = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(urls), 4096):
                parts = [canonical(u) for u in urls[lo : lo + 4096]]
                hit = automaton.matches([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
                best = np.where(hit, owner[None, :], len(rules)).min(axis=1, initial=len(rules)).tolist()
                is_site = [b < n_site for b in best]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, len(parts)),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([rules[b].name if s else None for b, s in zip(best, is_site)], pa.string()),
                    pa.array([None if s or b == len(rules) else rules[b].name for b, s in zip(best, is_site)], pa.string()),
                    pa.array([default if b == len(rules) else rules[b].verdict for b in best], pa.string()),
                ], names=[id_col, "host", "path", "rule", "own_rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url_col)).mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, own_rule string, verdict string")
