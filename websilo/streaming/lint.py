"""Lint over a stream of records: keyed state of each file instead of windows.

A file's state is its last record, the types, ids and URIs of the two before it, and the nearest
warcinfo record's id.  A record's findings are known once the next one is there; the last
record's when its file has been idle for a while.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.lint import findings, narrow

_AROUND = ("lag1", "lag2", "lead1", "id1", "uri1", "uri2", "info")


def start() -> dict:
    return {"last": None, "before": [], "info": None, "told": False}


def advance(state: dict, rows: list[dict]) -> list[dict]:
    """Rows with the records around them known, after these narrow rows of a file in order; state changes with them."""
    out = []
    for row in rows:
        last = state["last"]
        if last is not None:
            if not state["told"]:
                out.append(last | around(state, row["kind"]))
            state["before"] = [{k: last[k] for k in ("kind", "record_id", "target_uri")}, *state["before"][:1]]
            if last["kind"] == "warcinfo" and last["record_id"] is not None:
                state["info"] = last["record_id"]
        state["last"], state["told"] = row, False
    return out


def finish(state: dict) -> list[dict]:
    """The last record's row, as if its file ended with it; once."""
    if state["last"] is None or state["told"]:
        return []
    state["told"] = True
    return [state["last"] | around(state, None)]


def around(state: dict, following: str | None) -> dict:
    one, two = [*state["before"], None, None][:2]
    of = lambda r, k: r and r[k]
    return dict(zip(_AROUND, (of(one, "kind"), of(two, "kind"), following, of(one, "record_id"), of(one, "target_uri"), of(two, "target_uri"), state["info"])))


def lint_stream(records: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """The findings of ``operators.lint.lint`` on a stream of records at the semantic level (append mode).

    Records of a file come in order over the batches.  A file without new records for
    ``idle_ms`` is taken to have ended; if it goes on, that finding has been made, and the
    rules on what follows a record aren't asked of it again.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = narrow(records)
    known = T.StructType([*rows.schema, *[T.StructField(c, T.StringType()) for c in _AROUND]])
    names = rows.columns

    def run(key, frames, state):
        now = json.loads(state.get[0]) if state.exists else start()
        if state.hasTimedOut:
            out = finish(now)
        else:
            new = [r for f in frames for r in f.astype(object).where(f.notna(), None).to_dict("records")]
            for r in new:
                r["concurrent_to"] = None if r["concurrent_to"] is None else list(r["concurrent_to"])
            new.sort(key=lambda r: r["record_index"])
            out = advance(now, new)
        state.update((json.dumps(now, default=lambda x: x.item()),))
        if now["last"] is not None and not now["told"]:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[r[c] for c in known.names] for r in out], columns=known.names).astype({"record_index": "int64"})

    held = rows.groupBy("file").applyInPandasWithState(run, known, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return findings(held.select(*names, *_AROUND))


