"""Streaming restoration: deltas of a reply arrive in order per (stream_id, key); tokens may be split over deltas.

State per stream is the text held back, never more than an unfinished token. For every key the emitted texts join to the
restored text of the joined deltas. A row with is_end flushes what is held and drops the state.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.walks import restore

#: Fixed value: what may be the beginning of a token.
TAIL = re.compile(r"\[[A-Za-z0-9 _\-]{0,32}\Z")
OUT = "stream_id string, key string, seq long, text string"
STATE = "held string, vault string"


def restore_text(text: str, vault: dict, as_json: bool = False) -> str:
    return restore(text, vault, as_json)


def held_back(text: str) -> int:
    """How much of a text can't be part of an unfinished token."""
    at = text.rfind("[")
    return at if at >= 0 and TAIL.match(text, at) else len(text)


def _step(key, frames, state):
    held, vault = ({}, {}) if not state.exists else (json.loads(state.get[0]), json.loads(state.get[1]))
    rows = []
    ended = False
    for r in pd.concat(list(frames)).sort_values("seq").itertuples():
        vault.update(json.loads(r.vault) if isinstance(r.vault, str) else {})
        if isinstance(r.delta, str):
            name = f"{int(bool(r.as_json))}{r.key}"
            text = held.pop(name, "") + r.delta
            cut = held_back(text)
            if cut < len(text):
                held[name] = text[cut:]
            rows.append((key[0], r.key, r.seq, restore_text(text[:cut], vault, bool(r.as_json))))
        if r.is_end:
            rows += [(key[0], k[1:], r.seq, restore_text(t, vault, k[0] == "1")) for k, t in sorted(held.items())]
            held, ended = {}, True
    if ended:
        state.remove()
    else:
        state.update((json.dumps(held), json.dumps(vault)))
    yield pd.DataFrame(rows, columns=["stream_id", "key", "seq", "text"])


def restore_stream(deltas: DataFrame) -> DataFrame:
    """deltas: stream_id, seq, key, delta, vault (JSON map, usually on the first row), is_end, as_json. Works on streams and tables."""
    return deltas.groupBy("stream_id").applyInPandasWithState(_step, OUT, STATE, "append", "NoTimeout")
