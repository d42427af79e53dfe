"""Event streams (lines of `event:` and `data:`) with placeholders restored, whatever way the bytes are cut.

Texts that come in pieces are restored across pieces: what may be an unfinished token waits for the next piece of the same
choice, tool call or block, and goes out in an event of its own where that ends. State per stream is one JSON text: the
unfinished line, an event line that waits for its data, and the held pieces; never more than an unfinished token each.
"""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.scan import Blocked
from ..functions.walks import _at, _list, dump, restore
from .restore import held_back

OUT = "stream_id string, seq long, bytes binary"
STATE = "state string"
#: Fixed value: the type of an error that this side reports. What a reader gets where the upstream fails midway.
ERROR = "proxy_error"
FAILED = "event: error\ndata: " + dump({"error": {"message": "the upstream failed before its reply ended", "type": ERROR}}) + "\n\n"


class Events:
    """Bytes in, bytes out; flush() at the end. Keys of held pieces: ["c", choice], ["t", choice, tool], ["b", block, json]."""

    def __init__(self, schema: str, vault: dict, state: str | None = None):
        self.schema, self.vault = schema, vault
        line, self.event, held = json.loads(state) if state else ("", None, [])
        self.line = base64.b64decode(line)
        self.held = {tuple(k): t for k, t in held}
        self.out: list[str | bytes] = []

    def state(self) -> str:
        return json.dumps([base64.b64encode(self.line).decode(), self.event, [[list(k), t] for k, t in self.held.items() if t]])

    def _taken(self) -> bytes:
        out = b"".join(x if isinstance(x, bytes) else x.encode() for x in self.out)
        self.out = []
        return out

    def push(self, data: bytes) -> bytes:
        if not self.vault:
            return data
        *lines, self.line = (self.line + data).split(b"\n")
        for x in lines:
            self._line(x.removesuffix(b"\r").decode("utf-8", "replace"))
        return self._taken()

    def flush(self, failed: bool = False) -> bytes:
        if self.line:
            line, self.line = self.line.rstrip(b"\r\n").decode("utf-8", "replace"), b""
            self._line(line)
        self._flush(lambda k: True)
        self._event()
        if failed:
            self.out.append(FAILED)
        return self._taken()

    def _event(self) -> None:
        if self.event is not None:
            self.out.append(self.event + "\n")
            self.event = None

    def _line(self, line: str) -> None:
        if line.startswith("event:"):
            self._event()
            self.event = line
            return
        value = None
        if line.startswith("data:"):
            data = line[5:].lstrip()
            if data == "[DONE]":
                self._flush(lambda k: True)
            else:
                try:
                    value = json.loads(data)
                except (ValueError, RecursionError):
                    pass
        if value is None:
            self._event()
            self.out.append(line + "\n")
            return
        if self.schema == "anthropic" and _at(value, "type") == "content_block_stop":
            index = value.get("index", 0)
            self._flush(lambda k: k[:2] == ("b", index))
        self._event()
        (self._blocks if self.schema == "anthropic" else self._choices)(value)
        self.out.append(f"data: {self._written(value, line)}\n")

    @staticmethod
    def _written(value, line: str) -> str:
        """The event as JSON; where it holds half of a surrogate pair, all but ASCII as escapes; where it holds a number
        that no double can, as it came."""
        try:
            return dump(value)
        except Blocked:
            try:
                return json.dumps(value, allow_nan=False, separators=(",", ":"))
            except ValueError:
                return line[5:].lstrip()

    def _piece(self, holder, name: str, key: tuple) -> None:
        if isinstance(holder, dict) and isinstance(holder.get(name), str):
            text = self.held.pop(key, "") + holder[name]
            cut = held_back(text)
            if cut < len(text):
                self.held[key] = text[cut:]
            holder[name] = restore(text[:cut], self.vault, self._quoted(key))

    @staticmethod
    def _quoted(key: tuple) -> bool:
        return key[0] == "t" or key[0] == "b" and key[2]

    def _choices(self, value) -> None:
        for n, choice in enumerate(_list(value, "choices")):
            index = _at(choice, "index")
            index = index if isinstance(index, int) else n
            delta = _at(choice, "delta")
            self._piece(delta, "content", ("c", index))
            for m, call in enumerate(_list(delta, "tool_calls")):
                tool = _at(call, "index")
                self._piece(_at(call, "function"), "arguments", ("t", index, tool if isinstance(tool, int) else m))

    def _blocks(self, value) -> None:
        if _at(value, "type") != "content_block_delta":
            return
        index, delta = value.get("index", 0), _at(value, "delta")
        if _at(delta, "type") == "text_delta":
            self._piece(delta, "text", ("b", index, False))
        elif _at(delta, "type") == "input_json_delta":
            self._piece(delta, "partial_json", ("b", index, True))

    def _flush(self, chosen) -> None:
        """What the chosen keys hold, as events of their own, in order of the keys."""
        for key in sorted(k for k in self.held if chosen(k)):
            text = restore(self.held.pop(key), self.vault, self._quoted(key))
            if key[0] == "c":
                value = {"choices": [{"index": key[1], "delta": {"content": text}}]}
            elif key[0] == "t":
                value = {"choices": [{"index": key[1], "delta": {"tool_calls": [{"index": key[2], "function": {"arguments": text}}]}}]}
            else:
                delta = {"type": "input_json_delta", "partial_json": text} if key[2] else {"type": "text_delta", "text": text}
                value = {"type": "content_block_delta", "index": key[1], "delta": delta}
                self.out.append("event: content_block_delta\n")
            self.out.append(f"data: {self._written(value, '')}\n\n")


def _rows(stream: str, frame: pd.DataFrame, state: str | None, vault: dict, schema: str | None):
    """The rows of one stream that arrived, and its state after them (None once it ended)."""
    rows, ended = [], False
    for r in frame.sort_values("seq").itertuples():
        if isinstance(r.vault, str):
            vault.update(json.loads(r.vault))
        schema = r.schema if isinstance(r.schema, str) else schema
        e = Events(schema or "openai", vault, state)
        out = e.push(bytes(r.bytes)) if r.bytes is not None else b""
        if r.is_end or r.failed:
            out += e.flush(bool(r.failed))
            ended = True
        state = e.state()
        rows.append((stream, r.seq, out))
    return pd.DataFrame(rows, columns=["stream_id", "seq", "bytes"]), None if ended else json.dumps([state, vault, schema])


def restore_events(chunks: DataFrame) -> DataFrame:
    """stream_id, seq, bytes of a streaming table (stream_id, seq, bytes, schema, vault as a JSON map on the first row,
    is_end, failed): each piece of a stream as it may go out."""

    def step(key, frames, state):
        old = json.loads(state.get[0]) if state.exists else (None, {}, None)
        out, new = _rows(key[0], pd.concat(list(frames)), *old)
        if new is None:
            if state.exists:
                state.remove()
        else:
            state.update((new,))
        yield out

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def restore_recorded(chunks: DataFrame) -> DataFrame:
    """As restore_events, for a table of whole streams; a stream without an end is left unfinished."""
    return chunks.groupBy("stream_id").applyInPandas(lambda key, frame: _rows(key[0], frame, None, {}, None)[0], OUT)
