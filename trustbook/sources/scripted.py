"""Scripted streams and damage, for tests: make a correct one, then drop, repeat, swap or cut messages."""

from __future__ import annotations

import json

from ..streaming.state import Side, digits


class Script:
    """A fake venue's messages, and the book that they make."""

    def __init__(self) -> None:
        self.seq, self.out, self.bids, self.asks = 0, [], Side(True), Side(False)

    def snapshot(self, bids, asks) -> Script:
        self.bids.fill(bids)
        self.asks.fill(asks)
        return self._say("snapshot", bids, asks)

    def delta(self, bids=(), asks=()) -> Script:
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for p, q in levels:
                side.put(p, q)
        return self._say("delta", list(bids), list(asks))

    def checkpoint(self) -> Script:
        import zlib

        text = "".join(digits(p) + digits(q) for side in (self.asks, self.bids) for p, q in side.best(10))
        self.out.append(json.dumps({"type": "checksum", "value": zlib.crc32(text.encode())}))
        return self

    def _say(self, kind, bids, asks) -> Script:
        self.seq += 1
        self.out.append(json.dumps({"type": kind, "seq": self.seq, "bids": [list(x) for x in bids], "asks": [list(x) for x in asks]}))
        return self


def drop(messages: list, i: int) -> list:
    return messages[:i] + messages[i + 1 :]


def duplicate(messages: list, i: int) -> list:
    return messages[: i + 1] + messages[i:]


def swap(messages: list, i: int, j: int) -> list:
    out = list(messages)
    out[i], out[j] = out[j], out[i]
    return out


def truncate(messages: list, i: int) -> list:
    return messages[:i]
