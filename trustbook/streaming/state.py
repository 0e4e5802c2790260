"""The one stateful operator: messages of a stream in, one timeline row per message out.

Pure Python over plain values; time comes in the rows. A message may change the status of the
book, and the status decides what later messages do, which is why this is not a set operation.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from decimal import Decimal

from ..sources.venues import Malformed, Venue, adapter

NEEDS_NO_STREAM = ("awaiting_snapshot", "connection_lost")
LADDER = 10


def digits(text: str) -> str:
    """What a checksum takes of a number: no point, no leading zeros, all trailing ones."""
    return text.replace(".", "").lstrip("0") or "0"


class Side:
    """Sorted prices with the text that each level was sent in."""

    def __init__(self, bids: bool) -> None:
        self.bids, self.prices, self.levels = bids, [], {}

    def put(self, price: str, qty: str) -> None:
        p = Decimal(price)
        if Decimal(qty) == 0:
            if p in self.levels:
                del self.levels[p]
                self.prices.pop(bisect_left(self.prices, p))
            return
        if p not in self.levels:
            self.prices.insert(bisect_left(self.prices, p), p)
        self.levels[p] = (price, qty)

    def fill(self, levels: list) -> None:
        self.levels = {Decimal(p): (p, q) for p, q in levels if Decimal(q) != 0}
        self.prices = sorted(self.levels)

    def best(self, n: int) -> list[tuple[str, str]]:
        keys = self.prices[: -n - 1 : -1] if self.bids else self.prices[:n]
        return [self.levels[k] for k in keys]

    def top(self) -> Decimal | None:
        return (self.prices[-1] if self.bids else self.prices[0]) if self.prices else None

    def prune(self, depth: int) -> None:
        gone = self.prices[:-depth] if self.bids else self.prices[depth:]
        for p in gone:
            del self.levels[p]
        if gone:
            self.prices = self.prices[-depth:] if self.bids else self.prices[:depth]


def audit(bids: Side, asks: Side, their_bids: list, their_asks: list, guard_bps: int = 10, most: int = 500) -> tuple[str, int, list]:
    """(outcome, levels compared, findings) of a book against a depth answer."""
    findings, compared = [], 0
    for side, name, theirs in ((bids, "bid", their_bids), (asks, "ask", their_asks)):
        best = side.top()
        if best is None:
            continue
        sign = -1 if side.bids else 1
        edge = best * (1 + sign * Decimal(guard_bps) / 10000)
        beyond = (lambda p, e=edge: p <= e) if side.bids else (lambda p, e=edge: p >= e)
        ours = {p: side.levels[p] for p in (reversed(side.prices) if side.bids else side.prices) if beyond(p)}
        ours = dict(list(ours.items())[:most])
        other = sorted(((Decimal(p), q) for p, q in theirs if Decimal(q) != 0 and beyond(Decimal(p))), reverse=side.bids)
        other = dict(other[:most])
        if not ours or not other:
            continue
        lo, hi = max(min(ours), min(other)), min(max(ours), max(other))
        for p in sorted(x for x in ours.keys() | other.keys() if lo <= x <= hi):
            compared += 1
            a, b = ours.get(p), other.get(p)
            if a is None or b is None or Decimal(a[1]) != Decimal(b):
                findings.append((name, str(p), a[1] if a else None, b))
    findings = findings[:64]
    return ("mismatch" if findings else "match" if compared else "inconclusive"), compared, findings


class Stream:
    """State of one (venue, symbol)."""

    def __init__(self, venue: str, symbol: str, integrity: int | None = None, consecutive: int = 2, guard_bps: int = 10, scripted: bool = False) -> None:
        self.name, self.symbol, self.consecutive, self.guard_bps = venue, symbol, consecutive, guard_bps
        self.forced, self.scripted = integrity, scripted
        self.sync = self._adapter()
        self.bids, self.asks = Side(True), Side(False)
        self.status, self.integrity, self.reason, self.detail = "uninitialized", None, None, None
        self.since = self.verified = self.updated = None
        self.streak, self.suspects = 0, []

    def _adapter(self) -> Venue:
        sync = adapter(self.name, self.symbol, self.scripted)
        if self.forced is not None:
            sync.integrity = self.forced
        return sync

    # status

    def desync(self, reason: str, detail: str, at: int) -> None:
        if (self.status, self.reason) != ("desynced", reason) or self.detail != detail:
            self.status, self.reason, self.detail, self.since = "desynced", reason, detail, at
            self.integrity = self.verified = None

    def guard(self, at: int) -> None:
        b, a = self.bids.top(), self.asks.top()
        if b is not None and a is not None and b >= a:
            self.desync("crossed_book", f"crossed book: bid {b} >= ask {a}", at)

    def checksum(self) -> int:
        return zlib.crc32("".join(digits(p) + digits(q) for side in (self.asks, self.bids) for p, q in side.best(10)).encode())

    # actions

    def act(self, action: tuple, at: int) -> list[tuple] | None:
        """Event rows that the action emits, or None if it emits none."""
        kind = action[0]
        if kind == "desync":
            self.desync(action[1], action[2], at)
            return None
        if kind in ("snapshot", "delta"):
            _, bids, asks = action
            if kind == "snapshot":
                self.bids.fill(bids)
                self.asks.fill(asks)
                self.status, self.integrity, self.since, self.verified, self.reason, self.detail = "live", self.sync.integrity, at, None, None, None
            else:
                if self.status != "live":
                    return None
                for side, levels in ((self.bids, bids), (self.asks, asks)):
                    for p, q in levels:
                        side.put(p, q)
            if self.sync.depth:
                self.bids.prune(self.sync.depth)
                self.asks.prune(self.sync.depth)
            self.updated = at
            self.guard(at)
            rows = [(kind, side, p, q, i, None, None, None) for side, levels in (("bid", bids), ("ask", asks)) for i, (p, q) in enumerate(levels)]
            return rows or [(kind, None, None, None, None, None, None, None)]
        if kind == "trade":
            return [(kind, None, action[1], action[2], None, None, None, action[3])]
        if kind == "heartbeat":
            return [(kind, None, None, None, None, None, action[1], None)]
        if kind == "checksum":
            if self.status == "live":
                computed = self.checksum()
                if computed != action[1]:
                    self.desync("checksum_mismatch", f"checksum mismatch: venue said {action[1]}, we computed {computed}", at)
                elif self.sync.integrity == 2:
                    self.verified = at
            return [(kind, None, None, None, None, action[1], None, None)]
        raise ValueError(kind)

    def audited(self, payload: str, at: int) -> dict:
        bids, asks, _ = self.sync.rest(payload)
        if self.status != "live":
            return {}
        outcome, compared, findings = audit(self.bids, self.asks, bids, asks, self.guard_bps)
        out = {"audit": outcome, "audit_compared": compared, "audit_findings": findings}
        if outcome == "match":
            self.streak, self.suspects = 0, []
        elif outcome == "mismatch":
            prices = {Decimal(f[1]) for f in findings}
            left = prices & {Decimal(x) for x in self.suspects}
            if self.streak and left:
                self.streak += 1
                self.suspects = sorted(map(str, left), key=Decimal)
                if self.streak >= self.consecutive:
                    out["audit_desync"] = self.suspects[0]
                    self.desync("audit_mismatch", f"depth audit disagreed at {self.suspects[0]}, {self.streak} audits running", at)
            else:
                self.streak, self.suspects = 1, sorted(map(str, prices), key=Decimal)
        return out

    def step(self, ord_: int, at: int, wall: int | None, kind: str, source: str | None, payload: str | None) -> dict:
        """Apply one message; the row that describes the stream after it."""
        was = self.status
        events: list[tuple] = []
        ts, error, extra = None, None, {}
        if kind == "session_ended":
            self.sync = self._adapter()
            self.streak, self.suspects = 0, []
            self.desync("connection_lost", "connection lost", at)
        else:
            before = self.sync.save()
            try:
                if kind == "event":
                    e = json.loads(payload or "{}")
                    actions, ts = [tuple(e["action"])], e.get("venue_ts")
                elif source == "rest_audit":
                    actions, extra = [], self.audited(payload or "", at)
                elif source == "rest_snapshot":
                    actions, ts = self.sync.splice(payload or "")
                else:
                    actions, ts = self.sync.parse(payload or "")
            except (Malformed, KeyError, TypeError, ValueError, AttributeError) as e:
                self.sync.load(before)
                actions, error = [], str(e) or type(e).__name__
            for action in actions:
                rows = self.act(action, at)
                if rows is not None:
                    n = 1 + (events[-1][-1] if events else 0)
                    events += [(*r, n) for r in rows]
        bid, ask = self.bids.best(LADDER), self.asks.best(LADDER)
        resync = kind != "session_ended" and was != "desynced" and self.status == "desynced" and self.reason not in NEEDS_NO_STREAM
        return {
            "venue": self.name, "symbol": self.symbol, "ord": ord_, "elapsed_ns": at, "wall_ns": wall, "venue_ts_ns": ts, "input": kind, "status": self.status, "integrity": self.integrity, "reason": self.reason, "reason_detail": self.detail, "since_ns": self.since,
            "last_verified_ns": self.verified, "best_bid": bid[0][0] if bid else None, "best_ask": ask[0][0] if ask else None, "bid_qty": bid[0][1] if bid else None, "ask_qty": ask[0][1] if ask else None, "levels_held": len(self.bids.prices) + len(self.asks.prices),
            "bids": bid, "asks": ask, "last_update_ns": self.updated, "parse_error": error, "resync": resync, "audit": None, "audit_compared": None, "audit_findings": None, "audit_desync": None, "events": events, **extra,
        }

    # persistence between micro-batches

    def dump(self) -> str:
        own = {k: v for k, v in self.__dict__.items() if k not in ("sync", "bids", "asks")}
        return json.dumps(own | {"sync": self.sync.save(), "b": list(self.bids.levels.values()), "a": list(self.asks.levels.values())})

    @classmethod
    def restore(cls, text: str) -> Stream:
        s = json.loads(text)
        out = cls(s["name"], s["symbol"], s["forced"], s["consecutive"], s["guard_bps"], s["scripted"])
        out.sync.load(s.pop("sync"))
        out.bids.fill(s.pop("b"))
        out.asks.fill(s.pop("a"))
        out.__dict__.update(s)
        return out
