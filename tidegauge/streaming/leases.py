"""Sites of a crawl handed out as leases: one claimer has a site at a time, whatever comes twice, late or out of order.

A transition is (site_id, event, claimer, seq, at). ``wait`` puts a site into the queue, ``claim`` asks for it, ``renew`` makes a lease last longer, ``done`` and ``error``
end it. A claimer numbers its transitions; what has a number that was seen is ``repeated`` and changes nothing. A lease ends after ``lease_s`` of event time:
a claim that is later than its end gets the site even before the timer has fired, and what the former holder sends after that is ``late``. The timer puts
a site whose lease has run out into the queue again.

State is kept by site (RocksDB), so a restart goes on with the leases as they were, and sites don't meet. The numbers seen of a claimer at a site
are one row. The outcomes are granted, refused, renewed, closed, late, repeated, queued and expired, with the number of the lease and its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

WAITING, LEASED, OVER = 0, 1, 2
#: Seconds that a lease lasts, and that transitions may be behind the latest.
LEASE_S, DELAY = 1800, "10 minutes"
OUT_SCHEMA = "site_id long, event string, claimer string, seq long, at_ms long, outcome string, lease long, until_ms long"


class _Lease(StatefulProcessor):
    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.site = handle.getValueState("site", "state int, claimer string, lease long, until_ms long")
        self.seen = handle.getMapState("seen", "claimer string", "seq long")

    def _apply(self, held: list, event: str, claimer: str, at: int) -> str:
        """Change the state (state, claimer, lease, until) by one transition and say what became of it."""
        state, holder, _, until = held
        mine = state == LEASED and holder == claimer and at <= until
        if event == "claim":
            if state == WAITING or (state == LEASED and at > until):
                held[:] = [LEASED, claimer, held[2] + 1, at + self.lease_ms]
                return "granted"
            return "refused"
        if event == "wait":
            if state in (None, OVER):
                held[:] = [WAITING, None, held[2], 0]
                return "queued"
            return "late"
        if event == "renew" and mine:
            held[3] = max(until, at + self.lease_ms)
            return "renewed"
        if event in ("done", "error") and mine:
            held[:] = [OVER, claimer, held[2], at]
            return "closed"
        return "late"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = sorted(r for b in rows for r in zip(b["at_ms"], b["seq"], b["claimer"], b["event"], strict=True))
        held = list(self.site.get()) if self.site.exists() else [None, None, 0, 0]
        before, out = held[3], []
        # the state is read and written once for each claimer, not for each row
        known: dict[str, int | None] = {}
        last: dict[str, int] = {}
        for at, seq, claimer, event in new:
            at, seq = int(at), int(seq)
            if claimer not in known:
                known[claimer] = self.seen.getValue((claimer,))[0] if self.seen.containsKey((claimer,)) else None
            if known[claimer] is not None and seq <= known[claimer]:
                outcome = "repeated"
            else:
                known[claimer] = last[claimer] = seq
                outcome = self._apply(held, event, claimer, at)
            out.append((key[0], event, claimer, seq, at, outcome, held[2], held[3]))
        for claimer, seq in last.items():
            self.seen.updateValue((claimer,), (seq,))
        self.site.update(tuple(held))
        if held[0] == LEASED and held[3] != before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(held[3])
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT_SCHEMA.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = list(self.site.get())
        if held[0] == LEASED and held[3] <= expiredTimerInfo.getExpiryTimeInMs():
            self.site.update((WAITING, None, held[2], 0))
            yield pd.DataFrame([(key[0], "timer", held[1], 0, held[3], "expired", held[2], held[3])], columns=[c.split(" ")[0] for c in OUT_SCHEMA.split(", ")])

    def close(self) -> None:
        pass


def leases(transitions: DataFrame, lease_s: int = LEASE_S, delay: str = DELAY) -> DataFrame:
    """Streaming outcomes (``OUT_SCHEMA``) of transitions (site_id, event, claimer, seq, at); those without a site, event, number or time, or behind the latest by more than ``delay``, are left out.

    Timers and map states need the RocksDB state store: set it for the session before the stream starts.
    """
    named = transitions.filter("site_id IS NOT NULL AND event IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL")
    rows = named.withWatermark("at", delay).select(F.col("site_id").cast("long").alias("site_id"), "event", F.coalesce("claimer", F.lit("")).alias("claimer"), F.col("seq").cast("long").alias("seq"), "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("site_id").transformWithStateInPandas(_Lease(lease_s * 1000), OUT_SCHEMA, "append", "EventTime")
