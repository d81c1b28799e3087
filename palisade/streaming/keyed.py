"""Keyed state with timers over streams: approvals that are settled once, and what investigations have read of files."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Requests that may be pending in a workspace, seconds after which one times out, share of a read that makes it a repeat.
MOST_PENDING, TIMEOUT_S, OVERLAP = 16, 60, 0.5
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AUDIT = "workspace string, id string, tool string, approved boolean, reason string, at timestamp, duration_ms long"
COVERAGE = "run string, file string, seq long, blocked boolean, overlap double, overlapping boolean, covered long, reads long, blocked_reads long"


class _Approvals(StatefulProcessor):
    """Of a workspace: the requests that can still be answered, by id, and whether they have been settled."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("requests", "id string", "token string, tool string, at long, settled boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        batch = pd.concat(list(rows))
        batch["first"] = batch["kind"] != "requested"
        held = {k[0]: list(v) for k, v in self.known.iterator()}
        for r in batch.sort_values(["at", "first", "id"]).itertuples():
            at, entry = int(r.at.timestamp() * 1000), held.get(r.id)
            if r.kind == "requested":
                if entry is not None:
                    continue  # the same request again
                if sum(not e[3] for e in held.values()) >= MOST_PENDING:
                    out.append((key[0], r.id, r.tool, False, "too-many-pending", r.at, 0))
                    continue
                held[r.id] = [r.token, r.tool, at, False]
                self.known.updateValue((r.id,), tuple(held[r.id]))
                self.handle.registerTimer(at + TIMEOUT_S * 1000)
                continue
            if entry is None or at > entry[2] + TIMEOUT_S * 1000:
                reason = "expired"
            elif entry[3]:
                reason = "replayed"
            elif r.token != entry[0]:
                reason = "invalid-token"
            else:
                reason, entry[3] = r.kind, True
                self.known.updateValue((r.id,), tuple(entry))
            out.append((key[0], r.id, entry[1] if entry else None, reason == "approved", reason, r.at, at - entry[2] if entry else 0))
        yield self._rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out, until = [], expiredTimerInfo.getExpiryTimeInMs()
        for (id_,), (_, tool, at, settled) in list(self.known.iterator()):
            if at + TIMEOUT_S * 1000 <= until:
                if not settled:
                    out.append((key[0], id_, tool, False, "timeout", pd.Timestamp(at + TIMEOUT_S * 1000, unit="ms"), TIMEOUT_S * 1000))
                self.known.removeKey((id_,))
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])
        return frame.astype({"approved": bool, "duration_ms": "int64", "at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def approvals(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of audit rows from a stream of (workspace, id, kind, token, tool, at): requested, approved, denied.

    A request is settled once: by the first answer with its token within the timeout, else by a timer of event time, as
    `timeout`. Other answers are told apart and settle nothing: replayed, invalid-token, expired (unknown, too). Beyond 16
    pending requests of a workspace new ones are refused. Requests that repeat an id change nothing, so files that are
    read again after a restart don't either. Within a batch events count in the order of `at`.
    """
    rows = events.select("workspace", "id", "kind", "token", "tool", "at").withWatermark("at", late)
    return rows.groupBy("workspace").transformWithStateInPandas(_Approvals(), AUDIT, "Append", "EventTime")


class _Coverage(StatefulProcessor):
    """Of a file in a run: the ranges read, and how often it was read and refused."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("coverage", "starts array<long>, ends array<long>, reads long, blocked long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else ([], [], 0, 0, -1)
        ranges, reads, blocked, last = [list(x) for x in zip(held[0], held[1], strict=True)], held[2], held[3], held[4]
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").drop_duplicates("seq").itertuples():
            if r.seq <= last:
                continue  # a step that has counted already
            last, overlap = int(r.seq), 0.0
            if r.blocked:
                blocked += 1
            else:
                a, b = int(r.start_line), int(r.end_line)
                overlap = max((max(0, min(e, b) - max(s, a) + 1) for s, e in ranges), default=0) / (b - a + 1)
                reads += 1
                ranges = _with(ranges, a, b)
            out.append((key[0], key[1], last, bool(r.blocked), overlap, overlap > OVERLAP, sum(e - s + 1 for s, e in ranges), reads, blocked))
        self.state.update(([s for s, _ in ranges], [e for _, e in ranges], reads, blocked, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COVERAGE.split(", ")]).astype({"seq": "int64", "blocked": bool, "overlap": float, "overlapping": bool, "covered": "int64", "reads": "int64", "blocked_reads": "int64"})

    def close(self) -> None:
        pass


def _with(ranges: list[list[int]], a: int, b: int) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*ranges, [a, b]]):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def coverage(reads: DataFrame) -> DataFrame:
    """A stream of what each read added, from a stream of (run, file, seq, start_line, end_line, blocked): overlap with the best range before, lines covered, reads and refused reads so far.

    State is a file's merged ranges and counters. Steps with a seq at or under the last one counted are taken as repeats.
    """
    rows = reads.select("run", "file", "seq", "start_line", "end_line", "blocked")
    return rows.groupBy("run", "file").transformWithStateInPandas(_Coverage(), COVERAGE, "Append", "None")
