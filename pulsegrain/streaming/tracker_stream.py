"""The monitoring stream: vitals in, tracker values and alerts out, one state per subject.

State per key: the last 30 heart rates (null for a missing one), the AF timer, the personal baseline,
the number of windows and the last alert's signature.  It crosses segment borders.  Rows of one
micro-batch are put in event order within their key; a row that arrives after a later one of its key
was processed is dropped and counted, which is how this engine defines late data.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrain.runtime import ship

OUTPUT = "subject_id long, event_id long, off_us long, samples long, ratio double, timer double, baseline double, rules string, urgency string, alert boolean, late long"
STATE = "ring array<double>, timer double, baseline double, last_us long, last_id long, signature string, late long"
RING, ALPHA, BAND = 30, 0.05, 0.2


def _fired(hr: float | None, window_s: float, samples: int, ratio: float | None) -> list[tuple[str, str]]:
    out = []
    if hr is not None and window_s >= 10:
        if hr < 30:
            out.append(("extreme_bradycardia", "critical"))
        if hr > 200:
            out.append(("extreme_tachycardia", "critical"))
    if samples >= RING and ratio is not None and ratio >= 0.80:
        out.append(("sustained_tachycardia", "medium"))
    return out


class Memory:
    """One subject's tracker."""

    def __init__(self, held: tuple | None = None):
        ring, self.timer, self.baseline, us, event, self.signature, self.late = held or ([], None, None, -(1 << 62), 0, None, 0)
        self.ring, self.last = list(ring), [us, event]

    def dump(self) -> tuple:
        return self.ring, self.timer, self.baseline, *self.last, self.signature, self.late

    def step(self, event_id: int, off_us: int, hr: float | None, rhythm: str | None, window_s: float) -> tuple | None:
        if [off_us, event_id] <= self.last:
            self.late += 1
            return None
        self.last = [off_us, event_id]
        self.ring = [*self.ring, hr][-RING:]
        known = [v for v in self.ring if v is not None]
        ratio = sum(v > 100 for v in known) / len(self.ring) if known else None
        if rhythm == "AF":
            self.timer = (self.timer or 0.0) + window_s
        elif rhythm in ("N", "Other"):
            self.timer = None
        if hr is not None:
            if self.baseline is None:
                self.baseline = round(hr, 1)
            elif abs(hr - self.baseline) < BAND * self.baseline:
                self.baseline = round(self.baseline + ALPHA * (hr - self.baseline), 1)
        fired = _fired(hr, window_s, len(self.ring), ratio)
        rules = ",".join(r for r, _ in fired)
        urgency = "critical" if any(u == "critical" for _, u in fired) else "medium" if fired else "none"
        alert = bool(fired) and rules != self.signature
        self.signature = rules or None
        return event_id, off_us, len(self.ring), ratio, self.timer, self.baseline, rules, urgency, alert, self.late


def _update(window_s: float):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = Memory(tuple(state.get) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["off_us", "event_id"])
        out = []
        for r in rows.itertuples(index=False):
            hr = None if pd.isna(r.hr_bpm) else float(r.hr_bpm)
            got = memory.step(int(r.event_id), int(r.off_us), hr, None if pd.isna(r.rhythm_class) else r.rhythm_class, window_s)
            if got:
                out.append((int(key[0]), *got))
        state.update(memory.dump())
        yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in OUTPUT.split(",")])

    return update


def track_stream(rows: DataFrame, window_s: float = 10.0) -> DataFrame:
    """Streaming rows of (subject_id, event_id, off_us, hr_bpm, rhythm_class) to tracker rows."""
    ship(rows.sparkSession)
    return rows.groupBy("subject_id").applyInPandasWithState(_update(window_s), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def alerts(tracked: DataFrame) -> DataFrame:
    return tracked.where("alert")


def run_to_end(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Drains a bounded stream into a Parquet file sink (exactly once by its checkpoint) and reads it back."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
