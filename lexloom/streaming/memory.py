"""Decayed memory over a stream: teach halves what was displaced, bumps what was chosen, and makes common what is known in two contexts.

State is held by reading.  A stream's rows are (reading, seq, day, context, word, displaced, delta); a row with null delta
forgets its word in every context.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.memory import ACTIVE, HALF_LIFE, LEAST

OUT = "reading string, context string, word string, weight double, day long"
STATE = "contexts array<string>, words array<string>, weights array<double>, days array<long>"
#: Context of what holds everywhere, and how many records a reading keeps.
COMMON, CAP = "*", 2000

Records = dict[tuple[str, str], tuple[float, int]]


def _decay(weight: float, day: int, today: int) -> float:
    return weight * 0.5 ** (max(today - day, 0) / HALF_LIFE)


def fold(records: dict[str, tuple[float, int]], events: list[tuple[int, str, str | None, float]]) -> dict[str, tuple[float, int]]:
    """Apply (day, word, displaced, delta) in order, within one context."""
    for day, word, displaced, delta in events:
        if displaced is not None and displaced in records:
            w, d = records[displaced]
            records[displaced] = (_decay(w, d, day) / 2, max(d, day))
        w, d = records.get(word, (0.0, day))
        records[word] = (_decay(w, d, day) + delta, max(d, day))
    return records


def taught(records: Records, events: list[tuple[int, str, str, str | None, float | None]]) -> Records:
    """Apply (day, context, word, displaced, delta) in order to the records (context, word) of one reading.

    A word that is active in two contexts or more also becomes active in common.
    """
    for day, context, word, displaced, delta in events:
        if delta is None:
            for key in [k for k in records if k[1] == word]:
                del records[key]
            continue
        here = {w: v for (c, w), v in records.items() if c == context}
        for w, v in fold(here, [(day, word, displaced, delta)]).items():
            records[context, w] = v
        known = sum(_decay(*v, day) >= ACTIVE for (c, w), v in records.items() if w == word and c != COMMON)
        if known >= 2:
            have = _decay(*records.get((COMMON, word), (0.0, day)), day)
            if have < 1:
                records[COMMON, word] = (1.0, day)
    return records


def pruned(records: Records, today: int, cap: int = CAP) -> Records:
    """Records of weight LEAST or more today, at most cap of them by weight; of equals the later in the order of context and word goes first."""
    live = sorted(((-_decay(*v, today), k) for k, v in records.items() if _decay(*v, today) >= LEAST))
    return {k: records[k] for _, k in live[:cap]}


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    records: Records = {(c, w): (x, d) for c, w, x, d in zip(*state.get, strict=True)} if state.exists else {}
    rows = pd.concat(list(frames)).sort_values(["day", "seq"])
    none = lambda v: None if pd.isna(v) else v
    events = [(int(d), c, w, none(x), none(y)) for d, c, w, x, y in zip(*(rows[c] for c in ("day", "context", "word", "displaced", "delta")), strict=True)]
    records = pruned(taught(records, events), int(rows["day"].max())) if events else records
    keys = list(records)
    state.update(([c for c, _ in keys], [w for _, w in keys], [float(records[k][0]) for k in keys], [int(records[k][1]) for k in keys]))
    yield pd.DataFrame({"reading": key[0], "context": [c for c, _ in keys], "word": [w for _, w in keys], "weight": [records[k][0] for k in keys], "day": [records[k][1] for k in keys]})


def teach(events: DataFrame) -> DataFrame:
    """Stream of events -> all records of each reading that changed, in update mode."""
    return events.groupBy("reading").applyInPandasWithState(_update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
