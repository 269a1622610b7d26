"""State kept by streams: bounded pieces, the same values as a plain loop."""

import random

import pandas as pd

from logloom.streaming import streams


class Kept:
    exists = False

    def update(self, value):
        self.value = value


def test_state_is_made_in_pieces(monkeypatch):
    monkeypatch.setattr(streams, "CHUNK_ROWS", 7, raising=False)
    draw = random.Random(4)
    rows = []
    for n in range(60):
        time = pd.NaT if draw.random() < 0.1 else pd.Timestamp(draw.randrange(20), unit="s")
        cells = {f"{side}_{name}": draw.choice([None, "", f"{side[0]}{n}"]) for name in streams.STATE_FIELDS for side in ("own", "default")}
        rows.append({"time": time, "row_id": n, "reset": draw.random() < 0.2} | cells | {"default_policy_type": None})
    shuffled = draw.sample(rows, len(rows))
    kept = Kept()
    pieces = list(streams._advance(("k",), iter([pd.DataFrame(shuffled[i : i + 11]) for i in range(0, 60, 11)]), kept))
    assert len(pieces) == 9 and max(map(len, pieces)) == 7
    want, now = [], [None] * 3
    for row in sorted(rows, key=lambda r: (r["time"] is pd.NaT, 0 if r["time"] is pd.NaT else r["time"].value, r["row_id"])):
        now = [row[f"own_{n}"] or now[i] or row[f"default_{n}"] or None for i, n in enumerate(streams.STATE_FIELDS)]
        want.append((row["row_id"], *now))
        if row["reset"]:
            now = [None] * 3
    got = pd.concat(pieces)
    assert [(r[1], *(v if isinstance(v, str) else None for v in r[2:])) for r in got.itertuples(index=False)] == want
    assert kept.value == tuple(now)
