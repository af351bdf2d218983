"""Grids over whole recordings against brute force."""

from fractions import Fraction

import pytest

from tessellar.plans import catalog
from tessellar.sources import frames

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def by_recording(spark):
    out = {}
    for r in frames(spark, SF).select("recording", "event_id", "start_ns", "label").collect():
        out.setdefault(r.recording, []).append((r.start_ns, r.event_id, r.label == "error"))
    return out


def grid(rows):
    """k and target from the first frame to the last, both included."""
    step = Fraction(catalog.STEP, 3)
    lo, hi = min(rows)[0], max(rows)[0]
    return [(k, round(k * step)) for k in range(int(lo / step) - 1, int(hi / step) + 3) if lo <= round(k * step) <= hi]


def test_targets_span_every_recording(spark, by_recording):
    got = {(r.recording, r.k): r.target_ns for r in catalog.QUERIES["grid_targets"](spark, SF).collect()}
    assert got == {(rec, k): t for rec, rows in by_recording.items() for k, t in grid(rows)}
    assert len({rec for rec, _ in got}) > 1 and max(k for _, k in got) - min(k for _, k in got) > 100


def test_nearest_frames_of_every_recording(spark, by_recording):
    want = {}
    for rec, rows in by_recording.items():
        best = {}
        for k, t in grid(rows):
            near = [(bad, abs(ns - t), ns, i) for ns, i, bad in rows if abs(ns - t) <= catalog.TOLERANCE]
            best[k] = (*min(near), t) if near else None
            want[rec, k] = (t, -1, -1, -1, "NO_FRAME")
        used = set()
        for k, b in sorted(((k, b) for k, b in best.items() if b), key=lambda p: (p[1][1], p[1][4], p[0])):
            bad, delta, ns, i, t = b
            status = "DECODE_FAILED" if bad else "DEDUPLICATED_FRAME" if i in used else "SELECTED"
            want[rec, k] = (t, i, ns, delta, status)
            used |= set() if bad else {i}
    got = {(r.recording, r.k): (r.target_ns, r.frame_id, r.frame_ns, r.delta, r.status) for r in catalog.QUERIES["j2_j3_nearest_frame"](spark, SF).collect()}
    assert got == want
    assert {v[4] for v in got.values()} == {"SELECTED", "DECODE_FAILED", "NO_FRAME", "DEDUPLICATED_FRAME"}
