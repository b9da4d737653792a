"""Tracking accuracy against an independent loop, and what an identity switch costs."""

import math
import random
from collections import Counter

import pytest

from loomline.operators import matching
from loomline.operators.tracks import _overlap

ROW = "det_id long, clip long, frame long, label string, track long, score double, x1 double, y1 double, x2 double, y2 double"


def loop(preds, gts, alpha):
    pairs, used = [], set()
    for p in sorted(preds, key=lambda r: (r[1], r[2], r[3], -r[5], r[4])):
        best = max(((_overlap(p[6:], g[6:]), -g[0], g) for g in gts if g[1:4] == p[1:4] and g[0] not in used and _overlap(p[6:], g[6:]) > 0), default=None)
        if best and best[0] >= alpha:
            used.add(best[2][0])
            pairs.append(((p[1], p[4]), (best[2][1], best[2][4])))
    n, of_p, of_g = Counter(pairs), Counter((p[1], p[4]) for p in preds), Counter((g[1], g[4]) for g in gts)
    tp = len(pairs)
    deta = tp / (len(preds) + len(gts) - tp)
    assa = sum(k * k / (of_p[a] + of_g[b] - k) for (a, b), k in n.items()) / tp if tp else 0.0
    return deta, assa, math.sqrt(deta * assa)


def test_against_loop(spark):
    rng, preds, gts = random.Random(7), [], []
    for i in range(300):
        clip, frame, track = rng.randrange(3), rng.randrange(12), rng.randrange(4)
        x, y = 30.0 * track + rng.randrange(0, 12), float(rng.randrange(0, 8))
        row = (i, clip, frame, "xy"[track % 2], track, rng.randrange(1000) / 1000, x, y, x + 25, y + 25)
        (preds if i % 2 else gts).append(row)
    a, b = spark.createDataFrame(preds, ROW), spark.createDataFrame(gts, ROW)
    for r in matching.hota(a, b, "clip", "frame", [0.1, 0.4, 0.7]).collect():
        assert (r.deta, r.assa, r.hota) == pytest.approx(loop(preds, gts, r.alpha), abs=1e-12)


def test_switch_and_nothing(spark):
    gts = [(i, 0, i, "x", 1, 1.0, 0.0, 0.0, 10.0, 10.0) for i in range(10)]
    same = [(100 + i, 0, i, "x", 1, 0.9, 0.0, 0.0, 10.0, 10.0) for i in range(10)]
    switched = [(*r[:4], 1 + (r[2] >= 5), *r[5:]) for r in same]
    g = spark.createDataFrame(gts, ROW)
    whole = matching.hota(spark.createDataFrame(same, ROW), g, "clip", "frame", [0.5]).first()
    broken = matching.hota(spark.createDataFrame(switched, ROW), g, "clip", "frame", [0.5]).first()
    assert (whole.deta, whole.assa) == (1.0, 1.0) and broken.deta == 1.0 and broken.assa == pytest.approx(0.5)
    none = matching.hota(spark.createDataFrame(same, ROW), g.limit(0), "clip", "frame", [0.5]).first()
    assert none.deta is None and none.hota is None
