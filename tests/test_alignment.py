import random
from collections import Counter

import numpy as np

from logweft.operators import alignment


def brute(a, b):
    """The same by plain lists; the chain by trying all."""
    ca, cb = Counter(a), Counter(b)
    anchors = [(i, b.index(x)) for i, x in enumerate(a) if ca[x] == 1 and cb[x] == 1]
    best = [[] for _ in anchors]
    for i, (_, q) in enumerate(anchors):
        before = max((best[j] for j in range(i) if anchors[j][1] < q), key=len, default=[])
        best[i] = [*before, anchors[i]]
    return len(max(best, key=len, default=[]))


def test_the_chain_is_the_longest_and_rises_in_both():
    draw = random.Random(3)
    for _ in range(300):
        n = draw.randrange(0, 12)
        first, second = np.array(draw.sample(range(40), n), int), np.array(draw.sample(range(40), n), int)
        chain = alignment.longest_chain(first, second)
        assert (np.diff(first[chain]) > 0).all() and (np.diff(second[chain]) > 0).all()
        order = np.argsort(first)
        a, b = [str(i) for i in order], [str(i) for i in np.argsort(second)]
        assert len(chain) == brute(a, b)


def aligned(spark, a, b):
    frames = [spark.createDataFrame([(i, x) for i, x in enumerate(s)], "step bigint, shape string") for s in (a, b)]
    return {(r["side"], r["step"]): (r["change"], r["other_step"]) for r in alignment.align(*frames).collect()}


def test_steps_added_missing_and_moved(spark):
    a = ["login", "load", "tick", "tick", "pay", "tick", "mail", "logout"]
    b = ["login", "tick", "pay", "load", "tick", "tick", "audit", "logout"]
    got = aligned(spark, a, b)
    assert len(got) == len(a) + len(b)
    assert got[1, 0] == ("same", 0) and got[1, 7] == ("same", 7) and got[1, 6] == ("missing", None) and got[2, 6] == ("added", None)
    assert {got[1, 1][0], got[1, 4][0]} == {"same", "moved"} and got[1, 1][1] == 3 and got[1, 4][1] == 2
    ticks = [got[1, i] for i in (2, 3, 5)]
    assert all(c in ("same", "moved") for c, _ in ticks) and {o for _, o in ticks} == {1, 4, 5}


def test_what_holds_for_all_pairs_of_sessions(spark):
    draw = random.Random(6)
    for k in range(4):
        a = [draw.choice("abcdefghijkl") + draw.choice(["", "1", "2"]) for _ in range(25)] + [None]
        b = [x for x in a if draw.random() < 0.8] + [draw.choice("axyz") for _ in range(4)] if k else []
        got = aligned(spark, a, b)
        assert len(got) == len(a) + len(b)
        for (side, step), (change, other) in got.items():
            if other is not None:
                assert got[3 - side, other] == (change, step)
            assert (other is None) == (change in ("missing", "added"))
        missing, added = Counter(a) - Counter(b), Counter(b) - Counter(a)
        assert Counter(a[i] for (s, i), (c, _) in got.items() if c == "missing") == missing
        assert Counter(b[i] for (s, i), (c, _) in got.items() if c == "added") == added
    assert aligned(spark, ["a", "b"], ["a", "b"]) == {(1, 0): ("same", 0), (1, 1): ("same", 1), (2, 0): ("same", 0), (2, 1): ("same", 1)}
