import hashlib
import random
import zlib
from fractions import Fraction

import pyarrow as pa

from logweft.llm import periodic_runs, queries
from tests.llm.edge import WORD, edge_docs, listed, nothing


def brute(x):
    """Every run, by comparing words at each distance."""
    out = []
    for q in range(1, len(x) // 4 + 1):
        i = q
        while i < len(x):
            j = i
            while j < len(x) and x[j] == x[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(x[k] == x[k - p] for k in range(start + p, start + length)) for p in range(1, q)):
                out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def digests(doc_id, text):
    x = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and x:
        g = h // 10
        a = g % len(x)
        p = 1 + (len(x) - a) // (3 + g % 8)
        x = [w if i < a else x[a + (i - a) % p] for i, w in enumerate(x)]
    runs = brute(x)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    best = [(*r, 1000 * r[1] // r[2]) for r in best] or [(None,) * 4]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best[0], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(x) if i not in gone)))


def test_runs_and_windows_equal_brute_force():
    draw = random.Random(3)
    for _ in range(4000):
        kinds, size, x = draw.choice([1, 2, 3, 5, 50]), draw.randrange(80), []
        while len(x) < size:
            if draw.random() < 0.3:
                unit = [draw.randrange(kinds) for _ in range(draw.randrange(1, 7))]
                x += (unit * 9)[: draw.randrange(1, 50)]
            else:
                x.append(draw.randrange(kinds))
        want = brute(x)
        assert periodic_runs.runs_of(x) == want
        text = " ".join(map(str, x))
        found, collapsed = periodic_runs.search(pa.array([text, None, f"a b {text}", text]), [1, 2, 3, 4])
        assert found == [want, [], [(s + 2, n, q) for s, n, q in want], want]
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert collapsed[0].decode().split() == [str(w) for i, w in enumerate(x) if i not in gone]


def test_long_repetitions_are_found_in_little_time():
    assert periodic_runs.runs_of([7] * 50_000) == [(0, 50_000, 1)]
    assert periodic_runs.runs_of([1, 2, 3] * 10_000 + [1, 2]) == [(0, 30_002, 3)]
    period = random.Random(1).sample(range(10**6), 3000)
    assert periodic_runs.runs_of(period * 4) == [(0, 12_000, 3000)]


def test_operator_on_odd_rows(spark):
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(edge_docs(spark)).collect() if r["doc_id"] is not None}
    assert [tuple(r) for r in got[20]["runs"]] == [(0, 300, 1)] and got[20]["collapsed"] == "to"
    assert got[0]["runs"] == [] and got[0]["collapsed"] == ""
    assert listed(periodic_runs.periodic_runs(nothing(spark))) == []
    docs = edge_docs(spark)
    small = docs.where("coalesce(length(text), 0) < 5000")
    want = [digests(r["doc_id"], r["text"]) for r in small.collect()]
    assert listed(periodic_runs.run_digests(small, looped=periodic_runs.looped_tail)) == sorted(want, key=str)
    assert periodic_runs.run_digests(docs).count() == docs.count()


def test_query_equals_brute_force(spark, small):
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    short = [digests(r["doc_id"], r["text"]) for r in docs if len(r["text"] or "") < 6000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, small).collect()}
    assert len(got) == len(docs) and any(x[1] for x in short)
    assert [got[x[0]] for x in short] == short
