import random

from logweft.functions import literals
from logweft.operators.filters import apply_filter
from logweft.operators.timeline_store import TimelineStore
from logweft.plans.config import LogFilter
from tests.test_timeline_store import event


def test_what_a_pattern_needs():
    tree = literals.pattern_tree
    assert tree("abcd") == ("and", ["abc", "bcd"]) == literals.literal_tree("ABCD")
    assert tree("ab+cde") == "cde" and tree("(?:ab)cd") == ("and", ["abc", "bcd"]) and tree("a.bc") is None
    assert tree("(?:abc|xyz)\\d+") == ("or", ["abc", "xyz"]) and tree("(?:abc|x)?def") == "def" and tree("abc|x") is None
    assert tree("(?<n>abc){2,}") == "abc" and tree("ab{3}c") == ("and", ["abb", "bbb", "bbc"]) and tree("a{0}bcd") == "bcd"
    assert tree("[x]yz") == "xyz" and tree("[^x]yz") is None and tree("(?!abc)def") == "def" and tree("é日abcé") == "abc"
    for odd in (r"\Qabc\E", r"\p{L}abc", "(", r"abc\101", "[a&&[b]]abc", "(?x) a b c"):
        assert tree(odd) is None
    assert literals.holds(("or", ["abc", ("and", ["x y", "yz!"])]), {"x y", "yz!"}) and not literals.holds("abc", set())


def test_search_finds_what_a_full_scan_finds(spark, tmp_path):
    draw = random.Random(8)
    words = ["timeout", "Timeout", "payment", "TIMEOUT", "straße", "STRASSE", "İstanbul", "istanbul", "ſafe", "ΣΑΣ", "σας", "KKm", "a", "b1", "café", "日本語", "x.y(Z:1)"]
    rows = []
    for i in range(300):
        text = " ".join(draw.choice(words[(i // 25) % 5 :: 5] + ["common"]) for _ in range(draw.randrange(1, 6)))
        rows.append(event(i, None if i % 60 == 59 else i * 3, draw.choice(["INFO", "ERROR"]), text))
    store = TimelineStore(spark, f"file://{tmp_path}/t")
    store.append(spark.createDataFrame(rows[:200], store.schema).coalesce(1), 0)
    store.compact()
    store.append(spark.createDataFrame(rows[200:260] + [event(5, 15, message="grown needle")], store.schema).coalesce(1), 1)
    store.compact()
    store.append(spark.createDataFrame(rows[260:] + [event(7, 21, message="payment again")], store.schema).coalesce(1), 2)
    now, everything = store.manifest(), store.events().cache()
    filters = [LogFilter(text=t, regex=r, case_sensitive=c) for t in ("timeout", "straße", "istan", "safe", "ΣΑΣ", "nothing of it") for r, c in ((False, False), (False, True), (True, False))]
    filters += [LogFilter(text=t, regex=True) for t in (r"pay\w+ (again|time)", "time(out)?", "(needle|café)$", r"^\d{4}.*ISTANBUL", "[ſs]afe", "x\\.y\\(Z", "(", "(?:pay|ist)[a-z]+")]
    filters += [LogFilter(levels=("ERROR",), text="payment")]
    skipped = 0
    for wanted in filters:
        got = {r["event_id"] for r in store.search(wanted).select("event_id").collect()}
        want = {r["event_id"] for r in apply_filter(everything, wanted).select("event_id").collect()}
        assert got == want, wanted
        skipped += len(now.buckets) - len(store.candidates(now, wanted))
    assert skipped > len(filters) * len(now.buckets) * 0.4  # of all buckets that full scans would have read
    page = store.newest(LogFilter(text="needle"), 5)
    assert [r["event_id"] for r in page.rows.collect()] == ["e00005"] and not page.has_more()
