"""Queries over whole tables, and the byte limit of windows, against brute force."""

import re
from collections import Counter, defaultdict

from credsieve.operators import lines
from credsieve.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def window_by_hand(rows, k):
    out, size = [], 0
    for number, text in rows[max(0, k - 3) : k + 4]:
        part = f"{number}: {text[:200] + '…' if len(text) > 200 else text}\n"
        if size + len(part.encode()) > 1500:
            break
        out.append(part)
        size += len(part.encode())
    return "".join(out).removesuffix("\n")


def test_context_of_all_lines(spark):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r["conv_id"]].append((len(convs[r["conv_id"]]) + 1, re.sub(r"[^ -~]|\s", " ", r["text"])))
    expected = {(c, n): window_by_hand(rows, k) for c, rows in convs.items() for k, (n, _) in enumerate(rows)}
    found = {(r["conv_id"], r["number"]): r["context"] for r in QUERIES["context_window"](spark, SMALL).collect()}
    assert found == expected and max(map(len, convs.values())) > 5


def test_context_stops_at_its_bytes(spark):
    rows = [(k, 10**15 + k, "x" * (150 + 20 * k)) for k in range(9)]
    df = spark.createDataFrame([("u", *r) for r in rows], "unit_id string, idx int, number long, text string")
    numbered = [r[1:] for r in rows]
    found = {r["idx"]: r["context"] for r in lines.with_context(df).collect()}
    assert found == {k: window_by_hand(numbered, k) for k in range(9)}
    assert found[4].count("\n") == 5 and found[0].count("\n") == 3


def test_related_of_all_orders(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    expected = {o: f"user=u{c} (line 1); host=h{o} (line 3)" for o, c in orders}
    found = QUERIES["related_topk"](spark, SMALL).collect()
    assert len(found) == len(orders) and dict(map(tuple, found)) == expected


def test_labels_of_all_orders(spark):
    marks = defaultdict(list)
    for o, c in spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        marks[o % 300].append((c % 400, c % 400 + 3, (3, 2, 1)[o % 3]))
    hits = [(p % 300, p % 400, p % 400 + 1) for (p,) in spark.read.parquet(f"{SMALL}/part.parquet").select("p_partkey").collect()]
    best = [max((r for a, b, r in marks[path] if a <= hi and lo <= b), default=0) for path, lo, hi in hits]
    labels = Counter(("none", "X", "F", "T")[x] for x in best)
    assert {r["label"]: r["n"] for r in QUERIES["label_interval_score"](spark, SMALL).collect()} == labels
    true = [(path, a, b) for path, x in marks.items() for a, b, r in x if r == 3]
    met = sum(any(path == p and a <= hi and lo <= b for p, lo, hi in hits) for path, a, b in true)
    got = QUERIES["precision_recall"](spark, SMALL).first()
    judged = labels["T"] + labels["F"]
    assert tuple(got) == (labels["T"], judged, met, len(true), round(labels["T"] / judged, 9) if judged else None, round(met / len(true), 9))
