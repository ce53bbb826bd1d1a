import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meibo.llm.groups import consolidate, name_groups
from meibo.llm.mixing import mix, mix_rates, share_report
from meibo.llm.packing import fill_report, first_fit_decreasing, pack
from meibo.llm.queries import confirmed_links


def union_find(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    groups = {}
    for x in up:
        groups.setdefault(top(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "rings"])
def test_groups_against_union_find(spark, shape):
    rnd = random.Random(7)
    pairs = {
        "chain": [(f"O{i}", f"O{i + 1}") for i in range(60)],
        "star": [("O0", f"O{i}") for i in range(1, 80)],
        "random": [(f"O{rnd.randint(0, 120)}", f"O{rnd.randint(0, 120)}") for _ in range(90)],
        "rings": [(f"O{10 * k + i}", f"O{10 * k + (i + 1) % 10}") for k in range(6) for i in range(10)],
    }[shape]
    noisy = pairs + [(b, a) for a, b in pairs[:5]] + pairs[:5] + [("O5", "O5"), (None, "O1"), ("O2", None)]
    got = {}
    for r in consolidate(spark.createDataFrame(noisy, "a string, b string"), "a", "b").collect():
        got.setdefault(r["group"], set()).add(r.member)
    assert {frozenset(g) for g in got.values()} == union_find([p for p in pairs if p[0] != p[1]])


def test_group_names_and_empty_table(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert consolidate(none, "a", "b").count() == 0
    m = spark.createDataFrame([("O10", "g"), ("O9", "g"), ("O2", "h")], "member string, group string")
    assert {(r.member, r.group_id) for r in name_groups(m, F.length("member") * 1000).collect()} == {("O10", "O9"), ("O9", "O9"), ("O2", "O2")}


def test_latest_verdict_counts(spark):
    rows = [(1, "O1", "O2", 0.9, True, "2024-01-01"), (2, "o02", "O1", 0.9, False, "2024-02-01"), (3, "O3", "O4", 0.9, False, "2024-01-01"), (4, "O4", "O3", None, True, "2024-03-01"), (5, "O4", "O3", None, None, "2024-04-01"), (6, "O5", "O5", 0.9, True, "2024-01-01")]
    df = spark.createDataFrame(rows, "pair_id long, organization_id_a string, organization_id_b string, similarity double, llm_confirmed boolean, checked_at string")
    assert {(r.a, r.b) for r in confirmed_links(df).collect()} == {("O3", "O4")}


def plain_ffd(sizes, cap):
    bins, at = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(bins) if r >= sizes[i]), None)
        if k is None:
            bins.append(cap)
            k = len(bins) - 1
        bins[k] -= sizes[i]
        at[i] = k
    return at


def test_tournament_tree_is_first_fit_decreasing():
    rnd = random.Random(8)
    for n in (0, 1, 2, 3, 17, 200):
        sizes = [rnd.randint(0, 100) for _ in range(n)]
        assert first_fit_decreasing(np.array(sizes, dtype=np.int64), 100).tolist() == plain_ffd(sizes, 100)
    with pytest.raises(ValueError, match="exceeds"):
        first_fit_decreasing(np.array([101]), 100)


def test_packing_keeps_every_token(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 1, 50, 99, 100, 101, 250]), "x", 7) for i in range(300)] + [(1000, None, "x", 7)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_kind string, piece int")
    kinds = spark.createDataFrame([("a", 100), ("b", 7), ("zero", 0), ("a", 100)], "container_kind string, capacity_tokens int")
    out = pack(items, kinds, group_items=40)
    got = out.collect()
    for kind, cap in (("a", 100), ("b", 7)):
        mine = [r for r in got if r.container_kind == kind]
        room, per = {}, {}
        for r in mine:
            room[r.container_id] = room.get(r.container_id, 0) + r.piece_tokens
            per.setdefault(r.doc_id, []).append((r.first_token, r.piece_tokens))
        assert max(room.values()) <= cap and len(per) == 301
        for i, n, *_ in rows:
            parts = sorted(per[i])
            assert sum(p for _, p in parts) == (n or 0) and (len(parts) == 1 or n > cap)
            assert [f for f, _ in parts] == [k * cap for k in range(len(parts))]
    assert {r.container_kind for r in got} == {"a", "b"}
    report = {r.container_kind: r for r in fill_report(out, kinds.where("capacity_tokens > 0")).collect()}
    assert 0 <= report["a"].unused_share < 0.3
    assert pack(items.limit(0), kinds).count() == 0 and pack(items, kinds.limit(0)).count() == 0


def test_mix_holds_shares_and_caps(spark):
    rnd = random.Random(10)
    rows = [(i, "big" if i % 3 else "small", rnd.randint(1, 400), 5) for i in range(3000)] + [(9001, None, 5, 5), (9002, "unlisted", 5, 5), (9003, "small", None, 5)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, rate int")
    targets = spark.createDataFrame([("big", 0.2, 2), ("small", 0.8, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mix(items, targets)
    got = m.collect()
    assert all(1 <= r.copies <= (3 if r.source == "small" else 2) for r in got) and {r.source for r in got} == {"big", "small"}
    rep = {r.source: r for r in share_report(m, items, targets).collect()}
    assert abs(rep["small"].actual_share - 0.8) < 0.002 and rep["small"].most_copies == 3 and rep["absent"].actual_share == 0
    short = mix_rates(items, targets, total=10**9).collect()
    assert {r.source: r.rate for r in short} == {"big": 2.0, "small": 3.0, "absent": 0.0}
    assert mix(items.limit(0), targets).count() == 0
