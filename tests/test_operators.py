import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from meibo.functions.similarity import jaro_winkler, ratio
from meibo.operators import catalogue as K
from meibo.operators import network as N
from meibo.operators import ordered as O
from meibo.operators import places as P
from meibo.operators import resolve as R
from meibo.operators import stats as S
from meibo.operators.enrich import enrich, rule_provider
from meibo.operators.setsim import similar_sets
from meibo.plans import rules
from meibo.sources import readers, sinks


def test_stitch_fold_drops_near_duplicates_and_reattaches(spark):
    rows = [("v", 1, "standard", "aaaaaaaaaa bbbb"), ("v", 2, "orphan", "cc"), ("v", 3, "standard", "aaaaaaaaaa bbbb cc"), ("v", 4, "orphan", "dd"), ("v", 5, "full_row", "lost"), ("v", 6, "standard", "zzzz"), ("w", 1, "orphan", "none"), ("w", 2, "standard", None), (None, 1, "standard", "x")]
    df = spark.createDataFrame(rows, "volume string, segment_id long, segment_type string, body_text string")
    got = {(r.volume, r.first): (r.n_segments, r.text) for r in O.stitch_dropping_duplicates(df, "volume", "segment_id").collect()}
    assert ratio("aaaaaaaaaa bbbb cc", "aaaaaaaaaa bbbb cc") >= 0.85
    assert got == {("v", 1): (3, "aaaaaaaaaa bbbb cc dd"), ("v", 6): (1, "zzzz"), ("w", 2): (1, "")}


def test_running_count_by_ranges(spark):
    rows = [("v" if i % 3 else None, i * 7919 % 1000, i % 4 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, c boolean")
    got = {(r.g, r.o): r.n for r in O.running_count(df, "g", "o", F.col("c"), "n").collect()}
    assert got == {(g, o): sum(c2 for g2, o2, c2 in rows if g2 == g and o2 <= o) for g, o, _ in rows}


def test_number_rows_is_global(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("v"))
    got = [r.n for r in O.number_rows(df, ["v"], "n").orderBy("v").collect()]
    assert got == list(range(1, 501))


def test_fuzzy_pairs_against_brute_force(spark):
    rnd = random.Random(3)
    names = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7))) for _ in range(160)} | {"", "kokushi", "kokusi"}
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)] + [("x", None)], "i string, n string")
    got = {(r.name_a, r.name_b) for r in R.fuzzy_pairs(df, "i", "n").collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(n for n in names if n), 2) if jaro_winkler(a, b) >= 0.9}


def _shuffled(spark):
    """Bytes that tasks have written for shuffles so far."""
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


def test_fuzzy_pairs_writes_names_and_no_candidates(spark):
    rnd = random.Random(7)
    names = sorted({f"{rnd.choice(['Central', 'Second'])} {''.join(rnd.choice('aiueoknst') for _ in range(9))} {rnd.choice(['Railway', 'Rubber'])} Co., Ltd." for _ in range(700)} | {"Second " + "x" * 70, "Second " + "x" * 69 + "y"})
    df = spark.createDataFrame([("i", n) for n in names], "i string, n string").coalesce(1)
    before = _shuffled(spark)
    got = {(r.name_a, r.name_b) for r in R.fuzzy_pairs(df, "i", "n", floor=True, boost_above=0.7).collect()}
    assert _shuffled(spark) - before < 8 * sum(map(len, names))
    assert got == {(a, b) for a, b in itertools.combinations(names, 2) if jaro_winkler(a, b, floor=True, boost_above=0.7) >= 0.9}


def test_reference_name_pairs_writes_names_and_no_candidates(spark, tmp_path):
    rnd = random.Random(9)
    names = sorted({f"{rnd.choice(['Northern', 'Great'])} {''.join(rnd.choice('aiueoknst') for _ in range(9))} Bank Co., Ltd." for _ in range(500)})
    names += sorted(n[:-6] + n[-5:] for n in names[:40])
    spark.createDataFrame([(str(i), n) for i, n in enumerate(names)] + [("x", None), ("y", "")], "organization_id string, name_en string").coalesce(1).write.parquet(str(tmp_path / "organizations.parquet"))
    before = _shuffled(spark)
    got = {tuple(r) for r in rules.reference_name_pairs(spark, str(tmp_path)).collect()}
    assert _shuffled(spark) - before < 8 * sum(map(len, names))
    assert len(got) >= 40 and got == {(a, b) for a, b in itertools.combinations(sorted(set(names)), 2) if jaro_winkler(a, b) >= 0.95}


def test_reference_name_pairs_writes_each_name_once_for_all_parts(spark, tmp_path, monkeypatch):
    rnd = random.Random(10)
    names = sorted({f"{rnd.choice(['Northern', 'Great'])} {''.join(rnd.choice('aiueoknst') for _ in range(9))} Bank Co., Ltd." for _ in range(600)})
    names += sorted(n[:-6] + n[-5:] for n in names[:40])
    spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "organization_id string, name_en string").coalesce(1).write.parquet(str(tmp_path / "organizations.parquet"))
    wrote = {}
    for tile in (R.TILE, 40):
        monkeypatch.setattr(R, "TILE", tile)
        before = _shuffled(spark)
        got = [tuple(r) for r in rules.reference_name_pairs(spark, str(tmp_path)).collect()]
        wrote[tile] = _shuffled(spark) - before
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.combinations(sorted(set(names)), 2) if jaro_winkler(a, b) >= 0.95}
    assert wrote[40] < 2 * wrote[16_000]


def test_name_tiles_against_brute_force():
    rnd = random.Random(8)
    for chars, least, most in (("ab", 1, 12), ("梓柄寺鉄道𠮷\0", 1, 9), ("abc", 55, 90)):
        names = list({"".join(rnd.choice(chars) for _ in range(rnd.randint(least, most))) for _ in range(150)})
        for floor, above in ((True, 0.7), (False, 0.0)):
            for left, right in ((names, None), (names[:40], names[40:])):
                got = {(n[i], n[j]): s for n, a, b, score in R.alike_in_tile(left, right, 0.9, floor, above) for i, j, s in zip(a, b, score)}
                pairs = itertools.combinations(sorted(left), 2) if right is None else ((min(x, y), max(x, y)) for x in left for y in right)
                assert got == {(a, b): s for a, b in pairs if (s := jaro_winkler(a, b, floor=floor, boost_above=above)) >= 0.9}


def test_similar_sets_against_brute_force(spark):
    rnd = random.Random(4)
    sets = {f"s{i}": sorted({f"t{rnd.randint(0, 12)}" for _ in range(rnd.randint(0, 8))}) for i in range(80)}
    df = spark.createDataFrame(list(sets.items()) + [("n", None)], "id string, tokens array<string>")
    for t in (0.3, 0.6, 1.0):
        got = {(r.id_l, r.id_r) for r in similar_sets(df, None, t).collect()}
        jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
        assert got == {(x, y) for x, y in itertools.combinations(sorted(sets), 2) if jac(sets[x], sets[y]) >= t - 1e-9}


def test_weighted_similar_sets_against_brute_force(spark):
    rnd = random.Random(5)
    sets = {f"s{i}": (rnd.choice([None, "m", "n"]), sorted({f"t{min(rnd.randint(0, 12), rnd.randint(0, 12))}" for _ in range(rnd.randint(0, 8))})) for i in range(90)}
    df = spark.createDataFrame([(k, m, s, "x") for k, (m, s) in sets.items()], "id string, m string, tokens array<string>, w string")
    full = {k: (m or "", set(s)) for k, (m, s) in sets.items() if s}
    df_of = lambda tok: sum(tok in s for _, s in full.values())
    w = {tok: math.log(1 + len(full) / df_of(tok)) for _, s in full.values() for tok in s}
    heavy = lambda s: sum(w[x] for x in s)
    for t in (0.3, 0.7):
        got = {(r.id_l, r.id_r) for r in similar_sets(df, None, t, mark="m", weighted=True).collect()}
        assert got == {(x, y) for x, y in itertools.combinations(sorted(full), 2) if full[x][0] == full[y][0] and heavy(full[x][1] & full[y][1]) / heavy(full[x][1] | full[y][1]) >= t - 1e-9}
    assert similar_sets(df.limit(0), df, 0.5, mark="m", weighted=True).count() == 0


def test_similar_sets_shuffles_sets_and_no_pairs(spark):
    n = 700
    df = spark.createDataFrame([(f"s{i:03}", ["all", f"a{i}", f"b{i}", f"c{i}"], i % 7) for i in range(n)], "id string, tokens array<string>, k int").coalesce(1)
    before = _shuffled(spark)
    pairs = similar_sets(df, None, 0.14, keep=["k"])
    got = pairs.agg(F.count(F.lit(1)), F.min("jaccard"), F.sum((F.substring("id_r", 2, 3).cast("int") % 7 != F.col("k_r")).cast("int"))).first()
    assert _shuffled(spark) - before < 200 * 4 * n
    assert got[0] == n * (n - 1) // 2 and got[1] == pytest.approx(1 / 7) and got[2] == 0


def test_closure_and_depth(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("q", "p"), ("z", "z"), (None, "a")], "old_id string, new_id string")
    got = dict((r.old_id, r.new_id) for r in R.close_remap(m).collect())
    assert {k: got[k] for k in "abcx"} == {"a": "d", "b": "d", "c": "d", "x": "y"} and "z" not in got
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(20)], "c string, p string")
    assert {int(r.c): r.depth for r in R.parent_depth(chain, "c", "p").collect()} == {i: i for i in range(20)}
    ring = spark.createDataFrame([(str(i), str((i + 1) % 4)) for i in range(4)] + [("t", "2"), ("u", "t"), ("9", "9")], "c string, p string")
    assert {r.c: (r.depth, r.top) for r in R.parent_depth(ring, "c", "p").collect()} == {c: (64, None) for c in "0123tu"} | {"9": (0, "9")}
    assert {r.c: r.p for r in R.close_remap(ring, "c", "p").collect()} == dict.fromkeys("0123tu", "0")
    long = spark.createDataFrame([(f"{i:04d}", f"{i - 1:04d}" if i else None) for i in range(300)], "c string, p string")
    assert {int(r.c): (r.depth, r.top) for r in R.parent_depth(long, "c", "p").collect()} == {i: (i, "0000") for i in range(300)}
    assert {r.p for r in R.close_remap(long, "c", "p").collect()} == {"0000"}
    df = spark.createDataFrame([("a",), ("k",), (None,)], "i string")
    assert sorted((r.i or "") for r in R.remap(df, "i", m).collect()) == ["", "b", "k"]


def test_subsets_and_provenance(spark):
    rows = [(1, "p", "clerk", 1920), (2, "p", None, None), (3, "p", "clerk", None), (4, "p", "boss", None), (5, "p", "clerk", 1920), (6, "q", None, None), (7, "p", "NULL", 1920), (8, None, "", None), (9, None, "x", None)]
    df = spark.createDataFrame(rows, "i long, g string, t string, y int")
    assert sorted(r.i for r in R.drop_subsets(df, ["g"], ["t", "y"], "i").collect()) == [1, 4, 5, 6, 9]
    f = spark.createDataFrame([("k", 2, ["b"], "z"), ("k", 1, ["a"], None), ("k", 3, ["a", "c"], "w"), ("k", 4, None, "v")], "k string, o long, v array<string>, x string")
    r = R.fold_provenance(f, ["k"], ["o"], ["v"], ["x"]).first()
    assert r.v == ["a", "b", "c"] and r.n_rows == 4 and r.x is None
    assert R.merge_last_non_null(f, ["k"], ["o"], ["x"]).first().x == "v"


def test_greedy_clusters(spark):
    rows = [("n", "1", "1927", 1880, ["A", "B"]), ("n", "2", "1935", 1882, ["A", "B", "C"]), ("n", "3", "1935", None, ["A", "B"]), ("n", "4", "1943", 1900, ["A", "B"]), ("m", "5", "1927", 1880, ["A", "B"])]
    df = spark.createDataFrame(rows, "n string, i string, v string, y int, o array<string>")
    got = {(r.i, r.canonical_id) for r in R.greedy_clusters(df, "n", "i", "i", "y", "v", "o").collect()}
    assert got == {("1", "1"), ("2", "1"), ("3", "3"), ("4", "3")}


def test_suffix_and_hierarchy(spark):
    o = spark.createDataFrame([("1", "横浜船渠"), ("2", "横濱船渠株"), ("3", "日銀"), ("4", "日銀京都"), ("5", "日銀京都支店"), ("6", None)], "i string, n string")
    assert [(r.old_id, r.new_id) for r in R.suffix_merges(o, "i", "n").collect()] == [("2", "1")]
    assert {(r.child_name, r.parent_name) for r in P.name_hierarchy(o, "i", "n").collect()} == {("日銀京都", "日銀"), ("日銀京都支店", "日銀京都")}


def test_spread_is_exact(spark):
    rnd = random.Random(5)
    pts = [("o", 30 + rnd.random() * 8, 130 + rnd.random() * 8) for _ in range(120)] + [("s", 1.0, 1.0), ("s", 1.0, 1.0), (None, 1.0, 1.0), ("e", None, 1.0)]
    got = {r.k: r.spread_km for r in P.organisation_spread(spark.createDataFrame(pts, "k string, la double, lo double"), "k", "la", "lo").collect()}
    from tests.test_spatial import hav

    want = max(hav(a[1:], b[1:]) for a in pts[:120] for b in pts[:120]) * 6371.0 / 6371.0088
    assert got["o"] == pytest.approx(want, rel=1e-9) and got["s"] == 0 and set(got) == {"o", "s"}


def test_geocode_prefers_longest_then_feature(spark):
    g = spark.createDataFrame([("東京", 1, 1.0, 1.0, "PPL", "JP"), ("東京市", 2, 2.0, 2.0, "PPL", "JP"), ("東京市", 3, 3.0, 3.0, "ADM1", "JP"), ("台中區", 4, 4.0, 4.0, "ADM1", "TW"), ("台中", 5, 5.0, 5.0, "ADM1", "JP")], "name string, geonameid long, latitude double, longitude double, code string, country string")
    p = spark.createDataFrame([("東京市幸町", None), ("台中區幸町", None), (None, None)], "place string, origin string")
    assert {(r.place, r.geonameid) for r in P.geocode(p, g).collect()} == {("東京市幸町", 3), ("台中區幸町", 5)}


def test_symbols_to_regions(spark):
    s = spark.createDataFrame([("p", "a", [0, 0, 10, 10]), ("p", "b", [100, 100, 110, 110]), ("p", "c", [19, 0, 29, 10])], "page string, sym string, box array<int>")
    b = spark.createDataFrame([("p", "H", 0, [0, 0, 9, 10]), ("p", "B", 1, [0, 0, 25, 50])], "page string, region string, stage int, region_box array<int>")
    assert {(r.sym, r.region) for r in P.assign_symbols(s, b, "page", "sym", "box", "region").collect()} == {("a", "H"), ("c", "B")}


def test_statistics(spark):
    v = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3)], "v int")
    assert {r.decile: r.value for r in S.deciles(v, "v").collect()} == {d: sorted([5, 1, 4, 2, 3])[int(5 * d / 10) - 1] for d in range(1, 10)}
    assert S.chi2_p(3.841) == pytest.approx(0.05, abs=1e-3)
    k = S.cohens_kappa(spark.createDataFrame([(True, True)] * 4 + [(False, False)] * 4 + [(True, False)] * 2, "a boolean, b boolean"), "a", "b").first()
    assert k.kappa == pytest.approx((0.8 - 0.48) / 0.52)
    sample = S.stratified_sample(spark.range(1000).select("id", (F.col("id") < 10).alias("s")), "s", "id", 50)
    # the strata's quotas are 1 and 50; the sample is cut to the size asked for
    by = {r.s: r["count"] for r in sample.groupBy("s").count().collect()}
    assert sum(by.values()) == 50 and by[False] in (49, 50)
    m = S.mcnemar(spark.createDataFrame([(True, False)] * 12 + [(False, True)] * 3 + [(True, True)] * 9, "a boolean, b boolean"), F.col("a"), F.col("b")).first()
    assert (m.only_a, m.only_b) == (12, 3) and m.p == pytest.approx(S.chi2_p(m.chi2), abs=1e-6)
    few = S.volume_balanced_sample(spark.range(40).select("id", (F.col("id") < 3).alias("v"), (F.col("id") % 2).alias("k")), "v", "k", "id", 20)
    assert {r.v: r["count"] for r in few.groupBy("v").count().collect()} == {True: 3, False: 17}
    t = S.tertile_sample(spark.range(10), "id", "id", 7).collect()
    assert sorted((r.tertile, r.id // 3) for r in t if r.tertile < 2) == [(0, 0)] * 3 + [(1, 1)] * 2 and sum(r.tertile == 2 for r in t) == 2
    assert S.stratified_sample(spark.createDataFrame([], "id long, s string"), "s", "id", 5).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300)]
    hub = [("hub", f"z{i}") for i in range(100)]
    got = {r.node: r.component for r in N.components(spark.createDataFrame(chain + hub, "src string, dst string")).collect()}
    assert {got[f"{i:04d}"] for i in range(301)} == {"0000"} and {got[f"z{i}"] for i in range(100)} == {"hub"}
    with pytest.raises(RuntimeError):
        N.components(spark.createDataFrame(chain, "src string, dst string"), most=2)


def test_catalogue(spark):
    df = spark.createDataFrame([("a (b) c", None), ("ab", "other"), (None, "x")], "t string, c string")
    assert df.where(K.keyword_filter("(b)", [F.col("t")], whole=False)).count() == 1 and df.where(K.keyword_filter("", [F.col("t")])).count() == 3
    assert df.where(K.category_filter(F.col("c"), ["other"], ["x"])).count() == 2
    assert K.id_filter("P12") == ("person", "P12") and K.id_filter("Paris") is None
    counts = spark.createDataFrame([("p", 3), ("c", 2), ("g", 5)], "k string, n long")
    links = spark.createDataFrame([("c", "p"), ("g", "c"), ("z", "y")], "k string, p string")
    assert {r.k: r.n for r in K.rollup_counts(counts, links, "k", "p", "n").collect()} == {"p": 5, "c": 7, "g": 5}


def test_network(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("x", "y")], "src string, dst string")
    assert {(r.node, r.component) for r in N.components(e).collect()} == {(n, "a") for n in "abcd"} | {(n, "x") for n in "xy"}
    c = {r.node: r for r in N.centralities(e).collect()}
    assert c["b"].betweenness == 2 and c["a"].closeness == pytest.approx(3 / 6) and c["b"].degree == 2
    assert N.large_components(N.components(e), 0.6).count() == 1


def test_enrichment_resumes_from_its_cache(spark, tmp_path):
    df = spark.createDataFrame([("the bank",), ("a school",), (None,)], "n string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = {r.n: r.c for r in enrich(df, "n", rule_provider([("bank", "K")], "-"), "c", cache).collect()}
        assert got == {"the bank": "K", "a school": "-", None: None}
    assert spark.read.parquet(cache).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    seg = tmp_path / "ocr" / "p2" / "row10"
    seg.mkdir(parents=True)
    (seg / "1_segmented_output.json").write_text('[{"type": "standard", "body_text": "x", "segment_index": 0}]', encoding="utf-8")
    (seg / "2_segmented_output.json").write_text("{broken", encoding="utf-8")
    assert [(r.body_text, r.source_page) for r in readers.segments(spark, str(tmp_path / "ocr")).collect()] == [("x", "row10")]
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    bio = tmp_path / "biographies_extracted_1943A.jsonl"
    bio.write_text('{"validation": "Passed", "extraction": {"name": "x"}}\n{"validation": "no", "extraction": {"name": "y"}}\n', encoding="utf-8")
    assert [(r.volume, r.extraction.name) for r in readers.volume_records(spark, str(bio)).collect()] == [("1943A", "x")]
    (tmp_path / "gold.csv").write_text("﻿Column1,Column2\nid,label\n1,a\n2,b\n", encoding="utf-8")
    assert [tuple(r) for r in readers.gold_csv(spark, str(tmp_path / "gold.csv")).collect()] == [("1", "a"), ("2", "b")]
    (tmp_path / "JP.txt").write_text("1\tTokyo\tTokyo\t東京,とうきょう,東京都\t35.6\t139.7\tP\tPPLC\n2\tx\tx\t川\t1\t1\tH\tSTM\n3\tshort\n", encoding="utf-8")
    g = readers.geonames(spark, str(tmp_path / "JP.txt"))
    assert {(r.name, r.country) for r in g.collect()} == {("東京", "JP"), ("東京都", "JP")}
    (tmp_path / "b.geojson").write_text('{"features": [{"properties": {"p": "X"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]]]}}, {"properties": {"p": "Y"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}]}', encoding="utf-8")
    assert [(r.province, len(r.rings), r.rings[0][1].lon) for r in readers.boundaries(spark, str(tmp_path / "b.geojson"), "p", "ja").collect()] == [("X", 1, 1.0), ("Y", 1, 1.0)]
    df = spark.createDataFrame([("1", ["a"]), ("2", ["a", "b"])], "k string, v array<string>")
    assert sinks.append_new(df, str(tmp_path / "t"), ["k"]) == 2 and sinks.append_new(df, str(tmp_path / "t"), ["k"]) == 0
    assert [r.v for r in sinks.demoted(df, ["v"]).orderBy("k").collect()] == ["a", '["a","b"]']


def test_incremental_stream(spark, tmp_path):
    from meibo.streaming.incremental import append_stream

    src = tmp_path / "in"
    src.mkdir()
    for text in ('{"k": "1", "v": 1}\n', '{"k": "1", "v": 1}\n{"k": "2", "v": 2}\n'):
        (src / f"{len(list(src.iterdir()))}.json").write_text(text)
        append_stream(spark, str(src), "k string, v int", str(tmp_path / "out"), str(tmp_path / "ck"), ["k"]).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
