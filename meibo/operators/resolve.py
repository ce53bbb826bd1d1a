"""Entity resolution: exact groups, tiers, fuzzy pairs, remaps and their closure, provenance, subsets."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meibo.functions.keys import skew_lookup
from meibo.functions.similarity import WORD, jaro_winkler, jaro_winkler_many
from meibo.functions.text import fold_col
from meibo.operators.network import components
from meibo.session import materialize, release


def exact_groups(df: DataFrame, key: Sequence[Column], id_col: str, volume: str, order: Sequence[str], place: str | None = None) -> DataFrame:
    """(canonical_id, merged_ids, n_volumes, conflicts): rows of equal key found in two volumes or more.

    The canonical row is the first in order; ``conflicts`` lists the places if they differ.  Keys with a null part
    group nothing.
    """
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(key)})
    ks = [f"_k{i}" for i in range(len(key))]
    for k in ks:
        named = named.where(F.col(k).isNotNull())
    ids = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(id_col).alias("_id")))), lambda s: s["_id"])
    places = F.array_sort(F.collect_set(place)) if place else F.array().cast("array<string>")
    g = named.groupBy(*ks).agg(ids.alias("ids"), F.count_distinct(volume).alias("n_volumes"), places.alias("places")).where("n_volumes >= 2")
    return g.select(
        F.element_at("ids", 1).alias("canonical_id"), F.slice("ids", 2, F.size("ids")).alias("merged_ids"), F.col("n_volumes").cast("bigint").alias("n_volumes"),
        F.when(F.size("places") > 1, F.col("places")).alias("conflicts"),
    )


def band_groups(df: DataFrame, key: Sequence[str], id_col: str, year: str, volume: str, band: int = 3) -> DataFrame:
    """Groups of equal key over two volumes or more whose years all lie within ``band`` of each other; null years fit any."""
    g = df.groupBy(*key).agg(F.min(id_col).alias("canonical_id"), F.count(F.lit(1)).alias("n"), F.count_distinct(volume).alias("n_volumes"), (F.max(year) - F.min(year)).alias("spread"))
    return g.where((F.col("n_volumes") >= 2) & (F.coalesce("spread", F.lit(0)) <= band)).select(*key, "canonical_id", F.col("n").cast("bigint").alias("n"))


def decade_pairs(df: DataFrame, name: str, id_col: str, year: str, volume: str, members: str, apart: int = 10) -> DataFrame:
    """(id_a, id_b): equal names, years exactly ``apart``, different volumes, at least one shared member (employer).

    The years meet as an equi-join on year and year - apart, so a common name is not paired with itself.
    """
    a = df.select(F.col(name).alias("k"), F.col(year).alias("y"), F.col(id_col).alias("id_a"), F.col(volume).alias("va"), F.col(members).alias("ma"))
    b = df.select(F.col(name).alias("k"), (F.col(year) - apart).alias("y"), F.col(id_col).alias("id_b"), F.col(volume).alias("vb"), F.col(members).alias("mb"))
    return a.join(b, ["k", "y"]).where((F.col("va") != F.col("vb")) & F.arrays_overlap("ma", "mb")).select("id_a", "id_b")


def greedy_clusters(df: DataFrame, key: str, id_col: str, order: str, year: str, volume: str, members: str, shared: int = 2, band: int = 3) -> DataFrame:
    """(key, id, canonical_id): clusters grown in order: one row per volume, ``shared`` members in common with one row of the cluster, years in the band with all.

    Sequential by definition, so each name's rows go through one Python group; names of a single row are left out
    before, and a name's rows are as many as its namesakes.
    """
    several = df.groupBy(key).agg(F.count_distinct(volume).alias("_v")).where("_v >= 2").select(key)
    kind = df.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([order, id_col]).to_dict("records")
        for r in rows:
            r["_set"] = set(r[members]) if r[members] is not None else set()
            r["_y"] = None if pd.isna(r[year]) else r[year]
        free, out = list(range(len(rows))), []
        while free:
            cluster = [free.pop(0)]
            for j in list(free):
                c, rs = rows[j], [rows[i] for i in cluster]
                if c[volume] in {r[volume] for r in rs} or not any(len(c["_set"] & r["_set"]) >= shared for r in rs):
                    continue
                if all(c["_y"] is None or r["_y"] is None or abs(c["_y"] - r["_y"]) <= band for r in rs):
                    cluster.append(j)
                    free.remove(j)
            if len(cluster) > 1:
                first = min(cluster, key=lambda i: (rows[i][volume], i))
                out += [(rows[i][key], rows[i][id_col], rows[first][id_col]) for i in cluster]
        return pd.DataFrame(out, columns=[key, id_col, "canonical_id"])

    return df.join(several, key, "left_semi").groupBy(key).applyInPandas(run, f"{key} string, {id_col} {kind}, canonical_id {kind}")


#: names that are compared with as many others in one task, and of which blocks are compared at once
TILE, ROWS, COLUMNS = 16_000, 512, 2_048
#: pairs that are scored at once
BATCH = 16_000
#: columns of a name's numbered characters: one for each of the commonest, the rest share
OWN, SHARED = 96, 32


def _bags(names: list[str], codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Numbered characters (the second a of a name is not its first) by column; the product of two rows is what two names share at least."""
    ordered = np.sort(codes, axis=1)
    place = np.broadcast_to(np.arange(WORD), ordered.shape)
    begins = np.ones(ordered.shape, bool)
    begins[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    token = ordered.astype(np.int64) * WORD + place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
    row, k = np.nonzero((ordered > 0) & (length <= WORD)[:, None])
    token = token[row, k]
    # a long name's characters are numbered one by one, under the same numbers
    small = {c: k for name, line in zip(names, codes) for c, k in zip(name, line.tolist())} if (length > WORD).any() else {}
    more, of = [], []
    for i in np.flatnonzero(length > WORD):
        seen: dict[str, int] = {}
        for c in names[i]:
            seen[c] = seen.get(c, -1) + 1
            more.append(small.get(c, 0) * WORD + seen[c] if c in small and seen[c] < WORD else -1)
            of.append(i)
    row, token = np.concatenate([row, np.array(of, np.int64)]), np.concatenate([token, np.array(more, np.int64)])
    kinds, kind, n = np.unique(token, return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.argsort(-n, kind="stable")] = np.arange(len(kinds))
    column = np.where(rank < OWN, rank, OWN + rank % SHARED)[kind]
    return np.bincount(row * (OWN + SHARED) + column, minlength=len(names) * (OWN + SHARED)).reshape(len(names), -1).astype(np.float32)


def alike_in_tile(left: list[str], right: list[str] | None, threshold: float, floor: bool = False, boost_above: float = 0.0) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(names, a, b, similarity), again and again: pairs of a left and a right name, or of two left ones, as places in ``names``; the smaller name is a."""
    names = sorted(left if right is None else left + right)
    length = np.array([len(x) for x in names], np.int64)
    points = np.array([x[:WORD] for x in names], f"U{WORD}").view(np.uint32).reshape(-1, WORD).astype(np.int64) + 1
    points[np.arange(WORD) >= length[:, None]] = 0
    known, codes = np.unique(np.append(points.ravel(), 0), return_inverse=True)
    codes = codes[:-1].reshape(points.shape).astype(np.int32)
    bags, per = _bags(names, codes, length), (1 / np.maximum(length, 1)).astype(np.float32)
    need = np.array([3 * (threshold - p / 10) / (1 - p / 10) - 1 for p in range(5)], np.float32) - np.float32(1e-4)
    if right is None:
        one = other = np.arange(len(names))
    else:
        of = set(left)
        own = np.array([x in of for x in names], bool)
        one, other = np.flatnonzero(own), np.flatnonzero(~own)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def scored() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        a, b = np.minimum(a, b), np.maximum(a, b)
        short = np.maximum(length[a], length[b]) <= WORD
        score = np.zeros(len(a))
        score[short] = jaro_winkler_many(codes, length, a[short], b[short], threshold, boost_above=boost_above, floor=floor)
        for k in np.flatnonzero(~short):
            score[k] = jaro_winkler(names[a[k]], names[b[k]], floor=floor, boost_above=boost_above)
        keep = score >= threshold
        return names, a[keep], b[keep], score[keep]

    for i in range(0, len(one), ROWS):
        x = one[i : i + ROWS]
        for j in range(i if right is None else 0, len(other), COLUMNS):
            y = other[j : j + COLUMNS]
            share = bags[x] @ bags[y].T
            share *= per[x][:, None] + per[y][None, :]
            if points[x[0], 0] > points[y[-1], 0] or points[x[-1], 0] < points[y[0], 0]:
                near = share >= need[0]
            else:
                p, same = np.zeros(share.shape, np.int8), np.ones(share.shape, bool)
                for k in range(4):
                    same &= (points[x, k][:, None] == points[y, k][None, :]) & (points[x, k] > 0)[:, None]
                    p += same
                near = share >= need[p]
            u, v = np.divmod(np.flatnonzero(near), len(y))
            u, v = x[u], y[v]
            if right is None:
                u, v = u[u < v], v[u < v]
            waiting.append((u, v))
            if sum(len(u) for u, _ in waiting) > BATCH:
                yield scored()
    if waiting:
        yield scored()


def fuzzy_pairs(df: DataFrame, id_col: str, name: str, threshold: float = 0.90, floor: bool = False, boost_above: float = 0.0) -> DataFrame:
    """(name_a, name_b, similarity): different names of Jaro-Winkler similarity of at least ``threshold``, each pair once.

    A common beginning of p characters (four at most) lets a Jaro similarity of (t - p/10) / (1 - p/10) suffice, and
    that needs common characters m with m/|a| + m/|b| >= 3 j - 1.  Romanised names are made of so few letters that
    an index of them leaves nearly every two names to compare, so candidates are never written: the names are dealt to
    parts, a task holds two of them, bounds m for a block of pairs by one matrix product and scores what is left
    at once.  A part is one row, and the tasks read the parts they hold from the one shuffle that dealt the names,
    so the disk grows as the names, however many parts there are.
    """
    names = materialize(df.where(F.col(name).isNotNull() & (F.col(name) != "")).select(F.col(name).alias("id")).distinct(), "names")
    n = names.count()
    parts = max(math.ceil(n / TILE), min(8, math.ceil(n / 1_000)), 1)
    dealt = names.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id").repartitionById(parts, "part")
    held = dealt.groupBy("part").agg(F.collect_list("id").alias("names"))
    left, right = held.select(F.col("part").alias("l"), F.col("names").alias("left")), held.select(F.col("part").alias("r"), F.col("names").alias("right"))
    # the hint makes each two partitions a task, without another shuffle or a broadcast
    tiles = left.hint("shuffle_replicate_nl").join(right, F.col("l") <= F.col("r"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                l, r, x, y = (batch.column(c)[i].as_py() for c in ("l", "r", "left", "right"))
                text, of = None, None
                for named, a, b, score in alike_in_tile(x, None if l == r else y, threshold, floor, boost_above):
                    if of is not named:
                        text, of = pa.array(named, pa.string()), named
                    yield pa.RecordBatch.from_arrays([text.take(pa.array(a)), text.take(pa.array(b)), pa.array(score)], names=["id_l", "id_r", "similarity"])

    met = tiles.mapInArrow(compare, "id_l string, id_r string, similarity double")
    return met.select(F.col("id_l").alias("name_a"), F.col("id_r").alias("name_b"), F.bround("similarity", 3).alias("similarity"))


def remap(df: DataFrame, column: str, mapping: DataFrame, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """``column`` replaced through the mapping; ids without an entry stay.  A few hot ids are spread."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("_new")).dropDuplicates([column])
    joined = skew_lookup(df, m, column, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new")


def close_remap(mapping: DataFrame, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """The mapping followed to its ends by pointer doubling: chains of length n close in log2 n rounds.

    Only numbers of rows reach the driver.  What leads to a cycle, which has no end, is resolved to the cycle's smallest id.
    """
    given = materialize(mapping.select(F.col(old).alias("o"), F.col(new).alias("n")).where("o is not null and n is not null and o <> n").dropDuplicates(["o"]), "remap")
    cur, moved = given, 0
    # so many doublings pass every entry: what still has a next one then is on a cycle
    for _ in range(given.count().bit_length() + 1):
        ahead = cur.select(F.col("o").alias("n"), F.col("n").alias("nn"))
        nxt = materialize(cur.join(ahead, "n", "left").select("o", F.coalesce("nn", "n").alias("n"), F.col("nn").isNotNull().alias("moved")), "remap")
        moved = nxt.where("moved").limit(1).count()
        if cur is not given:
            release(cur)
        cur = nxt
        if not moved:
            break
        cur = cur.drop("moved")
    out = cur.select("o", "n")
    if moved:
        looped = materialize(out.join(out.select(F.col("o").alias("n")), "n", "left_semi").select("o", "n"), "cycles")
        part = components(given.join(looped.select("o"), "o", "left_semi").select(F.col("o").alias("src"), F.col("n").alias("dst"))).select(F.col("node").alias("o"), "component")
        least = looped.join(part, "o").groupBy("component").agg(F.min("n").alias("least"))
        ends = part.join(least, "component").select("o", "least")
        out = out.join(ends, "o", "left").select("o", F.coalesce("least", "n").alias("n"))
    return out.select(F.col("o").alias(old), F.col("n").alias(new))


def parent_depth(df: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """(child, depth, top): steps to the topmost known ancestor by pointer doubling, however long the chain.

    What leads to a cycle has no top: its depth is ``most`` and its ``top`` null.
    """
    known = df.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c is not null").dropDuplicates(["c"])
    up = known.where("p is not null and p <> c")
    cur = materialize(known.join(up.withColumnRenamed("p", "_p"), "c", "left").select("c", F.col("_p").alias("p"), F.when(F.col("_p").isNotNull(), 1).otherwise(0).cast("bigint").alias("d"), F.lit(False).alias("moved")), "depth")
    for _ in range(cur.count().bit_length() + 1):
        above = cur.select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("d").alias("dd"))
        nxt = materialize(cur.join(above, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.col("d") + F.when(F.col("pp").isNotNull(), F.col("dd")).otherwise(0)).alias("d"), F.col("pp").isNotNull().alias("moved")), "depth")
        moved = nxt.where("moved").limit(1).count()
        release(cur)
        cur = nxt
        if not moved:
            break
    return cur.select(F.col("c").alias(child), F.when(F.col("moved"), F.lit(most)).otherwise(F.col("d")).cast("int").alias("depth"), F.when(~F.col("moved"), F.coalesce("p", "c")).alias("top"))


def merge_last_non_null(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], agreeing: Sequence[str] = (), on: str | None = None) -> DataFrame:
    """One row per key: of each column the last value that is not null, in the given order.

    ``agreeing`` columns take only values of rows whose ``on`` is that of the key's first row (a null is one of its own).
    """
    at = F.struct(*order)
    last = lambda c, ok: F.max_by(c, F.when(F.col(c).isNotNull() & ok, at)).alias(c)
    if not agreeing:
        return df.groupBy(*key).agg(*[last(c, F.lit(True)) for c in columns])
    first = df.groupBy(*key).agg(F.min_by(F.struct(on), at).alias("_on"))
    same = F.col(on).eqNullSafe(F.col("_on")[on])
    return df.join(first, list(key)).groupBy(*key).agg(*[last(c, F.lit(True)) for c in columns], *[last(c, same) for c in agreeing])


def fold_provenance(df: DataFrame, key: Sequence[str], order: Sequence[str], lists: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of equal key folded to the first in order; the list columns keep every value, in order of first appearance."""
    at = F.struct(*order)
    folded = [F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(at.alias("o"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("v")))), lambda s: s["v"]))).alias(c) for c in lists]
    return df.groupBy(*key).agg(*[F.min_by(c, at).alias(c) for c in keep], *folded, F.count(F.lit(1)).alias("n_rows"))


def _detail_sets(df: DataFrame, group: Sequence[str], details: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with group ``_g`` and details ``_d``, pairs (_g, _d, _s) of a set and a strict superset in its group).

    Empty text and the word NULL count as unknown.  Within a group only distinct detail sets are compared, each
    row counted with its set, so repeated rows cost nothing.
    """
    known = lambda c: F.when((F.col(c).cast("string") != "") & (F.col(c).cast("string") != "NULL"), F.concat(F.lit(c + "="), F.col(c).cast("string")))
    rows = df.withColumn("_d", F.array_sort(F.filter(F.array(*[known(c) for c in details]), lambda x: x.isNotNull()))).withColumn("_g", F.to_json(F.struct(*group), {"ignoreNullFields": "false"}))
    sets = rows.select("_g", "_d").distinct()
    # a strict subset of a non-empty set shares one of its own elements with the superset; the empty set is below any other
    big = sets.select("_g", F.col("_d").alias("_s"), F.explode("_d").alias("_t"))
    small = sets.where(F.size("_d") > 0).select("_g", "_d", F.element_at("_d", 1).alias("_t"))
    below = small.join(big, ["_g", "_t"]).where((F.size("_s") > F.size("_d")) & (F.size(F.array_except("_d", "_s")) == 0)).select("_g", "_d", "_s")
    empty = sets.where(F.size("_d") == 0).join(sets.where(F.size("_d") > 0).select("_g", F.col("_d").alias("_s")), "_g").select("_g", "_d", "_s")
    return rows, below.unionByName(empty)


def drop_subsets(df: DataFrame, group: Sequence[str], details: Sequence[str], row_id: str) -> DataFrame:
    """Rows whose known details are no strict subset of another row's in their group; equal rows all stay."""
    rows, below = _detail_sets(df, group, details)
    return rows.join(below.select("_g", "_d").distinct(), ["_g", "_d"], "left_anti").select(*df.columns)


def absorb_subsets(df: DataFrame, group: Sequence[str], details: Sequence[str], row_id: str, lists: Sequence[str]) -> DataFrame:
    """As ``drop_subsets``, and a row that stays takes over the values of the list columns of those it absorbs.

    A dropped row goes to the first row (by ``row_id``) whose details hold its own, and on from there if that is
    dropped too.  Values are added behind the row's own, in the order of the absorbed rows, without repeats.
    """
    rows, below = _detail_sets(df, group, details)
    rows = materialize(rows, "detail-rows")
    first = rows.groupBy("_g", "_d").agg(F.min(row_id).alias("_at"))
    above = below.join(first.withColumnRenamed("_d", "_s"), ["_g", "_s"]).groupBy("_g", "_d").agg(F.min("_at").alias("_to"))
    goes = close_remap(rows.join(above, ["_g", "_d"]).select(F.col(row_id).alias("old_id"), F.col("_to").alias("new_id")))
    values = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    taken = rows.join(goes, F.col(row_id) == F.col("old_id")).groupBy("new_id").agg(F.sort_array(F.collect_list(F.struct(F.col(row_id).alias("o"), *[values(c).alias(c) for c in lists]))).alias("_all"))
    kept = rows.join(goes.select(F.col("old_id").alias(row_id)), row_id, "left_anti").join(taken.withColumnRenamed("new_id", row_id), row_id, "left")
    added = {c: F.array_distinct(F.concat(values(F.col(c)), F.coalesce(F.flatten(F.transform("_all", lambda x: x[c])), F.array().cast("array<string>")))) for c in lists}  # noqa: B023
    return kept.withColumns(added).select(*df.columns)


def variant_groups(df: DataFrame, name: str) -> DataFrame:
    """(folded, canonical, n_forms, n_rows): spellings equal after folding; the folded one is canonical if it is used, else the commonest."""
    counts = df.where(F.col(name).isNotNull()).groupBy(fold_col(name).alias("folded"), F.col(name).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct((F.col("form") == F.col("folded")).cast("int").alias("a"), F.col("n").alias("b"), F.col("form").alias("c"))
    return counts.groupBy("folded").agg(F.max_by("form", order).alias("canonical"), F.count(F.lit(1)).alias("n_forms"), F.sum("n").alias("n_rows"))


# Corporate endings, the longest first.
CORPORATE_SUFFIXES = ("株式會社", "株式会社", "株式", "株")


def suffix_merges(orgs: DataFrame, id_col: str, name: str) -> DataFrame:
    """(old_id, new_id): organisations that equal another one's name once a corporate ending is cut off, after folding; chains of endings are closed."""
    norm = fold_col(name)
    base = F.coalesce(*[F.when(norm.endswith(s) & (F.length(norm) > len(s)), F.substring(norm, F.lit(1), F.length(norm) - len(s))) for s in CORPORATE_SUFFIXES])
    rows = orgs.select(F.col(id_col).alias("old_id"), norm.alias("norm"), base.alias("base"))
    holders = rows.groupBy(F.col("norm").alias("base")).agg(F.min("old_id").alias("new_id"))
    return close_remap(rows.where("base is not null").join(holders, "base").where("old_id <> new_id").groupBy("old_id").agg(F.min("new_id").alias("new_id")))


def ordered_row_number(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """A running number from 1 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
