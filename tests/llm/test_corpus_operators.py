"""LM scores, Jaccard join, sharding, nearest neighbours, mixing and the pipeline against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import lm_scoring, mixing, nearest, ngram_join, queries, sharding
from spindrift.llm.components import components
from test_text_operators import brute_lines


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_scores(rows):
    """Stupid backoff of each text by the counts of all others."""
    one = [(i, w, collections.Counter(["<s>", *w] if w else []), collections.Counter(zip(["<s>", *w], w))) for i, w in rows]
    single, pairs = sum((x[2] for x in one), collections.Counter()), sum((x[3] for x in one), collections.Counter())
    total, found = sum(single.values()) - single["<s>"], {}
    for i, w, own, own2 in one:
        each = [math.log((pairs[p] - own2[p]) / (single[p[0]] - own[p[0]])) if pairs[p] > own2[p]
                else math.log(0.4 * max(0.5, single[p[1]] - own[p[1]]) / total) for p in zip(["<s>", *w], w)]
        found[i] = (len(w), sum(each) / len(each) if each else None)
    return found


def test_lm_scores(spark, sf, docs):
    wanted = brute_scores([(r.doc_id, words(r.text)) for r in docs.collect()])
    got = queries.QUERIES["op4_lm_scoring"](spark, sf).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert r.n_words == wanted[r.doc_id][0] and abs(r.score - wanted[r.doc_id][1]) < 2e-6


def test_lm_scores_of_odd_rows(odd, none):
    got = {r.doc_id: r for r in lm_scoring.score(odd).collect()}
    assert len(got) == 22 and got[0].score is None and got[0].n_words == 0 and got[4].n_words == 1 and got[7].n_words == 18
    assert lm_scoring.score(none).count() == 0


def test_lm_scores_know_words_past_any_rank(spark):
    """20,000 equally frequent words, every pair met in two texts; a text alone backs off throughout."""
    rows = [(i, [f"w{i * 100 + k}" for k in range(100)]) for i in range(200)]
    rows += [(200 + i, t) for i, t in rows] + [(400, [f"w{k}" for k in range(19_999, 0, -100)]), (401, ["new", "words"])]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got, wanted = {r.doc_id: r for r in lm_scoring.score(table).collect()}, brute_scores(rows)
    assert all(got[i].n_words == n and abs(got[i].score - s) < 2e-6 for i, (n, s) in wanted.items())
    assert min(got[i].score for i in range(400)) > max(got[400].score, got[401].score)


def test_lm_scores_shuffle_lists_and_no_row_for_each_pair(spark, docs, monkeypatch):
    plans, keep = [], lm_scoring.materialize
    monkeypatch.setattr(lm_scoring, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    lm_scoring.score(docs)
    assert len(plans) > 3 and not any("HashAggregate" in p for p in plans)  # grams and documents are summed from lists
    assert all("hashpartitioning(bucket#" in p for p in plans)


@pytest.mark.parametrize("hot,size", [(0, 1 << 22), (10**9, 30_000)])
def test_lm_scores_by_broadcast_and_by_bucket(spark, docs, monkeypatch, hot, size):
    """All that others have scored where it is found, and nothing; ids repeated and null."""
    monkeypatch.setattr(lm_scoring, "HOT", 10**12)
    monkeypatch.setattr(lm_scoring, "LEAST_HOT", hot)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", size)
    texts = [r.text for r in docs.limit(60).collect()] + ["", None, "alone", "the the the the", "the the"]
    ids = [None if i % 9 == 4 else i // 2 - 5 for i in range(len(texts))]
    wanted = collections.defaultdict(lambda: [0, 0.0])
    for i, (n, mean) in brute_scores([(i, words(t)) for i, t in enumerate(texts)]).items():
        wanted[ids[i]][0] += n
        wanted[ids[i]][1] += n * (mean or 0)
    got = lm_scoring.score(spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string")).collect()
    assert len(got) == len(wanted) == len({r.doc_id for r in got})
    for r in got:
        n, total = wanted[r.doc_id]
        assert r.n_words == n and (abs(r.score - total / n) < 2e-6 if n else r.score is None)


def brute_join(rows, width, num):
    sets = {i: frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
            for i, w in ((i, words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            n, m = len(sets[a]), len(sets[b])
            if 100 * min(n, m) >= num * max(n, m):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= num * (n + m - shared):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(spark):
    """A family around one text, whose copies are further from one another than from it, and a passage that others share."""
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        for k in range(1 + i % 3):
            copy[(17 * i + 40 * k) % 150] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(base[:60] + [f"own{i}-{k}" for k in range(60)])) for i in range(40)]
    rows += [(200, " ".join(base)), (201, None), (202, ""), (203, "one two"), (204, "One TWO"), (205, "one three")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_jaccard_join(spark, docs, width, num):
    for table in (docs.select("doc_id", "text"), near_copies(spark)):
        wanted = brute_join([(r.doc_id, r.text) for r in table.collect()], width, num)
        got = ngram_join.jaccard_components(table, ngram_join.Join(width, num, 100)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted


def test_jaccard_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    table = near_copies(spark)
    wanted = brute_join([(r.doc_id, r.text) for r in table.collect()], 3, 90)
    got = ngram_join.jaccard_components(table, ngram_join.Join(3, 90, 100)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted


def test_jaccard_join_of_odd_rows(odd, none):
    got = collections.defaultdict(set)
    for r in ngram_join.jaccard_components(odd).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert got[0] == {(0, 0)} and got[6] == got[14] == got[15] == {(3, 6)} and got[None] == {(2, None)}
    assert ngram_join.jaccard_components(none).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(20)] + [(50, 40), (40, 60), (60, 50), (70, 70), (None, 1), (1, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def least_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, used = (low + high) // 2, 1, 0
        for s in sizes:
            n, used = (n, used + s) if used + s <= mid else (n + 1, s)
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def test_cuts_are_minimax(spark):
    rng = np.random.default_rng(5)
    for n in (1, 3, 24, 200):
        sizes = [int(x) for x in rng.integers(1, 1000, n)]
        row = sharding.cuts(spark.createDataFrame(list(enumerate(sizes)), "cell long, bytes long")).first()
        assert row.capacity == least_capacity(sizes, 24) and len(row.starts) <= 24
        ends = [*row.starts[1:], n]
        assert max(sum(sizes[a:b]) for a, b in zip(row.starts, ends)) == row.capacity


def test_sharding_is_minimax_over_groups(spark):
    """Few bits a round, so that cells are split over and over; sizes alike, skewed, and with a group of a third of all."""
    rng = np.random.default_rng(6)
    for sizes, bits in (([int(x) for x in rng.integers(1, 50, 900)], 6), ([int(x) for x in rng.pareto(1.1, 500) * 10 + 1], 3), ([5000, *[10] * 1000], 4), ([7], 13)):
        hashes = sorted(int(x) for x in rng.integers(-2**63, 2**63, len(sizes)))
        table = spark.createDataFrame(list(zip(hashes, sizes)), "hash long, bytes long")
        capacity, starts = sharding.minimax(table, 24, bits, 2)
        assert capacity == least_capacity(sizes, 24) and len(starts) <= 24
        ends = [*starts[1:], 2**63]
        assert max(sum(n for h, n in zip(hashes, sizes) if a <= h < b) for a, b in zip(starts, ends)) == capacity


def test_sharding(spark, sf, docs, odd, none):
    rows = queries.QUERIES["op6_sharding"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    homes, slots = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 24
        homes[data].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(h) == 1 for h in homes.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == len(texts)
    groups = collections.Counter()
    for t in texts.values():
        groups[t or ""] += len((t or "").encode()) + 8
    hashed = spark.createDataFrame(list(groups.items()), "text string, bytes long").orderBy(F.xxhash64("text")).collect()
    filled = collections.Counter()
    for r in rows:
        filled[r.shard] += r.size
    assert max(filled.values()) == least_capacity([r.bytes for r in hashed], 24)
    assert sharding.shard(odd).count() == odd.count() and sharding.shard(none).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 64)).astype(np.float32)
    base[100:400] = base[100]  # a vector that half of the rows share
    bad = [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64), (1003, [1.0, None] * 32), (1004, [1.0]), (None, base[0].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + bad
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.nearest(table, table.filter("vec_id % 20 = 0")).collect()
    exact, found = base.astype(float), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 20):
        scores = exact @ exact[q]
        order = [j for j in np.lexsort((np.arange(600), -scores)) if j != q][:20]
        assert len(found[q]) == 20 and all(abs(scores[j] - s) < 1e-9 for j, s in found[q])
        assert [(-s, j) for j, s in found[q]] == sorted((-s, j) for j, s in found[q])
        hits += len({j for j, _ in found[q]} & set(order))
    assert hits / 600 >= 0.9
    assert nearest.nearest(table.limit(0), table.limit(0)).count() == 0


def test_nearest_widens_for_outlying_queries(spark):
    rng = np.random.default_rng(5)
    dense = rng.normal(size=64) + 0.02 * rng.normal(size=(500, 64))
    base = np.concatenate([dense, rng.normal(size=(12, 64))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    got = collections.Counter(r.query_id for r in nearest.nearest(table, table.filter("vec_id % 20 = 0 or vec_id >= 500")).collect())
    assert len(got) == 37 and set(got.values()) == {20}
    few = collections.Counter(r.query_id for r in nearest.nearest(table.filter("vec_id >= 495"), table.filter("vec_id >= 495")).collect())
    assert len(few) == 17 and set(few.values()) == {16}  # all there are


def test_multi_index_finds_all_codes_in_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (500, 16), dtype=np.uint8)
    codes[:50] = codes[0] ^ (1 << rng.integers(0, 8, (50, 16)) * (rng.random((50, 16)) < 0.4)).astype(np.uint8)
    index = nearest.MultiIndex(codes)
    for radius in (0, 9, 20, 60, 128):
        far = np.bitwise_count(codes ^ codes[0]).sum(1)
        rows, got = index.within(codes[0], radius)
        assert rows.tolist() == np.flatnonzero(far <= radius).tolist() and (got == far[rows]).all()


def fill(sizes, weights, budget):
    target, free = {}, set(sizes)
    while free:
        left = budget - sum(target.values())
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in free}
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    return target


def test_mixing(spark, sf, docs):
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[source[i]] += n
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    target = fill(sizes, weights, 1.5 * sum(sizes.values()))
    rows = queries.QUERIES["op10_mixing"](spark, sf).collect()
    taken = collections.Counter()
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] += r.taken
    largest = collections.Counter()
    for i, n in size.items():
        largest[source[i]] = max(largest[source[i]], n)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.QUERIES["op10_mixing"](spark, sf).collect()))


def test_mixing_in_rounds_and_without_broadcast(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "source", "text")
    sizes = mixing.materialize(mixing.sizes_of(rows), "test")
    plain = sorted(map(tuple, mixing.plan(sizes).collect()), key=str)
    monkeypatch.setattr(mixing, "LAST", 1)
    monkeypatch.setattr(mixing, "BUCKET_BITS", 2)
    plan = mixing.plan(sizes)
    assert [(r[0], r[1], r[3]) for r in sorted(map(tuple, plan.collect()), key=str)] == [(r[0], r[1], r[3]) for r in plain]
    counts = {most: sorted((r._row.doc_id, r.copies) for r in mixing.with_copies(rows, plan, mixing.draw(), most).collect()) for most in (0, 10**6)}
    assert counts[0] == counts[10**6] and len(counts[0]) == docs.count()
    taken = collections.Counter()
    for r in mixing.with_copies(sizes, plan, F.col("draw")).collect():
        taken[r._row.source, r.target] += r.copies * r._row.size
    assert all(abs(n - target) <= 20_000 for (_, target), n in taken.items())


def test_mixing_of_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    counts = collections.Counter(r.doc_id for r in rows)
    assert all(n <= 4 for n in counts.values()) and out.filter("source is null").count() > 0
    assert all(r.draw in ("draw", None) and r.target in ("target", None) for r in rows)
    assert mixing.mix(none).count() == 0


def test_pipeline_keeps_one_of_equal_rows(spark, odd):
    import corpus_pipeline as p

    texts = ["a b c d e f g", None, "x y z"]
    rows = [(3, texts[0]), (None, texts[0]), (2, texts[0]), (2, texts[0]), (None, texts[2]), (None, texts[2]), (7, None), (8, "")]
    out = p.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(2, texts[0]), (None, texts[2]), (7, None), (8, "")], key=str)


def test_pipeline(spark, sf, docs):
    import corpus_pipeline as p

    at, names = docs, [n for n, _ in p.STAGES]
    steps = {}
    for name, stage in p.STAGES:
        before = at
        at = p.materialize(stage(spark, before, sf), "test")
        steps[name] = (before, at)
        if name != names[-1]:
            assert at.columns == docs.columns
    before, after = steps["n-gram Jaccard join"]
    wanted = brute_join([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (_, c) in wanted.items() if c == i)
    before, after = steps["line dedup"]
    lines = brute_lines([(r.doc_id, r.text or "") for r in before.collect()])
    assert {(r.doc_id, r.text or "") for r in after.collect()} == {(i, "\n".join(kept)) for (i, _), kept in lines.items()}
    before, after = steps["mixing sources"]
    size, sizes = {r.doc_id: len(words(r.text)) for r in before.collect()}, collections.Counter()
    for r in before.collect():
        sizes[r.source] += size[r.doc_id]
    target = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()))
    taken = collections.Counter()
    for r in after.collect():
        taken[r.source] += size[r.doc_id]
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in sizes)
    before, after = steps["byte-pair encoding"]
    assert after.count() == before.count() and after.filter("n_tokens > 0").count() > 0
    before, after = steps["toxicity"]
    assert 0.7 * before.count() < after.count() <= before.count()
