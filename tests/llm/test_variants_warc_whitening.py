"""Spelling variants, archives and whitening against plain versions of what they promise."""

import glob
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import variants, warc, whitening
from spindrift.llm.common import table_path
from spindrift.llm.queries import QUERIES


def brute_variants(rows, min_chars=6, min_count=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}
    letters = sorted(set("".join(words)))

    def near(w):
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        return [v for v in edits - {w} if v in words]

    form, count = {}, {}
    for w, n in words.items():
        found = near(w)
        count[w] = len(found)
        best = min(((-words[v], v) for v in found), default=None)
        form[w] = best[1] if best and -best[0] >= times * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, count[w], words.get(form[w])))
    return out


def test_variants_equal_all_edits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in QUERIES["op12_variants"](spark, sf).collect()}
    assert got == brute_variants(docs.select("doc_id", "text").collect())
    assert sum(r[1] is not None for r in got) > 10


def test_variants_of_runs_ties_chains_and_long_words(spark):
    long = "ab" * 31 + "c"  # 63 letters: its rotations are plain, those of longer neighbours are hashed
    words = (["aaaaaaa"] * 700 + ["aaaaaa"] * 6 + ["aabaaa"] * 6 + ["balloon"] * 30 + ["baloon"] * 6 + ["balloom"] * 30 + ["ballon"] * 150
             + [long] * 40 + [long + "x"] * 6 + [long + "xy"] * 5 + [long[:20] + "z" + long[20:] + "x"] * 8 + ["k" * 5000] * 50 + ["k" * 4999] * 5
             + ["k" * 2000 + "j" + "k" * 2999] * 6 + ["×÷ÀÿÖß"] * 9 + ["ÀÿÖßé÷"] * 9)
    rows = [(1, " ".join(words)), (None, "balloon Balloon BALLOON"), (2, None), (3, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(docs).collect()} == brute_variants(rows)


def test_rotations_meet_exactly_at_one_edit():
    rng = random.Random(5)
    for size in (7, 63, 64, 65, 66, 130):
        word = "".join(rng.choice("abc") for _ in range(size))
        at = rng.randrange(size)
        for other, near in ((word[:at] + "z" + word[at + 1:], True), (word[:at] + word[at + 1:], True), (word[:at] + "zz" + word[at:], False)):
            keys = Counter(k for w in (word, other) for k in {k for k, kind in variants.rotation_keys(w)})
            assert any(n == 2 for n in keys.values()) == near


@pytest.mark.parametrize("name", ["op11_whitening", "op12_variants", "op13_warc"])
def test_empty_tables(spark, tmp_path, name):
    for table, schema in (("documents", "doc_id long, text string"), ("embeddings", "vec_id long, embedding array<float>"),
                          ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_variants_of_odd_documents(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.variants(odd, 3, 1, 2).collect()} == brute_variants(rows, 3, 1, 2)


def expected_pages(rows):
    held = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        held[body] = max([held.get(body), page_id], key=lambda p: float("-inf") if p is None else p)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 1000 and held[body] is not None and held[body] != page_id
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", held[body] if again else None))
    return sorted(out, key=repr)


def test_archives_round_trip(spark, tmp_path):
    big = "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50
    rows = [(i, f"http://h/{i}", "same page of many words " * 100) for i in range(400)]
    rows += [(1000, None, None), (1001, "http://h/ é\r\nX: y", ""), (1002, "u", "short"), (1003, "u", "short"), (None, "n", "same page of many words " * 100),
             (1004, "u", big), (1005, "u", big), (1005, "v", big), (None, "u", "all null " * 200), (None, "u", "all null " * 200), (1006, "u", "\x00\n\r\n" * 900),
             (1007, "u", "é" * 500), (1008, "u", "é" * 500), (1009, "u", "x" * 999), (1010, "u", "x" * 999), (1011, "u", "0123456789" * 2_000_000)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, part int").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op13_warc"](spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == expected_pages(rows)


def plain(i, text):
    return warc.record("response", i, f"http://h/{i}", text.encode(), warc.sha1_label(text.encode()))


def found_ids(content):
    parts = list(warc.salvage(content))
    assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and (not parts or (parts[0][0], parts[-1][1]) == (0, len(content)))
    return [h["warc-record-id"] for p in parts for h, _ in p[3]], [(p[0], p[1]) for p in parts if p[2]]


@pytest.mark.parametrize("shape", [warc.member, lambda r: r], ids=["members", "plain"])
def test_one_torn_place_costs_one_record(shape):
    rng = random.Random(3)
    records = [shape(plain(i, "".join(rng.choice("abc \n") for _ in range(rng.randrange(2000))))) for i in range(30)]
    starts = np.cumsum([0, *map(len, records)])
    whole = b"".join(records)
    assert found_ids(whole) == ([f"<urn:page:{i}>" for i in range(30)], [])
    for _ in range(60):
        hit = rng.randrange(30)
        at = int(starts[hit]) + rng.randrange(len(records[hit]))
        cut = rng.randrange(1, 40)
        kind = rng.randrange(3)
        torn = whole[:at] + (b"", bytes(rng.randrange(256) for _ in range(cut)), b"WARC/1.1\r\nContent-Length: 9\r\n\r\n" + warc.MAGIC)[kind] + whole[at + cut if kind < 2 else at:]
        ids, gaps = found_ids(torn)
        hurt = {i for i in range(30) if starts[i] < at + cut and starts[i + 1] > at} if kind < 2 else {hit}
        assert {f"<urn:page:{i}>" for i in range(30)} - set(ids) <= {f"<urn:page:{i}>" for i in hurt}
        assert gaps or len(ids) == 30
    assert found_ids(whole[:int(starts[29]) + 60])[0] == [f"<urn:page:{i}>" for i in range(29)]
    assert found_ids(b"junk" + whole)[1] == [(0, 4)]
    assert found_ids(b"no archive at all") == ([], [(0, 17)])


def test_false_lengths_and_digests():
    a, b, c = plain(1, "first"), plain(2, "second text"), plain(3, "third")
    false = re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: 99999\r\n\r\nHTTP", b)
    assert found_ids(a + false + c) == (["<urn:page:1>", "<urn:page:3>"], [(len(a), len(a + false))])
    assert found_ids(a + b.replace(b"second", b"secund") + c) == (["<urn:page:1>", "<urn:page:3>"], [(len(a), len(a + b))])
    both = warc.member(a + b)  # several records in one member: those before the damage are kept
    assert found_ids(both + warc.member(c))[0] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert found_ids(warc.member(a + b.replace(b"second", b"secund")) + warc.member(c)) == (["<urn:page:1>", "<urn:page:3>"], [(0, len(warc.member(a + b.replace(b"second", b"secund"))))])


def test_damaged_archives_are_logged_and_the_rest_is_read(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * 300) for i in range(80)]
    path = f"{tmp_path}/archives"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, path, archive_bytes=60_000)
    files = sorted(glob.glob(f"{path}/part-*"))
    assert len(files) > 2
    content = open(files[0], "rb").read()
    second = list(warc.salvage(content))[1]
    copy = f"{tmp_path}/copy"
    spark.createDataFrame([(bytearray(content[:second[0] + 30] + b"\xff" * 5 + content[second[0] + 35:-1]),)], "v binary").coalesce(1).selectExpr(
        "cast(v as string) v").write.option("lineSep", "\0").text(copy)
    found = warc.read_archives(spark, copy)
    log = warc.gaps(found).collect()
    assert [(g.start, g.stop) for g in log] == [second[:2]] and "member" in log[0].reason
    kept = {r.record_id for r in found.filter("gap is null").collect()}
    assert kept == {h["warc-record-id"][1:-1] for p in warc.salvage(content) if p[0] != second[0] for h, _ in p[3]}
    lost = warc.resolved(warc.read_archives(spark, path).filter("record_type = 'revisit'")).collect()
    assert lost and all(r.payload_bytes is None and re.fullmatch("[0-9a-f]{40}", r.payload_digest) for r in lost)


def plain_whitening(rows, k):
    kept = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if v and len(v) == len(rows[0][1]) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    centred = fit - fit.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    return kept, fit, values[::-1][:k], axes[:, ::-1][:, :k], values.sum()


def test_whitening_equals_a_dense_solver(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    kept, fit, values, axes, trace = plain_whitening(rows, 4)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, sf).collect()}
    assert len(got) == 4 * len(kept)
    for j in range(4):
        white = {i: float((x - fit.mean(0)) @ axes[:, j] / np.sqrt(values[j])) for i, x in kept}
        sign = np.sign(sum(white[i] * got[i, j + 1].whitened for i in white))
        for i, x in kept:
            r = got[i, j + 1]
            assert abs(r.whitened - sign * white[i]) < 1e-9 and abs(r.explained - values[j] / trace) < 1e-12 and r.identity_error < 1e-9 and r.n == n
            assert r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(x, sums))


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, [1.0, 2.0, 0.5]), (2, [0.0, -1.0, 0.25]), (None, [3.0, 1.0, -2.0]), (4, None), (5, [None, 1.0, 1.0]), (6, [nan, 1.0, 1.0]),
            (7, [inf, 1.0, 1.0]), (8, [1e30, 0.0, 0.0]), (9, [1.0]), (10, [])]
    frame = lambda r: spark.createDataFrame([(*x, "c", 1) for x in r], "vec_id long, embedding array<double>, x string, component int")
    got = whitening.whiten(frame(rows)).collect()
    assert Counter(r.vec_id for r in got) == {1: 3, 2: 6, None: 3} and all(r.n == 3 for r in got)
    assert [r.whitened is None for r in sorted(got, key=lambda r: r.component)] == [False] * 8 + [True] * 4  # three points span a plane
    same = whitening.whiten(frame([(i, [1.0, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in same)
    huge = whitening.whiten(frame([(1, [4e12, 0.0]), (2, [-4e12, 1.0])])).collect()
    assert {r.deviation for r in huge} == {None}


def test_jacobi_davidson_on_hard_operators():
    rng = np.random.default_rng(2)
    spread = [np.r_[np.linspace(1, 1.001, 100)], np.r_[[5.0, 5.0, 5.0], np.linspace(0, 1, 60)], np.logspace(0, -12, 80), np.r_[np.zeros(30), [1.0]],
              np.linspace(1, 2, 300), np.ones(1), np.array([2.0, 1.0])]
    for values in spread:
        d, k = len(values), min(4, len(values))
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        a = (q * values) @ q.T
        axes, found = whitening.jacobi_davidson(lambda b: a @ b, d, k, float(values.sum()))
        assert np.abs(found - np.sort(values)[::-1][:k]).max() < 1e-12 * values.max()
        assert np.abs(a @ axes - axes * found).max() < 1e-12 * values.max() and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    a = (q * np.linspace(-3, 4, 20)) @ q.T
    rhs = rng.normal(size=(20, 3))
    rhs[:, 1] = 0
    x = whitening.minres(lambda b: a @ b, rhs, 60, 1e-12)
    assert np.abs(a @ x - rhs).max() < 1e-9


def test_exact_sums_beyond_doubles(spark):
    big = 2**52 - 1
    fit = spark.createDataFrame([([big - i, -big + i],) for i in range(3000)], "x array<long>")
    assert whitening.exact_sums(fit) == [sum(big - i for i in range(3000)), -sum(big - i for i in range(3000))]
