"""Cover density against brute force, and the positional index: buckets read, refreshes, and writers that meet."""

import random
import re

import pytest

from spindrift.functions.stemming import stem
from spindrift.functions.text import STOP_WORDS
from spindrift.operators import commits, postings


def brute(text, query, stemmed):
    """Score by trying every stretch of words."""
    form = stem if stemmed else (lambda w: w)
    terms = {form(w) for w in re.split("[^a-z0-9]+", query.lower()) if w and w not in STOP_WORDS}
    words = [None if w in STOP_WORDS else form(w) for w in re.split("[^a-z0-9]+", text.lower()) if w]
    full = {(i, j) for i in range(len(words)) for j in range(i, len(words)) if terms <= set(words[i:j + 1])}
    covers = [(i, j) for i, j in full if (i + 1, j) not in full and (i, j - 1) not in full]
    return sum(0.1 / (1 + sum(w not in terms for w in words[i:j + 1])) for i, j in covers) if terms and covers else None


def texts():
    rng = random.Random(8)
    words = ["ask", "asked", "orders", "order", "the", "of", "blue", "reds", "x1", "Ünï"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)]
    return [(i, t) for i, t in enumerate([*made, None, "", "...", "order", "Orders-asks, order? THE asking", "the of"])]


def got(df):
    return {r.key: pytest.approx(r.score) for r in df.collect()}


@pytest.mark.parametrize("stemmed", [True, False])
@pytest.mark.parametrize("query", ["order", "asked orders", "blue of order ask", "the", "", "nowhere order", "order orders ordering"])
def test_cover_density_is_brute_force(spark, query, stemmed):
    docs = spark.createDataFrame(texts(), "id long, body string")
    wanted = {i: s for i, t in texts() if t is not None and (s := brute(t, query, stemmed)) is not None}
    assert got(postings.ranked_texts(docs, "id", "body", query, stemmed)) == wanted


@pytest.fixture
def index(spark, tmp_path):
    made = postings.Index(spark, str(tmp_path), buckets=16)
    made.build(spark.createDataFrame(texts(), "id long, body string"), "id", "body")
    return made


def test_search_reads_its_terms_buckets_only(spark, index):
    docs = spark.createDataFrame(texts(), "id long, body string")
    found = index.search("asks ORDERS")
    assert got(found) == got(postings.ranked_texts(docs, "id", "body", "asks ORDERS"))
    plan = found._jdf.queryExecution().toString()
    at = index.buckets_of(["ask", "order"])
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(" + ",".join(map(str, at)), plan) and re.search(r"PushedFilters: \[In\(stem, \[(ask,order|order,ask)", plan)
    read = found.inputFiles()
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in index.postings_of(["ask"]).inputFiles()} >= set(index.buckets_of(["ask"])) and read


def test_refresh_equals_a_new_index(spark, index):
    later = dict(texts()) | {3: "orders asked asked", 4: None, 7: "", 100: "ask an order", 5: "nothing"}
    changed = [(i, later[i]) for i in (3, 4, 7, 100, 5)]
    assert index.refresh(spark.createDataFrame(changed, "id long, body string"), "id", "body") == 1
    wanted = {i: s for i, t in later.items() if t is not None and (s := brute(t, "ask order", True)) is not None}
    assert got(index.search("ask order")) == wanted and 100 in wanted
    index.refresh(spark.createDataFrame([(100, "gone"), (3, "order. order. ask")], "id long, body string"), "id", "body")
    wanted = {i: s for i, s in wanted.items() if i not in (100, 3)} | {3: brute("order. order. ask", "ask order", True)}
    assert got(index.search("ask order")) == wanted and got(index.search("of")) == {}


def test_second_writer_of_a_number_is_refused(spark, index, tmp_path):
    before = set(tmp_path.iterdir())
    with pytest.raises(commits.Conflict):
        index.build(spark.createDataFrame([(1, "x")], "id long, body string"), "id", "body")
    assert set(tmp_path.iterdir()) == before
    (tmp_path / "_commits" / "1").write_text("")  # a lost writer's
    assert list(index.generations()) == [0]
    assert index.refresh(spark.createDataFrame([(1, "ask order")], "id long, body string"), "id", "body") == 2
    assert list(index.generations()) == [0, 2]


def test_string_keys_and_no_index(spark, tmp_path):
    docs = spark.createDataFrame([("A-1", "ask"), (None, "ask")], "k string, t string")
    assert got(postings.ranked_texts(docs, "k", "t", "asking")) == {"A-1": 0.1}
    with pytest.raises(ValueError):
        postings.Index(spark, f"{tmp_path}/none").search("x")
