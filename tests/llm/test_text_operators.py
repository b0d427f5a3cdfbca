"""PII, fingerprints, byte-pair encoding, toxicity and line dedup against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import bpe, line_dedup, pii, queries, sketches, toxicity

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_rules_equal_plain_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice("a1..@@-+ 9() 0") for _ in range(rng.randint(0, 40)))
        plain = [(k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, text) if k == "email" or pii.valid(k, m[0])]
        assert pii.rule_spans(text) == plain


def test_rules_take_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+" * 100_000, "a@" * 100_000):
        pii.rule_spans(text)


def field_model(texts):
    rows = np.concatenate([pii.Field(t, pii.rule_spans(t)).training_rows() for t in texts])
    model = pii.SkipChainModel(rows.shape[1] - 21)
    model.fit(rows, np.ones(len(rows)))
    return model


CARD = "4111111111111111"
TEXTS = [f"pay {CARD} now and a{i} more, {CARD} again" for i in range(40)] + [
    f"call +1 555 010 {1000 + i} or room {i} then +1 555 010 {1000 + i} for 3{i} days" for i in range(40)]


def test_field_carries_labels_over_the_document():
    model = field_model(TEXTS)
    text = f"first {CARD} then both {CARD} {CARD} end"  # two in a row are no match of the rule
    ruled = pii.rule_spans(text)
    assert ruled == [("card", 6, 22)]
    p = model.marginals(pii.Field(text, ruled))
    assert p.shape == (3, 5) and abs(p.sum(1) - 1).max() < 1e-9 and p[1, 3] > 0.5 and p[2, 3] > 0.5


def test_field_reaches_far_mentions():
    """The first of 80 mentions is a rule's match, the others run together in pairs, which is none."""
    text = f"first {CARD} " + "".join(f"then {CARD} {CARD} and so on " for _ in range(40))
    ruled = pii.rule_spans(text)
    more = field_model(TEXTS).more_spans(text, ruled)
    assert len(ruled) == 1 and len(more) == 80 and {k for k, _, _ in more} == {"card"}


def test_messages_give_exact_marginals_on_a_tree():
    """One chain and one group: no loop, so the marginals are those of all labellings."""
    rng = np.random.default_rng(1)
    field = pii.Field("call 5551234 5 or 5551234 now", [])
    model = pii.SkipChainModel(field.features.shape[1])
    model.nodes = rng.normal(size=model.nodes.shape)
    model.tables = {k: (t + t.T) / 2 for k, t in ((k, rng.normal(size=(5, 5))) for k in ("chain", "same", "alike"))}
    field.groups = field.groups[-1:]
    base, wanted = field.features @ model.nodes, np.zeros((3, 5))
    for labels in itertools.product(range(5), repeat=4):  # three tokens and the group
        kind, members = field.groups[0]
        score = sum(base[i, labels[i]] for i in range(3)) + sum(model.tables["chain"][labels[a], labels[b]] for a, b in field.chain)
        score += sum(model.tables[kind][labels[i], labels[3]] for i in members)
        for i in range(3):
            wanted[i, labels[i]] += np.exp(score)
    assert abs(model.marginals(field) - wanted / wanted.sum(1, keepdims=True)).max() < 1e-3


def test_pii_query(spark, sf, docs):
    rows = {r.doc_id: r for r in queries.QUERIES["op1_pii"](spark, sf).collect()}
    for d in docs.collect():
        plain = [(k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, d.text or "") if k == "email" or pii.valid(k, m[0])]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain)
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in plain) for k in RULES)


def test_pii_query_finds_plainer_repeats(spark, tmp_path):
    """Texts that repeat a found mention in a form without a rule, and texts with such a form that repeats nothing."""
    rng = random.Random(5)
    found, decoys, rows = {}, set(), []
    for d in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        text, ruled = d.text or "", pii.rule_spans(d.text or "")
        if ruled and d.doc_id % 2:
            kind, a, b = rng.choice(ruled)
            if d.doc_id % 4 == 1:
                form = pii.plainer(kind, text[a:b])
            else:  # digits and names of nobody here
                form = pii.plainer(kind, re.sub("[a-z0-9]", lambda m: rng.choice("123456789" if m[0].isdigit() else "qxzj"), text[a:b]))
            text = f"{text} zz {form}"
            if len(pii.rule_spans(text)) == len(ruled) and d.doc_id % 4 == 1:
                found[d.doc_id] = f"{kind}:{len(text) - len(form)}:{len(text)}"
            elif len(pii.rule_spans(text)) == len(ruled):
                decoys.add(d.doc_id)
        rows.append((d.doc_id, text))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r.doc_id: r.spans.split(",") for r in queries.QUERIES["op1_pii"](spark, str(tmp_path)).collect()}
    texts = dict(rows)
    assert len(found) > 50 and sum(s in spans[i] for i, s in found.items()) >= 0.95 * len(found)
    assert len(decoys) > 50 and sum(len(spans[i]) > len(pii.rule_spans(texts[i])) for i in decoys) <= 0.05 * len(decoys)


def test_group_tables_pass_on_the_trained_potential():
    even = np.array([[2.0, -1.0, -1.0], [-1.0, 2.0, -1.0], [-1.0, -1.0, 2.0]])
    two = np.exp(pii.halved(even))
    two = np.log(two @ two)
    assert abs(two - two[0, 0] - (even - even[0, 0])).max() < 1e-9
    assert abs(np.diag(pii.halved(np.array([[3.0, -1.0], [-1.0, 2.0]])))).max() < 1e-9


def test_unknown_tokens_cannot_make_themselves_known():
    model = field_model(TEXTS)
    assert model.more_spans("take 4111111111111112 and 4111111111111112 or 4111111111111112", []) == []


def test_pii_of_odd_rows(spark, odd, none):
    found = {(r.doc_id): r for r in pii.find(odd, pii.fit(odd)).collect()}
    assert [tuple(s) for s in found[13].base] == [("email", 11, 33), ("ip", 37, 45)]
    assert found[0].base == [] and found[None].spans == []
    assert pii.find(none, pii.fit(none)).count() == 0


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_fingerprints(spark, sf, docs):
    texts = [r.text or "" for r in docs.orderBy("doc_id").collect()]
    rows = queries.QUERIES["op2_fingerprints"](spark, sf).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for i, r in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        m = len(text) // 4
        edited = text[:len(text) - m] + after[:m]
        a, b, c = map(shingles, (text, edited, after))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (len(r.fingerprint), len(r.edited_fingerprint)) == (16 * min(128, len(a)), 16 * min(128, len(b)))
        assert abs(r.near_edited - len(a & b) / max(1, len(a | b))) < 0.2 and abs(r.near_next - len(a & c) / max(1, len(a | c))) < 0.2


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    rows = [(" ".join(words[:2000]), " ".join(words[1000:]), " ".join(words))]
    s = lambda c: sketches.sketch(F.col(c))
    r = spark.createDataFrame(rows, "a string, b string, c string").select(s("a").alias("a"), s("b").alias("b"), s("c").alias("c")).select(
        sketches.resemblance(F.col("a"), F.col("b")).alias("j"), sketches.containment(F.col("a"), F.col("c")).alias("in"),
        sketches.distinct_count(F.col("c")).alias("n"), (sketches.read(sketches.written(F.col("a"))) == F.col("a")).alias("back"),
        sketches.resemblance(sketches.merge(F.col("a"), F.col("b")), F.col("c")).alias("m")).first()
    assert abs(r.j - 1 / 3) < 0.15 and r["in"] > 0.8 and abs(r.n / 2996 - 1) < 0.3 and r.back and r.m > 0.95


def test_order_by_further_parts(spark, docs):
    """With few cuts ranges are dealt by steps of doc_id; the next rows stay the same."""
    rows = sketches.in_order(docs, rows_a_range=10, most_cuts=3)
    got = rows.withColumn("next", F.lead("text", 1, "").over(sketches.next_row())).filter("_copy = 0").collect()
    texts = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    wanted = {i: texts[(k + 1) % len(texts)][1] for k, (i, _) in enumerate(texts)}
    assert len({tuple(r._range) for r in got}) > 5 and {r.doc_id: r.next for r in got} == wanted


def test_fingerprints_of_odd_rows(odd, none):
    rows = sketches.fingerprints(odd).collect()
    assert len(rows) == odd.count() and all(r.sketch == [] for r in rows if r.doc_id in (0, 1, 2, 3))
    assert len({tuple(r.sketch) for r in rows if r.doc_id in (6, 14, 15)}) == 1
    assert sketches.fingerprints(none).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library(docs, library):
    coder, rng = bpe.ForcedBoundaryBPE(bpe.default_vocabulary()), random.Random(1)
    letters = "abcXYZ Σςσ  \t\n\x1c\x85\xa0é́ñ'st'll9٣½​　日本İıﬁÅ#@!<|endoftext|>ẞ😀\x00"
    texts = [r.text for r in docs.limit(40).collect()] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for text in [*texts, "", "a<|endoftext|>b<|startoftext|>", "a" * 20_000, "don't WE'LL"]:
        wanted = library.encode(text, add_special_tokens=False)
        ids = coder.encode(text)
        assert list(memoryview(ids).cast("I")) == wanted.ids
        assert coder.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)


def test_cuts_lie_between_pairs_of_no_token():
    coder = bpe.ForcedBoundaryBPE(bpe.default_vocabulary())
    word = "~q~qthe"
    parts = coder.fragments(word)
    assert "".join(parts) == word and len(parts) > 1
    assert all(a[-1] + b[0] not in coder.joined for a, b in zip(parts, parts[1:]))


def test_encoding_of_odd_rows(odd, none, library):
    coded = bpe.encode(odd, decode=True)
    for r in bpe.decode(coded.drop("decoded")).join(coded.select("doc_id", F.col("decoded").alias("d"), "ids"), "doc_id").collect():
        assert r.d == r.decoded
    assert {r.doc_id: r.n_tokens for r in bpe.digests(coded).collect()}[0] == 0
    assert bpe.encode(none).count() == 0


def brute_lines(rows, min_docs=3, min_chars=20):
    blank = " \t\n\x0b\x0c\r"
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(blank))
    at = collections.defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= min_chars:
                at[key(line)].add(i)
    gone = lambda i, s: len(key(s)) >= min_chars and len(at[key(s)]) >= min_docs and max(at[key(s)]) != i
    return {(i, text): [s for s in text.split("\n") if not gone(i, s)] for i, text in rows}


@pytest.mark.parametrize("partitions", ["1", "4", "37"])
def test_line_dedup(spark, docs, odd, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        common = docs.select("doc_id", F.concat_ws("\n", F.lit("One line that every document has in it"), "text").alias("text"))
        for table in (docs.select("doc_id", "text"), common):
            rows = [(r.doc_id, r.text or "") for r in table.collect()]
            wanted = brute_lines(rows)
            for r in line_dedup.drop_lines(table.withColumn("t", F.col("text"))).collect():
                kept = wanted[r.doc_id, r.t or ""]
                assert (r._kept, r._n_lines, r._n_dropped) == ("\n".join(kept), (r.t or "").count("\n") + 1, (r.t or "").count("\n") + 1 - len(kept))
        got = {r.doc_id: r for r in line_dedup.drop_lines(odd).collect()}
        assert (got[10]._kept, got[11]._kept, got[12]._n_dropped, got[0]._n_lines, got[0]._null) == ("second", "third", 0, 1, True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_dedup_of_nothing(none):
    assert line_dedup.drop_lines(none).count() == 0


def test_bitmaps_round_trip():
    import zlib

    import numpy as np
    keep = np.array([1, 0, 1, 1, 1, 1, 1, 1], np.uint8)
    assert line_dedup.unpack(zlib.compress(np.packbits(keep).tobytes()), 11).tolist() == [True, False] + [True] * 9


def test_dictionaries_hold_text_alone_at_every_size():
    """The trainer's header, entropy tables and padding are no text of a dictionary."""
    few = [b" worthless idiot scum ", b" loser moron clown ", b" stupid trash idiot "]
    for samples in (few, few * 7, few * 3000):
        text = toxicity.trained(samples, 4096, k=50, d=8)
        assert b"\0" not in text and b"idiot" in text and set(text.split()) & {b"worthless", b"loser", b"stupid"}
    assert toxicity.trained([], 4096) == b""


def test_windows_of_learnt_words_compress_better():
    """Independent of the operator's own features: zstandard's lengths with either dictionary, window by window."""
    rng = random.Random(2)
    plain = ["".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    bad = ["worthless", "disgusting", "pathetic", "idiotic"]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(60)]
        for at in rng.sample(range(60), 6 if toxic else 0):
            words[at] = rng.choice(bad)
        return " ".join(words)

    model = toxicity.train([text(True) for _ in range(60)], [text(False) for _ in range(200)])
    ordinary, toxic = model.compressors()
    over, level = [], []
    for _ in range(50):
        words = [rng.choice(plain) for _ in range(10)]
        level.append(len(ordinary(" ".join(words).encode())) - len(toxic(" ".join(words).encode())))
        words[3], words[7] = rng.sample(bad, 2)
        over.append(len(ordinary(" ".join(words).encode())) - len(toxic(" ".join(words).encode())))
    assert min(over) > max(level)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op8_toxicity"](spark, folder).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    toxic, plain = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in plain) / len(toxic) / len(plain) > 0.7


def test_toxicity_query_equals_plain_scores(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    tools = model.compressors()
    rows = {r.doc_id: r for r in queries.QUERIES["op8_toxicity"](spark, sf).collect()}
    for d in docs.collect():
        r = rows[d.doc_id]
        assert abs(r.score - model.score(d.text or "", tools)) < 1e-12 and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.fit(docs, flipped).weights == model.weights).all()


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(16)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(none, labels).count() == 0


def test_bpe_equals_the_library_on_every_code_point():
    """Assigned or not: all up to U+31FFF, past which few are assigned, and a share of the rest."""
    from tokenizers import Tokenizer

    library, coder = Tokenizer.from_file(bpe.default_vocabulary()), bpe.ForcedBoundaryBPE(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    points = [c for c in [*range(0x32000), *range(0x32000, 0x110000, 211)] if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 500):
        text = " ".join(f"a{chr(c)}B {chr(c)}" for c in points[at:at + 500])
        wanted = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == b"".join(i.to_bytes(4, "little") for i in wanted), hex(points[at])
