"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers. The field
then labels every document's tokens that hold a digit or an at sign.
Neighbours share a chain potential; distant tokens that repeat one another
(the same characters, the same digits, or an address's name part) or look
alike (the same shape) share skip potentials. All tokens of such a group are
joined to one hidden label of the group, so any two are two steps apart, how
far they stand from one another, and a group of k tokens has k edges. Tokens
under a rule's match are fixed, and so is the label of a group of repeated
tokens whose found members are of one kind. Loopy message passing runs until
no message changes, and tokens that end up with a label at high probability
become further spans. Rules' spans stay.

The potentials are trained by pseudo-likelihood with the rules as labels, on
about ``sample`` documents chosen by a hash; a token that no rule found but
that repeats a found one trains nothing. A rule's match shows by its own
characters what it is, so from these rows alone the skip potentials would
learn nothing. So each match trains more rows with its label hidden: a repeat
in a plainer form that the rules miss, the same form where nothing it repeats
was found, which is then no mention, and, where others repeat a token, the
token without its own characters. Rare labels weigh more. Tasks turn these
documents into rows of features and labels and Spark counts equal rows, so no
text goes through the driver. Documents are labelled one by one in tasks,
without a shuffle.

Defined results: null and empty texts have no spans; rows are independent, so
repeated rows get equal spans; with no tokens to train on the rules alone
count; an empty table gives an empty result; other columns are kept, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import documents, mapped, text_of

KINDS = ("email", "ip", "card", "phone")
#: Documents that training looks at, about this many.
SAMPLE = 3000
#: Probability from which the field's label adds a span.
SURE = 0.95
#: Weight decay in training, of what a token shows and of what others say about it.
SHRINK = (1e-2, 1e-5)
#: Rounds of messages at most; they end once none changes by STILL.
ROUNDS = 300
STILL = 1e-4

# At signs, digit runs and plus signs are looked for first, which keeps long runs linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TELLING = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGITS = re.compile(r"[0-9]+")
EDGES = "\"'`.,;:!?()[]{}<>#$%&*|=_"

SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def luhn(digits: str) -> bool:
    ones = [int(d) for d in digits[::-1]]
    return (sum(ones[::2]) + sum(sum(divmod(2 * d, 10)) for d in ones[1::2])) % 10 == 0


def valid(kind: str, match: str) -> bool:
    digits = NOT_DIGIT.sub("", match)
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in match.split(".")))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """Every rule's matches, by kind and then start."""
    if not TELLING.search(text):
        return []
    found, end = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL_LETTERS:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append(("email", start, end))
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        if kind == "phone" and "+" not in text:
            continue
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


def plainer(kind: str, match: str) -> str:
    """A form of the match that no rule finds: no plus sign, other separators, or a domain cut off."""
    if kind == "email":
        name, _, domain = match.partition("@")
        return f"{name}@{domain.partition('.')[0]}"
    digits = NOT_DIGIT.sub("", match)
    return {"ip": match.replace(".", "-"), "card": ".".join(digits[i:i + 4] for i in range(0, len(digits), 4)), "phone": digits}[kind]


def shape(token: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", token))


def node_features(token: str) -> list[float]:
    digits = NOT_DIGIT.sub("", token)
    n = len(digits)
    plain = token.strip(EDGES)
    return [1.0, "@" in token, "@" in token and "." in token.rpartition("@")[2], token.count(".") == 3, token[0] == "+",
            token[0] == "(", "-" in token, bool(DIGITS.fullmatch(plain)), any(c.isalpha() for c in token), n <= 2, n == 3, 4 <= n <= 6,
            7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, 13 <= n <= 19 and luhn(digits),
            bool(IP.fullmatch(plain)) and valid("ip", plain), len(token) > 20]


class Field:
    """One document's tokens, edges and the labels that rules fix."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        self.at = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
        tokens = [text[a:b] for a, b in self.at]
        self.labels = np.zeros(len(tokens), int)
        self.fixed = np.zeros(len(tokens), bool)
        starts = np.array([a for a, _ in self.at] or [0])
        for kind, a, b in spans:
            k = max(0, int(np.searchsorted(starts, a, "right")) - 1)
            while k < len(tokens) and self.at[k][0] < b:
                if self.at[k][1] > a:
                    self.labels[k], self.fixed[k] = KINDS.index(kind) + 1, True
                k += 1
        self.shown = np.array([node_features(t) for t in tokens], float).reshape(len(tokens), -1)
        self.repeats = [(KINDS.index(kind) + 1, node_features(plainer(kind, text[a:b]))) for kind, a, b in spans]
        self.chain = [(i - 1, i) for i in range(1, len(tokens)) if not text[self.at[i - 1][1]:self.at[i][0]].strip(" ")]
        groups: dict[tuple[str, str], list[int]] = {}
        equal: dict[str, list[int]] = {}
        seen: set[str] = set()
        for i, token in enumerate(tokens):
            core, digits = token.strip(EDGES).lower(), NOT_DIGIT.sub("", token)
            if not self.fixed[i] and len(core) >= 4:
                equal.setdefault(core, []).append(i)
            keys = {("same", core)} if len(core) >= 4 else set()
            if keys and core not in seen:  # equal tokens are tied already
                keys.add(("alike", shape(core)))
            seen.add(core)
            if "@" in core:
                keys.add(("same", core.partition("@")[0]))
            if len(digits) >= 7:
                keys |= {("same", digits), ("same", digits[-7:])}
            for key in keys:
                groups.setdefault(key, []).append(i)
        self.features = self.shown.copy()  # equal tokens show one and the same thing, so each has its share of it
        for members in equal.values():
            self.features[members] /= len(members)
        distinct = {(kind, tuple(m)) for (kind, _), m in groups.items() if len(m) > 1}
        self.groups = [(kind, np.array(m)) for kind, m in sorted(distinct)]

    def training_rows(self) -> np.ndarray:
        """Features, neighbours' labels and label of each token that a rule tells something about, and of matches with hidden labels."""
        k = len(KINDS) + 1
        one = np.eye(k)[self.labels]
        back, fore = np.zeros((len(one), k)), np.zeros((len(one), k))
        for a, b in self.chain:
            back[b], fore[a] = one[a], one[b]
        said = {"same": np.zeros((len(one), k)), "alike": np.zeros((len(one), k))}
        known = np.ones(len(one), bool)
        for kind, members in self.groups:
            others = one[members].sum(0) - one[members]
            said[kind][members] += np.eye(k)[others.argmax(1)]
            if kind == "same" and self.fixed[members].any():
                known[members[~self.fixed[members]]] = False
        rows = np.concatenate([self.shown, back, fore, np.minimum(said["same"], 3), np.minimum(said["alike"], 3), self.labels[:, None]], 1)
        bare = rows[known & said["same"].any(1)]
        bare[:, 1:self.features.shape[1] + 2 * k] = 0
        none = np.zeros(k)
        repeats = np.array([[*features, *none, *none, *same, *none, y] for label, features in self.repeats
                            for same, y in ((np.eye(k)[label], label), (np.eye(k)[0], 0), (none, 0))])
        return np.concatenate([rows[known], bare, repeats.reshape(-1, rows.shape[1])]).astype(np.int8)


def halved(table: np.ndarray) -> np.ndarray:
    """The table from a token to its group's label, of which two in a row are the given table from token to token.

    Summed over the group's label, two steps multiply the tables' exponentials, so it is a matrix square root.
    Its diagonal is then evened out, so that tokens nobody knows cannot talk one another into a label.
    """
    values, vectors = np.linalg.eigh(np.exp(table - table.max()))
    root = np.log(np.maximum((vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T, 1e-6))
    own = np.diag(root) / 2
    return root - own - own[:, None]


class SkipChainModel:
    """Node weights and one potential table for each kind of edge, all in logarithms."""

    def __init__(self, n_features: int):
        k = len(KINDS) + 1
        self.nodes = np.zeros((n_features, k))
        self.learnt = np.ones(k, bool)  # labels that training met; the field gives no other
        self.tables = {e: np.zeros((k, k)) for e in ("chain", "same", "alike")}

    def fit(self, rows: np.ndarray, counts: np.ndarray, steps: int = 300, rate: float = 0.1, shrink: tuple[float, float] = SHRINK) -> None:
        """Pseudo-likelihood: each token given its features and its neighbours' labels; counts are the rows' numbers.

        A label weighs by the root of its count, so that rare ones are learnt too.
        """
        k = len(KINDS) + 1
        x, y = rows[:, :-1].astype(float), np.eye(k)[rows[:, -1].astype(int)]
        share = counts / np.sqrt(np.maximum(counts @ y, 1))[rows[:, -1].astype(int)]
        share = (share / share.sum())[:, None]
        n = x.shape[1] - 4 * k
        w, m, v = np.zeros((x.shape[1], k)), 0.0, 0.0
        decay = np.repeat(shrink, [n, 4 * k])[:, None]
        for t in range(1, steps + 1):
            p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (share * (p - y)) + decay * w
            back, fore, same, alike = g[n:].reshape(4, k, k)  # an edge has one table, whichever of its ends is asked
            g[n:] = np.concatenate([back + fore.T, fore + back.T, same + same.T, alike + alike.T]) / 2
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.nodes, self.learnt = w[:n], y.any(0)
        back, _, same, alike = w[n:].reshape(4, k, k)
        self.tables = {"chain": back, "same": halved(same), "alike": halved(alike)}

    def marginals(self, field: Field, rounds: int = ROUNDS) -> np.ndarray:
        """Each token's label probabilities by loopy belief propagation over tokens and groups."""
        n, k = len(field.at), len(KINDS) + 1
        base = field.features @ self.nodes
        base = np.concatenate([base, np.zeros((len(field.groups), k))])
        base[:, ~self.learnt] = -1e3
        fixed = np.flatnonzero(field.fixed)
        base[fixed] = -1e3
        base[fixed, field.labels[fixed]] = 0.0
        for g, (kind, members) in enumerate(field.groups):
            found = set(field.labels[members[field.fixed[members]]])
            if kind == "same" and len(found) == 1:
                base[n + g] = -1e3
                base[n + g, found.pop()] = 0.0
        parts = [(np.array(field.chain, int).reshape(-1, 2), self.tables["chain"])]
        for g, (kind, members) in enumerate(field.groups):
            parts.append((np.stack([members, np.full(len(members), n + g)], 1), self.tables[kind]))
        ends = np.concatenate([e for e, _ in parts])
        belief = base
        if len(ends):
            tables = np.repeat(np.array([t for _, t in parts]), [len(e) for e, _ in parts], 0)
            source, target = np.r_[ends[:, 0], ends[:, 1]], np.r_[ends[:, 1], ends[:, 0]]
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            order = np.argsort(target, kind="stable")
            at, starts = np.unique(target[order], return_index=True)
            said = np.zeros((len(source), k))
            for _ in range(rounds):
                z = (belief[source] - np.roll(said, len(ends), 0))[:, :, None] + tables
                top = z.max(1, keepdims=True)
                new = np.log(np.exp(z - top).sum(1)) + top[:, 0]
                new = 0.5 * said + 0.5 * (new - new.max(1, keepdims=True))
                moved = np.abs(new - said).max()
                said, belief = new, base.copy()
                belief[at] += np.add.reduceat(said[order], starts)
                if moved < STILL:
                    break
        belief = belief[:n]
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def more_spans(self, text: str, spans: list[tuple[str, int, int]], sure: float = SURE) -> list[tuple[str, int, int]]:
        """Spans of tokens that no rule found and the field is sure of."""
        if not TELLING.search(text):
            return []
        field = Field(text, spans)
        if field.fixed.all():  # nothing to label
            return []
        p = self.marginals(field)
        added = []
        for i in np.flatnonzero(~field.fixed & (p[:, 1:].max(1) >= sure)):
            a, b = field.at[i]
            core = text[a:b].strip(EDGES)
            start = a + text[a:b].index(core)
            if core:
                added.append((KINDS[int(p[i, 1:].argmax())], start, start + len(core)))
        return added


def fit(docs: DataFrame, sample: int = SAMPLE) -> SkipChainModel | None:
    count = docs.count()
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 33)
    chosen = docs.filter(mark < F.lit(int(2**31 * min(1.0, sample / max(1, count))))).filter(F.col("text").rlike("[0-9@]"))

    def rows_of(batches):
        for batch in batches:
            fields = [Field(t, rule_spans(t)) for t in batch.column(0).to_pylist()]
            rows = [f.training_rows() for f in fields if f.at]
            found, n = np.unique(np.concatenate(rows), axis=0, return_counts=True) if rows else (np.empty((0, 1), np.int8), np.empty(0, int))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), pa.array(n, pa.int64())], ["row", "n"])

    # rows of small numbers, of which equal ones are counted
    rows = chosen.select("text").mapInArrow(rows_of, "row binary, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    table = np.array([np.frombuffer(r.row, np.int8) for r in sorted(rows)])
    model = SkipChainModel(table.shape[1] - 1 - 4 * (len(KINDS) + 1))
    model.fit(table, np.array([r.n for r in sorted(rows)], float))
    return model


def find(docs: DataFrame, model: SkipChainModel | None) -> DataFrame:
    """docs, without text, with base (the rules' spans) and spans (those and the field's), by kind and start."""
    order = {k: i for i, k in enumerate(KINDS)}

    def as_rows(spans):
        return [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batch):
        base, spans = [], []
        for text in batch.column(0).to_pylist():
            ruled = rule_spans(text)
            base.append(as_rows(ruled))
            more = model.more_spans(text, ruled) if model else []
            spans.append(as_rows(sorted({*ruled, *more}, key=lambda s: (order[s[0]], *s[1:]))) if more else base[-1])
        return [pa.array(base, SPAN_TYPE), pa.array(spans, SPAN_TYPE)]

    return mapped(docs, {"text": text_of()}, run, f"base {SPANS}, spans {SPANS}", without=["text"])


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find(docs, fit(docs))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
