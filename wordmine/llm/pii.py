"""Personal data in whole texts: fixed patterns and a skip-chain random field.

The patterns find what has the full form of an address, an IP, a card or a phone
number.  The random field looks at every number expression and every word with
an @ (and words that are the name of an address found in the text): a node with
features of its form and its neighbours.  Nodes that stand close are joined by a
chain edge; equal ones (the same last digits, the same name) by a strong skip
edge; those of the same shape by a weak one, each to the one before it, so edges
grow with the nodes; and a node that equals a known one has a strong edge to the
nearest of them, however far away.  Nodes inside a pattern's match are known.  Loopy message
passing carries their labels to the rest of the document.

Node and edge weights are fitted here, on a sample of documents whose pattern
matches serve as labels, half of them hidden at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmine.llm.textbytes import runs, text_bytes

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents, about, that the field is fitted on, and nodes of each.
SAMPLE_TEXTS = 20_000
SAMPLE_NODES = 200
#: Marginal probability from which a node becomes a span.
SURE = 0.85

# Patterns.  Each is written so that no text makes it take more than linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+@")
_LOCAL_END = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_END:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind, then by start."""
    out = [(0, *x) for x in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# Nodes and edges

_NODE = re.compile(
    r"(?P<mail>(?<![^\s<(\"',;:])[^\s@<(\"',;:]++@[^\s@>)\"',;]*+)|\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+"
)
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9._%+-]{3,}")
_BUCKETS = 16
_N_FEATURES = 29 + 2 * _BUCKETS


def _bucket(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=2).digest(), "big") % _BUCKETS


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    before = text[max(0, start - 24) : start].split()
    after = text[end : end + 24].split()
    return (before[-1] if before else ""), (after[0] if after else "")


def _features(text: str, start: int, end: int) -> list[int]:
    value = text[start:end]
    digits = sum(c.isdigit() for c in value)
    dots, dashes = value.count("."), value.count("-")
    letters = any(c.isalpha() for c in value)
    at = value.find("@")
    before, after = text[start - 1 : start], text[end : end + 1]
    flags = [
        True,
        at >= 0,
        at > 0 and "." in value[at:],
        value[0] == "+",
        "(" in value,
        " " in value,
        dashes > 0,
        dashes > 1,
        letters,
        not letters and digits == len(value),
        before.isalnum() or before == "_",
        after.isalnum() or after == "_",
        before in ('"', "'", "="),
    ]
    sizes = [digits == 0, 0 < digits < 4, 3 < digits < 7, 6 < digits < 9, 8 < digits < 13, 12 < digits < 20, digits > 19]
    marks = [dots == 0, dots == 1, dots == 2, dots == 3, dots > 3]
    width = [len(value) < 6, 5 < len(value) < 12, 11 < len(value) < 20, len(value) > 19]
    on = [k for k, x in enumerate([*flags, *sizes, *marks, *width]) if x]
    left, right = _around(text, start, end)
    return [*on, 29 + _bucket(left), 29 + _BUCKETS + _bucket(right)]


def _keys(value: str) -> tuple[str, str]:
    """Key of equal nodes and key of nodes of one shape; empty: none."""
    digits = _NOT_DIGIT.sub("", value)
    if "@" in value or value[0].isalpha():
        name = value.split("@")[0].lower()
        return ("@" + name if len(name) > 3 else ""), ""
    if len(digits) < 7:
        return "", ""
    shape = re.sub("[0-9]", "9", value)
    return "#" + digits[-8:], shape if len(shape) > 8 else ""


def _same(kind: int, value: str, match: str) -> bool:
    """Whether ``value`` may be the data of a match, written in another way.

    A number of a card has the same digits; a phone number may lack what stands
    before the area, or have a zero there; a name is that of the address.
    """
    if kind == 0:
        return value.split("@")[0].lower() == match.split("@")[0].lower()
    one, other = (_NOT_DIGIT.sub("", x) for x in (value, match))
    if kind == 3:
        one, other = sorted((one.lstrip("0"), other.lstrip("0")), key=len)
        return len(one) >= 7 and other.endswith(one) and "@" not in value
    return one == other and "@" not in value


Graph = tuple[list[tuple[int, int]], list[list[int]], list[int], list[tuple[int, int, int]]]


def graph(text: str, base: list[Span], most: int | None = None) -> Graph:
    """Nodes (start, end), their features, known labels (0: none), edges (a, b, type)."""
    places = [(m.start(), m.end()) for m in _NODE.finditer(text)]
    names = {text[s:e].split("@")[0].lower() for k, s, e in base if k == 0}
    if names:
        said = [(m.start(), m.start() + len(m[0].rstrip("."))) for m in _WORD.finditer(text)]
        said = [(s, e) for s, e in said if text[s:e].lower() in names]
        mails = [(s, e) for s, e in places if "@" in text[s:e]]
        said = _outside(said, mails + [(s, e) for _, s, e in base])
        places = sorted(said + _outside(places, said))
    places = places[:most]
    known, at = [0] * len(places), 0
    ordered = sorted(base, key=lambda x: x[1])
    starts = [s for s, _ in places]
    for kind, start, end in ordered:
        at = int(np.searchsorted(starts, start, "right")) - 1
        at = max(at, 0)
        while at < len(places) and places[at][0] < end:
            if places[at][1] > start:
                known[at] = kind + 1
            at += 1

    def repeats(a: int, b: int) -> bool:
        if (known[a] > 0) == (known[b] > 0):
            return False
        node, match = (a, b) if known[b] else (b, a)
        return _same(known[match] - 1, *(text[slice(*places[x])] for x in (node, match)))

    edges, last, equal = [], {}, {}
    for k, (start, end) in enumerate(places):
        if k and start - places[k - 1][1] <= 24:
            edges.append((k - 1, k, 0))
        for kind, key in enumerate(_keys(text[start:end]), 1):
            if key:
                if (kind, key) in last:
                    edges.append((last[kind, key], k, 3 if kind == 1 and repeats(last[kind, key], k) else kind))
                last[kind, key] = k
                if kind == 1:
                    equal.setdefault(key, []).append(k)
    for group in equal.values():
        sure = [i for i, k in enumerate(group) if known[k]]
        for i, k in enumerate(group):
            if sure and not known[k]:
                at = int(np.searchsorted(sure, i))
                near = min(sure[max(0, at - 1) : at + 1], key=lambda x: abs(x - i))
                if abs(near - i) > 1:
                    edges.append((*sorted((group[near], k)), 3 if repeats(group[near], k) else 1))
    return places, [_features(text, s, e) for s, e in places], known, edges


def _outside(places: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places that overlap none of ``others``."""
    others = sorted(others)
    starts = [s for s, _ in others]
    # The matches of different kinds may overlap; so far reaches any that starts before.
    reach = np.maximum.accumulate([e for _, e in others]).tolist() if others else []
    free = []
    for s, e in places:
        at = int(np.searchsorted(starts, e)) - 1
        if at < 0 or reach[at] <= s:
            free.append((s, e))
    return free


# The field


class Field:
    """Node weights (features x labels) and one label matrix per edge type."""

    #: Rounds of messages while fitting, and change under which they are settled.
    ROUNDS = 6
    SETTLED = 1e-3

    def __init__(self):
        k = len(LABELS)
        self.node = np.zeros((_N_FEATURES, k))
        self.edge = self.prior()

    @staticmethod
    def prior() -> np.ndarray:
        """Edge weights before any data: equal nodes agree, those of one shape lean to,
        and a node that holds the data of a match has its label."""
        k = len(LABELS)
        same = np.eye(k)
        return np.stack([np.zeros((k, k)), 5.0 * same, 0.5 * same, 12.0 * same])

    def potentials(self, features: list[list[int]]) -> np.ndarray:
        if not features:
            return np.zeros((0, len(LABELS)))
        owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
        flat = np.fromiter((x for f in features for x in f), np.int64)
        out = np.zeros((len(features), len(LABELS)))
        np.add.at(out, owner, self.node[flat])
        return out

    def marginals(
        self, log_node: np.ndarray, edges: np.ndarray, settle: bool = False
    ) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of nodes and of edges after some rounds of damped messages.

        With ``settle`` rounds go on until no message changes, or until one could
        have passed every node.
        """
        n, k = log_node.shape
        if not len(edges):
            return _softmax(log_node), np.zeros((0, k, k))
        a, b, kind = edges.T
        w = self.edge[kind]
        to_b = np.zeros((len(edges), k))
        to_a = np.zeros((len(edges), k))
        for _ in range(self.ROUNDS + (4 * n + 50 if settle else 0)):
            total = log_node.copy()
            np.add.at(total, b, to_b)
            np.add.at(total, a, to_a)
            new_b = _log_sum((total[a] - to_a)[:, :, None] + w, 1)
            new_a = _log_sum((total[b] - to_b)[:, None, :] + w, 2)
            off_b = new_b - _log_sum(new_b, 1)[:, None] - to_b
            off_a = new_a - _log_sum(new_a, 1)[:, None] - to_a
            to_b += 0.5 * off_b
            to_a += 0.5 * off_a
            if settle and max(np.abs(off_b).max(), np.abs(off_a).max()) < self.SETTLED:
                break
        total = log_node.copy()
        np.add.at(total, b, to_b)
        np.add.at(total, a, to_a)
        pair = (total[a] - to_a)[:, :, None] + (total[b] - to_b)[:, None, :] + w
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        return _softmax(total), pair / pair.sum((1, 2), keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _softmax(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _clamped(log_node: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = log_node.copy()
    fixed = known > 0
    # More than all messages to a node can add up to.
    out[fixed] = -1e6
    out[fixed, known[fixed]] = 1e6
    return out


def fit_field(graphs: list[tuple[list[list[int]], list[int], list[tuple[int, int, int]]]], rounds: int = 120) -> Field:
    """Maximise the likelihood of the labels, with the beliefs of message passing.

    All documents are one graph of separate parts.  In each round about half of
    the labelled nodes are given, the rest are to be explained.  A node without
    a match that equals one with a match has no known label and explains nothing.
    """
    field = Field()
    features, known, edges = [], [], []
    for f, k, e in graphs:
        edges += [(a + len(features), b + len(features), t) for a, b, t in e]
        features += f
        known += k
    if not features:
        return field
    known, edges = np.array(known), np.array(edges, np.int64).reshape(-1, 3)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    flat = np.fromiter((x for f in features for x in f), np.int64)
    truth = np.eye(len(LABELS))[known]
    share = 1.0 / np.maximum(np.bincount(known, minlength=len(LABELS)), 1)
    weight = share[known] / share[known].sum() * len(known)
    a, b, kind = edges.T
    strong = (kind == 1) | (kind == 3)
    unsure = np.zeros(len(known), bool)
    for x, y in ((a[strong], b[strong]), (b[strong], a[strong])):
        unsure[x[(known[x] == 0) & (known[y] > 0)]] = True
    weight[unsure] = 0
    telling = ~(unsure[a] | unsure[b])
    rng = np.random.default_rng(3)
    size_n, size_e = np.zeros_like(field.node), np.zeros_like(field.edge)
    for _ in range(rounds):
        given = np.where(rng.random(len(known)) < 0.5, known, 0)
        log_node = _clamped(field.potentials(features), given)
        belief, pair = field.marginals(log_node, edges)
        off = (truth - belief) * weight[:, None] * (given == 0)[:, None]
        step = np.zeros_like(field.node)
        np.add.at(step, flat, off[owner])
        step = step / len(known) - 1e-4 * field.node
        size_n += step**2
        field.node += 0.5 * step / (np.sqrt(size_n) + 1e-8)
        if len(edges):
            seen = np.zeros_like(pair)
            seen[np.arange(len(edges)), known[a], known[b]] = 1
            step = np.zeros_like(field.edge)
            np.add.at(step, kind[telling], (seen - pair)[telling])
            step = (step + step.transpose(0, 2, 1)) / 2 / len(edges)
            step -= 1e-2 * (field.edge - field.prior())
            size_e += step**2
            field.edge += 0.1 * step / (np.sqrt(size_e) + 1e-8)
    return field


# Texts


def added_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans that the field adds to those of the patterns, text by text.

    Only a node that holds the data of a match of its kind in the same text, in
    whatever writing, becomes a span.
    """
    graphs = [graph(t, b) for t, b in zip(texts, bases, strict=True)]
    edges, first, features, known = [], [], [], []
    for places, f, k, e in graphs:
        first.append(len(features))
        edges += [(a + first[-1], b + first[-1], t) for a, b, t in e]
        features += f
        known += k
    if not features:
        return [[] for _ in texts]
    known, edges = np.array(known), np.array(edges, np.int64).reshape(-1, 3)
    belief, _ = field.marginals(_clamped(field.potentials(features), known), edges, settle=True)
    linked = np.zeros((len(features), len(LABELS)), bool)
    for a, b, _ in edges[edges[:, 2] == 3].tolist():
        linked[(a, known[b]) if known[b] else (b, known[a])] = True
    best = belief.argmax(1)
    sure = (belief[np.arange(len(best)), best] >= SURE) & (best > 0) & (known == 0)
    out = []
    for text, base, (places, *_), start in zip(texts, bases, graphs, first, strict=True):
        taken = sorted((s, e) for _, s, e in base)
        begins = [s for s, _ in taken]
        own = []
        for k in np.flatnonzero(sure[start : start + len(places)]).tolist():
            s, e = places[k]
            kind = int(best[start + k]) - 1
            at = int(np.searchsorted(begins, e)) - 1
            free = not any(y > s for _, y in taken[max(0, at - 4) : at + 1])
            if free and linked[start + k, kind + 1]:
                own.append((kind, s, e))
        out.append(own)
    return out


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _interesting(texts: pa.Array) -> np.ndarray:
    """Texts with a digit or an @; nothing can be found in others."""
    data, offsets = text_bytes(texts)
    seen = ((data >= 0x30) & (data <= 0x39)) | (data == 0x40)
    return np.diff(np.concatenate(([0], np.cumsum(seen)))[offsets]) > 0


def _found(texts: pa.Array, field: Field) -> tuple[np.ndarray, list[str], list[list[Span]], list[list[Span]]]:
    at = np.flatnonzero(_interesting(texts))
    own = texts.take(pa.array(at)).to_pylist()
    base = [base_spans(t) for t in own]
    return at, own, base, added_spans(own, base, field)


# On Spark


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS, most: int = SAMPLE_NODES) -> Field:
    """Fit the field on a sample of about ``texts`` documents, drawn by a hash.

    At most ``most`` nodes of a document are used, so what comes to the driver
    is bounded by the two parameters.
    """
    rows = max(1, docs.count())
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 30)) < texts / rows * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            at = np.flatnonzero(_interesting(column))
            kept = [graph(t, base_spans(t), most) for t in column.take(pa.array(at)).to_pylist()]
            kept = [g for g in kept if g[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[1] for g in kept], pa.list_(pa.list_(pa.int32()))),
                    pa.array([g[2] for g in kept], pa.list_(pa.int32())),
                    pa.array([[list(e) for e in g[3]] for g in kept], pa.list_(pa.list_(pa.int32()))),
                ],
                names=["f", "k", "e"],
            )

    schema = "f array<array<int>>, k array<int>, e array<array<int>>"
    got = drawn.select(F.col("text").cast("string")).mapInArrow(run, schema).collect()
    graphs = sorted((r["f"], r["k"], [tuple(x) for x in r["e"]]) for r in got)
    return fit_field(graphs)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id``, counts and digest of the pattern matches, and all ``spans``.

    One row per row of ``docs``; a null text counts as empty, and a text without
    matches has empty strings' digest and spans.  ``n_added`` counts what the
    field adds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for start, stop in runs(batch.column("text")):
                part = batch.slice(start, stop - start)
                n = len(part)
                counts = np.zeros((n, 5), np.int64)
                digests, spans = [nothing] * n, [""] * n
                at, _, base, more = _found(part.column("text"), field)
                for i, b, m in zip(at.tolist(), base, more, strict=True):
                    for kind, *_ in b:
                        counts[i, kind] += 1
                    counts[i, 4] = len(m)
                    digests[i] = hashlib.sha256(spans_text(b).encode()).hexdigest()
                    spans[i] = spans_text(b + m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        *[pa.array(counts[:, k]) for k in range(4)],
                        pa.array(digests, pa.string()),
                        pa.array(spans, pa.string()),
                        pa.array(counts[:, 4]),
                    ],
                    names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
                )

    numbers = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, {numbers}, base_sha256 string, spans string, n_added long"
    )


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind in angle brackets."""
    out, done = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= done:
            out += [text[done:s], f"<{KINDS[k]}>"]
            done = e
        elif e > done:  # the rest of a span that began inside another
            done = e
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """The documents, all columns, with personal data masked in ``text``."""
    names = list(docs.columns)
    at_text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in runs(batch.column(at_text)):
                part = batch.slice(start, stop - start)
                column = part.column(at_text)
                at, own, base, more = _found(column, field)
                changed = {
                    i: masked(t, b + m)
                    for i, t, b, m in zip(at.tolist(), own, base, more, strict=True)
                    if b or m
                }
                if changed:
                    values = column.to_pylist()
                    for i, t in changed.items():
                        values[i] = t
                    column = pa.array(values, pa.string())
                columns = [column if k == at_text else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"`{n}` {'string' if n == 'text' else k}" for n, k in docs.dtypes)
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, kinds)
