"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

Patterns give base spans of four kinds, which always stay. The field labels the
tokens of a document that hold a digit or an @ (no other token can be an
entity): linear-chain potentials join neighbours, and skip edges join distant
tokens that repeat each other or are similar (the same trailing seven digits, or
an address and its local part). Tokens inside base spans are observed; loopy
message passing carries their labels along the edges, so an entity keeps its
label wherever it recurs in the document. Tokens whose belief in a kind is high
enough add spans.

The weights are trained in numpy by pseudo-likelihood on a bounded sample of
documents, with the base spans as labels and a prior that favours equal labels
on skip edges. As patterns label no bare mention (a number without its prefix,
split or written with other signs, an address without its host), the sample's
entities are mentioned once more behind their documents in such forms, with
their labels, next to numbers of the same form that repeat nothing and are none:
so the field learns that it is the repetition that tells.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, byte_blocks, kept

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is no entity
#: Documents that the fit reads.
FIT_DOCS = 4000
#: Belief from which a token adds a span; sweeps of message passing.
SURE, SWEEPS = 0.8, 12
#: Prior mean of the skip potential between equal labels, and strengths of the priors.
AGREE, PRIOR, PAIR_PRIOR = 4.5, 1e-3, 1e-2

# The patterns of the base spans. A match is looked for where it can start only.
_EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, leftmost and non-overlapping within a kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_TAIL.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if octets(m[0]):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


_TOKEN = re.compile(r"(?<!\S)(?=[^\s0-9@]*[0-9@])\S+")
_EDGE = "\"'`.,;:!?()[]{}<>|*#$%&"
FEATURES = 34


def features(t: str, before: bool, after: bool) -> list[int]:
    """The active features of a token; before, after: whether the next token on that side is one too."""
    digits = _NOT_DIGIT.sub("", t)
    n, core = len(digits), t.strip(_EDGE)
    on = [0, 1 + min(7, (n > 0) + (n > 2) + (n > 4) + (n > 6) + (n > 8) + (n > 12) + (n > 19))]
    on.append(9 + min(core.count("."), 4))
    on.append(14 + min(core.count("-"), 3))
    on += [k for k, yes in (
        (18, "@" in t), (19, "@" in t and "." in t.rpartition("@")[2]), (20, t[0] == "+"), (21, "(" in t or ")" in t),
        (22, any(c.isalpha() for c in t)), (23, 13 <= n <= 19 and luhn(digits)), (24, core.count(".") == 3 and _IP.fullmatch(core) is not None and octets(core)),
        (25, before), (26, after), (27, len(t) > 20), (28, len(t) > 40), (29, "=" in t or '"' in t), (30, n == len(core)), (31, n == 3), (32, n == 7), (33, t[0] == "+" and n <= 3),
    ) if yes]
    return on


def skip_keys(t: str) -> list[str]:
    """What a token must share with another one to be joined to it."""
    core, digits = t.strip(_EDGE).lower(), _NOT_DIGIT.sub("", t)
    keys = [f"={core}"] if len(core) >= 5 else []
    if 7 <= len(digits) and len(digits) >= 0.6 * len(core):
        keys.append(f"#{digits[-7:]}")
    local = core.partition("@")[0]
    if len(local) >= 4:
        keys.append(f"@{local}")
    return keys


class Graph:
    """The tokens and edges of a batch of documents."""

    def __init__(self):
        self.doc, self.span, self.on, self.label, self.chain, self.skip = [], [], [], [], [], []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        if not found:
            return
        first = len(self.doc)
        near = [i > 0 and not text[found[i - 1][1] : found[i][0]].strip() for i in range(len(found))]
        base = sorted((s, e, k) for k, s, e in base)
        at, last = 0, {}
        for i, (s, e) in enumerate(found):
            while at < len(base) and base[at][1] <= s and all(b[1] <= s for b in base[at : at + 4]):
                at += 1
            label = next((k + 1 for bs, be, k in base[at : at + 8] if bs < e and be > s), 0)
            self.doc.append(doc)
            self.span.append((s, e))
            self.label.append(label)
            self.on.append(features(text[s:e], near[i], i + 1 < len(found) and near[i + 1]))
            if near[i]:
                self.chain.append((first + i - 1, first + i))
            # equal tokens form a chain of occurrences, not all their pairs
            for key in skip_keys(text[s:e]):
                if key in last and last[key] != first + i:
                    self.skip.append((last[key], first + i))
                last[key] = first + i

    def unary(self, W: np.ndarray) -> np.ndarray:
        lens = np.array([len(x) for x in self.on])
        flat = np.fromiter((k for x in self.on for k in x), np.int64, int(lens.sum()))
        return np.add.reduceat(W[flat], np.cumsum(lens) - lens, axis=0)


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Marginals by damped loopy sum-product; edges (n, 2), pair (n, LABELS, LABELS) log potentials."""
    u = unary - unary.max(axis=1, keepdims=True)
    if len(edges):
        m = np.zeros((2, len(edges), LABELS))  # to the second end, to the first end
        for _ in range(sweeps):
            total = u.copy()
            np.add.at(total, edges[:, 1], m[0])
            np.add.at(total, edges[:, 0], m[1])
            a, b = total[edges[:, 0]] - m[1], total[edges[:, 1]] - m[0]
            to_b = np.logaddexp.reduce(a[:, :, None] + pair, axis=1)
            to_a = np.logaddexp.reduce(b[:, None, :] + pair, axis=2)
            new = np.stack([to_b, to_a])
            new -= new.max(axis=2, keepdims=True)
            m = 0.5 * m + 0.5 * new
        u = u.copy()
        np.add.at(u, edges[:, 1], m[0])
        np.add.at(u, edges[:, 0], m[1])
    p = np.exp(u - u.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(on: list[list[int]], label: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of tokens, chain and skip edges by penalised pseudo-likelihood."""
    W, A, S = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), AGREE * np.eye(LABELS)
    S0 = S.copy()
    n = len(on)
    if n:
        lens = np.array([len(x) for x in on])
        flat, who = np.fromiter((k for x in on for k in x), np.int64, int(lens.sum())), np.repeat(np.arange(n), lens)
        starts, want = np.cumsum(lens) - lens, np.eye(LABELS)[label]
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (W, A, S)]
        for t in range(1, steps + 1):
            z = np.add.reduceat(W[flat], starts, axis=0)
            for edges, P in ((chain, A), (skip, S)):
                if len(edges):
                    np.add.at(z, edges[:, 0], P[:, label[edges[:, 1]]].T)
                    np.add.at(z, edges[:, 1], P[label[edges[:, 0]]])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = p / p.sum(axis=1, keepdims=True) - want
            gW = np.zeros_like(W)
            np.add.at(gW, flat, d[who])
            grads = [gW / n + PRIOR * W]
            for edges, P, P0 in ((chain, A, 0), (skip, S, S0)):
                g = np.zeros_like(P)
                if len(edges):
                    np.add.at(g.T, label[edges[:, 1]], d[edges[:, 0]])
                    np.add.at(g, label[edges[:, 0]], d[edges[:, 1]])
                grads.append(g / n + PAIR_PRIOR * (P - P0))
            for x, g, (m, v) in zip((W, A, S), grads, state, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return W, A, S


def mention(kind: int, entity: str, form: int) -> str:
    """An entity as it may be named again, in a form that no pattern matches."""
    digits = _NOT_DIGIT.sub("", entity)
    if kind == 0:
        return entity.partition("@")[0] + ("@", "@intranet")[form % 2]
    if kind == 1:
        return entity.replace(".", "-_"[form % 2])
    if kind == 2:
        return ("." if form % 2 else "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return (f"{digits[-7:-4]}-{digits[-4:]}", f"({digits[-10:-7]}){digits[-7:]}", digits[-7:])[form % 3]


def with_mentions(text: str, base: list[tuple[int, int, int]], form: int) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The text with each entity mentioned again behind it, the spans of these mentions, and those of as many decoys.

    A decoy has the form of a mention and other digits or letters.
    """
    true, false, parts, at = [], [], [text], len(text)
    for n, (kind, s, e) in enumerate(base):
        entity = text[s:e]
        other = "".join(chr(ord("0") + (int(c) * 7 + n + 3) % 10) if c.isdigit() and c.isascii() else c for c in entity) if kind else f"desk{(form * 31 + n * 7) % 9973}x{entity[entity.find('@'):]}"
        for spans, what in ((true, entity), (false, other)):
            word = mention(kind, what, form + n)
            if len(word) >= 5 and not any(word in x for x in parts) and not base_spans(f" {word} "):
                parts += [" then ", word]
                spans.append((kind, at + 6, at + 6 + len(word)))
                at += 6 + len(word)
    return "".join(parts), true, false


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_DOCS) -> bytes:
    """The field's weights, as bytes, from about ``rows`` documents (twice that at most) chosen by a hash of the id."""
    spark = docs.sparkSession
    arrow_rows(spark)
    some = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    total = some.count()
    share = int(min(1.0, rows / max(total, 1)) * (1 << 30))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                g, base = Graph(), base_spans(text)
                longer, mentions, _ = with_mentions(text, base, h % 997)
                g.add(0, longer, base + mentions)
                out.append(pickle.dumps((g.on, g.label, g.chain, g.skip)))
            yield pa.record_batch([b.column("h"), pa.array(out, pa.binary())], names=["h", "graph"])

    chosen = some.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share).mapInArrow(tokens, "h long, graph binary").limit(2 * rows)
    on, label, chain, skip = [], [], [], []
    for r in sorted(chosen.collect(), key=lambda r: (r["h"], bytes(r["graph"]))):
        o, la, c, s = pickle.loads(bytes(r["graph"]))
        k = len(on)
        on += o
        label += la
        chain += [(a + k, b + k) for a, b in c]
        skip += [(a + k, b + k) for a, b in s]
    as_edges = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return pickle.dumps(train(on, np.array(label, np.int64), as_edges(chain), as_edges(skip)))


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], weights: tuple) -> list[list[tuple[int, int, int]]]:
    """Spans that the field adds to each text's base spans."""
    W, A, S = weights
    g = Graph()
    for d, (t, b) in enumerate(zip(texts, bases, strict=True)):
        g.add(d, t, b)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not g.doc:
        return out
    label = np.array(g.label)
    unary = g.unary(W)
    seen = np.flatnonzero(label)
    unary[seen] = -50.0
    unary[seen, label[seen]] = 0.0
    edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
    pair = np.concatenate([np.broadcast_to(A, (len(g.chain), LABELS, LABELS)), np.broadcast_to(S, (len(g.skip), LABELS, LABELS))])
    p = beliefs(unary, edges, pair)
    kind = p.argmax(axis=1)
    new = (label == 0) & (kind > 0) & (p.max(axis=1) >= SURE)
    before = {b for a, b in g.chain if new[a] and new[b] and kind[a] == kind[b]}
    for i in np.flatnonzero(new):
        d, (s, e) = g.doc[i], g.span[i]
        last = out[d][-1] if out[d] else None
        joint = texts[d][last[1] : e] if last else ""
        if i in before and last and texts[d][s:e] not in texts[d][last[1] : last[2]] and len(_NOT_DIGIT.sub("", joint)) <= 19:  # neighbours of one kind are parts of one entity
            out[d][-1] = (last[0], last[1], e)
        else:
            out[d].append((int(kind[i]) - 1, s, e))
    for d, spans in enumerate(out):
        trimmed = []
        for k, s, e in spans:
            while e > s and texts[d][e - 1] in _EDGE:
                e -= 1
            while s < e and texts[d][s] in _EDGE and not (texts[d][s] == "(" and ")" in texts[d][s:e]):
                s += 1
            if e > s:
                trimmed.append((k, s, e))
        out[d] = trimmed
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, model: bytes, text_col: str = "text", columns: list[str | Column] = ()) -> DataFrame:
    """n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) and n_added, after ``columns``.

    Offsets count code points, ends are exclusive. A null or empty text has no
    spans; whole texts of any length are read; an empty table gives an empty
    table; other columns pass through.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    keep = kept(docs, columns, [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])
    base = docs.select(*keep)
    counts = {f"n_{k}": F.lit(0).cast("long") for k in KINDS}
    schema = base.withColumns(counts | {"base_sha256": F.lit(""), "spans": F.lit(""), "n_added": F.lit(0).cast("long")}).schema
    shared, names = spark.sparkContext.broadcast(model), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = pickle.loads(shared.value)
        nothing = hashlib.sha256(b"").hexdigest()
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            some = [i for i, t in enumerate(texts) if t]
            bases, added = [base_spans(texts[i]) for i in some], []
            ends = np.cumsum([0, *[len(texts[i]) for i in some]])
            for lo, hi in byte_blocks(ends):  # the graph of so much text is held at a time
                added += added_spans([texts[i] for i in some[lo:hi]], bases[lo:hi], weights)
            n = np.zeros((len(KINDS) + 1, len(texts)), np.int64)
            sha, spans = [nothing] * len(texts), [""] * len(texts)
            for i, old, more in zip(some, bases, added, strict=True):
                for k, _, _ in old:
                    n[k, i] += 1
                n[-1, i] = len(more)
                sha[i] = hashlib.sha256(joined(old).encode()).hexdigest()
                spans[i] = joined(old + more)
            yield pa.record_batch([*b.columns[:-1], *[pa.array(n[k]) for k in range(len(KINDS))], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(n[-1])], names=names)

    # texts without digit and @ have no token that could be an entity
    return docs.select(*keep, F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col)).alias("__text")).mapInArrow(run, schema)
