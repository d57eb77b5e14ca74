"""Personal data: base patterns, and a skip-chain conditional random field that completes them.

The base patterns find addresses, network addresses, card and phone numbers. The field then labels
all tokens that hold a digit or an ``@`` (nothing else can be one of the kinds). Its potentials are

* of a token: a log-linear score of hashed features (shape, lengths, neighbours); tokens in base
  spans are clamped to their kind;
* of neighbours in the chain: transition scores;
* of the skip chain: a score per label for equal labels between each token and the next one, at any
  distance, that repeats it (the same letters and digits, case and punctuation aside) or is similar:
  it has the same characters but for one, which both show when that one is left out.

All weights are fitted together on the base spans of a bounded sample of documents, by gradient
steps on the pseudo-likelihood: the probability of each token's label given its features and the
labels of its neighbours in both chains. A token that no pattern matches is known to be none of the
kinds unless it repeats one that is; such tokens are left out. In every second term the features
are left out, so that what the neighbours tell is learned although features tell as much.

Loopy message passing over all documents of an Arrow slice at once gives marginals, so that an
entity which is written elsewhere in a form that no pattern matches gets the same label. Added spans
never touch base spans, and base spans stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SAMPLE_ROWS = 2000  # bound of the training sample, documents
SAMPLE_TOKENS = 200  # and tokens of each
BINS = 1024
FEATURES = 6
PENALTY = 1e-3
STEPS = 150
SIMILAR_CHARS = 40  # longer tokens are only looked for as they are
CLAMP = 30.0
ROUNDS = 8
SLICE_CHARS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"[0-9.]+")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")
_SQUEEZE = re.compile(r"(.)\1+")
_CORE = re.compile(r"[^0-9a-z]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their ``@`` outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the network address pattern, part by part through runs of digits and dots."""
    out = []
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, starts, at = run[0].split("."), [], run.start()
        for part in parts:
            starts.append(at)
            at += len(part) + 1
        i = 0
        while i + 3 < len(parts):
            if all(parts[i : i + 4]):
                out.append((starts[i], starts[i + 3] + len(parts[i + 3])))
                i += 4
            else:
                i += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind and start."""
    if not _ANY.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for a, b in addresses(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[a:b].split(".")):
            out.append((1, a, b))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _bin(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BINS


def token_features(token: str, before: str) -> list[int]:
    """Hashed features: shape, its parts, number of digits, length, and what stands before."""
    core = token.strip("\"'()[]{}<>,;:!?.")
    shape = "".join("9" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in core[:64])
    squeezed = _SQUEEZE.sub(r"\1", shape)
    digits = shape.count("9")
    return [
        _bin("s" + squeezed), _bin(f"d{min(digits, 20)}"), _bin(f"l{min(len(core), 40)}"),
        _bin(f"@{core.count('@')}.{min(core.count('.'), 4)}-{min(core.count('-'), 4)}"),
        _bin("b" + before.lower()[-12:]), _bin("+" if core[:1] == "+" else "("[: token[:1] == "("]),
    ]


def similar_forms(core: str) -> list[str]:
    """What a token shares with those that differ from it in one character: itself with one left out."""
    if not 6 <= len(core) <= SIMILAR_CHARS:
        return []
    return [f"{i}:{core[:i]}{core[i + 1:]}" for i in range(len(core))]


def ruled_out(core: str) -> bool:
    """A whole network address or card number that failed its check is known to be none."""
    return bool(_IP.fullmatch(core) or len(core) >= 13 and _CARD.fullmatch(core))


class Graph:
    """The candidate tokens of several texts, with chain and skip edges."""

    def __init__(self) -> None:
        self.place: list[tuple[int, int, int]] = []  # text, start, end
        self.label: list[int] = []  # of the base span it is in, else 0; -1 when it can be none
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, at: int, text: str, base: list[tuple[int, int, int]]) -> None:
        spans = sorted((a, b, k + 1) for k, a, b in base)
        last_of: dict[str, int] = {}
        last_like: dict[str, int] = {}
        previous_end, i = -2, 0
        for m in _TOKEN.finditer(text):
            if not _ANY.search(m[0]):
                continue
            a, b = m.span()
            while i < len(spans) and spans[i][1] <= a:
                i += 1
            j, label = i, 0
            while j < len(spans) and spans[j][0] < b:
                if spans[j][1] > a:
                    label = spans[j][2]
                    break
                j += 1
            node = len(self.place)
            self.place.append((at, a, b))
            self.label.append(label if label or not ruled_out(m[0].strip("\"'()[]{}<>,;:!?.")) else -1)
            cut = max(0, a - 40)
            before = text[cut:a].rstrip(" \t\n\r\x0b\x0c").rpartition(" ")[2]
            self.features.append(token_features(m[0], before))
            if a == previous_end + 1:
                self.chain.append((node - 1, node))
            previous_end = b
            core = _CORE.sub("", m[0].lower())
            if len(core) >= 3:
                like = {last_of[core]} if core in last_of else set()
                if not like:  # a repetition is linked with what it repeats, and that with what is similar
                    forms = similar_forms(core)
                    like = {last_like[f] for f in forms if f in last_like}
                    for f in forms:
                        last_like[f] = node
                self.skip += [(other, node) for other in sorted(like)]
                last_of[core] = node


class Weights(NamedTuple):
    """``token`` (labels x feature bins and a bias), ``move`` (label to next label), ``same`` (per label)."""

    token: np.ndarray
    move: np.ndarray
    same: np.ndarray


def marginals(graph: Graph, weights: Weights) -> np.ndarray:
    """Label probabilities of each node by loopy belief propagation."""
    k = len(LABELS)
    unary = weights.token[:, np.array(graph.features)].sum(axis=2).T + weights.token[:, BINS]
    label = np.array(graph.label)
    fixed = np.flatnonzero(label)
    unary[fixed, np.maximum(label[fixed], 0)] += CLAMP
    edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    if not len(edges):
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    pair = np.zeros((len(edges), k, k))
    pair[: len(graph.chain)] = weights.move
    pair[len(graph.chain) :] = np.diag(weights.same)
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    both = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), k))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + both
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= SLICE_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _graph_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the features, labels and edges of their first SAMPLE_TOKENS candidates."""
    kinds = (pa.list_(pa.int64()),) * 4
    for batch in batches:
        for _, texts in _slices(batch.column(0)):
            rows = []
            for text in texts:
                graph = Graph()
                graph.add(0, text, base_spans(text))
                n = min(len(graph.place), SAMPLE_TOKENS)
                if n:
                    inside = [[i for e in edges if max(e) < n for i in e] for edges in (graph.chain, graph.skip)]
                    rows.append(([f for own in graph.features[:n] for f in own], [max(x, 0) for x in graph.label[:n]], *inside))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["features", "labels", "chain", "skip"])


def fit_weights(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = STEPS) -> Weights:
    """Weights with the greatest penalised pseudo-likelihood, by Adam steps from zero.

    ``features`` (n x FEATURES) are bins, ``chain`` and ``skip`` (m x 2) are edges between tokens.
    The score of a skip edge is one for all labels and a part of each label's own.
    """
    k, n = len(LABELS), len(labels)
    token, move, own, shared = np.zeros((k, BINS + 1)), np.zeros((k, k)), np.zeros(k), np.zeros(1)
    repeats = np.zeros(n, bool)
    for a, b in ((0, 1), (1, 0)):
        repeats[skip[labels[skip[:, b]] > 0, a]] = True
    known = ~(repeats & (labels == 0))
    if not known.any():
        return Weights(token, move, own)
    truth = np.eye(k)[labels] * known[:, None]
    # Rare labels weigh more, up to a point: most tokens are none of the kinds.
    share = np.bincount(labels[known], minlength=k) / known.sum()
    weight = (1 / np.maximum(share, 0.02))[labels] * known
    weight /= weight.sum()
    shown = np.random.default_rng(1).random((2, n, 1)) < 0.5
    neighbours = np.zeros((n, k))  # skip neighbours of each label
    np.add.at(neighbours, skip[:, 0], truth[skip[:, 1]])
    np.add.at(neighbours, skip[:, 1], truth[skip[:, 0]])
    before, after = np.zeros((n, k)), np.zeros((n, k))
    np.add.at(after, chain[:, 0], truth[chain[:, 1]])
    np.add.at(before, chain[:, 1], truth[chain[:, 0]])
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (token, move, own, shared)]
    for t in range(1, steps + 1):
        seen = shown[t % 2]
        score = token[:, features].sum(axis=2).T * seen + token[:, BINS] + before @ move + after @ move.T + neighbours * (own + shared)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        off = (p - truth) * weight[:, None]
        d_token = np.zeros((BINS + 1, k))
        for j in range(features.shape[1]):
            np.add.at(d_token, features[:, j], off * seen)
        d_token[BINS] = off.sum(axis=0)
        pull = (neighbours * off).sum(axis=0)
        gradients = (d_token.T, before.T @ off + (after.T @ off).T, pull, pull.sum(keepdims=True))
        for x, g, (m, v) in zip((token, move, own, shared), gradients, moments):
            g = g + PENALTY * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Weights(token, move, own + shared)


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Weights:
    """Weights from at most ``rows`` documents with digits or ``@``, and SAMPLE_TOKENS tokens of each.

    Documents are drawn by a hash of their id; of rows that repeat an id, one graph is taken.
    """
    draw = F.xxhash64("doc_id", F.lit(3))
    some = docs.where(F.col("text").rlike("[0-9@]"))
    drawn = some.select(draw.alias("draw")).distinct().orderBy("draw").limit(rows)
    texts = some.select("text", draw.alias("draw")).join(F.broadcast(drawn), "draw").groupBy("draw").agg(F.min("text").alias("text"))
    found = texts.select("text").mapInArrow(
        _graph_batches, "features array<long>, labels array<long>, chain array<long>, skip array<long>").collect()
    found = sorted(found, key=lambda r: (r["features"], r["labels"]))
    shift, chain, skip = 0, [], []
    for r in found:
        chain += [i + shift for i in r["chain"]]
        skip += [i + shift for i in r["skip"]]
        shift += len(r["labels"])
    edges = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
    features = np.array([f for r in found for f in r["features"]], np.int64).reshape(-1, FEATURES)
    return fit_weights(features, np.array([y for r in found for y in r["labels"]], np.int64), *edges)


def added_spans(graph: Graph, p: np.ndarray, texts: list[str], least: float) -> dict[int, list[tuple[int, int, int]]]:
    out: dict[int, list[tuple[int, int, int]]] = {}
    best = p.argmax(axis=1)
    for node in np.flatnonzero((best > 0) & (np.array(graph.label) == 0)):
        if p[node, best[node]] < least:
            continue
        at, a, b = graph.place[node]
        token = texts[at][a:b]
        core = token.strip("\"'()[]{}<>,;:!?.")
        a += token.find(core)
        out.setdefault(at, []).append((int(best[node]) - 1, a, a + len(core)))
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_batches(weights: Weights, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                graph, base = Graph(), []
                for i, text in enumerate(texts):
                    own = base_spans(text)
                    base.append(own)
                    if _ANY.search(text):
                        graph.add(i, text, own)
                more = added_spans(graph, marginals(graph, weights), texts, least) if graph.place else {}
                counts = [[sum(k == kind for k, _, _ in own) for own in base] for kind in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(texts)), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array([hashlib.sha256(_join(own).encode()).hexdigest() for own in base]),
                    pa.array([_join(own + more.get(i, [])) for i, own in enumerate(base)]),
                    pa.array([len(more.get(i, [])) for i in range(len(base))], pa.int64()),
                ], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return run


def find_personal_data(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """``doc_id n_email n_ip n_card n_phone base_sha256 spans n_added``, a row per row of ``docs``.

    The counts and the digest are those of the base spans; ``spans`` are all, written
    ``kind:start:end`` in code points by kind and start. Added are tokens whose label has a marginal
    of at least ``least``. Null text is empty and has none. Without any text to learn from the scores
    are even, and nothing is added.
    """
    weights = fit(docs)
    schema = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find_batches(weights, least), schema)
