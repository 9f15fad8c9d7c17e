"""Secrets in texts: patterns, and a character network over every other candidate.

A candidate is a maximal run of ``CANDIDATE`` or more characters of ``[A-Za-z0-9+/_.-]`` with a digit. Those that overlap a
pattern's finding are labelled findings, the others are labelled clean. A convolutional network in numpy reads a candidate,
whatever its length, with ``CONTEXT`` bytes on either side, is trained on all of them, and is then calibrated on a held-out
fifth. Its threshold is the one of best precision among those that keep the recall of findings at ``RECALL``. Clean ones that
a network fitted to the other half takes for findings are left out of both parts, as labels in doubt. Candidates that no
pattern has found and that reach it become spans of kind ``secret``.

Training sees each candidate with its context and without, so that a string is also known by its own letters. It goes in
rounds: every shard of the candidates takes a pass over its own, from the same state, and the states are averaged by their
rows. Both classes weigh the same, however few the findings are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import body, chunks, stored

KINDS = ("assign", "access", "hex")

#: Least length of a candidate; bytes of context; share of the held-out findings that the threshold must keep.
CANDIDATE = 12
CONTEXT = 24
RECALL = 0.98
#: Candidates of a shard, about; shards whose states are averaged in one task.
SHARD = 4096
AVERAGED = 32
#: Steps of a logit that scores tell apart, and the greatest one.
STEPS, GREATEST = 256, 64

# Patterns of the contract.
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_VALUE = re.compile(rb"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
VALUE, ACCESS, HEX = 6, 20, 24

_TOKEN, _HEX, _SIGN, _DIGIT = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
for _bit, _members in (
    (_TOKEN, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-"),
    (_HEX, b"0123456789abcdef"),
    (_SIGN, b":="),
    (_DIGIT, b"0123456789"),
):
    _CLASS[list(_members)] |= _bit

Span = tuple[str, int, int]


def runs(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least ``least`` true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


def assigned(data: bytes, signs: list[int]) -> Iterator[tuple[int, int]]:
    """Matches of the assignment pattern, sought from their sign: as from the left, but linear in the text's length."""
    end = 0
    for sign in signs:
        at = sign
        while at > end and data[at - 1] == 0x20:
            at -= 1
        near = data[max(at - 9, 0) : at].lower()
        if near[-1:] in (b'"', b"'"):
            at, near = at - 1, near[:-1]
        word = next((w for w in _KEYWORDS if near.endswith(w)), None)
        if word is None or at - len(word) < end:
            continue
        value = _VALUE.match(data, sign + 1)
        if value:
            end = value.end()
            if value.end(1) - value.start(1) >= VALUE:
                yield at - len(word), end


def spans_of(data: bytes) -> tuple[list[Span], list[tuple[int, int]]]:
    """The patterns' spans, by start and then kind, and the candidates, in bytes. Texts are parted by line feeds."""
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    spans: list[Span] = [("assign", a, b) for a, b in assigned(data, np.flatnonzero(kinds & _SIGN).tolist())]
    spans += [("access", *m.span()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= ACCESS]
    spans += [("hex", a, b) for a, b in zip(*(x.tolist() for x in runs(kinds & _HEX > 0, HEX)), strict=True)]
    starts, ends = runs(kinds & _TOKEN > 0, CANDIDATE)
    digits = np.flatnonzero(kinds & _DIGIT)
    some = np.searchsorted(digits, ends) > np.searchsorted(digits, starts)
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans, list(zip(starts[some].tolist(), ends[some].tolist(), strict=True))


def symbols(data: bytes, start: int, end: int, first: int, last: int) -> bytes:
    """A candidate and its context inside the text from ``first`` to ``last``: ASCII codes, 127 for other bytes, and the
    upper bit for the candidate itself."""
    low, high = max(first, start - CONTEXT), min(last, end + CONTEXT)
    codes = np.minimum(np.frombuffer(data, np.uint8, high - low, low), 127)
    codes[start - low : end - low] |= 128
    return codes.tobytes()


FOUND = "array<struct<kind:string,start:int,end:int>>"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base (the patterns' spans in code points) and candidates (start, end, labelled, symbols) of every row."""
    rows = docs.select("doc_id", body().cast("binary").alias("text"))
    fields = "array<struct<start:int,end:int,labelled:boolean,symbols:binary>>"
    empty = [F.lit(None).cast(t).alias(name) for t, name in ((FOUND, "base"), (fields, "candidates"))]
    schema = rows.select("doc_id", *empty).schema
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    own = [("start", pa.int32()), ("end", pa.int32()), ("labelled", pa.bool_()), ("symbols", pa.binary())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=1 << 20):
            texts = batch.column(1).to_pylist()
            data = b"\n".join(texts)
            ends = np.cumsum([len(t) + 1 for t in texts]) - 1
            starts = ends - [len(t) for t in texts]
            spans, candidates = spans_of(data)
            base: list[list[dict]] = [[] for _ in texts]
            found: list[list[dict]] = [[] for _ in texts]
            row_of = np.searchsorted(starts, [s for _, s, _ in spans], "right") - 1
            # Code points before each byte: bytes that continue one do not count.
            before = np.cumsum(np.frombuffer(data, np.int8) >= -64, dtype=np.int32) if spans or candidates else np.zeros(0)
            upto = np.concatenate([[0], before])
            points = lambda row, place: int(upto[place] - upto[starts[row]])
            for row, (kind, a, b) in zip(row_of.tolist(), spans, strict=True):
                base[row].append({"kind": kind, "start": points(row, a), "end": points(row, b)})
            # Last end of the spans that begin before a place; the spans are in order of their starts.
            firsts = np.array([a for _, a, _ in spans], np.int64)
            lasts = np.maximum.accumulate(np.array([b for *_, b in spans], np.int64))
            row_of = np.searchsorted(starts, [a for a, _ in candidates], "right") - 1
            for row, (a, b) in zip(row_of.tolist(), candidates, strict=True):
                earlier = int(np.searchsorted(firsts, b))
                labelled = earlier > 0 and int(lasts[earlier - 1]) > a
                code = symbols(data, a, b, int(starts[row]), int(ends[row]))
                while b < min(ends[row], len(data)) and data[b] == 0x3D and not labelled:  # padding belongs to the string
                    b += 1
                place = {"start": points(row, a), "end": points(row, b)}
                found[row].append({**place, "labelled": labelled, "symbols": code})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, span_type), pa.array(found, pa.list_(pa.struct(own)))], schema.names
            )

    return rows.mapInArrow(find, schema)


WIDTH, FILTERS, HIDDEN = 5, 24, 16
#: Symbols that the network reads at once; fitting.
PART = 1 << 15
EPOCHS, BATCH, RATE = 8, 64, 0.004


@dataclass
class Network:
    """Filters over ``WIDTH`` symbols, the greatest answer of each anywhere, and two layers; then a calibrated logit."""

    filters: np.ndarray  # width x symbols x filters
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray  # the last entry is the bias
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int = 13) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.2, shape)
        return cls(draw(WIDTH, 256, FILTERS), np.zeros(FILTERS), draw(FILTERS, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN + 1))

    def answers(self, codes: np.ndarray) -> np.ndarray:
        """Each filter's answer at every place of padded symbols."""
        n = len(codes) - WIDTH + 1
        total = self.filters[0][codes[:n]] + self.bias
        for k in range(1, WIDTH):
            total += self.filters[k][codes[k : k + n]]
        return total

    def pooled(self, sequences: list[bytes]) -> np.ndarray:
        """The greatest answers over each whole sequence, read in parts that overlap by the filters' width."""
        out = np.full((len(sequences), FILTERS), -np.inf)
        parts: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def read() -> None:
            nonlocal size
            starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
            codes = np.concatenate(parts)
            answers = self.answers(np.append(codes, np.zeros(WIDTH - 1, codes.dtype)))
            for k, part in enumerate(parts):  # places whose filter would reach into the next part
                answers[starts[k] + len(part) - WIDTH + 1 : starts[k] + len(part)] = -np.inf
            np.maximum.at(out, owners, np.maximum.reduceat(answers, starts, axis=0))
            parts.clear(), owners.clear()
            size = 0

        for owner, sequence in enumerate(sequences):
            codes = padded(sequence)
            for start in range(0, len(codes) - WIDTH + 1, PART):
                parts.append(codes[start : start + PART + WIDTH - 1])
                owners.append(owner)
                size += len(parts[-1])
                if size > PART:
                    read()
        if parts:
            read()
        return out

    def logits(self, sequences: list[bytes]) -> np.ndarray:
        top = np.maximum(np.maximum(self.pooled(sequences), 0) @ self.hidden + self.hidden_bias, 0)
        return top @ self.out[:-1] + self.out[-1]

    def probabilities(self, sequences: list[bytes]) -> np.ndarray:
        if not sequences:
            return np.zeros(0)
        return self.calibrated(rounded(self.logits(sequences)))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60)))

    def gradients(self, sequences: list[bytes], labels: np.ndarray, weight: float = 1.0) -> list[np.ndarray]:
        """Of the mean log loss, in the order of ``weights``; a finding counts ``weight`` times."""
        coded = [padded(s) for s in sequences]
        starts = np.cumsum([0, *(len(c) for c in coded[:-1])])
        codes = np.concatenate([*coded, np.zeros(WIDTH - 1, np.uint8)])
        best = np.full((len(coded), FILTERS), -np.inf)
        place = np.empty((len(coded), FILTERS), np.int64)
        for first in range(0, len(codes) - WIDTH + 1, PART):  # no more than a part's answers at once
            answers = self.answers(codes[first : first + PART + WIDTH - 1])
            for k in range(int(np.searchsorted(starts, first, "right")) - 1, int(np.searchsorted(starts, first + PART))):
                low, high = max(starts[k], first), min(starts[k] + len(coded[k]) - WIDTH + 1, first + PART)
                if low >= high:
                    continue
                own = answers[low - first : high - first]
                at = own.argmax(axis=0)
                top = np.take_along_axis(own, at[None], axis=0)[0]
                more = top > best[k]
                best[k, more], place[k, more] = top[more], low + at[more]
        first = np.maximum(best, 0)
        second = np.maximum(first @ self.hidden + self.hidden_bias, 0)
        error = 1 / (1 + np.exp(-(second @ self.out[:-1] + self.out[-1]))) - labels
        error *= np.where(labels > 0, weight, 1.0)
        error /= np.where(labels > 0, weight, 1.0).sum()
        back = np.outer(error, self.out[:-1]) * (second > 0)
        below = back @ self.hidden.T * (best > 0)
        filters = np.zeros_like(self.filters)
        columns = np.broadcast_to(np.arange(FILTERS), place.shape)
        for k in range(WIDTH):
            np.add.at(filters[k], (codes[place + k], columns), below)
        return [filters, below.sum(axis=0), first.T @ back, back.sum(axis=0), np.append(second.T @ error, error.sum())]

    def weights(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out]


def rounded(z: np.ndarray) -> np.ndarray:
    """Logits as they are told apart: a bounded number of values, whose rows can all be counted."""
    return np.round(np.clip(z, -GREATEST, GREATEST) * STEPS) / STEPS


def padded(sequence: bytes) -> np.ndarray:
    edge = np.zeros(WIDTH // 2, np.uint8)
    return np.concatenate([edge, np.frombuffer(sequence, np.uint8), edge])


def alone(sequence: bytes) -> bytes:
    """The candidate with blanks for its context."""
    codes = np.frombuffer(sequence, np.uint8)
    return np.where(codes & 128, codes, 32).astype(np.uint8).tobytes()


class Learner:
    """A network and the moments of Adam, as one vector that can be averaged."""

    def __init__(self, seed: int = 13, state: np.ndarray | None = None):
        self.net = Network.new(seed)
        size = sum(w.size for w in self.net.weights())
        self.state = np.zeros(3 * size + 1) if state is None else np.array(state)  # weights, moments, steps
        views = []
        for k in range(3):
            at = k * size
            views.append([])
            for w in self.net.weights():
                views[k].append(self.state[at : at + w.size].reshape(w.shape))
                at += w.size
        if state is None:
            for own, w in zip(views[0], self.net.weights(), strict=True):
                own[:] = w
        net = self.net
        net.filters, net.bias, net.hidden, net.hidden_bias, net.out = views[0]
        self.first, self.second = views[1:]

    def learn(self, sequences: list[bytes], labels: np.ndarray, order: np.ndarray, weight: float = 1.0) -> None:
        """A pass of Adam over mini-batches in ``order``."""
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            self.state[-1] += 1
            slopes = self.net.gradients([sequences[i] for i in at], labels[at], weight)
            for w, m, v, g in zip(self.net.weights(), self.first, self.second, slopes, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                step = self.state[-1]
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def fit(sequences: list[bytes], labels: np.ndarray, seed: int = 13) -> Network:
    """The network of rows at hand, in a seeded order; every other epoch without context."""
    learner, rng = Learner(seed), np.random.default_rng(seed)
    bare = [alone(s) for s in sequences]
    for epoch in range(EPOCHS):
        learner.learn(bare if epoch % 2 else sequences, labels, rng.permutation(len(bare)))
    return learner.net


def settle(net: Network, z: np.ndarray, labels: np.ndarray, counts: np.ndarray, recall: float = RECALL) -> None:
    """Scale and shift of the logits by maximum likelihood with smoothed targets, and the threshold, from held-out rows:
    ``counts`` of them have the logit ``z`` and the label."""
    wanted, clean = int(counts[labels > 0].sum()), int(counts[labels == 0].sum())
    target = np.where(labels > 0, (wanted + 1) / (wanted + 2), 1 / (clean + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -60, 60)))
        slope, curve = x.T @ (counts * (p - target)), (x.T * (counts * p * (1 - p))) @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        ab -= np.clip(move, -2, 2)
    net.scale, net.shift = max(float(ab[0]), 1e-3), float(ab[1])
    p = net.calibrated(z)
    limits = np.unique(p[labels > 0])[::-1]
    kept, wrong = (
        np.array([counts[own & (p >= limit)].sum() for limit in limits]) for own in (labels > 0, labels == 0)
    )
    precision = np.where(kept >= max(1, int(np.ceil(recall * wanted))), kept / (kept + wrong), -1)
    # The most findings among equals in precision; half-way down to the next clean candidate.
    lowest = limits[np.flatnonzero(precision == precision.max())[-1]]
    under = p[(labels == 0) & (p < lowest)]
    net.threshold = float((lowest + under.max()) / 2) if len(under) else float(lowest)


def calibrate(net: Network, sequences: list[bytes], labels: np.ndarray, recall: float = RECALL) -> None:
    z, each = np.unique(np.stack([rounded(net.logits(sequences)), labels]), axis=1, return_counts=True)
    settle(net, z[0], z[1], each, recall)


def held_out(sequence: bytes) -> bool:
    return zlib.crc32(sequence) % 5 == 0


def half(sequence: bytes) -> int:
    return zlib.crc32(sequence) // 5 % 2


def fit_all(rows: DataFrame, seed: int = 13) -> dict[int, Network]:
    """A network for each ``net`` (number) of stored rows (net, symbols, labelled) that has both classes, fitted to all rows."""
    classes = {(r.net, r.labelled): r.n for r in rows.groupBy("net", "labelled").agg(F.count("*").alias("n")).collect()}
    nets = sorted(n for n, labelled in classes if labelled and (n, False) in classes)
    weights = {n: classes[n, False] / classes[n, True] for n in nets}
    states = {n: Learner(seed).state for n in nets}
    shards = max((classes[n, False] + classes[n, True] for n in nets), default=0) // SHARD + 1
    dealt = rows.where(F.col("net").isin(nets)).withColumn("shard", F.pmod(F.xxhash64("symbols"), F.lit(shards)))
    # By number: the rows are few bytes for their work, and would be gathered into one task by size.
    dealt = dealt.repartition(max(1, len(nets)) * shards, "net", "shard")
    schema = "net int, shard long, n long, state binary"
    context = rows.sparkSession.sparkContext
    for epoch in range(EPOCHS if nets else 0):
        shared = context.broadcast(states)

        def learn(table: pa.Table) -> pa.Table:
            table = table.sort_by("symbols")
            net, shard = table["net"][0].as_py(), table["shard"][0].as_py()
            learner = Learner(seed, shared.value[net])
            sequences = table["symbols"].to_pylist()
            order = np.random.default_rng([seed, shard, epoch]).permutation(len(sequences))
            labels = np.array(table["labelled"].to_pylist(), float)
            learner.learn([alone(s) for s in sequences] if epoch % 2 else sequences, labels, order, weights[net])
            values = [[net], [shard], [len(order)], [learner.state.tobytes()]]
            return pa.table(dict(zip(["net", "shard", "n", "state"], values, strict=True)), learned)

        def average(table: pa.Table) -> pa.Table:
            table = table.sort_by("shard")
            n = np.array(table["n"].to_pylist())
            state = sum(k * np.frombuffer(x) for k, x in zip(n, table["state"].to_pylist(), strict=True)) / n.sum()
            values = [[table["net"][0].as_py()], [table["shard"][0].as_py()], [int(n.sum())], [state.tobytes()]]
            return pa.table(dict(zip(["net", "shard", "n", "state"], values, strict=True)), learned)

        learned = pa.schema([("net", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("state", pa.binary())])
        taught = dealt.groupBy("net", "shard").applyInArrow(learn, schema)
        tables = taught.groupBy("net", F.expr(f"shard div {AVERAGED}").alias("part")).applyInArrow(lambda _, t: average(t), schema)
        found = sorted(tables.collect(), key=lambda r: (r.net, r.shard))
        for n in nets:
            own = [r for r in found if r.net == n]
            states[n] = sum(r.n * np.frombuffer(r.state) for r in own) / sum(r.n for r in own)
        shared.unpersist()
    return {n: Learner(seed, states[n]).net for n in nets}


def without_doubt(every: DataFrame) -> DataFrame:
    """Stored rows (symbols, labelled) less the clean ones that a network fitted to the other half takes for findings:
    secrets of shapes that no pattern knows would teach the network to pass them over."""
    halves = F.expr("cast(crc32(symbols) div 5 % 2 as int)")
    shared = every.sparkSession.sparkContext.broadcast(fit_all(every.withColumn("net", halves)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nets = shared.value
        for batch in chunks(batches):
            sequences, labels = (column.to_pylist() for column in batch.columns)
            sure = np.ones(len(labels), bool)
            for side, net in nets.items():
                at = [k for k, s in enumerate(sequences) if not labels[k] and half(s) != side]
                if at:
                    sure[at] = net.logits([sequences[k] for k in at]) <= 0
            yield batch.filter(pa.array(sure))

    return every.mapInArrow(keep, every.schema)


def train(found: DataFrame) -> Network | None:
    """The network of a stored ``detect``; none where findings or clean candidates are missing in either part.

    Candidates that are equal with their context count once.
    """
    every = found.select(F.explode("candidates").alias("c")).select("c.symbols", "c.labelled")
    every = stored(every.groupBy("symbols").agg(F.max("labelled").alias("labelled")), "labelled")
    apart = F.expr("crc32(symbols) % 5 = 0")
    sure = stored(without_doubt(every).withColumn("apart", apart), "sure")
    if sure.select("apart", "labelled").distinct().count() < 4:
        return None
    net = fit_all(sure.where(~F.col("apart")).select(F.lit(0).alias("net"), "symbols", "labelled"))[0]
    shared = found.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            z = rounded(shared.value.logits(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column(1)], ["z", "labelled"])

    scored = sure.where("apart").select("symbols", "labelled").mapInArrow(score, "z double, labelled boolean")
    # At most a row for each logit that is told apart and label.
    counted = scored.groupBy("z", "labelled").agg(F.count("*").alias("n")).toPandas().sort_values(["z", "labelled"])
    settle(net, counted["z"].to_numpy(), counted["labelled"].to_numpy(float), counted["n"].to_numpy())
    return net


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (the patterns' spans) and extra (the network's, kind ``secret``) of every row; null texts have none.

    Equal rows have equal spans. Without labelled findings in the table there is no network and nothing is added.
    """
    found = stored(detect(docs), "secrets")
    shared = docs.sparkSession.sparkContext.broadcast(train(found))
    schema = found.select("doc_id", "base", F.col("base").alias("extra")).schema
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in chunks(batches):
            extra: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            rows = [
                (k, c) for k, own in enumerate(batch.column(2).to_pylist()) for c in own or () if net and not c["labelled"]
            ]
            scores = net.probabilities([c["symbols"] for _, c in rows]) if rows else []
            for (k, c), p in zip(rows, scores, strict=True):
                if p >= net.threshold:
                    extra[k].append({"kind": "secret", "start": c["start"], "end": c["end"]})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(extra, span_type)], schema.names)

    return found.select("doc_id", "base", "candidates").mapInArrow(score, schema)


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of the patterns' spans by kind, base_sha256, spans (of the patterns and the network) and n_secret."""
    kinds = F.array(*map(F.lit, (*KINDS, "secret")))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind))
    keyed = F.transform(
        F.concat("base", "extra"),
        lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("nth"), s["kind"].alias("kind"), s["end"].alias("end")),
    )
    return scan(docs).select(
        "doc_id",
        *(number(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(keyed)).alias("spans"),
        F.size("extra").cast("long").alias("n_secret"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; overlapping spans become one, named after the
    first. Null texts stay null. Rows of equal id and text have equal spans."""
    rows = docs.select(F.struct("doc_id", "text").alias("doc_id"), "text")
    found = scan(rows).select(F.col("doc_id").alias("row"), F.concat("base", "extra").alias("spans"))
    schema = docs.select("doc_id", "text").schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = []
            for row, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, parts, at = row["text"], [], 0
                for s in sorted(spans, key=lambda s: (s["start"], (*KINDS, "secret").index(s["kind"]))):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind']}]"]
                    at = max(at, s["end"])
                texts.append(text if text is None else "".join(parts) + text[at:])
            ids = batch.column(0).field("doc_id")
            yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], schema.names)

    return found.mapInArrow(replace, schema)
