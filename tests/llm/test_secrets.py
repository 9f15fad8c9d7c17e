"""Secret scans: patterns against plain expressions, the network against direct sums and held-out findings."""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.samples import COLUMNS, corpus, table
from themelens.llm import secrets

PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                spans.append((kind, *m.span()))
    return sorted(spans, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_patterns_match_as_from_the_left():
    rng = random.Random(1)
    pieces = ["password", "PassWd", "Token", "secret", "api_key", "APIkey", "=", ":", " ", "  ", '"', "'", "abcdef", "12", "-", "."]
    pieces += ["AKIA", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "f" * 23, "g", "ü", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        spans, _ = secrets.spans_of(text.encode())
        own = [(k, len(text.encode()[:a].decode()), len(text.encode()[:b].decode())) for k, a, b in spans]
        # Quotes and spaces may stand before a line's end only.
        assert own == plain_spans(text), text


def mixed(rng: random.Random, n: int) -> str:
    return "".join(rng.choices(string.ascii_letters + string.digits, k=n))


def labelled_rows() -> list[tuple]:
    rng = random.Random(2)
    rows = []
    for k in range(400):
        filler = " ".join("".join(rng.choices("aeiounrst", k=rng.randint(2, 9))) for _ in range(40))
        clean = [f"mail{k}.example.com", f"10.{k}.12.255", f"{rng.randrange(10**15, 10**16)}", f"www.site{k}.org/page-{k}"]
        secret = [f'password="{mixed(rng, 20)}"', f"token: {mixed(rng, 32)}", "AKIA" + mixed(rng, 16).upper(), f"{rng.getrandbits(128):032x}"]
        rows.append((1000 + k, f"{filler} {rng.choice(clean)} é {filler[:50]} {rng.choice(secret)} {filler}", "en", "s", 0))
    return rows


def test_report(spark):
    rng = random.Random(4)
    plain = [f"a1{mixed(rng, 38)}" for _ in range(20)]
    loose = [(3000 + k, f"Ünder the door lies {s} for you", "en", "s", 0) for k, s in enumerate(plain)]
    rows = corpus() + labelled_rows() + loose
    rows += [(4000, "token=" + "a1" * 1_500_000, "en", "s", 0), (4001, "x" * 3_000_000 + " 0123456789abcdef0123456789abcdef", "en", "s", 0)]
    found = secrets.report(table(spark, rows, extra=True)).collect()
    assert len(found) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    kinds = [*PATTERNS, "secret"]
    caught = 0
    for r in found:
        base = plain_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for kind, *_ in base) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (s[1], kinds.index(s[0]))) and set(base) <= set(spans)
        extra = [s for s in spans if s[0] == "secret"]
        assert len(extra) == r.n_secret == len(spans) - len(base)
        if r.doc_id is not None and 3000 <= r.doc_id < 3020:
            caught += [texts[r.doc_id][a:b] for _, a, b in extra] == [plain[r.doc_id - 3000]]
        elif r.doc_id is not None and 1000 <= r.doc_id < 1400:
            assert not extra, texts[r.doc_id]
    assert caught >= 16


def test_held_out_findings_are_recalled():
    rng = random.Random(6)
    data = [f"some words before {mixed(rng, rng.randint(16, 40))} and after".encode() for _ in range(500)]
    data += [f"some words before {rng.choice(['mail', 'host', 'www'])}{k}.example.com and after".encode() for k in range(500)]
    sequences = []
    for text in data:
        (span,) = secrets.spans_of(text)[1] or [(18, len(text) - 10)]
        sequences.append(secrets.symbols(text, *span, 0, len(text)))
    labels = np.repeat([1.0, 0.0], 500)
    apart = np.array([secrets.held_out(s) for s in sequences])
    net = secrets.fit([s for s, out in zip(sequences, apart, strict=True) if not out], labels[~apart])
    held = [s for s, out in zip(sequences, apart, strict=True) if out]
    secrets.calibrate(net, held, labels[apart])
    p = net.probabilities(held)
    assert (p[labels[apart] > 0] >= net.threshold).mean() >= secrets.RECALL
    assert (p[labels[apart] == 0] < net.threshold).mean() >= 0.98
    assert abs(p.mean() - labels[apart].mean()) < 0.05


def test_the_threshold_keeps_the_recall_where_classes_overlap():
    net = secrets.Network.new()
    rng = np.random.default_rng(0)
    labels = (rng.random(4000) < 0.3).astype(float)
    z = rng.normal(labels * 1.5, 1)
    net.logits = lambda sequences: z  # scores alone are of interest
    secrets.calibrate(net, [b""] * 4000, labels)
    p = net.probabilities([b""] * 4000)
    assert (p[labels > 0] >= net.threshold).mean() >= secrets.RECALL
    for low in (0.1, 0.3, 0.5):
        own = (p >= low) & (p < low + 0.2)
        assert abs(p[own].mean() - labels[own].mean()) < 0.05


def test_gradients_and_parts(monkeypatch):
    rng = random.Random(8)
    sequences = [bytes(rng.choices(range(256), k=n)) for n in (1, 4, 5, 30, 700)]
    net = secrets.Network.new(1)
    labels = np.array([1.0, 0, 1, 0, 1])

    def loss() -> float:
        z = net.logits(sequences)
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    for weights, slope in zip(net.weights(), net.gradients(sequences, labels), strict=True):
        for at in [np.unravel_index(i, weights.shape) for i in np.argsort(-np.abs(slope), axis=None)[:4]]:
            weights[at] += 1e-5
            up = loss()
            weights[at] -= 2e-5
            down = loss()
            weights[at] += 1e-5
            assert abs((up - down) / 2e-5 - slope[at]) < 1e-5
    whole = net.logits(sequences)
    monkeypatch.setattr(secrets, "PART", 7)
    assert np.allclose(net.logits(sequences), whole)
    assert np.allclose([net.logits([s])[0] for s in sequences], whole)


def test_all_candidates_train_in_any_number_of_shards(spark, monkeypatch):
    """Findings of any length count: here all are longer than 512 bytes."""
    rng = random.Random(9)
    texts = [(mixed(rng, 560), True) for _ in range(300)] + [(f"mail{k}.example.com", False) for k in range(900)]
    rows = [((np.frombuffer(text.encode(), np.uint8) | 128).tobytes(), labelled) for text, labelled in texts]
    every = spark.createDataFrame(rows, "symbols binary, labelled boolean")
    found = every.select(F.array(F.struct("labelled", "symbols")).alias("candidates"))
    labels = np.array([labelled for _, labelled in rows])
    for shard in (secrets.SHARD, 400):
        monkeypatch.setattr(secrets, "SHARD", shard)
        net = secrets.train(found.unionByName(found))
        p = net.probabilities([s for s, _ in rows])
        assert (p[labels] >= net.threshold).mean() >= 0.97 and (p[~labels] < net.threshold).mean() >= 0.97


def test_nothing_to_learn_from_adds_nothing(spark):
    assert secrets.report(spark.createDataFrame([], COLUMNS)).collect() == []
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "token=abcdef12345678", "en", "s", 0)]
    found = {r.doc_id: r for r in secrets.report(table(spark, rows)).collect()}
    assert [found[k].spans for k in (1, 2, 3)] == ["", "", "assign:0:20"]


def test_redact(spark):
    rows = labelled_rows()[:5] + [(1, "an api_key='s3cr3t+value' here", "en", "s", 0), (2, None, "en", "s", 0)]
    clean = {r.doc_id: r.text for r in secrets.redact(table(spark, rows, extra=True)).collect()}
    assert clean[1] == "an [assign]' here" and clean[2] is None
    assert all(not plain_spans(t or "") for t in clean.values())


@pytest.mark.parametrize("text", ["", "é" * 30, "a1" * 6, "é" + "a1" * 6 + "==é"])
def test_symbols_mark_the_candidate(text):
    data = text.encode()
    for a, b in secrets.spans_of(data)[1]:
        codes = np.frombuffer(secrets.symbols(data, a, b, 0, len(data)), np.uint8)
        assert bytes(codes[codes >= 128] & 127) == data[a:b]
