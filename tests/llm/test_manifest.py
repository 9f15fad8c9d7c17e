"""The Merkle manifest against a plain one that keeps whole trees."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import COLUMNS, corpus, rows_of, table
from themelens.llm import manifest


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row: tuple, text: str | None) -> str:
    doc_id, _, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain_tree(level: list[str]) -> list[list[str]]:
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels: list[list[str]], place: int) -> list[tuple[list[str], list[str]]]:
    path = []
    for level in levels[:-1]:
        first = place // 3 * 3
        path.append((level[first:place], level[place + 1 : first + 3]))
        place //= 3
    return path


def plain(rows: list[tuple]) -> Counter:
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), k) for k, r in enumerate(rows) if r[3] == s)
        trees[s] = [x[3] for x in own], plain_tree([x[2] for x in own])
    top = plain_tree([trees[s][1][-1][0] for s in sources])
    found: Counter = Counter()
    for place, s in enumerate(sources):
        members, levels = trees[s]
        for at, k in enumerate(members):
            path = plain_path(levels, at) + plain_path(top, place)
            doc_id, text = rows[k][:2]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = plain_leaf(rows[k], text)
            for left, right in path:
                folded = digest("".join([*left, folded, *right]))
            proof = digest("".join(x for left, right in path for x in left + right))
            found[doc_id, levels[0][at], levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]] += 1
    return found


def test_the_corpus_and_repeated_rows(spark):
    rows = corpus() + [(None, None, None, None, None), (900, "a\nb", "en", "", 3), (900, "c", "en", "", 3)]
    docs = table(spark, rows, extra=True)
    found = manifest.report(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert rows_of(found) == plain(rows)


def test_every_leaf_is_folded(spark, monkeypatch):
    whole = manifest.proved
    wrong = F.regexp_replace("proof", "^(.*?)[0-9a-f]{64}", f"$1{'0' * 64}")
    monkeypatch.setattr(manifest, "proved", lambda *args: whole(*args).withColumn("proof", wrong))
    rows = [(k, "no line feed", "en", "s", 12) for k in range(20)]
    found = manifest.report(table(spark, rows)).collect()
    assert len(found) == 20 and not any(r.verified for r in found)


@pytest.mark.parametrize("levels", [1, 2])
def test_runs_of_any_height_give_the_same(spark, levels):
    rng = random.Random(levels)
    rows = [(k, "x\n" * rng.randrange(3), "en", rng.choice(["hot"] * 30 + [f"s{k}" for k in range(9)]), k) for k in range(250)]
    assert rows_of(manifest.report(table(spark, rows), levels)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 27, 28, 80, 243])
def test_one_source_of_each_shape(spark, n):
    levels = plain_tree([digest(str(k)) for k in range(n)])
    assert manifest.sweep_up(levels[0], len(levels) - 1) == levels
    proofs = dict(manifest.sweep_down(levels, ""))
    assert sorted(proofs) == list(range(n))
    for place, proof in proofs.items():
        assert manifest.siblings(proof) == "".join(x for left, right in plain_path(levels, place) for x in left + right)
        assert manifest.fold(levels[0][place], proof) == levels[-1][0]


def test_an_empty_table_and_a_single_row(spark):
    assert manifest.report(spark.createDataFrame([], COLUMNS)).collect() == []
    rows = [(5, "one\ntwo", None, "s", 7)]
    assert rows_of(manifest.report(table(spark, rows))) == plain(rows)


def test_a_very_long_text(spark):
    rows = [(k, "long line\n" * 300_000, "en", "s", 3_000_000) for k in range(3)]
    assert rows_of(manifest.report(table(spark, rows))) == plain(rows)
