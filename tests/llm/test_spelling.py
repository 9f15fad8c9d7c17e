"""Spelling variants against edit distances of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.samples import COLUMNS, corpus, rows_of, table
from themelens.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_counts(rows: list[tuple]) -> dict[str, int]:
    total: Counter = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def plain_forms(counts: dict[str, int]) -> Counter:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    found: Counter = Counter()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        found[w, form[w], root, counts[w], len(near[w]), counts.get(form[w])] += 1
    return found


def texts() -> list[tuple]:
    rng = random.Random(12)
    words = ["Strasse", "straße", "ÀÉÎõüñ", "anagram", "nagaram", "aaaaaa", "aaaaaaa", "aaaaaaaa", "banana", "ananas", "short"]
    words += ["".join(rng.choices("abcdé", k=rng.randint(5, 8))) for _ in range(120)]
    words += ["".join(rng.sample("abcdefg", 7)) for _ in range(150)]
    text = " ".join(w for w in words for _ in range(rng.choice([1, 4, 5, 6, 30, 40, 200, 1000])))
    text += " qwertzu" * 4 + " qwertzi" * 30 + " qwerti" * 200
    long = "x" * 50_000
    rows = [(k, f"{text[k::1]}\n{long} {long[1:]}", "en", "s", 0) for k in range(3)]
    return rows + [(None, f"{long} {long[:-1]} Ｗide", "en", "s", 0)] + corpus()


@pytest.mark.parametrize("shard", [2, 30, 2000])
def test_whole_chain_with_shards_of_any_size(spark, shard):
    rows = texts()
    docs = table(spark, rows, extra=True)
    counts = plain_counts(rows)
    found = rows_of(spelling.counted(docs, spelling.SLIP))
    assert found == Counter(counts.items())
    words = spelling.near_words(spelling.counted(docs, spelling.SLIP), shard)
    result = spelling.forms(words).select("word", "form", "root", "n", "n_near", "form_n")
    expected = plain_forms(counts)
    assert any(w[1] != w[2] for w in expected if w[1]) and rows_of(result) == expected


def test_report_and_empty_table(spark):
    rows = corpus()
    found = spelling.report(table(spark, rows, extra=True))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(found) == plain_forms(plain_counts(rows))
    assert spelling.report(spark.createDataFrame([], COLUMNS)).collect() == []
    assert spelling.report(table(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0)])).collect() == []


def test_counts_are_the_same_when_tasks_hold_few_words(spark):
    rows = texts()
    held = spelling.HELD
    counts = Counter()
    try:
        spelling.HELD = 10
        docs = spark.createDataFrame(rows, COLUMNS)
        counts = rows_of(spelling.counted(docs))
    finally:
        spelling.HELD = held
    assert counts == rows_of(spelling.counted(docs))


def test_one_edit_of_all_pairs():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 6))) for _ in range(80)})
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    own = spelling.one_edit(spelling.spelled(words), a, b)
    assert own.tolist() == [one_edit(words[i], words[j]) for i, j in zip(a, b, strict=True)]


def test_a_long_text_is_counted_word_by_word(spark):
    text = "Repeated wörter " * 100_000
    assert rows_of(spelling.counted(table(spark, [(1, text, "en", "s", 0)]))) == Counter({("repeated", 100_000): 1, ("wörter", 100_000): 1})
