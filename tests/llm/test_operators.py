"""Each query against a plain version on the awkward corpus, with clashing column names, and on an empty table."""

from __future__ import annotations

import gc
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.samples import COLUMNS, corpus, repeated, rows_of, runs, table
from themelens.llm import (
    automata,
    exact,
    language,
    mixing,
    packing,
    personal,
    quality,
    repeats,
    simhash,
    suffixes,
    tokenfile,
    tokens,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def token_ids(text: str | None) -> list[int]:
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize(
    "operator",
    [
        tokenfile.write_and_read,
        quality.judge,
        mixing.mix,
        mixing.repeat_to_mix,
        simhash.label,
        simhash.keep_one,
        language.identify,
        language.keep_identified,
        packing.pack,
        exact.duplicates,
        exact.drop_duplicates,
        suffixes.report,
        personal.report,
        personal.sanitise,
        automata.report,
    ],
)
def test_an_empty_table_gives_an_empty_result(spark, operator):
    assert operator(spark.createDataFrame([], COLUMNS)).collect() == []


def test_token_file(spark):
    docs = table(spark, extra=True)
    found = tokenfile.write_and_read(docs).collect()
    own = Counter((i, len(ids) + 1, crc([*ids, 2])) for i, t, *_ in corpus() for ids in [token_ids(t)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == own
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in found), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered[:-1])]).tolist()


@pytest.mark.parametrize("width", range(1, 33))
def test_lanes_keep_values_of_every_width(width):
    values = np.random.default_rng(width).integers(0, 1 << width, (5, tokenfile.BLOCK), np.uint64).astype(np.uint32)
    assert (tokenfile._unpacked(tokenfile._packed(values, width), width) == values).all()


@pytest.mark.parametrize("n", [1, 127, 128, 129, 5000])
def test_blocks_keep_every_id_and_are_read_alone(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    ids[rng.random(n) < 0.03] = 4_294_967_295
    data = tokenfile.pack(ids)
    assert (tokenfile.unpack(data) == ids).all()
    assert (tokenfile.unpack(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_quality_counts_and_verdicts(spark):
    def plain(text):
        text = text or ""
        words = WORD.findall(text)
        places = {}
        for j in range(len(words) - 2):
            places.setdefault(tuple(words[j : j + 3]), []).append(j)
        covered = {x for at in places.values() if len(at) > 1 for j in at for x in (j, j + 1, j + 2)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed

    rng = random.Random(3)
    junk = [(200 + k, " | ".join(f"w{rng.random():.5f}"[:6] for _ in range(80)), "en", "s", 1) for k in range(8)]
    twice = [(300, "a b c d\n" * 30 + "\n".join(f"word{k} other{k}" for k in range(100)), "en", "s", 1)]
    rows = corpus() + junk + twice
    found = quality.judge(table(spark, rows, extra=True)).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[n] for n in names) for r in found) == Counter((i, *plain(t)) for i, t, *_ in rows)
    kept = {r.doc_id: r.kept for r in found}
    assert not any(kept[i] for i, *_ in junk) and not kept[107] and not kept[104]
    assert all(kept[r.doc_id] for r in found if not r.base_failed and r.doc_id is not None and r.doc_id < 60)


def test_mix_comes_near_the_targets(spark):
    rows = [(k, "w " * (k % 17), "en", f"s{k % 7}" if k % 3 else "big", 0) for k in range(3000)] + corpus()
    docs = table(spark, rows, extra=True)
    found = mixing.mix(docs)
    assert rows_of(found) == rows_of(mixing.mix(table(spark, rows[::-1])))
    sizes = Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    got = found.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == sizes
    assert all(r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"] for r in got)
    # Targets by resharing, round after round.
    source = Counter()
    for _, t, _, s, _ in rows:
        source[s] += len(WORD.findall(t or ""))
    order = sorted(source, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(source.values())), set(order)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: target[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] = min(share[s], 3 * source[s])
            left += share[s] - target[s]
            if share[s] >= 3 * source[s]:
                open_.discard(s)
    expected = Counter((source[s], round(target[s], 3)) for s in order)
    assert {(r.source_size, round(r.target, 3)) for r in got} == set(expected)
    taken = Counter()
    for r in got:
        taken[r.source_size, round(r.target, 3)] += r.taken
    # The document at the threshold is taken or left, whichever is nearer.
    largest = Counter()
    for r in got:
        largest[r.source_size] = max(largest[r.source_size], r["size"])
    assert all(abs(n - key[1]) <= largest[key[0]] / 2 for key, n in taken.items())


def test_equal_rows_do_not_spoil_the_mix(spark):
    rows = [(1, "a b c d e", "en", "one", 0)] * 400 + [(k, "x y z", "en", "two", 0) for k in range(300)]
    for r in mixing.mix(table(spark, rows)).groupBy("source_size", "target").sum("taken").collect():
        assert abs(r["sum(taken)"] - r.target) <= 5


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 3]), 42) for j in range(max(len(words) - 2, 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values: list[int]) -> dict[int, int]:
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (a ^ b).bit_count() <= 3 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_simhash(spark):
    rows = corpus()
    fingerprints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    label = brute_components(sorted({f for _, f in fingerprints}))
    least = {}
    for i, f in fingerprints:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    expected = Counter((i, f"{f:016x}", least.get(label[f])) for i, f in fingerprints)
    docs = table(spark, extra=True)
    assert rows_of(simhash.label(docs)) == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.get(x) for x in set(label.values()))


@pytest.mark.parametrize("tile", [4, 512])
def test_simhash_links_lose_no_pair(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    values = {0, 1, 3, 7, 15}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(20):
            values.add(v)
            v ^= 1 << rng.randrange(64)
            v ^= 1 << rng.randrange(64)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.near_duplicates(spark.createDataFrame(signed * 2, "fingerprint long")).collect()
    label = brute_components(values)
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.fingerprint & (2**64 - 1))
    expected = {}
    for v, x in label.items():
        expected.setdefault(x, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_language(spark):
    rows = corpus()
    found = language.identify(table(spark, extra=True)).collect()
    part = {i: zlib.crc32(str(i).encode()) % 3 for i, *_ in rows if i is not None}
    assert Counter((r.doc_id, r.held_out) for r in found) == Counter((i, part.get(i) == 1) for i, *_ in rows)
    lang = {i: x for i, t, x, *_ in rows if i is not None and i < 60}
    held = [r for r in found if r.held_out and r.doc_id in lang]
    assert held and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert {r.lang_pred for r in found if r.doc_id in (104, 105, 106)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)


def plain_features(text):
    """Hashed 2- and 3-grams one by one, in Python integers."""
    codes, word = [ord(c) for c in text.lower()], 2**32 - 1

    def mixed(h):
        h ^= h >> 15
        return ((h * 0x2C1B3C6D) & word) >> (32 - language.BITS)

    for k in range(len(codes) - 1):
        pair = (codes[k] * 0x9E3779B1 + codes[k + 1] * 0x85EBCA6B) & word
        yield mixed(pair)
        if k + 2 < len(codes):
            triple = (pair * 0xC2B2AE35 + codes[k + 2] * 0x27D4EB2F) & word
            yield mixed(triple ^ 0x165667B1)


def test_language_equals_a_plain_naive_bayes(spark):
    rows = [row for row in corpus() if row[0] is not None and len(row[1] or "") < 5000]
    counts, docs = {}, Counter()
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and text is not None and lang is not None:
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_features(text))
    size = 1 << language.BITS
    expected = {}
    for i, text, *_ in rows:
        if not text or not any(c.isalpha() for c in text):
            expected.setdefault(i, []).append(("und", 0.0))
            continue
        grams, joint = Counter(plain_features(text)), {}
        for lang, own in counts.items():
            whole = sum(own.values()) + language.SMOOTHING * size
            joint[lang] = math.log(docs[lang] / sum(docs.values())) + sum(
                n * math.log((own[g] + language.SMOOTHING) / whole) for g, n in grams.items()
            )
        best = min(joint, key=lambda lang: (-joint[lang], lang))
        expected.setdefault(i, []).append((best, 1 / sum(math.exp(v - joint[best]) for v in joint.values())))
    found = {}
    for r in language.identify(table(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert found.keys() == expected.keys()
    for i, pairs in expected.items():
        for (a, x), (b, y) in zip(sorted(pairs), sorted(found[i]), strict=True):
            assert a == b and abs(x - y) < 1e-3, (i, a, x, b, y)


def test_language_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    model = language.Model(("a", "b", "c"), rng.normal(size=(1 << language.BITS, 3)).astype(np.float32), np.zeros(3))
    texts = ["ab" * k + "xyz" for k in range(40)] + ["", None, "1 2", "q", "word " * 150_000]
    assert model.predict(texts) == [model.predict([text])[0] for text in texts]
    assert model.predict([]) == []


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    with pytest.raises(language.TooManyLanguagesError):
        language.train(table(spark))


def test_language_depends_on_the_text_alone(spark):
    rows = [(i, t, x, s, n) for i, t, x, s, n in corpus() if i is not None]
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else x, "q", 0) for i, t, x, s, n in rows]
    assert rows_of(language.identify(table(spark, rows))) == rows_of(language.identify(table(spark, changed)))
    nothing = [(i, t, None, s, n) for i, t, x, s, n in rows]
    assert {r.lang_pred for r in language.identify(table(spark, nothing)).collect()} == {"und"}


def test_packing(spark):
    found = packing.pack(table(spark, extra=True)).collect()
    expected = Counter()
    for i, t, *_ in corpus():
        ids = [*token_ids(t), 0]
        first = (len(ids) - 1) % 2048 + 1
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            expected[i, k, a, b - a, crc(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(r.length for r in found) // 2048) + 1


@pytest.mark.parametrize("seed", range(30))
def test_configurations_hold_exactly_the_histogram(seed):
    rng = random.Random(seed)
    top = rng.choice([50, 300, 2048])
    histogram = {rng.randint(1, top): rng.choice([1, 3, 1000]) for _ in range(40)}
    plan = packing.solve(histogram, top)
    held = Counter()
    for found, times in plan:
        assert sum(length * copies for length, copies in found) <= top
        for length, copies in found:
            held[length] += copies * times
    assert held == histogram
    least = -(-sum(k * n for k, n in histogram.items()) // top)
    simple = sum(packing.best_fit(np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)]), top).values())
    assert least <= sum(n for _, n in plan) <= simple


def test_exact_duplicates(spark):
    rows = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    groups = {}
    for (i, t, *_), n in zip(rows, norm, strict=True):
        groups.setdefault(n, []).append((-len(t or ""), i is None, i or 0, i))
    found = exact.duplicates(table(spark, extra=True)).collect()
    expected = Counter((i, min(groups[n])[3], len(groups[n]), sha(n.encode())) for (i, *_), n in zip(rows, norm, strict=True))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == expected
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert kept == Counter(dict.fromkeys(kept, 1)) and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    docs = table(spark, extra=True)
    stays = exact.drop_duplicates(docs)
    assert stays.columns == docs.columns
    assert Counter(r.doc_id for r in stays.collect()) == Counter(min(g)[3] for g in groups.values())


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    total: Counter = Counter()
    filters = []
    for bits, many in ((20, 300), (20, 1), (20, 5000)):
        values, counts = np.unique(rng.integers(0, 1 << bits, many, np.uint64), return_counts=True)
        counts = counts * rng.choice([1, 1, 70_000], len(counts))
        total.update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
        own = exact.CountingQuotientFilter(bits, values, counts)
        filters.append(exact.CountingQuotientFilter.from_bytes(own.to_bytes()))
    values, counts = exact.CountingQuotientFilter.merged(filters).items()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == dict(total)


@pytest.mark.parametrize("hot", [3, 5000])
@pytest.mark.parametrize(("module", "window"), [(suffixes, 200), (automata, 35)])
def test_repeated_spans(spark, module, window, hot):
    rows = corpus() + [(500, "ab" * 400, "en", "s", 0), (501, " ".join(["tic tac toe"] * 40), "en", "s", 0)]
    texts = [(t or "").encode() for _, t, *_ in rows]
    items = texts if module is suffixes else [tuple(t.split()) for t in texts]
    expected = Counter()
    for (i, *_), s, flags in zip(rows, items, repeated(items, window), strict=True):
        rest = [x for x, out in zip(s, flags, strict=True) if not out]
        if module is suffixes:
            expected[i, len(s), sum(flags), runs(flags), sha(bytes(rest))] += 1
        else:
            expected[i, len(s), sum(flags), sha(b" ".join(rest))] += 1
    assert rows_of(module.report(table(spark, rows, extra=True), hot)) == expected


def test_words_without_white_space_may_be_as_long_as_the_text(spark):
    long, few = "xy" * 1_500_000, " ".join(f"w{k}" for k in range(40))
    texts = [long, f"{long} {few}", f"{few} {long}z {few} {few}", f"{few[:50]} {long}", "a b c", few + " " + long, "  " + "\xe9" * (1 << 20) + " e"]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    items = [tuple(t.encode().split()) for t in texts]
    expected = Counter()
    for (i, *_), s, flags in zip(rows, items, repeated(items, 35), strict=True):
        rest = [x for x, out in zip(s, flags, strict=True) if not out]
        expected[i, len(s), sum(flags), sha(b" ".join(rest))] += 1
    assert sum(n for (_, _, n, _) in expected) > 0 and rows_of(automata.report(table(spark, rows))) == expected


def test_words_of_one_polynomial_are_no_repeats(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join([*words[:20], w, *words[20:]]) for w in (word, word.translate(str.maketrans("ab", "ba")))]
    found = automata.report(table(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])).collect()
    assert [(r.n_words, r.n_removed) for r in found] == [(41, 0)] * 2


@pytest.mark.parametrize("module", [suffixes, automata])
def test_long_texts_are_cut_without_losing_a_window(module, monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(3000)).encode()
    units = suffixes.Bytes() if module is suffixes else automata.Words()
    whole = list(units.pieces(pa.array([text, b"", text[:4000]], pa.binary())))
    monkeypatch.setattr(module, "BYTES_AT_ONCE", 900)
    monkeypatch.setattr(repeats, "STEP", 700)
    parts = list(units.pieces(pa.array([text, b"", text[:4000]], pa.binary())))

    def windows(pieces):
        found = Counter()
        for p in pieces:
            piece, first, count, gram = p.snippets(units.window, units.gram)
            for k, a, n, g in zip(piece, first, count, gram, strict=True):
                place = int(a - p.starts[k] + p.offsets[k])
                for j in range(n):
                    found[int(p.rows[k]), place + j, int(g), units.content(p, int(a) + j, int(a) + j + units.window)] += 1
        return found

    assert len(parts) > len(whole) and windows(parts) == windows(whole) and set(windows(whole).values()) == {1}


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        text = np.array([rng.randrange(1, 4) for _ in range(rng.randrange(40))], np.int64)
        assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    def passes(kind, found):
        digits = re.sub("[^0-9]", "", found)
        doubled = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
        return {
            "email": True,
            "ip": all(int(x) <= 255 for x in found.split(".")) if kind == "ip" else False,
            "card": 13 <= len(digits) <= 19 and doubled % 10 == 0,
            "phone": 9 <= len(digits) <= 15,
        }[kind]

    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def test_patterns_match_as_from_the_left():
    rng = random.Random(4)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256", "4111111111111111", "+1 (23) 456-7890", "-", " ", "x", "é", "%", "0012", "5.6"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 9)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_personal_data(spark):
    near = "the secret handle zorblax is used by jo.doe@mail.example today"
    rows = corpus() + [(700 + k, f"{near} text number{k}", "en", "s", 0) for k in range(6)]
    found = {r.doc_id: r for r in personal.report(table(spark, rows, extra=True)).collect()}
    assert len(found) == len({i for i, *_ in rows})
    for i, t, *_ in rows:
        base = plain_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        r = found[i]
        assert r.base_sha256 == sha(text.encode()) and r.spans.startswith(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in PATTERNS]
        assert base or r.spans == ""
    start = near.index("zorblax")
    assert f"term:{start}:{start + 7}" in found[703].spans
    clean = {r.doc_id: r.text for r in personal.sanitise(table(spark, rows)).collect()}
    assert "[email]" in clean[700] and "@" not in clean[700] and clean[104] is None and clean[5] == corpus()[5][1]


def test_terms_far_from_the_entity_are_found_and_marked_throughout(spark):
    filler = [" ".join(f"w{k}x{j}" for j in range(20)) for k in range(8)]
    far = [f"jo.doe@mail.example {filler[k]} by{k} Zorblax, {filler[k][::-1]} zorblax" for k in range(4)]
    other, none = f"ann.lee@mail.example {filler[5]} met zorblax", f"{filler[6]} (zorblax) wrote"
    rows = corpus() + [(700 + k, t, "en", "s", 0) for k, t in enumerate([*far, other, none])]
    found = {r.doc_id: r for r in personal.report(table(spark, rows, extra=True)).collect()}
    for k, t in enumerate([*far, other]):
        places = [m.span() for m in re.finditer(r"[Zz]orblax,?", t)]
        assert [f"term:{a}:{b}" for a, b in places] == [s for s in found[700 + k].spans.split(",") if s.startswith("term")]
    clean = {r.doc_id: r.text for r in personal.sanitise(table(spark, rows)).collect()}
    assert clean[702] == f"[email] {filler[2]} by2 [term] {filler[2][::-1]} [term]"
    assert clean[704] == f"[email] {filler[5]} met [term]" and clean[705] == f"{filler[6]} [term] wrote"
    assert clean[5] == corpus()[5][1]


def test_ids_are_those_of_the_plain_call_where_a_text_holds_a_special_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end} {end}", f"one {end} two", f"one  {end}\n{end}  two", f" {end}x{end} ", f"<|endoftext {end}>", "plain"]
    ids = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids[0] == [64, 50256, 65]
    docs = table(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    found = sorted(tokenfile.write_and_read(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in found] == [(len(i) + 1, crc([*i, 2])) for i in ids]
    assert [r.start for r in found] == np.cumsum([0, *(len(i) + 1 for i in ids[:-1])]).tolist()
    packed = sorted(packing.pack(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.length, r.ids_crc32) for r in packed] == [(len(i) + 1, crc([*i, 0])) for i in ids]


def test_words_without_white_space_are_not_looked_at_one_by_one(monkeypatch):
    """The encoder's test of new words, against the plain one; collections are off inside a batch only."""
    looked = []
    plain = tokens.clean
    monkeypatch.setattr(tokens, "clean", lambda word: looked.append(word) or plain(word))
    for words in (["a", "bc"], ["a\nb", "c"], ["a", ""], ["a", "b\n"], ["\u2003a", "a"], ["a\u00a0b", "\u00a0"], []):
        assert tokens.all_clean(words) == all(map(plain, words))
    assert not {"a", "bc", "c"} & set(looked)
    during = []
    own = tokens.Encoder()
    monkeypatch.setattr(own, "_encode", lambda texts: during.append(gc.isenabled()))
    own.encode([])
    assert during == [False] and gc.isenabled()


def test_new_words_are_encoded_together_and_a_failed_batch_leaves_nothing(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = tokens.Encoder()
    sent = []

    class Counting:
        def encode_batch_fast(self, pieces, add_special_tokens):
            sent.extend(pieces)
            return plain.encode_batch_fast(pieces, add_special_tokens=add_special_tokens)

    own.tokenizer = Counting()
    rng = random.Random(5)
    parts = ["a", "Zq", "'s", "x'll", "\u0120", "\u00e9\u0301", "\u4e2d", "\U0001f600", "9", "...", "\n", "\t", "\x1c", "\x85", "\u00a0", "", "<|endoftext|>", "y" * 70]
    texts = ["", " ", "one", *("".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(300))]
    texts += [rng.choice([" ", " ", "  ", "\n "]).join(rng.choices(texts, k=rng.randint(1, 12))) for _ in range(300)]
    for _ in range(2):  # the second time from memory
        for k in range(0, len(texts), 50):
            batch = texts[k : k + 50]
            assert own.encode(batch) == [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(batch, add_special_tokens=False)]
    words = [f"{k}w{k * 7}" for k in range(1000)]
    sent.clear()
    own.encode([" ".join(words[:500]), " ".join(words[500:])])
    assert len(sent) < 10  # two first words, and the others in a few texts

    broken = ["new1 new2 new3"]
    with monkeypatch.context() as patch:
        patch.setattr(own, "_ids", lambda pieces: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            own.encode(broken)
    assert own.encode(broken) == [np.array(plain.encode(broken[0], add_special_tokens=False).ids, "<u4").tobytes()]
