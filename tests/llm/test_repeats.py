"""Periodic runs, repeated strings and collocations against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablecare.llm import periods, phrases, transforms
from tablecare.llm.periods import find_runs, periodic_runs, transform
from tablecare.llm.phrases import chunked, collocations, tokens
from tablecare.llm.queries import op11_periods, op12_repeats, with_repeats
from tablecare.llm.transforms import (
    merged,
    repeated_starts,
    repeated_string_digests,
    shard_order,
    without_repeated_strings,
)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- periodic runs --------------------------------------------------------------------


def plain_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            smaller = any(
                all(stretch[t] == stretch[t + r] for t in range(len(stretch) - r))
                for r in range(1, q)
            )
            if j > i and len(stretch) >= max(6, 4 * q) and not smaller:
                found.append((i, len(stretch), q))
            i = max(i + 1, j + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def plain_description(words):
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def random_words(rng):
    kinds, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 6, 7, 20, 60, 150])
    words = [rng.randrange(1, kinds + 1) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n > 4:
            a = rng.randrange(n)
            p = rng.randrange(1, max(2, (n - a) // 3 + 1))
            for i in range(a + p, rng.randrange(a, n + 1)):
                words[i] = words[i - p]
    return words


def test_transform_is_exact():
    prime = int(periods._PRIME)
    rows = np.random.default_rng(1).integers(0, prime, (3, 16)).astype(np.uint64)
    turn = pow(periods._ROOT, (prime - 1) // 16, prime)
    plain = [
        sum(int(v) * pow(turn, i * k, prime) for i, v in enumerate(rows[0])) % prime
        for k in range(16)
    ]
    assert transform(rows)[0].tolist() == plain
    assert (transform(transform(rows), inverse=True) == rows).all()


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    # batches of a few blocks, and (by a tiny prime) zeros that are none
    monkeypatch.setattr(periods, "_AT_ONCE", rng.choice([16, 1 << 20]))
    texts = [random_words(rng) for _ in range(60)]
    ids = np.array([w for t in texts for w in t], np.uint64)
    found = find_runs(ids, np.array([len(t) for t in texts]))
    for number, text in enumerate(texts):
        own = found[found["text"] == number][["start", "length", "period"]]
        assert [tuple(r) for r in own.to_numpy().tolist()] == plain_runs(text)


def test_runs_of_long_and_simple_texts():
    for words, runs in (
        ([1] * 50_000, [[0, 0, 50_000, 1]]),
        (list(range(1, 3001)) * 5, [[0, 0, 15_000, 3000]]),
        (([1] * 300 + [2]) * 4, [[0, 0, 300, 1], [0, 0, 1204, 301], [0, 301, 300, 1],
                                 [0, 602, 300, 1], [0, 903, 300, 1]]),
    ):
        found = find_runs(np.array(words, np.uint64), np.array([len(words)]))
        assert found.to_numpy().tolist() == runs
    assert not len(find_runs(np.zeros(0, np.uint64), np.zeros(0, np.int64)))


def test_zeros_modulo_the_prime_are_no_runs(monkeypatch):
    # differences of multiples of the prime look like matches to the transform
    monkeypatch.setattr(periods, "_PRIME", np.uint64(193))
    monkeypatch.setattr(periods, "_ROOT", 5)
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(3)]
    ids = np.array([w for t in texts for w in t][:100], np.uint64)
    try:
        found = find_runs(ids, np.array([len(ids)]))
    except ValueError:
        return  # more words than the small prime tells apart
    assert [tuple(r) for r in found[["start", "length", "period"]].to_numpy().tolist()] == plain_runs(
        ids.tolist()
    )


def test_periodic_runs_of_odd_rows(table):
    docs = table(
        "doc_id long, text string, start string, _of int",
        (1, "a b a b a b a b a c", "x", 0),
        (1, "a b a b a b a b a c", "x", 0),
        (2, None, "x", 0),
        (3, "", None, None),
        (None, "z z\tz\nz  z z", "x", 0),
        (4, "é É é É é É é É    ", "x", 0),
    )
    found = sorted(rows_of(periodic_runs(docs)), key=lambda r: (r[0] is None, r[0] or 0, r[8]))
    assert [r[:6] for r in found] == [
        (1, 1, 0, 9, 2, 4500), (1, 1, 0, 9, 2, 4500), (2, 0, None, None, None, None),
        (3, 0, None, None, None, None), (4, 1, 0, 8, 2, 4000), (None, 1, 0, 6, 1, 6000),
    ]
    assert [bytes(r[8]) for r in found[:3]] == [b"a b c", b"a b c", b""]
    assert found[0][9] == [[0, 9, 2]]
    assert not rows_of(periodic_runs(docs.where("false")))


def test_query_finds_all_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in op11_periods(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    planted = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 10 == 0]
    short = [r for r in docs if len(r[1] or "") < 2500][:60]
    for doc_id, text in {*(r for r in planted if len(r[1] or "") < 6000), *short}:
        words = with_repeats(doc_id, (text or "").encode().split())
        assert found[doc_id] == plain_description(words)


# --- repeated strings -----------------------------------------------------------------


def plain_removal(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for text in texts:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            if counts[text[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        yield len(text), int(gone.sum()), spans, bytes(np.frombuffer(text, np.uint8)[~gone])


def random_texts(rng, length, count):
    base = bytes(rng.choice(b"ab") if rng.random() < 0.5 else rng.choice(b"cdefgh") for _ in range(300))
    for _ in range(count):
        kind, n, a = rng.random(), rng.randrange(0, 3 * length), rng.randrange(250)
        if kind < 0.5:
            yield base[a : a + n]
        elif kind < 0.7:
            yield base[a : a + length] + b"-" + base[:n]
        else:
            yield rng.choice([b"a", b"ab", b"abc"]) * n


def test_shards_are_sorted_and_merged():
    # two strings read symbol by symbol: ends are smallest, in order of the strings
    a, b = [2, 3, 2, 0], [3, 2, 3, 2, 1]
    orders = [shard_order(np.array(s), 1).tolist() for s in (a, b)]
    assert orders == [[3, 2, 0, 1], [4, 3, 1, 2, 0]]
    fronts = [np.array([s[i - 1] for i in o]) for s, o in zip((a, b), orders, strict=True)]
    shard, common = merged(fronts, 4, 4)
    assert shard.tolist() == [0, 1, 0, 1, 0, 1, 0, 1, 1]
    assert common.tolist() == [0, 0, 0, 1, 1, 3, 0, 2, 2]


@pytest.mark.parametrize("seed", range(6))
def test_repeated_starts_are_those_of_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(25):
        length = rng.choice([4, 7, 12, 20, 60, 100])
        monkeypatch.setattr(transforms, "_SHARD", rng.choice([50, 200, 1 << 16]))
        texts = [t for t in random_texts(rng, length, 8) if len(t) >= length]
        if not texts:
            continue
        counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for text, marks in zip(texts, repeated_starts(texts, length), strict=True):
            plain = [counts[text[i : i + length]] > 1 for i in range(len(text) - length + 1)]
            assert marks.tolist() == plain


@pytest.mark.parametrize("key_bytes", [1 << 20, 300])
def test_removal_is_that_of_brute_force(table, monkeypatch, key_bytes):
    monkeypatch.setattr(transforms, "_PART", 64)
    rng = random.Random(key_bytes)
    texts = [t.decode() for t in random_texts(rng, 24, 80)] + ["é" * 40, "x" + "é" * 40, ""]
    docs = table("doc_id long, text string", *enumerate(texts))
    cleaned = without_repeated_strings(docs, length=24, key_bytes=key_bytes)
    found = {r[0]: tuple(r)[1:] for r in cleaned.collect()}
    plain = plain_removal([t.encode() for t in texts], 24)
    for number, expected in enumerate(plain):
        got = found[number]
        assert (*got[:3], bytes(got[3])) == expected


def test_segments_of_many_forms_are_a_row_each(spark, table, tmp_path, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(transforms, "_BUCKET", 500)
    forms = list(dict.fromkeys(t.decode() for t in random_texts(rng, 24, 90) if len(t) >= 24))
    strings = table(
        "key long, content long, string binary",
        *((n % 2, n - (1 << 62), t.encode()) for n, t in enumerate(forms)),
    )
    scratch = transforms.Scratch(spark, "forms")
    found = rows_of(transforms._spread_ranges(strings, 24, 300, scratch))
    assert len(found) == len({r[:2] for r in found}) > 10
    marks = {r[1] + (1 << 62): {i for a, b in r[2] for i in range(a, b)} for r in found}
    for key in (0, 1):
        texts = {n: t for n, t in enumerate(forms) if n % 2 == key}
        counts = Counter(t[i : i + 24] for t in texts.values() for i in range(len(t) - 23))
        for n, t in texts.items():
            assert marks.get(n, set()) == {i for i in range(len(t) - 23) if counts[t[i : i + 24]] > 1}


def test_removal_of_odd_rows(table):
    docs = table(
        "doc_id long, text string, key int, t string, ranges int",
        (1, "0123456789" * 2, 0, "x", 1),  # repeats within itself
        (2, "once only, never again", 0, "x", 1),
        (2, "once only, never again", 0, "x", 1),  # the row again is a copy
        (None, None, 0, None, None),
        (None, "abcdefgh", 0, None, None),
        (3, "", 0, "x", 1),
    )
    found = sorted(rows_of(without_repeated_strings(docs, length=8)), key=lambda r: (r[0] or 0, r[1]))
    assert [(*r[:4], bytes(r[4])) for r in found] == [
        (None, 0, 0, 0, b""), (None, 8, 0, 0, b"abcdefgh"), (1, 20, 20, 1, b""),
        (2, 22, 22, 1, b""), (2, 22, 22, 1, b""), (3, 0, 0, 0, b""),
    ]
    assert not rows_of(repeated_string_digests(docs.where("false")))


def test_query_removes_what_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r[0]: tuple(r)[1:] for r in op12_repeats(spark, sf_dir).collect()}
    texts = [(r[1] or "").encode() for r in docs]
    for row, (n, removed, spans, kept) in zip(docs, plain_removal(texts, 400), strict=True):
        assert found[row[0]] == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    assert any(r[1] for r in found.values())


# --- collocations ---------------------------------------------------------------------


def plain_phrases(rows, most=3, least=10, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        sequence = tokens((text or "").encode())
        pieces = " ".join(t.decode() for t in sequence).split(".")
        for words in (p.split() for p in pieces):
            totals[lang or "und"] += len(words)
            for size in range(1, most + 1):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for phrase, a in frequent.items():
            for size in range(2, len(phrase)):
                for i in range(len(phrase) - size + 1):
                    part = phrase[i : i + size]
                    inner[part] = max(inner[part], a)
        scored = []
        for phrase, a in frequent.items():
            if 100 * inner[phrase] >= 50 * a:
                continue
            score, _, left, right = min(
                (10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k, f[phrase[:k]], f[phrase[k:]])
                for k in range(1, len(phrase))
            )
            scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            yield (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)


@pytest.mark.parametrize("seed", range(3))
def test_chunks_hold_each_phrase_once(seed):
    rng = random.Random(seed)
    texts = [
        [b"%d" % rng.randrange(40) if rng.random() < 0.9 else b"." for _ in range(rng.randrange(200))]
        for _ in range(50)
    ]
    for window in (1, 2, 4):
        seen, plain = Counter(), Counter()
        for words, chunks in zip(texts, chunked(texts, window, 8), strict=True):
            for chunk in (c.split(b" ") for c in chunks):
                for size in range(1, window + 2):
                    for end in range(window, len(chunk)):
                        phrase = tuple(chunk[end - size + 1 : end + 1])
                        seen[phrase] += b"." not in phrase
            for size in range(1, window + 2):
                for i in range(len(words) - size + 1):
                    phrase = tuple(words[i : i + size])
                    plain[phrase] += b"." not in phrase
        assert +seen == +plain


@pytest.mark.parametrize("most", [2, 3, 4])
def test_collocations_are_those_of_brute_force(table, monkeypatch, most):
    monkeypatch.setattr(phrases, "_WORDS", 300)
    rng = random.Random(most)
    rows = []
    for _ in range(300):
        words = [rng.choice(["New", "york", "CITY", "é", "a-b", "x'"]) for _ in range(rng.randrange(40))]
        text = "".join(w + rng.choice([" ", " ", "\t", ". ", "\n", "  ", ", "]) for w in words)
        rows.append((rng.choice(["en", "fr", None]), text))
    docs = table("lang string, text string", *rows)
    found = rows_of(collocations(docs, most=most, top=25))
    assert sorted(found) == sorted(plain_phrases(rows, most, top=25))


def test_collocations_of_odd_rows(table):
    docs = table(
        "doc_id long, lang string, text string, n long, phrase int, size int",
        *[(None, None, "Big  Data\tbig DATA", 1, 1, 1)] * 10,
        (1, "en", None, None, None, None),
        (2, "en", "", None, None, None),
        (3, "en", "never ten times", None, None, None),
    )
    assert sorted(rows_of(collocations(docs))) == [
        ("und", 1, "big data big", 10, 20, 20, 40, 250000),
        ("und", 2, "data big data", 10, 20, 20, 40, 250000),
    ]
    assert not rows_of(collocations(docs.where("false")))


def test_scores_beyond_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    a, left, right = 3_000_000_019, 3_000_000_020, 3_000_000_021
    parts = [F.lit(v).cast("decimal(19,0)") for v in (a, left, right)]
    product = F.lit(1_000_000).cast("decimal(7,0)") * (parts[0] * parts[0])
    score = F.call_function("div", product, parts[1] * parts[2]).cast("long")
    assert spark.range(1).select(score).first()[0] == 10**6 * a * a // (left * right)
