"""Token ids, packing and mixing."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tablecare.llm.encoding import CachedEncoder
from tablecare.llm.ids import id_digests, pack_values, read_ids, unpack_values, write_ids
from tablecare.llm.mixing import mix
from tablecare.llm.packing import (
    document_pieces,
    nonnegative_least_squares,
    pack_pieces,
    packed_sequences,
    plan_patterns,
)
from tablecare.llm.queries import op8_packing, tokenizer_path
from tablecare.llm.tables import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = [
    "a", "b", "Don", "'s", "'t", "'", "é", " ", "  ", "\n", "\t", "\xa0", "!", "??", "12", "²", "Ⅷ", "_",
    "-", "ß", "Σ", "中文", "\u0301", "<|endoftext|>", "<|startoftext|>", "<|", "\x1c", "İ", "'ll", "…", "\u200b", "\u3000",
]


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def coders(request):
    path = tokenizer_path(request.param)
    return Tokenizer.from_file(path), CachedEncoder(path, remembered=50)


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=14))
def test_cuts_change_no_id(coders, parts):
    text = "".join(parts)
    whole = coders[0].encode(text, add_special_tokens=False).ids
    assert coders[1].encode([text]) == [np.array(whole, "<u4").tobytes()]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
def test_values_round_trip(values):
    control, data = pack_values(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert unpack_values(control, data, len(values)).tolist() == values


def odd_docs(spark):
    rows = [
        (4, "Some text, some more.", "en", "a", 1), (2, None, "en", None, 0), (9, "", "en", "", 0),
        (1, "x " * 30_000, "en", "a", 1), (4, "Another of the id", "en", "a", 1), (4, "Some text, some more.", "en", "a", 1),
        (None, "no id", "en", "b", 1), (7, "unspaced" * 20_000, "en", "b", 1),
    ]
    return rows, spark.createDataFrame(rows, DOCS)


def expected_ids(name, text, end):
    ids = Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def test_token_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_ids(docs, f"{tmp_path}/ids", tokenizer_path(BYTES))
    found = {r.doc_id: r for r in id_digests(spark, f"{tmp_path}/ids").collect()}
    start, counts = 0, Counter()
    for row in docs.orderBy("doc_id").collect():
        ids = expected_ids(BYTES, row.text, 0)
        counts.update(ids.tolist())
        assert tuple(found[row.doc_id]) == (row.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    ranks = spark.read.parquet(f"{tmp_path}/ids/ranks").orderBy("rank").collect()
    assert [r.id for r in ranks] == sorted(counts, key=lambda i: (-counts[i], i))


def test_token_files_of_odd_rows(spark, tmp_path):
    rows, docs = odd_docs(spark)
    write_ids(docs, f"{tmp_path}/ids", tokenizer_path(BYTES))
    found = read_ids(spark, f"{tmp_path}/ids").orderBy("part", "place").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in found] == [r[0] for r in rows]
    for row, held in zip(rows, found, strict=True):
        assert bytes(held.ids) == expected_ids(BYTES, row[1], 0).tobytes()
    digests = id_digests(spark, f"{tmp_path}/ids").collect()
    assert sorted(r.start for r in digests)[0] == 0
    write_ids(spark.createDataFrame([], DOCS), f"{tmp_path}/none", tokenizer_path(BYTES))
    assert id_digests(spark, f"{tmp_path}/none").count() == 0


def test_cuts_are_what_they_say():
    """Letters with the white space before them, else anything up to the next white space."""
    import random
    import re

    from tablecare.llm.encoding import cuts_of

    said = re.compile(r"[ \t\n]*[^\W\d_]+|[ \t\n]*[^ \t\n]+|[ \t\n]+")
    chance = random.Random(4)
    for alphabet in (" \n\tab1.", " \nab1.\u00e9\u754c\U0001f600"):
        for _ in range(500):
            texts = ["".join(chance.choices(alphabet, k=chance.randrange(12))) for _ in range(4)]
            cuts, closing = cuts_of(texts)
            held, at = cuts.to_pylist(), 0
            for text, end in zip(texts, closing.tolist(), strict=True):
                found = []
                while sum(map(len, found)) < len(text):
                    rest = text[sum(map(len, found)) :]
                    begins = not found or rest[0] in " \t\n"
                    found.append((said if begins else re.compile(r"[^ \t\n]+")).match(rest).group())
                assert held[at:end] == found
                assert held[end][0] == "\n"
                at = end + 1


# --- packing ----------------------------------------------------------------------


def test_least_squares():
    rng = np.random.default_rng(1)
    a = rng.random((12, 30))
    b = a @ np.maximum(rng.standard_normal(30), 0)
    x = nonnegative_least_squares(a, b)
    assert (x >= 0).all()
    assert np.abs(a @ x - b).max() < 1e-6


@settings(max_examples=60, deadline=None)
@given(
    counts=st.dictionaries(st.integers(1, 200), st.integers(1, 400), max_size=30),
    capacity=st.sampled_from([200, 257]),
)
def test_plan_holds_everything(counts, capacity):
    held = Counter()
    for pattern, bins in plan_patterns(counts, capacity):
        assert sum(length * times for length, times in pattern) <= capacity
        for length, times in pattern:
            held[length] += times * bins
    assert held == Counter(counts)


def test_plan_is_tight():
    rng = np.random.default_rng(2)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.0, 200_000).astype(int) + 1)
    counts = Counter(lengths.tolist())
    bins = sum(n for _, n in plan_patterns(counts, 4096))
    assert bins <= 1.003 * -(-lengths.sum() // 4096)


def check_packing(rows, size):
    by_sequence = {}
    for r in rows:
        assert 0 < r.length <= size
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_packing_query(spark, sf_dir):
    rows = op8_packing(spark, sf_dir).collect()
    n = check_packing(rows, 4096)
    assert n <= 1.02 * sum(r.length for r in rows) / 4096 + 1
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = expected_ids(WORDS, doc.text, 1)
        pieces = sorted(found[doc.doc_id], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in pieces] == [
            (i, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
            for i, at in enumerate(range(0, len(ids), 4096))
        ]


def test_packing_of_odd_rows(spark):
    rows, docs = odd_docs(spark)
    pieces = document_pieces(docs, tokenizer_path(WORDS), size=64)
    places = Scratch(spark, "t").keep(pack_pieces(pieces, 64))
    held = places.collect()
    check_packing(held, 64)
    total = sum(len(expected_ids(WORDS, r[1], 1)) for r in rows)
    assert sum(r.length for r in held) == total
    sequences = packed_sequences(pieces, places).collect()
    assert sum(len(r.ids) // 4 for r in sequences) == total
    one = next(r for r in held if r.length > 5)
    ids = next(r.ids for r in sequences if r.sequence_id == one.sequence_id)
    assert zlib.crc32(bytes(ids)[4 * one.offset : 4 * (one.offset + one.length)]) == one.ids_crc32
    empty = document_pieces(spark.createDataFrame([], DOCS), tokenizer_path(WORDS))
    assert pack_pieces(empty).count() == 0


# --- mixing -----------------------------------------------------------------------


def sources(spark):
    rng = random.Random(3)
    rows = []
    for source, docs in [("big", 900), ("mid", 150), ("small", 40), (None, 25), ("", 10)]:
        rows += [(len(rows) + i, "w " * rng.randint(1, 40), "en", source, 1) for i in range(docs)]
    rows += [(9000, "", "en", "wordless", 0), (9001, None, "en", "wordless", 0), (9002, "", "en", "big", 0), (None, "a b", "en", "mid", 0)]
    return rows, spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("block_rows", [50, 10_000])
def test_mixing(spark, block_rows):
    rows, docs = sources(spark)
    tokens = {}
    for r in rows:
        tokens[r[3]] = tokens.get(r[3], 0) + len((r[1] or "").split())
    mixed = mix(docs, max_repeats=3.0, block_rows=block_rows)
    assert mixed.columns == [*docs.columns, "weight", "exponent", "copy", "block", "order_key"]
    held = mixed.collect()
    exponent = held[0].exponent
    # the smallest exponent that keeps the repeats within 3
    low, high = min(v for v in tokens.values() if v), max(tokens.values())
    assert (high / low) ** (1 - exponent) <= 3 < (high / low) ** (1 - exponent + 2e-6)
    assert sum({r.source: r.weight for r in held}.values()) == pytest.approx(1)
    assert {(r.doc_id, r.source) for r in held} == {(r[0], r[3]) for r in rows}
    for source, total in tokens.items():
        share = [len((r.text or "").split()) for r in held if r.source == source]
        if total:
            quota = (high / total) ** (1 - exponent) * total
            assert quota - 41 <= sum(share) <= quota + 1e-6
        else:
            assert len(share) == 2
        copies = Counter(r.doc_id for r in held if r.source == source)
        assert max(copies.values()) - min(copies.values()) <= 1


def test_mixing_to_an_entropy_and_budget(spark):
    _, docs = sources(spark)
    held = mix(docs, max_repeats=None, min_entropy=2.0, budget=5000).collect()
    weights = [w for w in {r.source: r.weight for r in held}.values() if w]
    entropy = -sum(w * np.log2(w) for w in weights)
    assert 2.0 <= entropy < 2.001
    assert 4700 <= sum(len((r.text or "").split()) for r in held) <= 5000


def test_mixing_odd_tables(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    wordless = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], DOCS)
    assert mix(wordless).count() == 2
    clashing = spark.createDataFrame([(1, "a b", "s", 5, "x"), (1, "a b", "s", 5, "x")], "doc_id long, text string, source string, copy int, doc string")
    held = mix(clashing)
    assert held.columns == ["doc_id", "text", "source", "doc", "weight", "exponent", "copy", "block", "order_key"]
    assert [(r.doc, r.copy) for r in held.collect()] == [("x", 0)] * 2


def test_many_frequent_lengths_are_packed(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tablecare.llm import packing

    # every one of 4096 lengths is ranked in groups of its own
    monkeypatch.setattr(packing, "_RANKED_ROWS", 1)
    pieces = spark.range(8192).select(
        F.col("id").alias("row"),
        F.lit(0).alias("piece"),
        (F.col("id") % 4096 + 1).alias("length"),
    )
    placed = packing.pack_pieces(pieces).toPandas()
    assert len(placed) == 8192
    placed = placed.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id")["length"].cumsum()
    assert (placed["offset"] == ends - placed["length"]).all() and ends.max() <= 4096


def test_the_encoder_keeps_few_cuts_between_tasks():
    from tablecare.llm import encoding
    from tablecare.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(500))]
    with encoding.encoding(path, kept=10) as known:
        first = known.encode(texts)
    assert len(known._known) <= 10 and not known._older
    assert known.encode(texts) == first


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PARTS, "𝒳", "x2y", "٣"]), max_size=9).map("".join), min_size=1, max_size=4))
def test_cuts_of_many_texts(texts):
    from tablecare.llm.encoding import cuts_of

    # letters after white space; else anything up to the next white space; else a tail
    space = "[ \t\n\r\x0b\x0c]"
    pattern = re.compile(rf"{space}*[^\W\d_]+|{space}*[^ \t\n\r\x0b\x0c]+|{space}+")
    cuts, closing = cuts_of(texts)
    found, at = cuts.to_pylist(), 0
    for text, end in zip(texts, closing.tolist(), strict=True):
        assert found[at:end] == pattern.findall(text) and found[end] == "\n"
        at = end + 1
    assert at == len(found)


def test_cuts_are_looked_up_once_for_many_texts():
    known = CachedEncoder(tokenizer_path(WORDS))
    asked = []
    ids_of = known._ids_of
    known._ids_of = lambda cuts: asked.append(cuts) or ids_of(cuts)
    texts = ["one two two", "two one \u200b", "", " two"] * 50
    whole = Tokenizer.from_file(tokenizer_path(WORDS))
    expected = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in known.encode(texts)] == expected
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
