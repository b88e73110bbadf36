"""SimHash, paragraphs, caps and components against brute force."""

import random
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tablecare.llm.buckets import roots
from tablecare.llm.caps import ProductCode, embedding_components
from tablecare.llm.components import connected_components
from tablecare.llm.paragraphs import repeated_paragraphs, tuned_bands, without_passages, without_repeats
from tablecare.llm.simhash import fingerprint, index_positions, keep_first, simhash_components
from tablecare.llm.tables import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def smallest_reached(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("uvwxyz") * rng.randint(1, 4) for _ in range(n)]


# --- components -------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    chain = [(i + 1, i) for i in range(1000, 1030)]
    hub = [(500, rng.randint(501, 900)) for _ in range(200)]
    loose = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(120)]
    links = [*chain, *hub, *loose]
    edges = spark.createDataFrame([*links, (7, None)], "a long, b long")
    found = {r.node: r.root for r in connected_components(edges, Scratch(spark, "t")).collect()}
    expected = smallest_reached({n for e in links for n in e}, links)
    assert found == {n: r for n, r in expected.items() if n != r}


def test_no_edges(spark):
    edges = spark.createDataFrame([(3, 3)], "a long, b long")
    assert connected_components(edges, Scratch(spark, "t")).count() == 0


def test_roots():
    assert roots(6, np.array([5, 4, 1]), np.array([4, 3, 0])).tolist() == [0, 0, 2, 3, 3, 3]


# --- SimHash ----------------------------------------------------------------------


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\x09\x0a\x0b\x0c\x0d":
        lowered = lowered.replace(space, " ")
    tokens = [t for t in lowered.split(" ") if t]
    if not tokens:
        return 0
    width = min(4, len(tokens))
    shingles = [" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBÄé \t\n\x0b\x1c\xa0zZ", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("matches", [3, 4, 5, 6, 7])
def test_positions_cover(matches):
    positions = index_positions(matches)
    for held in combinations(range(8), matches):
        assert any(set(p) <= set(held) for p in positions)


def near_docs():
    rng = random.Random(4)
    rows = []
    for group in range(40):
        base = words(rng, rng.choice([3, 30, 120]))
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy), "en", f"s{group % 3}", 1))
    # one dense group: very many near copies of a long text
    base = words(rng, 400)
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        rows.append((len(rows), " ".join(copy), "en", "hot", 1))
    rows += [(len(rows), None, "en", "e", 0), (len(rows) + 1, "", None, None, 0), (len(rows) + 2, " \n", "", "", 2)]
    return rows


def test_simhash_components(spark, monkeypatch):
    rows = near_docs()
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = smallest_reached(prints, links)
    found = simhash_components(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    assert all(len(r.fingerprint) == 16 for r in found)
    kept = keep_first(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in kept} == set(expected.values())


def test_simhash_odd_rows(spark):
    long = "word " * 300_000
    rows = [(5, "a b c d e", 1), (5, "a b c d e", 1), (None, "a b c d e", 2), (None, "q r s t", 3), (9, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    found = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash_components(docs).collect())
    assert found == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 9)]
    kept = keep_first(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 5, 9]
    empty = spark.createDataFrame([], DOCS)
    assert simhash_components(empty).count() == 0
    assert keep_first(spark, empty).columns == empty.columns


# --- paragraphs -------------------------------------------------------------------


def shingles(line):
    tokens = line.lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}


def passage_docs():
    rng = random.Random(8)
    shared = [" ".join(words(rng, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        lines = [" ".join(words(rng, rng.randint(3, 90))) for _ in range(rng.randint(0, 4))]
        if i % 2:
            line = rng.choice(shared).split()
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(60)] = "new"
            lines.insert(rng.randint(0, len(lines)), rng.choice([" ", "  "]).join(line))
        if i % 7 == 0:
            lines += ["All rights reserved.", ""]
        rows.append((i, "\n".join(lines), "en", "s", 1))
    return rows


def test_paragraphs_like_brute_force(spark):
    rows = passage_docs()
    held = {
        (d, n): shingles(line)
        for d, text, *_ in rows
        for n, line in enumerate(text.split("\n"))
        if len(line.split()) >= 40
    }
    links = [
        (a, b) for a, b in combinations(held, 2)
        if len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])
    ]
    expected = {p: r[0] for p, r in smallest_reached(held, links).items() if p != r}
    removed, _ = repeated_paragraphs(spark.createDataFrame(rows, DOCS))
    found = {(r.doc_id, r.paragraph): r.component_id for r in removed.collect()}
    assert found == expected
    assert len(expected) > 30
    cleaned = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    for d, text, *_ in rows:
        rest = [x for n, x in enumerate(text.split("\n")) if (d, n) not in expected]
        assert cleaned[d].text == "\n".join(rest)
        assert cleaned[d].removed_paragraphs == sorted(n for e, n in expected if e == d)


def test_paragraphs_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(50))
    long = " ".join(f"v{i}" for i in range(200_000))
    rows = [(1, line, "x"), (1, line, "x"), (2, line.upper(), "y"), (3, None, None), (None, line, "z"), (4, "", ""), (5, long, ""), (6, long, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_paragraphs string")
    found = sorted((r.doc_id or 0, r.text, r.removed_paragraphs) for r in without_repeats(docs).fillna("?", ["text"]).collect())
    assert found == sorted(
        [(0, line, []), (1, line, []), (1, line, []), (2, "", [0]), (3, "?", []), (4, "", []), (5, long, []), (6, "", [0])]
    )
    assert without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_over_short_lines(spark):
    """Wrapped anew over 6 and 5 lines that are all too short to be a paragraph."""
    passage = [f"p{i}" for i in range(60)]
    wraps = [[" ".join(passage[i : i + n]) for i in range(0, 60, n)] for n in (10, 12)]
    rows = [(i, "\n".join([f"head of {i}", *wraps[i % 2], f"{i} ends"])) for i in range(5)]
    found = {r.doc_id: r for r in without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].text == rows[0][1]
    for i in range(1, 5):
        assert found[i].text == f"head of {i}\n{i} ends"
        assert found[i].removed_paragraphs == list(range(1, 1 + len(wraps[i % 2])))
        assert set(found[i].removed_components) == {0}


def test_passages_inside_lines(spark):
    """60 words in lines of 100 that differ around them, as they are and with a changed word;
    one of 40 words stays, and so does the first of a word said over and over."""
    def line(i, inner):
        return " ".join([*(f"a{i}x{k}" for k in range(20)), *inner, *(f"b{i}x{k}" for k in range(20))])

    passage = [f"p{i}" for i in range(60)]
    changed = [*passage[:28], "new", *passage[29:]]
    rows = [(1, line(1, passage)), (2, line(2, passage)), (3, line(3, changed)), (4, line(4, passage[:40]))]
    rows += [(5, "no " * 200), (None, line(6, passage)), (7, line(7, passage)), (7, line(7, passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.text, [tuple(c) for c in r.cut_passages]) for r in without_passages(docs).collect())
    gone = [(0, 20, 60, 1)]
    assert found == [
        (0, line(6, passage), []), (1, line(1, passage), []), (2, line(2, []), gone), (3, line(3, []), gone),
        (4, line(4, passage[:40]), []), (5, " ".join(["no"] * 50), [(0, 50, 150, 5)]), (7, line(7, []), gone), (7, line(7, []), gone),
    ]


def test_passages_like_brute_force(spark):
    """Exact passages of random words, wrapped anew in each document."""
    rng = np.random.default_rng(6)
    vocabulary = [f"W{i}" for i in range(5000)]

    def some(n):
        return [vocabulary[i] for i in rng.integers(0, 5000, n)]

    passages = [some(int(rng.integers(50, 120))) for _ in range(12)] + [some(44) for _ in range(3)]
    held = {}
    for doc_id in range(1, 41):
        words = some(30)
        for place in rng.choice(len(passages), rng.integers(0, 4), replace=False):
            words += [w.lower() if doc_id % 2 else w for w in passages[place]] + some(30)
        held[doc_id] = words
    rows = []
    for doc_id, words in held.items():
        lines, at = [], 0
        while at < len(words):
            width = int(rng.integers(3, 30))
            lines.append(" ".join(words[at : at + width]))
            at += width
        rows.append((doc_id, "\n".join(lines)))
    seen, left = set(), {}
    for doc_id, words in sorted(held.items()):
        low, gone = [w.lower() for w in words], set()
        for at in range(len(words) - 49):
            run = tuple(low[at : at + 50])
            if run in seen:
                gone.update(range(at, at + 50))
            seen.add(run)
        left[doc_id] = [w for at, w in enumerate(words) if at not in gone]
    assert sum(map(len, held.values())) > sum(map(len, left.values()))
    found = without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text.split() for r in found} == left


def test_passages_clashing_names(spark):
    names = ["row", "lines", "of", "spans", "cut", "of_lines", "_spans", "a.b", "cut_passages"]
    line = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(i, f"{i}\n{line}", *range(len(names))) for i in range(3)],
        "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names),
    )
    found = without_passages(docs).orderBy("doc_id").collect()
    assert [r.text for r in found] == [f"0\n{line}", "1", "2"]
    assert [[r[n] for n in names[:-1]] for r in found] == [list(range(len(names) - 1))] * 3
    assert found[0].__fields__ == [*docs.columns, "removed_paragraphs", "removed_components"]
    repeats = without_repeats(docs).orderBy("doc_id").collect()
    assert [r.text for r in repeats] == [f"0\n{line}", "1", "2"]


def test_passages_of_frequent_seeds(spark, monkeypatch):
    """Runs dealt by their own hash give what runs dealt by their seed give."""
    from tablecare.llm import paragraphs

    rng = np.random.default_rng(16)
    common, other = ([f"{c}{i}" for i in range(70)] for c in "cd")
    rows = []
    for i in range(40):
        words = [f"a{i}x{k}" for k in range(30)]
        for passage in (common, other)[: 1 + i % 2]:
            cut = [*passage[: int(rng.integers(20, 70))], f"new{i}", *passage[int(rng.integers(0, 20)) :]]
            words += cut + [f"b{i}x{k}" for k in range(30)]
        rows.append((i // 2, " ".join(words)))  # two texts to an id
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for most in (1, 7, 1000):
        monkeypatch.setattr(paragraphs, "HOT_SEED", most)
        found.append(sorted(map(str, without_passages(docs).collect())))
    assert found[0] == found[1] == found[2]
    assert any("cut_passages=[Row" in row for row in found[0])


def test_first_runs_over_batches():
    """What is known of a key goes on in the next batch and ends with the key."""
    import pyarrow as pa

    from tablecare.llm.paragraphs import _first_runs

    rows = [(1, d, 10 * d, [7, 8, 9][d % 2 :]) for d in range(6)] + [(2, 9, 0, [17, 17]), (2, 9, 5, [17])]
    names = {"key": pa.int64(), "doc_id": pa.int64(), "of": pa.int64(), "at": pa.int32(), "width": pa.int32()}
    schema = pa.schema(names | {"hashes": pa.list_(pa.int64())})
    held = [dict(zip(schema.names, (k, d, 0, at, 24, h), strict=True)) for k, d, at, h in rows]
    seen, expected = {}, []
    for key, doc_id, at, hashes in rows:
        for n, h in enumerate(hashes):
            first = seen.setdefault((key, h), (doc_id, at + n))
            if first != (doc_id, at + n):
                expected.append((doc_id, at + n, *first))
    for size in (1, 2, 3, len(held)):
        batches = [pa.RecordBatch.from_pylist(held[a : a + size], schema) for a in range(0, len(held), size)]
        found = [
            (r["doc_id"], r["at"] + n, r["first"], r["there"] + n)
            for batch in _first_runs(iter(batches))
            for r in batch.to_pylist()
            for n in range(r["runs"])
        ]
        assert found == expected


def test_texts_are_dealt_once(spark):
    """Lines and passages meet the dealt rows, which are not shuffled again."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        line = " ".join(f"w{i}" for i in range(60))
        docs = spark.createDataFrame([(i, f"{i} {line}") for i in range(3)], "doc_id long, text string")
        tables = spark.catalog.listTables()
        cleaned = without_passages(docs)
        assert spark.catalog.listTables() == tables
        plan = cleaned._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan
        assert len(cleaned.collect()) == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cutting_is_linear():
    """Many lines and many spans are gone through once."""
    from tablecare.llm.paragraphs import _cut

    n = 60_000
    text = "\n".join(f"a{i} b{i} c{i}" for i in range(n))
    spans = [(3 * i, 3 * i + 2, 1) for i in range(0, n, 2)]
    start = time.perf_counter()
    found = _cut(text, [], [], spans)
    assert time.perf_counter() - start < 5
    assert found["text"].split("\n")[:3] == ["c0", "a1 b1 c1", "c2"]
    assert len(found["cut_passages"]) == n // 2


def test_bands():
    for similarity, recall in [(0.8, 0.998), (0.5, 0.95), (0.9, 0.99)]:
        bands, rows = tuned_bands(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall


def test_bands_are_selective():
    """Unlike paragraphs hardly ever meet, so that buckets don't grow with the corpus."""
    bands, rows = tuned_bands(0.8, 0.998)
    assert 1 - (1 - 0.2**rows) ** bands <= 0.05


# --- embeddings -------------------------------------------------------------------


def test_caps_like_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((150, 32))
    near = base[rng.integers(0, 30, 200)] + 0.06 * rng.standard_normal((200, 32))
    rows = np.concatenate([base, near, base[:10], 3 * base[10:20]]).astype(np.float32)
    vectors = [(i, v.tolist(), 0) for i, v in enumerate(rows)]
    units = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    close = units @ units.T >= 0.95
    np.fill_diagonal(close, False)
    roots_ = smallest_reached(range(len(rows)), zip(*np.nonzero(close), strict=True))
    n = len(rows)
    odd = [
        (n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [float("nan")] * 32, 0), (n + 3, [1.0] * 31, 0),
        (n + 4, [None] + [1.0] * 31, 0), (n + 5, [], 0), (n + 6, [float("inf")] * 32, 0), vectors[0],
    ]
    table = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<float>, kept int")
    found = {r.vec_id: r for r in embedding_components(table).collect()}
    assert len(found) == n + 7
    for i in range(n):
        assert (found[i].n_links, found[i].component_id) == (close[i].sum(), roots_[i]), i
        assert found[i].kept == (roots_[i] == i)
    for i in range(n, n + 7):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_components(empty).count() == 0


def test_caps_of_several_lengths_and_few_dimensions(spark, monkeypatch):
    """Lengths with a code of their own, a rare one, and an id with several vectors."""
    from tablecare.llm import caps

    monkeypatch.setattr(caps, "CODED_ROWS", 20)
    rng = np.random.default_rng(8)
    vectors = []
    for dimension, count in ((3, 60), (4, 40), (1, 25), (24, 30), (2, 5)):
        vectors += [rng.standard_normal(dimension) for _ in range(count)]
    vectors += [v + 0.01 for v in vectors[100::7]]
    n = len(vectors)
    close = np.zeros((n, n), bool)
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and len(a) == len(b):
                close[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    reached = smallest_reached(range(n), zip(*np.nonzero(close), strict=True))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    # far from all vectors of its length, as another vector of id 0
    rows.append((0, [1.0, -1.0] * 6))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = embedding_components(table).collect()
    assert len(found) == n + 1
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in found)
    expected = sorted([(i, int(close[i].sum()), reached[i]) for i in range(n)])
    assert [g for g in got if g[0]] == [e for e in expected if e[0]]
    assert sorted({g[2] for g in got if not g[0]}) == [0]


def test_filters_are_as_many_as_pairs_need():
    rng = np.random.default_rng(9)
    rows = rng.standard_normal((512, 32))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    few, many = (ProductCode(32, words, seed=1) for words in (20, 120))
    assert 32 <= few.tune(rows, 0.95, 0.99, 512) <= many.tune(rows, 0.95, 0.99, 512) <= 512
    away = rng.standard_normal(rows.shape)
    away -= (away * rows).sum(1, keepdims=True) * rows
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    partners = 0.95 * rows + (1 - 0.95**2) ** 0.5 * away
    pairs = zip(many.decode(rows), many.decode(partners), strict=True)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) >= 0.97


def test_decoding_finds_all_filters():
    code = ProductCode(12, 5, seed=1)
    rng = np.random.default_rng(0)
    rows = rng.standard_normal((20, 12))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    code.calibrate(rows, 6)
    a, b, c = code._scores(rows)
    total = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(20, -1)
    for number, found in enumerate(code.decode(rows)):
        bound = min(code.threshold, np.sort(total[number])[-code.least])
        assert set(found) == set(np.flatnonzero(total[number] >= bound - 1e-12))


def test_dense_bucket_in_blocks(spark, monkeypatch):
    """Members that no pivot links, in buckets of several blocks."""
    from tablecare.llm import buckets

    monkeypatch.setattr(buckets, "in_blocks", lambda members, rows=8, of=buckets.in_blocks: of(members, rows))
    rows = [(1, i) for i in range(0, 60)]
    table = spark.createDataFrame(rows, "key long, node long")
    reached = buckets.linked(
        table,
        lambda pairs: pairs.where("node - pivot <= 2"),
        lambda members: members,
        lambda a, b: abs(a["node"].to_numpy()[:, None] - b["node"].to_numpy()[None, :]) <= 2,
        Scratch(spark, "t"),
    )
    assert {r.node: r.root for r in reached.collect()} == dict.fromkeys(range(1, 60), 0)
