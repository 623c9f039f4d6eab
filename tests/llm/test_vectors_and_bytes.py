"""Byte-level BPE, whitening and hard negatives against plain computations."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from parley.llm import bytebpe, hardneg, whitening
from parley.llm import queries as q

RANKS = q.rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
KNOWN = {"ranks": RANKS, "pattern": public_tokenizers.PATTERN}
BPE_SCHEMA = "doc_id bigint, text string, tokens string, _k int, _uid string, decoded int"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward_texts():
    rng = random.Random(5)
    parts = ["word", " don't", "'ll", "'", " ", "  ", "\n\n", " \t", "x" * 70, " 12345", "!?", "é", "다중방", "字。字", "　", "🙂", "'re", " 'r", "e", "\xa0", "՘", " s"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 400))) for _ in range(60)]
    return [None, "", " ", "a", *texts, texts[0], "z" * 5000, " " * 5000, "a" + "\n" * 9000 + "b" + " " * 6000 + "c" + "\t" * 5000, "don't " * 900]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (200, 60), (bytebpe.CHUNK, bytebpe.OVERLAP)])
def test_bytes_as_the_library(spark, library, chunk, overlap):
    """Small chunks put every kind of seam into every kind of text; ids repeat and may be null."""
    rows = [(None if i == 7 else i // 2, t, "x", 1, "y", 2) for i, t in enumerate(awkward_texts())]
    docs = spark.createDataFrame(rows, BPE_SCHEMA).repartition(5)
    found = bytebpe.encode(docs, F.col("text"), F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("m"), **KNOWN, chunk=chunk, overlap=overlap)
    assert found.columns == ["doc_id", "m", "n_tokens", "tokens"]
    back = bytebpe.decode(found, F.col("tokens"), F.col("doc_id"), F.col("m"), F.col("n_tokens"), F.col("tokens"), **KNOWN).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.m, r.n_tokens, bytes(r.tokens), bytes(r.decoded)) for r in back)
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        runs = regex.split(r"(\s{4000,})", t or "")
        # the library overflows on long runs of white space, which are left to the matches of the pattern
        ids = library.encode_ordinary(t or "") if len(runs) == 1 else [x for m in regex.findall(public_tokenizers.PATTERN, t) for x in library._encode_single_piece(m)]
        want.append((i is None, i or 0, hashlib.md5(raw).hexdigest(), len(ids), np.array(ids, dtype="<u4").tobytes(), raw))
    assert got == sorted(want)


def test_bytes_of_an_empty_table(spark):
    found = bytebpe.encode(spark.createDataFrame([], BPE_SCHEMA), F.col("text"), F.col("doc_id"), **KNOWN)
    assert found.collect() == [] and found.columns == ["doc_id", "n_tokens", "tokens"]


def test_settled_characters_have_one_class_in_both_libraries():
    """Where texts are joined, the regex library and the encoder must agree on what is a letter, a number or white space."""
    ranks = {bytes([i]): i for i in range(256)}
    for a in (b"a", b"1", b"!"):
        for b in range(256):
            ranks.setdefault(a + bytes([b]), len(ranks))
    probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (bytebpe.settled(chr(c)) or bytebpe.IS_WHITE.match(chr(c)))]
    kinds = {}
    for a in "a1!":  # a token of two bytes says that the encoder takes both characters together
        for c, ids in zip(chars, probe.encode_ordinary_batch([a + c for c in chars], num_threads=4)):
            if ids[0] >= 256:
                kinds[c] = a
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    for c in chars:
        mine = "a" if letter.match(c) else "1" if number.match(c) else None if bytebpe.IS_WHITE.match(c) else "!"
        assert kinds.get(c) == mine, hex(ord(c))


VECTOR_SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y") for i, v in rows], VECTOR_SCHEMA)


def test_whitening_as_one_matrix(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    rows = [(i, [float(v) for v in mix @ rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a common vector counts once
    rows += [(None, rows[1][1]), (5, rows[5][1]), (2001, None), (2002, [1.0, None] * 3), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (2005, [1.0]), (2006, [])]
    found = whitening.whiten(vectors(spark, rows).repartition(7), components=4).collect()
    good = [(i, v) for i, v in rows if v is not None and len(v) == 6 and None not in v and np.isfinite(v).all()]
    assert len(found) == 4 * len(good)
    x = np.floor(64 * np.array([v for _, v in good], dtype=np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    values, parts = np.linalg.eigh(cov)
    by_id = {(r.vec_id, r.component): r for r in found}
    for k in range(4):
        value, part = values[-1 - k], parts[:, -1 - k]
        want = (x - s / n) @ part / np.sqrt(value)
        got = np.array([by_id[i, k + 1].whitened for i, _ in good])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert by_id[0, k + 1].explained == pytest.approx(value / np.trace(cov), rel=1e-12)
    for (i, _), row in zip(good, x.tolist()):
        r = by_id[i, 1]
        assert (r.n, r.deviation) == (n, sum((n * a - int(b)) ** 2 for a, b in zip(row, s))) and r.identity_error < 1e-9


def test_merged_moments_equal_those_of_all_rows():
    rng = np.random.default_rng(4)
    rows = rng.integers(-50, 50, size=(500, 5))
    state = whitening.NOTHING
    for part in np.array_split(rows, [1, 2, 50, 51, 300]):
        state = whitening.merge(whitening.moments(part), state)
    n, sums, mean, scatter = state
    apart = rows - rows.mean(axis=0)
    assert n == 500 and sums == rows.sum(axis=0).tolist()
    assert np.allclose(mean, rows.mean(axis=0), atol=1e-12) and np.allclose(scatter, apart.T @ apart, rtol=1e-12)


def test_whitening_without_variance(spark):
    """Fewer distinct vectors than dimensions, one vector, none, and empty ones."""
    two = whitening.whiten(vectors(spark, [(1, [0.0, 0.5, 1.0]), (2, [1.0, 0.5, 1.0]), (3, [1.0, 0.5, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, abs(r.whitened or 0), r.explained) for r in two) == [(i, c, 2, float(c == 1), float(c == 1)) for i in (1, 2, 3) for c in (1, 2, 3)]
    assert all((r.whitened is None) == (r.component > 1) for r in two)
    one = whitening.whiten(vectors(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in one] == [(None, None, 0, 0.0)] * 2
    assert whitening.whiten(vectors(spark, [])).collect() == [] and whitening.whiten(vectors(spark, [(1, []), (2, None)])).collect() == []
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors(spark, [(1, [1e30])])).collect()


def plain_negatives(rows, positives=5, negatives=3):
    """The contract by brute force; ``rows`` are (id, label, integers, is an anchor)."""
    out = []
    for i, (a, label, x, anchor) in enumerate(rows):
        if not anchor:
            continue
        scored = [(-int(np.dot(x, y)), b, m) for j, (b, m, y, _) in enumerate(rows) if j != i]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            inside = sorted(s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:negatives]
            out += [(a, p, n + 1, b, -ps, -s) for n, (s, b, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("cell, block, pivots", [(8192, 256, 16), (7, 3, 4), (40, 2, 1)])
def test_hard_negatives_as_brute_force(spark, monkeypatch, cell, block, pivots):
    """Ties, repeated ids and rows, a common vector, and rows that take no part; cells of every size give the same."""
    for name, value in (("CELL", cell), ("BLOCK", block), ("PIVOTS", pivots)):
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8))
    raw = [(i, (centres[i % 6] + rng.normal(size=8) * 0.4).round(1).tolist(), int(rng.integers(4))) for i in range(260)]
    raw += [(1000 + i, raw[3][1], i % 3) for i in range(60)] + [(50, raw[50][1], raw[50][2]), (50, raw[9][1], 1), (20, [0.0] * 8, 0), (20, [0.0] * 8, 1)]
    bad = [(None, raw[0][1], 1), (5, None, 1), (10, raw[0][1], None), (15, [1.0, None] + [0.0] * 6, 1), (25, [float("nan")] * 8, 1), (35, [float("-inf")] * 8, 1), (45, [1.0], 0)]
    schema = "vec_id bigint, embedding array<double>, label int, cell int, block string, x string"
    table = spark.createDataFrame([(i, v, y, 1, "b", "c") for i, v, y in raw + bad], schema).repartition(5)
    vector = F.when(whitening.usable(F.col("embedding")), whitening.fixed(F.col("embedding"), 16, 0))
    found = hardneg.mine(table, vector, F.col("vec_id") % 5 == 0, F.col("label"))
    rows = [(i, y, np.floor(16 * np.array(v)).astype(int), i % 5 == 0) for i, v, y in raw]
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows)


def test_hard_negatives_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    vector = whitening.fixed(F.col("embedding"), 1, 0)
    for raw in ([], [(0, [1.0, 2.0], 1)], [(0, [], 1), (1, [], 1)], [(0, [3.0], 1), (1, [2.0], 1), (2, [1.0], 0), (3, [1.5e5], 0)]):
        found = hardneg.mine(spark.createDataFrame(raw, schema), vector, F.col("vec_id") == 0, F.col("label"))
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert [tuple(r) for r in found.collect()] == ([(0, 1, 1, 2, 6, 3)] if len(raw) == 4 else [])


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for size in (100, 1 << 20, 1 << 28):
        a, b = (rng.integers(-size, size, size=(5, 9)) for _ in range(2))
        assert hardneg.products(a, b).tolist() == (a.astype(object) @ b.T.astype(object)).tolist()
    with pytest.raises(OverflowError):
        hardneg.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
