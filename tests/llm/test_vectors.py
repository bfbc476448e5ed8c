"""Alignment of tokenizers, SimHash covering and whitening: brute force and odd tables."""

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from gaugeflow.llm import align, fingerprints, queries, whitening
from gaugeflow.llm.words import text_slices

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, a int, fp bigint, pair string, key bigint, n bigint"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and clashing extra names."""
    long = prose(1, 30_000)
    texts = [(1, "One two, three four five six."), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (7, "İstanbul ſ ≠ naïve—dash 'Tis don't <|endoftext|> é <s> </s>"), (None, "no id at all"),
             (7, "again seven"), (8, prose(2, 80)), (8, prose(2, 80)), (9, "\x00 \x85 a b   c "), (10, "a▁b"), (11, " lead  two   three    four\r\n\r\n\ttab "), (12, "日本語テキスト ok 漢字 " * 40),
             (13, "x" * 3000), (14, " " * 500 + "y"), (15, "🙂🙃  　 z q"), (16, "ONE  two, three\nfour FIVE six.")]
    return spark.createDataFrame([(*x, None, 5, "p", 1, None) for x in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain_alignment(texts):
    """The contract, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in letters} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in letters)}

    def bytes_of(piece):
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()

    docs = []
    for t in texts:
        ids = [], []
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            parts = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes_of(b.id_to_piece(i)) for i in ids[1]]
            if any(b"".join(p) != (" " + t).encode() for p in parts):
                ids = [], []
        if not ids[0]:
            docs.append([])
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in both]
        for k in (0, 1):
            for i, e in zip(ids[k], ends[k], strict=True):
                groups[bisect_left(both, e)][k].append(i)
        docs.append(groups)
    counts = Counter(p for g in docs for p in {(x, y) for ga, gb in g for x in ga for y in gb})
    high = {}
    for (x, _), n in counts.items():
        high[x] = max(high.get(x, 0), n)
    out = []
    for g in docs:
        links = [(x, y) for ga, gb in g for x in ga for y in gb]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == high[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


def test_segments_beyond_the_kept_ones(monkeypatch):
    """Batches encoded with a memory of any size give the same tokens."""
    texts = pa.array([prose(k % 7, 40) + f" word{k}" for k in range(60)])
    sides = align.side(A), align.side(B)

    def tokens(keep):
        monkeypatch.setattr(align, "KEEP", keep)
        memory = align.Segments(sides)
        out = [t.ids.tolist() for _, _, raw, off in text_slices(texts, 1000) for t in align.tokenise(raw, off, memory)]
        assert len(memory.same) <= max(keep, 0) and len(memory.hashes) == len(memory.same)
        return out

    assert tokens(1 << 19) == tokens(50) == tokens(0)


def same_rows(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk", [1 << 24, 1])
def test_alignment_of_odd_texts(spark, odd, empty, chunk, monkeypatch):
    monkeypatch.setattr(align, "CHUNK", chunk)
    rows = odd.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows]), strict=True)]
    got = align.link_counts(odd, A, B).select(*COLUMNS).collect()
    same_rows(got, want)
    assert sum(r.n_a == 0 for r in got) == 3  # null, empty, and the one with U+2581
    assert align.link_counts(empty, A, B).count() == 0


def test_alignment_query_equals_the_plain_form(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(docs, plain_alignment([r.text for r in docs]), strict=True)]
    same_rows(queries.QUERIES["op11_asof_alignment"](spark, SF).select(*COLUMNS).collect(), want)


def test_overlaps_are_all_and_only_tokens_that_share_bytes(spark, odd):
    sides = align.side(A), align.side(B)
    for r in align.alignments(odd.where("length(text) < 4000"), A, B).collect():
        ends = [np.cumsum([s.size[i] for i in ids]).tolist() for s, ids in zip(sides, (r.a_ids, r.b_ids), strict=True)]
        starts = [[0, *e[:-1]] for e in ends]
        want = {(i, j) for i in range(len(r.a_ids)) for j in range(len(r.b_ids)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        assert set(zip(r.over_a, r.over_b, strict=True)) == want
        assert all(r.a_group[i] == r.b_group[j] for i, j in want)
        assert sorted(set(r.a_group)) == list(range(len(set(ends[0]) & set(ends[1]))))


def test_folded_wide_groups_give_the_same_pairs(spark, odd, monkeypatch):
    usual = align.link_counts(odd, A, B).collect()
    monkeypatch.setattr(align, "WIDE", 0)
    same_rows(align.link_counts(odd, A, B).collect(), usual)


def plain_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + width]) for k in range(max(len(words) - width + 1, 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_classes(ids, prints, threshold=3):
    kinds = sorted(set(prints))
    at = {k: i for i, k in enumerate(kinds)}
    x = np.array(kinds, np.uint64)
    root = list(range(len(kinds)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(kinds)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= threshold).tolist():
            root[find(i)] = find(j)
    low = {}
    for d, p in zip(ids, prints, strict=True):
        c = find(at[p])
        low[c] = d if low.get(c) is None else (low[c] if d is None else min(low[c], d))
    return [(d, f"{p:016x}", low[find(at[p])]) for d, p in zip(ids, prints, strict=True)]


def test_simhash_of_odd_texts(spark, odd, empty):
    rows = odd.collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    assert len({p for r, p in zip(rows, prints, strict=True) if r.doc_id in (2, 3, 4)}) == 1
    same_rows(fingerprints.classify(odd).collect(), plain_classes([r.doc_id for r in rows], prints))
    assert fingerprints.classify(empty).count() == 0


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = plain_classes([r.doc_id for r in docs], [plain_fingerprint(r.text) for r in docs])
    got = queries.QUERIES["op12_anchor_covering"](spark, SF).collect()
    same_rows(got, want)
    assert sum(r.component_id != r.doc_id for r in got) > 10


def test_strides_of_a_long_text_add_up(monkeypatch):
    text = prose(5, 1000)
    want = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "STRIDE", 7)
    assert fingerprints.fingerprint(text) == want == plain_fingerprint(text)


def test_golay_code_is_perfect():
    words, begin, per = fingerprints._patterns(0)
    assert len(words) == 1 << fingerprints.CHECKS and (per == 1).all() and (np.diff(begin) == 1).all()


@pytest.mark.parametrize("part", [4096, 3])
def test_anchors_lose_no_link(spark, part, monkeypatch):
    """Random fingerprints, neighbours at 1 to 5 bits, chains and a dense ball; also with anchors split into many squares."""
    monkeypatch.setattr(fingerprints, "PART", part)
    rng = np.random.default_rng(part)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for x in prints[:100]:
        for bits in (1, 2, 3, 3, 4, 5):
            prints.append(x ^ sum(1 << int(k) for k in rng.choice(64, bits, replace=False)))
    chain = 0xDEADBEEF
    for _ in range(20):
        chain ^= sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
        prints.append(chain)
    prints += [1 << a | 1 << b for a in range(0, 64, 5) for b in range(64)]
    found = fingerprints.links(spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in set(prints)], "fp bigint"))
    ids = sorted(set(prints))
    want = plain_classes(ids, ids)
    root = {p: p for p in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found.collect():
        a, b = int(np.int64(a).astype(np.uint64)), int(np.int64(b).astype(np.uint64))
        assert 0 < (a ^ b).bit_count()
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in ids} == {d: c for d, _, c in want}


VECS = "vec_id bigint, embedding array<float>, x string, key string, v double"


def plain_whitening(vectors, scale=256):
    x = np.floor(scale * np.array(vectors, np.float64))
    fit = np.unique(x, axis=0)
    mean = fit.mean(axis=0)
    spread = (fit - mean).T @ (fit - mean) / len(fit)
    values, axes = np.linalg.eigh(spread)
    return x, fit, mean, values[::-1], axes[:, ::-1], np.trace(spread)


def check_whitening(rows, ids, vectors, k):
    x, fit, mean, values, axes, trace = plain_whitening(vectors)
    n, sums = len(fit), fit.sum(axis=0)
    got = pd.DataFrame([r.asDict() for r in rows])
    key = "vec_id" if "vec_id" in got else "key"
    assert len(got) == len(ids) * k and (got["n"] == n).all() and sorted(got["component"].unique()) == list(range(1, k + 1))
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    for c in range(k):
        part = got[got["component"] == c + 1].sort_values([key, "deviation", "whitened"], na_position="first")
        want = (x - mean) @ axes[:, c] / np.sqrt(values[c])
        np.testing.assert_allclose(part["explained"], values[c] / trace, rtol=1e-10)
        if len(set(ids)) == len(ids):
            want = want[np.argsort(ids)]
            sign = np.sign((want * part["whitened"]).sum())
            np.testing.assert_allclose(sign * part["whitened"], want, atol=1e-8)
            assert part["deviation"].tolist() == [int(((n * v - sums) ** 2).sum()) for v in x[np.argsort(ids)]]


def test_whitening_query_equals_an_eigensolver(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(queries.QUERIES["op13_feast_whitening"](spark, SF).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 4)


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(k, rng.standard_normal(6).astype(np.float32).tolist()) for k in range(40)]
    good += [(100 + k, good[0][1]) for k in range(30)]  # copies count once in the fit
    bad = [(50, None), (51, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (52, [float("nan")] + [0.0] * 5), (53, [float("inf")] * 6), (54, []), (55, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, None, "k", 1.0) for r in good + bad], VECS)
    check_whitening(whitening.whiten(table, "vec_id", "embedding").collect(), [i for i, _ in good], [v for _, v in good], 4)
    null = whitening.whiten(table.selectExpr("if(vec_id = 3, null, vec_id) vec_id", "embedding", "x", "key", "v"), "vec_id", "embedding")
    assert null.where("key IS NULL").count() == 4


def test_whitening_without_variance(spark):
    none = spark.createDataFrame([], VECS)
    assert whitening.whiten(none, "vec_id", "embedding").count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0], None, None, None) for k in range(3)], VECS)
    assert whitening.whiten(same, "vec_id", "embedding").count() == 0
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0], None, None, None) for k in range(5)], VECS)
    got = whitening.whiten(line, "vec_id", "embedding").collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    far = spark.createDataFrame([(k, [1e12 * k, float(k)], None, None, None) for k in range(5)], VECS)
    assert all(r.deviation is None for r in whitening.whiten(far, "vec_id", "embedding").collect() if r.key in (0, 4))


def test_feast_on_close_and_repeated_eigenvalues(spark):
    rng = np.random.default_rng(9)
    for values in ([5.0, 5.0, 5.0, 1, 1, 1], [3.0, 3 - 1e-7, 2, 1, 0, 0], np.linspace(1, 2, 24).tolist(), [1.0] * 12, [7.0]):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        matrix = (q * np.array(values)) @ q.T
        matrix = (matrix + matrix.T) / 2
        for wanted in (4, len(values)) if len(values) < 10 else (4,):
            got, axes = whitening.feast(spark, matrix, wanted)
            np.testing.assert_allclose(got, sorted(values, reverse=True)[:wanted], atol=1e-11)
            np.testing.assert_allclose(matrix @ axes, axes * got, atol=1e-11)
            np.testing.assert_allclose(axes.T @ axes, np.eye(len(got)), atol=1e-6)
        assert whitening.inertia_above(matrix, 1.5) == sum(v > 1.5 for v in values)
