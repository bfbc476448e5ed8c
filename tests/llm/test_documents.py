"""Operators on documents: brute force, round trips and odd tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gaugeflow.llm import binary, decontam, jaccard, pack, queries, rules, shard, substring
from gaugeflow.llm.tokens import encoder
from gaugeflow.llm.words import NOT_SPACE, shingles, text_slices, utf8, words

DOCS = "doc_id bigint, text string, part int, n bigint, tokens string, n_chars bigint"
SF = "/root/testdata/sf0.001"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows and clashing extra names."""
    long = prose(1, 30_000)
    rows = [(1, "One two, three four five six.", 1, 1, "x", 29), (2, None, None, None, None, None), (3, "", 3, 3, "y", 0), (4, " \n\t ", 4, 4, "z", 4), (5, long, 5, 5, None, len(long)),
            (6, long, 6, 6, "a", len(long)), (7, "İstanbul ſ ≠ naïve—dash 'Tis don't <|endoftext|> é", 7, 7, "b", 3), (None, "no id at all", 8, 8, "c", 12), (7, "again seven", 9, 9, "d", 11),
            (8, prose(2, 80), 1, 1, "e", 1), (8, prose(2, 80), 1, 1, "e", 1), (9, "\x00 \x85 a b   c", 1, 1, "f", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def reference_ids(texts):
    return [e.ids for e in encoder(queries.tokenizer_path()).library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_and_shingles():
    texts = ["a  b\tC", None, "", "one two three four five six", "é É z"]
    raw, off = utf8(pa.array(texts))
    starts, ends, counts, h = words(raw, off)
    found = [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in (t or "").split()]
    assert counts.tolist() == [3, 0, 0, 6, 3]
    g, per = shingles(h, counts, 5)
    assert per.tolist() == [1, 0, 0, 2, 1] and len(set(g.tolist())) == 4
    again = [words(*x[2:])[3].tolist() for x in text_slices(pa.array(texts), limit=1)]
    assert [v for x in again for v in x] == h.tolist()
    assert NOT_SPACE[0x85] and not NOT_SPACE[0x0B]


def test_token_pieces_equal_the_library():
    texts = ["don't I'LL x'S 'sa", "İİ ≠ ≠ a≠b", "b12 3é4", "<|endoftext|> hi <|startoftext|>x", "", None, "éa Á K", "\x1ca\x85b", "'''s.'s", "…“q”—d", "A.'s;b", "日本語テキスト ok", "x" * 5000]
    known = encoder(queries.tokenizer_path())
    for limit in (1, 64, 1 << 19):
        out = []
        for _, _, raw, off in text_slices(pa.array(texts), limit):
            ids, n = known.encode(raw, off)
            stop = np.cumsum(n)
            out += [ids[a:b].tolist() for a, b in zip(stop - n, stop, strict=True)]
        assert out == reference_ids(texts)


def test_pack(spark, odd, empty):
    rows = odd.collect()
    pieces = pack.pack(pack.token_table(odd, queries.tokenizer_path(), 2), 64)
    got = pieces.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, tuple(i + [2])) for r, i in zip(rows, reference_ids([r.text for r in rows]), strict=True))
    ordered = sorted(got, key=lambda p: (p.sequence_id, p.offset))
    stream, docs, at = [], [], 0
    for p in ordered:
        assert p.sequence_id * 64 + p.offset == at and 0 < p.length <= 64
        ids = np.frombuffer(p.tokens, "<u4").tolist()
        assert len(ids) == p.length and p.cut_before == (p.start > 0) and p.cut_after == (p.start + p.length < p.doc_tokens)
        docs.append((p.doc_id, [])) if not p.cut_before else None
        docs[-1][1].extend(ids)
        stream += ids
        at += p.length
    assert sorted((d if d is not None else -1, tuple(i)) for d, i in docs) == want
    full = pack.sequences(pieces, 64).orderBy("sequence_id").collect()
    assert [i for s in full for i in np.frombuffer(s.tokens, "<u4")[: s.n_tokens]] == stream
    assert all(len(s.tokens) == 256 or s.n_tokens & (s.n_tokens - 1) == 0 for s in full)
    assert pack.pack(pack.token_table(empty, queries.tokenizer_path(), 2)).count() == 0


@pytest.mark.parametrize("values", [[], [7], [5] * 1024, list(range(3000)), [0, 2**32 - 1] * 700, [3] * 2000 + [2**31] + [4] * 50])
def test_frames_round_trip(values):
    v = np.array(values, np.uint32)
    blob = memoryview(binary.encode_series(v))
    back, end = binary.decode_series(blob, 0)
    assert back.tolist() == values and end == len(blob)
    for a, b in ((0, 10), (1000, 1100), (1024, 2048), (5, 5)):
        assert binary.decode_series(blob, 0, a, b)[0].tolist() == values[a:b]


def test_frames_are_small():
    v = np.random.default_rng(0).integers(0, 2**10, 100_000).astype(np.uint32)
    v[::100] += 2**20  # a percent of outliers
    assert len(binary.encode_series(v)) < 100_000 * 2


def test_token_files(odd, empty):
    rows = odd.collect()
    got = sorted(binary.round_trip(odd, queries.tokenizer_path(), 1, 3).collect(), key=lambda r: r.start)
    order = sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is not None, rows[k].doc_id or 0, rows[k].text is not None, rows[k].text or ""))
    ids = reference_ids([rows[k].text for k in order])
    at = 0
    for k, i, r in zip(order, ids, got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (rows[k].doc_id, at, len(i) + 1, [*i, 1])
        at += len(i) + 1
    assert binary.round_trip(empty, queries.tokenizer_path(), 1, 2).count() == 0


def test_decontaminate(spark, odd, empty):
    item = prose(2, 80).upper().split()
    bench = spark.createDataFrame([(1, " ".join(item[10:30])), (2, "Two... THREE"), (3, None), (4, ""), (None, "four FIVE"), (2, "again seven")], "item_id bigint, text string")
    found = {(r.doc_id, r.text): r for r in decontam.find(odd, bench, 10).select("*", decontam.n_hit().alias("hit")).collect()}
    assert found[8, prose(2, 80)].hit == 20 and found[8, prose(2, 80)]["items"] == [1]
    one = found[1, "One two, three four five six."]
    assert (one.n_words, one.hit, one["items"]) == (6, 4, [2])
    assert found[7, "again seven"]["items"] == [2] and found[2, None].n_words == 0
    blocks = decontam.find(odd, bench, 10, block_windows=1)
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, decontam.find(odd, bench, 10).collect()))
    cut = {r.doc_id: r.text for r in decontam.clean(odd, bench, "spans").where("doc_id in (1, 7)").collect()}
    assert cut[1] == "One  six."
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "5", "6", "7", "9", "None"]
    assert decontam.find(empty, bench).count() == 0 and decontam.find(odd, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_clean_by_large_benchmarks(spark, odd):
    item = prose(2, 80).split()
    rows = [(1, " ".join(item[10:30])), (2, "Two... THREE"), (3, None), (4, " ".join(item[25:45])), (None, "four FIVE")]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    for remove in ("documents", "spans"):
        want = sorted(map(repr, decontam.clean(odd, bench, remove).collect()))
        assert sorted(map(repr, decontam.clean(odd, bench, remove, block_chars=60).collect())) == want
        large = bench.unionByName(spark.range(70).selectExpr("id AS item_id", "concat(id, repeat('x', 1000000)) AS text"))
        assert sorted(map(repr, decontam.clean(odd, large, remove).collect())) == want


def test_quality_features_by_brute_force(odd, empty):
    for r in rules.features(odd).collect():
        texts = [t.text or "" for t in odd.collect() if t.doc_id == r.doc_id]
        assert any(_features(t) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for t in texts)
    assert rules.judge(empty).count() == 0


def _features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at, lines, twice = {}, set(), 0
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(inside)


def test_quality_repeats_ties(spark):
    texts = ["a b c d e a b c d e x", "a a a a a a a", "a a a a a", "k\nk\n\nk\n \n ", "one two three four five six " * 3]
    got = {r.doc_id: r for r in rules.features(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for k, t in enumerate(texts):
        assert _features(t) == (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words)


def test_quality_keeps_clean_documents_and_rejects_junk(spark):
    rows = [(i, ". ".join(prose(100 * i + k, 12).capitalize() for k in range(8)) + ".") for i in range(200)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(i, 90).split())) for i in range(20)]
    rows += [(2000 + i, " ".join(w.upper() + "!!" for w in prose(i, 90).split())) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("text", "text")
    kept = {r.doc_id for r in rules.keep_good(docs).collect()}
    assert kept == set(range(200))
    assert rules.keep_good(docs).columns == docs.columns


def _links(texts):
    def of(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {k: of(t) for k, t in texts.items()}
    comp = {k: k for k in texts}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                comp[hi] = lo
    return {k: (len(sets[k]), root(k)) for k in texts}


def test_jaccard_chains_families_and_short_texts(spark):
    rng = np.random.default_rng(3)
    texts, k = {}, 0
    for family in range(12):
        base = prose(family, int(rng.integers(5, 300))).split()
        for _ in range(int(rng.integers(1, 12))):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, len(w) // 20)))):
                w[int(rng.integers(0, len(w)))] = "edit" + str(rng.integers(0, 9))
            texts[k] = " ".join(w)
            base = w if family % 2 else base  # every other family drifts: links form chains
            k += 1
    shared = prose(99, 60)
    for _ in range(15):  # one passage in unrelated texts
        texts[k] = prose(1000 + k, int(rng.integers(20, 120))) + " " + shared
        k += 1
    texts |= {k: "a b c", k + 1: "A B C", k + 2: "a b", k + 3: "", k + 4: None, k + 5: "a b c d e", k + 6: " a  b\tc "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classify(docs).collect()}
    assert got == _links(texts)


def test_jaccard_search_of_failed_groups(spark, monkeypatch):
    """With one level for all shingles and tiny parts, most links are found in the full search of the groups."""
    monkeypatch.setattr(jaccard, "levels", lambda counted: np.zeros(jaccard.SLOTS, np.uint8))
    rng = np.random.default_rng(5)
    shared, texts = prose(7, 40).split(), {}
    for k in range(40):
        w = prose(500 + k // 4, 45).split() + shared
        for _ in range(2):
            w[int(rng.integers(0, 45))] = f"e{rng.integers(0, 5)}"
        texts[k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classify(docs).collect()} == _links(texts)


def test_bitmaps_rule_out_pairs_before_their_shingles_travel(spark, monkeypatch):
    """Texts that share a few rare shingles meet; of these pairs only those that could link are verified."""
    shared, met = prose(3, 12), []
    texts = {k: prose(700 + k, 60) + " " + shared for k in range(30)} | {30: prose(900, 80), 31: prose(900, 80) + " more"}
    verify = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda pairs, *rest: met.extend(tuple(r) for r in pairs.collect()) or verify(pairs, *rest))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classify(docs).collect()} == _links(texts)
    assert set(met) == {(30, 31)}


def test_bitmap_bound_is_never_below_the_shared_shingles(spark):
    rng, rows = np.random.default_rng(2), {}
    pool = [f"w{k}" for k in range(400)]
    for k in range(12):
        rows[k] = " ".join(pool[: int(rng.integers(0, 200))] + [f"x{k}y{j}" for j in range(int(rng.integers(0, 150)))])
    docs = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    sketch = {r.doc_id: (r.n, np.frombuffer(r.bits, np.uint8)) for r in jaccard._sketches(docs, docs.select("doc_id"), 5).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for k, t in rows.items()}
    for a in rows:
        for b in rows:
            bound, both = jaccard._most_shared(*sketch[a], *sketch[b]), len(sets[a] & sets[b])
            assert both <= bound <= min(len(sets[a]), len(sets[b]))


def test_jaccard_odd_tables(odd, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.classify(odd).collect()}
    assert got[6, max(n for d, n in got if d == 6)] == 5 and got[2, 0] == 2 and got[None, 1] is None
    assert jaccard.classify(empty).count() == 0
    kept = jaccard.keep_first(odd)
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()}


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(1)
    grams, per, t = rng.integers(0, 60, 400).astype(np.uint64), np.array([120, 0, 30, 200, 50]), 46
    for seed in substring._SEEDS[:4]:
        own, left, centre, right, _ = substring.compact_windows(grams, per, t, seed)
        want, at = set(), 0
        mixed = substring.spread(grams ^ seed) >> np.uint64(int(400).bit_length())
        for d, n in enumerate(per.tolist()):
            v = [(int(mixed[at + i]), i) for i in range(n)]
            for i in range(n):
                a = next((x + 1 for x in range(i - 1, -1, -1) if v[x] < v[i]), 0)
                b = next((x - 1 for x in range(i + 1, n) if v[x] < v[i]), n - 1)
                if b - a + 1 >= t:
                    want.add((d, a, i, b))
            at += n
        assert set(zip(own.tolist(), left.tolist(), centre.tolist(), right.tolist(), strict=True)) == want


def test_passages(spark, odd, empty):
    passage, near = prose(40, 70), prose(40, 70).split()
    near[30] = "changed"
    rows = [(1, prose(41, 100) + " " + passage + " " + prose(42, 50)), (2, passage + " " + prose(43, 90)), (3, prose(44, 60)), (4, prose(45, 20) + " " + " ".join(near)), (5, prose(46, 200)), (6, prose(41, 100)[:200])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = substring.passages(docs)
    got = sorted((r.doc_id, r.source_doc_id, r.first_word, r.end_word) for r in found.collect())
    assert got == [(2, 1, 0, 70), (4, 1, 20, 90)]
    cleaned = {r.doc_id: r.text for r in substring.clean(docs, found).collect()}
    assert cleaned[2] == prose(43, 90) and cleaned[1] == rows[0][1] and cleaned[4].split() == prose(45, 20).split()
    again = substring.passages(odd)
    assert {(r.doc_id, r.source_doc_id) for r in again.collect()} == {(6, 5)}
    kept = substring.clean(odd, again)
    assert kept.columns == odd.columns and 6 not in {r.doc_id for r in kept.collect()} and kept.count() == odd.count() - 1
    assert substring.passages(empty).count() == 0


def test_passages_find_every_exact_repeat(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower()) for r in docs.collect()}
    covered, first = {}, {}
    for r in substring.passages(docs).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
    for k in sorted(texts):
        for i in range(len(texts[k]) - 50):
            if first.setdefault(tuple(texts[k][i : i + 51]), k) != k:
                assert set(range(i, i + 51)) <= covered.get(k, set())


def test_passages_of_frequent_lines(spark):
    """Two documents share a passage whose lines all occur singly before: in one document, in many and in the source itself."""
    lines = [prose(700 + k, 12) for k in range(6)]
    passage = " ".join(lines)
    pieces = [" ".join(passage.split()[a : a + 24]) for a in range(0, 60, 6)]
    first = [(k, f"{prose(800 + k, 70)} {x} {prose(900 + k, 70)}") for k, x in enumerate(pieces)]
    turned = [(20, " ".join(f"{x} {prose(850 + k, 40)}" for k, x in enumerate(lines[::-1])))]
    for earlier in (first, turned, first + turned):
        later = [(30, f"{lines[3]} {prose(1, 80)} {passage} {prose(2, 40)}"), (31, f"{prose(3, 55)} {passage} {prose(4, 90)}"), (32, f"{passage} {prose(5, 60)}")]
        for n in (1, 6):
            docs = spark.createDataFrame(earlier + later, "doc_id bigint, text string").repartition(n)
            covered = {}
            for r in substring.passages(docs).collect():
                assert r.source_doc_id < r.doc_id
                covered.setdefault(r.doc_id, set()).update(range(r.first_word, r.end_word))
            assert set(range(55, 127)) <= covered[31] and set(range(72)) <= covered[32] and 30 not in covered


def test_near_passages_of_others_than_the_leader(spark):
    """Earlier documents hold every shingle of a passage, but never two in a row; two later ones hold it with changed words."""
    rows, want = [], {}
    for p in range(8):
        passage = prose(3000 + p, 90).split()
        for k in range(4):
            rows.append((10 * p + k, " ".join(f"{' '.join(passage[a : a + 5])} {prose(10_000 + 1000 * p + 100 * k + a, 3)}" for a in range(86))))
        near = list(passage)
        near[20], near[72] = "changed", "twice"
        rows += [(1000 + p, f"{prose(4000 + p, 60)} {' '.join(passage)} {prose(5000 + p, 40)}"), (2000 + p, f"{prose(6000 + p, 30)} {' '.join(near)} {prose(7000 + p, 70)}")]
        want[2000 + p] = 1000 + p
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [r for r in substring.passages(docs).collect() if r.doc_id >= 1000]
    assert {r.doc_id: r.source_doc_id for r in found} == want
    for d in want:
        assert set(range(32, 118)) <= {w for r in found if r.doc_id == d for w in range(r.first_word, r.end_word)}


def test_spans_name_every_holder():
    """The index of a group against all pairs, with a line that all spans hold."""
    rng = np.random.default_rng(5)
    line = rng.integers(0, 1 << 32, 30).astype("<u4")
    sources = []
    for d in range(60):
        own = np.concatenate([rng.integers(0, 1 << 32, 25), line, rng.integers(0, 1 << 32, 25)]).astype("<u4")
        if d % 3 == 0 and d:
            own[5:70] = sources[d // 2][1][5:70]
            own[rng.integers(5, 70, 3)] = d
        sources.append((d, own))
    rows = [(g, side, d, own) for g in (1, 2) for side in (0, 1) for d, own in sources[:: 3 - g]]
    group, side, doc = (np.array([r[k] for r in rows]) for k in range(3))
    size = np.array([len(r[3]) for r in rows])
    out = substring.holders(group, side, doc, np.full(len(rows), -1), size, np.concatenate([r[3] for r in rows]), 46, 75)
    for k, (g, s, d, own) in enumerate(rows):
        got = {x for row, x in out if row == k}
        want = {x for x, its in sources[:: 3 - g] if x < d and substring.repeated(own, its, 46, 75)} if s else set()
        assert bool(got) == bool(want) and got <= want
    assert out


def test_shards(spark, odd, empty):
    hot = [(i, "the same text over and over") for i in range(3000)] + [(10_000 + i, prose(i, 5 + i % 90)) for i in range(6000)]
    docs = spark.createDataFrame(hot, "doc_id bigint, text string").repartition(7)
    rows = shard.shard(docs, 24).collect()
    sizes, slots, homes = np.zeros(24), {}, {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(r.doc_id, set()).add(r.shard)
    assert len(rows) == len(hot) and sizes.max() < 1.01 * sizes.min()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = shard.shard(odd, 3).collect()
    assert len(got) == odd.count() and {(r.size, r.text_crc32) for r in got} == {(len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    assert shard.shard(empty, 24).count() == 0


@pytest.mark.parametrize("name", ["op6_weak_supervision", "op9_prefix_tree_join", "op10_decontaminate"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_digest_of_items(spark):
    row = spark.createDataFrame([([10, 9, 100],), ([],)], "items array<bigint>").select(decontam.items_digest().alias("d")).collect()
    assert [r.d for r in row] == [hashlib.sha256(b"10,100,9").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_windows_travel_as_compressed_planes():
    """Places, documents and kinds take few bytes beside the signatures, and come back as they were."""
    rng = np.random.default_rng(3)
    n = 20_000
    rows = [rng.integers(0, 1 << 63, n).astype(np.uint64), np.sort(rng.integers(-5, 90_000, n)), *[rng.integers(0, 900, n).astype(np.int32) for _ in range(3)], rng.integers(0, 6, n).astype(np.int32), rng.random(n) < 0.5]
    part, *columns = substring._cut(rng.integers(0, 4, n), *rows)
    assert part.tolist() == [0, 1, 2, 3] and sum(len(x) for c in columns[1:] for x in c) < 0.4 * sum(x.nbytes for x in rows[1:])
    for c, x in zip(columns, rows, strict=True):
        back = np.concatenate([substring._plain(b, x.dtype) for b in c])
        assert back.dtype == x.dtype and sorted(back.tolist()) == sorted(x.tolist())
    one = np.array([-7], np.int64)
    assert substring._plain(substring._squeezed(one), np.int64).tolist() == [-7]
