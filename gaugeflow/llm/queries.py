"""The registered queries of the subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, binary, chat, decontam, dom, fingerprints, jaccard, pack, rules, shard, substring, urls, whitening
from .tables import require, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.pack(pack.token_table(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2), 4096)
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after")


@query
def op8_patched_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = binary.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


ORACLES["op10_decontaminate"] = r"""
WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[k + 1 : k + least(10, len(w))], ' ') AS gram
          FROM (SELECT *, unnest(range(greatest(len(w) - 9, 1))) AS k FROM bw WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM grams),
docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
cand AS (SELECT rid, width, k, array_to_string(w[k + 1 : k + width], ' ') AS gram
         FROM (SELECT rid, w, width, unnest(range(len(w) - width + 1)) AS k FROM docs, widths WHERE len(w) >= width)),
hits AS (SELECT c.rid, c.k, c.width, g.item_id FROM cand c JOIN grams g ON g.width = c.width AND g.gram = c.gram),
hit_words AS (SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(k, k + width)) AS i FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


@query
def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_sql(least_words: int = 10, most_repeated: int = 20) -> str:
    """The same estimation as rules.estimate, its rounds written out one after the other."""
    names, first = [r.name for r in rules.RULES], rules.start()
    space, kinds, v = r"\x09-\x0D\x20", range(len(first)), lambda n: f"v_{n}"
    words = f"regexp_extract_all(t, '[^{space}]+')"
    ctes = [
        "d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)",
        f"w AS MATERIALIZED (SELECT rid, {words} AS words FROM d)",
        f"l AS (SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^{space}]')] AS lines FROM d)",
        "g AS (SELECT rid, k, array_to_string(words[k + 1 : k + 5], chr(1)) AS gram FROM (SELECT rid, words, unnest(range(greatest(len(words) - 4, 0))) AS k FROM w))",
        "r AS (SELECT rid, count(DISTINCT i) AS n FROM (SELECT rid, unnest(range(k, k + 5)) AS i FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1) GROUP BY rid)",
        "f AS (SELECT rid, doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct,"
        " CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,"
        + ", ".join(f" CAST(length(regexp_replace(t, '[^{keep}]+', '', 'g')) AS BIGINT) AS {name}" for name, keep in (("n_symbols", "#*$%&|<>"), ("n_upper", r"\p{Lu}"), ("n_bangs", "!"), ("n_stops", ".,")))
        + " FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN r USING (rid))",
        "v AS MATERIALIZED (SELECT *, " + ", ".join(f"CASE WHEN {r.bad} THEN 0 WHEN {r.good} THEN 1 END AS v_{r.name}" for r in rules.RULES) + " FROM f)",
        f"p AS MATERIALIZED (SELECT {', '.join(map(v, names))}, count(*) AS n FROM v GROUP BY ALL)",
    ]
    params = [f"CAST({share!r} AS DOUBLE) AS s{k}" for k, (share, _) in enumerate(first)]
    params += [f"CAST({of[j][b]!r} AS DOUBLE) AS q{k}_{j}_{b}" for k, (_, of) in enumerate(first) for j in range(len(names)) for b in (0, 1)]
    ctes.append("m0 AS MATERIALIZED (SELECT " + ", ".join(params) + ")")
    clip = lambda x: f"least({1 - rules.EDGE!r}::DOUBLE, greatest({rules.EDGE!r}::DOUBLE, {x}))"
    weights = [" * ".join([f"s{k}", *[f"(CASE v_{n} WHEN 0 THEN {clip(f'q{k}_{j}_0')} WHEN 1 THEN {clip(f'q{k}_{j}_1')} ELSE {clip(f'1::DOUBLE - q{k}_{j}_0 - q{k}_{j}_1')} END)" for j, n in enumerate(names)]]) for k in kinds]
    for i in range(rules.ROUNDS):
        ctes.append(f"e{i} AS MATERIALIZED (SELECT p.*, {', '.join(f'{w} AS w{k}' for k, w in enumerate(weights))} FROM p, m{i})")
        total = " + ".join(f"w{k}" for k in kinds)
        ctes.append(f"c{i} AS MATERIALIZED (SELECT * REPLACE ({', '.join(f'n * w{k} / ({total}) AS w{k}' for k in kinds)}) FROM e{i})")
        new = [f"sum(w{k}) / sum(n) AS s{k}" for k in kinds]
        for k, (_, of) in enumerate(first):
            for j, n in enumerate(names):
                for b in (0, 1):
                    share = f"(coalesce(sum(w{k}) FILTER (v_{n} = {b}), 0) + {rules.WEIGHT!r}::DOUBLE * {of[j][b]!r}::DOUBLE) / (sum(w{k}) + {rules.WEIGHT!r}::DOUBLE)"
                    new.append(f"{f'least({rules.FALSE!r}::DOUBLE, {share})' if (k, b) == (0, 0) else share} AS q{k}_{j}_{b}")
        ctes.append(f"m{i + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM c{i})")
    failed = f"(n_words < {least_words} OR 100 * n_repeat_words > {most_repeated} * n_words)"
    good = f"({weights[0]}) / ({' + '.join(f'({w})' for w in weights)}) >= 0.5"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND {good} AS kept FROM v, m{rules.ROUNDS}"


ORACLES["op6_weak_supervision"] = _quality_sql()


@query
def op9_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classify(table(spark, sf_dir, "documents"), 5, 75)


ORACLES["op9_prefix_tree_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


@query
def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(table(spark, sf_dir, "documents"))


@query
def op3_vector_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    given = require(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(more)
    formatted = chat.windows(given, tokenizer_path(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return chat.read_back(formatted)


@query
def op5_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is the label of the document with its number: bad if toxic or of low quality."""
    rules = [urls.Rule("com/", "allow"), urls.Rule("example.com/en/", "block"), urls.Rule("www.example.com/en/", "allow"), urls.Rule("net/es/", "block"), urls.Rule("net/fr/", "block")]
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), labels, rules).drop("p_bad")


@query
def op2_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return dom.extract(pages, dom.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op11_asof_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align.link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


@query
def op12_anchor_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.classify(table(spark, sf_dir, "documents"), 3, 3)


@query
def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 256).withColumnRenamed("key", "vec_id")
