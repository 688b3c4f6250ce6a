"""Registered queries of this folder, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from wardlight.llm import (
    byte_bpe, decontaminate, exact_dedup, filter_audit, line_dedup, near_dedup, pii, quality_rules, secrets, substring_dedup,
    token_files, toxicity, whitening,
)
from wardlight.llm.stored import store
from wardlight.session import scratch_path

QUERIES: dict = {}
ORACLE: dict = {}


def _query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return wrap


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir: str):
    return _table(spark, sf_dir, "documents")


_OP2 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
"""


@_query("op2_exact_dedup", _OP2)
def op2(spark, sf_dir):
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


@_query("op3_byte_bpe")
def op3(spark, sf_dir):
    return byte_bpe.encode_documents(
        _documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


@_query("op5_token_files")
def op5(spark, sf_dir):
    files = token_files.write_token_files(
        _documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
        scratch_path(spark, "token-files"), end_id=2)
    return token_files.read_token_files(spark, files, ids=False)


def _joined(found):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _counts(found, kinds):
    def of(kind):
        return F.size(F.filter(found, lambda x: x["base"] & (x["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return [of(kind) for kind in kinds]


@_query("op9_secrets")
def op9(spark, sf_dir):
    found = secrets.find_secrets(_documents(spark, sf_dir))
    return found.select(
        "doc_id", *_counts(F.col("found"), secrets.KINDS[:3]),
        F.sha2(_joined(F.filter("found", lambda x: x["base"])), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"))


@_query("op6_toxicity")
def op6(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    scored = toxicity.score_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@_query("op8_decontaminate")
def op8(spark, sf_dir):
    return decontaminate.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


# Brute force over shared shingles: exact similarity of every pair, then connected documents.
_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (g) JOIN n x ON x.doc_id = a.doc_id
      JOIN n y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c
"""


@_query("op7_near_duplicates", _OP7)
def op7(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


_OP1 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 20 THEN [] ELSE range(1, len(w) - 18) END) AS p, w FROM d),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM s),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, list_filter(range(1, len(w) + 1),
             lambda i: NOT list_contains(coalesce(gone, []), i)) AS kept, w FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, n_words, n_words - len(kept) AS n_removed,
       sha256(array_to_string(list_transform(kept, lambda i: w[i]), ' ')) AS kept_sha256 FROM f
"""


@_query("op1_substring_dedup", _OP1)
def op1(spark, sf_dir):
    kept = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP10 = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(s))) AS line_no, unnest(s) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
w AS (SELECT doc_id, line_no, list_sort(list_distinct(list_filter(
        string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM l),
u AS (SELECT w, min((doc_id, line_no)) AS first FROM w WHERE len(w) > 0 GROUP BY w),
n AS (SELECT row_number() OVER () AS k, w, first, len(w) AS n FROM u),
t AS (SELECT k, n, first, unnest(w) AS g FROM n),
m AS (SELECT b.k FROM t a JOIN t b ON a.g = b.g AND a.first < b.first AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n
      GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
g AS (SELECT DISTINCT w.doc_id, w.line_no FROM w JOIN n ON n.w = w.w
      WHERE (w.doc_id, w.line_no) > n.first OR n.k IN (SELECT k FROM m)),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.line_no) FILTER (g.doc_id IS NULL) AS kept,
             count(g.doc_id) AS n_removed
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line_no = l.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


@_query("op10_line_dedup", _OP10)
def op10(spark, sf_dir):
    kept = line_dedup.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_query("op4_pii")
def op4(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = pii.find_personal_data(docs, pii.fit(docs))
    names = F.array(*map(F.lit, pii.KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda c: F.concat_ws(
            ":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")

    return found.select("doc_id", *map(number, range(4)), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


# Masks of the five filters (bit 0 is A), all orders of five letters, sums over masks at each step.
_OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, good, toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
        + 8 * regexp_matches(t, '[#$%&*|]')::int
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS mask
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
      WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS earlier
      FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::int AS step, letter,
        coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0)::int | bit::int) = 0), 0)::bigint AS kept,
        coalesce(sum(n) FILTER (mask & coalesce(earlier, 0)::int = 0 AND mask & bit::int > 0), 0)::bigint AS removed,
        coalesce(sum(n) FILTER (mask & coalesce(earlier, 0)::int > 0 AND mask & bit::int > 0), 0)::bigint AS redundant,
        coalesce(sum(n) FILTER (mask = bit::int), 0)::bigint AS unique_fails,
        coalesce(sum(good) FILTER (mask & coalesce(earlier, 0)::int = 0 AND mask & bit::int > 0), 0)::bigint AS good_lost,
        coalesce(sum(toxic) FILTER (mask & coalesce(earlier, 0)::int = 0 AND mask & bit::int > 0), 0)::bigint AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, letter, bit, earlier)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::bigint AS shapley FROM r
"""


@_query("op11_filter_audit", _OP11)
def op11(spark, sf_dir):
    return filter_audit.audit(filter_audit.failure_masks(_documents(spark, sf_dir), _table(spark, sf_dir, "labels")))


@_query("op12_quality_rules")
def op12(spark, sf_dir):
    counts = store(spark, quality_rules.statistics(_documents(spark, sf_dir)), "quality-counts")
    judged = quality_rules.judge(counts, quality_rules.fit(counts, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@_query("op13_whitening")
def op13(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))
