"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from fleet_health.llm import (
    ann, bpe, fingerprints, jaccard, line_dedup, lm_trie, merkle, mixing, quality, runs, secrets, substrings, token_files)
from fleet_health.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.link(table(spark, sf_dir, "documents"))


def op2_posting_lists(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20,
                      key="vec_id", vector="embedding")


def op3_substring_dedup(spark, sf_dir):
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op5_trie_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return lm_trie.score(docs, number % 7 == 2)


def op6_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, keys=["doc_id"])
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_files(spark, sf_dir):
    manifest = token_files.write(table(spark, sf_dir, "documents"), TOKENIZER, END_ID,
                                 added_tokens=True, null_ids=True)
    return token_files.read(spark, manifest).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_source_mix(spark, sf_dir):
    mixed, sources = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    sources = mixing.small_side(sources)
    mixed = mixed.join(sources, mixed["source"].eqNullSafe(sources["source"]))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target",
                        F.col("mix_taken").alias("taken"))


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select(
        "doc_id", *[secrets.count_of(F.col("spans"), k).cast("bigint").alias(f"n_{k}")
                    for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(F.col("spans"), ["assign", "access", "hex"]), 256)
        .alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = runs.find_runs(docs.select("doc_id", runs.repeat_tail(F.col("text"), number).alias("text")))
    best = found.withColumn("best", runs.highest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_line_dedup(spark, sf_dir):
    kept = line_dedup.remove_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = merkle.leaf_digest(fields)
    changed = merkle.leaf_digest([*fields[:3], fields[3] + 1, fields[4]])
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return merkle.verify(docs, leaf, F.when(tampered, changed).otherwise(leaf))


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_posting_lists, op3_substring_dedup, op4_quality, op5_trie_scoring,
    op6_byte_bpe, op7_token_files, op8_fingerprints, op9_source_mix, op10_secret_scan,
    op11_periodic_runs, op12_line_dedup, op13_merkle_manifest)}
WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH RECURSIVE tokens AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
grams AS (
  SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS gram
  FROM tokens WHERE len(w) >= 5
  UNION SELECT doc_id, array_to_string(w, ' ') FROM tokens WHERE len(w) BETWEEN 1 AND 4),
sized AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM grams x JOIN grams y
           ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized s ON s.doc_id = a JOIN sized t ON t.doc_id = b
          WHERE 100 * m >= 75 * (s.n + t.n - m)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
          UNION SELECT reach.a, ends.b FROM reach JOIN ends ON ends.a = reach.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN sized ON sized.doc_id = d.doc_id
GROUP BY d.doc_id
"""

#: Exact search. The posting lists find all of it where a table has so few lists that all are read.
OP2_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda x, y: x + y) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP3_SQL = r"""
WITH tokens AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM tokens WHERE len(w) >= 50)),
first AS (SELECT x, min(doc_id) AS least FROM windows GROUP BY x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN first USING (x) WHERE least < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM tokens),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM tokens t LEFT JOIN removed r ON r.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

#: Unsigned CRC-32 of the decimal doc_id, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))))"""

#: Matches of five words at every distance, joined to stretches.
OP11_SQL = rf"""
WITH given AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {CRC_SQL} AS h FROM documents),
sized AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM given),
cut AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
tokens AS (SELECT doc_id, n, list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) AS w FROM cut),
grams AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') AS x
          FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM tokens WHERE n >= 5)),
pairs AS (SELECT l.doc_id, l.i, r.i - l.i AS d FROM grams l JOIN grams r
          ON l.doc_id = r.doc_id AND l.x = r.x AND l.i < r.i AND 4 * (r.i - l.i) <= l.n),
placed AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS stretch FROM pairs),
matches AS (SELECT doc_id, d, min(i) AS s, count(*) + 4 AS m FROM placed GROUP BY doc_id, d, stretch),
runs AS (SELECT doc_id, s AS start, m + d AS length, min(d) AS period FROM matches WHERE m >= 3 * d GROUP BY ALL),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS x
           FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM tokens),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS x FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
       sha256(coalesce(l.x, '')) AS runs_sha256, sha256(coalesce(k.x, '')) AS collapsed_sha256
FROM tokens t LEFT JOIN listed l ON l.doc_id = t.doc_id LEFT JOIN best b ON b.doc_id = t.doc_id LEFT JOIN kept k ON k.doc_id = t.doc_id
"""

OP12_SQL = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
lines AS (SELECT doc_id, unnest(x) AS line, unnest(range(0, len(x))) AS i FROM cut),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
first AS (SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k),
told AS (SELECT doc_id, i, line, coalesce(doc_id > least, false) AS gone FROM keyed LEFT JOIN first USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""


def _field_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x}::VARCHAR END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: `side` 0 are the trees of the languages, 1 is the tree over them.
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN {CRC_SQL} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS shown FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS rank,
                  count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, rank AS pos, leaf AS digest, n FROM ranked
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place,
                    count(*) OVER () AS k FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place AS pos, subroot AS digest, k AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
path AS (
  SELECT r.doc_id, r.leaf, 0 AS side, n.level, n.pos, n.digest FROM ranked r JOIN nodes n
    ON n.lang IS NOT DISTINCT FROM r.lang AND n.n > 1 AND n.pos = xor(r.rank >> n.level, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, 1, t.level, t.pos, t.digest FROM ranked r
    JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang JOIN tops t ON t.n > 1 AND t.pos = xor(s.place >> t.level, 1)),
proofs AS (SELECT doc_id, leaf, sha256(string_agg(digest, '' ORDER BY side, level)) AS proof FROM path GROUP BY ALL),
folds AS (
  SELECT r.doc_id, r.leaf, r.lang, 0 AS side, 0 AS level, r.rank AS pos, r.n, s.place, s.k, r.shown AS digest
  FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang
  UNION ALL
  SELECT f.doc_id, f.leaf, f.lang, CASE WHEN f.n = 1 THEN f.side + 1 ELSE f.side END, CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END,
         CASE WHEN f.n = 1 THEN f.place ELSE f.pos // 2 END, CASE WHEN f.n = 1 THEN f.k ELSE (f.n + 1) // 2 END, f.place, f.k,
         CASE WHEN f.n = 1 THEN f.digest WHEN p.digest IS NULL THEN sha256(f.digest)
              WHEN f.pos % 2 = 0 THEN sha256(f.digest || p.digest) ELSE sha256(p.digest || f.digest) END
  FROM folds f LEFT JOIN path p ON p.doc_id = f.doc_id AND p.leaf = f.leaf AND p.side = f.side AND p.level = f.level AND f.n > 1
  WHERE f.side < 2 AND NOT (f.side = 1 AND f.n = 1))
SELECT r.doc_id, r.leaf, s.subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
       f.digest AS folded_root, f.digest = t.digest AS verified
FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang JOIN tops t ON t.n = 1
LEFT JOIN proofs p ON p.doc_id = r.doc_id AND p.leaf = r.leaf
JOIN folds f ON f.doc_id = r.doc_id AND f.leaf = r.leaf AND f.side = 1 AND f.n = 1
"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard": OP1_SQL, "op2_posting_lists": OP2_SQL,
                              "op3_substring_dedup": OP3_SQL, "op11_periodic_runs": OP11_SQL,
                              "op12_line_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
