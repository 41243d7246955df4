"""Every pipeline stage against plain Python on the stage's own input; the registered queries."""

import base64
import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from fleet_health.llm import queries
from fleet_health.session import cut_lineage
from tests.llm.test_links import grams
from tests.llm.test_native import base_spans
from tools.check import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output rows of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        made = cut_lineage(stage(spark, docs, SF))
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()]))
        docs = made
    return out


def test_columns(stages):
    for _, made in stages[:-1]:
        assert sorted(made[0]) == sorted(corpus_pipeline.COLUMNS)


def test_quality_keeps_clean_documents(spark, stages):
    docs, made = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in made}
    rate = {q: np.mean([i in kept for i, x in labels.items() if x == q]) for q in (0, 1)}
    assert rate[1] > 0.9 and rate[0] < 0.6
    assert all(r in docs for r in made)


def test_one_of_each_group_stays(stages):
    docs, made = stages[1]
    sets = {r["doc_id"]: grams(r["text"]) for r in docs}
    parent = {i: i for i in sets}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert sorted(r["doc_id"] for r in made) == sorted({root(i) for i in ids})
    assert all(r in docs for r in made)


def test_secrets_are_masked(stages):
    docs, made = stages[2]
    before = {r["doc_id"]: r for r in docs}
    assert len(made) == len(docs)
    for r in made:
        was = before[r["doc_id"]]
        spans = base_spans(was["text"])
        assert base_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])
        if not spans and "[SECRET]" not in r["text"]:
            assert r == was


def goals(sizes):
    """Shares of all words by weights 1, 2, 3, ..., at most three times a source's own words."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out = {}
    while True:
        left, below = sum(sizes.values()) - sum(out.values()), [s for s in sizes if s not in out]
        share = {s: left * weights[s] / sum(weights[t] for t in below) for s in below}
        over = [s for s in below if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}


def test_mix(stages):
    docs, made = stages[3]
    size = lambda r: len((r["text"] or "").encode().split())
    sizes, taken = Counter(), Counter()
    for r in docs:
        sizes[r["source"]] += size(r)
    for r in made:
        taken[r["source"]] += size(r)
    goal = goals(sizes)
    assert max(Counter(r["doc_id"] for r in made).values()) <= 3
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= max(60, 0.05 * goal[s]), (s, taken[s], goal[s])


def test_tokens(stages):
    docs, made = stages[4]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs}
    assert Counter(r["doc_id"] for r in docs) == Counter(r["doc_id"] for r in made)
    for r in made:
        text = texts[r["doc_id"]]
        ids = np.array(own.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r["token_ids"]) == ids and r["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert r["n_tokens"] == len(ids) // 4
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run_is_the_chain_of_stages(spark, stages):
    keys = ["doc_id", "ids_sha256"]
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select(keys).collect())
    assert got == Counter(tuple(r[k] for k in keys) for r in stages[-1][1])


def test_stages_of_odd_rows(spark):
    rows = [(None, "no id", "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y z", "en", None, 5),
            (3, "x y z", "en", None, 5), (4, "password=abcdefgh", None, "b", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumn("keep", F.lit(1)).withColumn("g", F.lit(2))
    for case in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            case = cut_lineage(stage(spark, case, SF))
        assert set(case.columns) >= {"doc_id", "n_tokens"}


def test_null_and_repeated_ids_lose_no_document(spark, stages):
    labels = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id").collect()}
    last = {r["doc_id"] for r in stages[1][1]}
    free = sorted(r["doc_id"] for r in stages[0][1] if r["doc_id"] in last and r["doc_id"] not in labels)[:9]
    assert len(free) == 9
    other = {**dict.fromkeys(free[:4]), **dict.fromkeys(free[4:], 10**9)}
    table = lambda x: Counter((other.get(r["doc_id"], r["doc_id"]), r["text"]) for r in x)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k, stage in enumerate((corpus_pipeline.keep_good, corpus_pipeline.keep_different)):
        before, after = stages[k]
        rows = [(other.get(r["doc_id"], r["doc_id"]), *(r[c] for c in corpus_pipeline.COLUMNS[1:])) for r in before]
        made = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
        got = table(r.asDict() for r in made)
        if k == 0:
            assert got == table(after)
        else:  # another copy may now have the least id of a group
            assert len(made) == len(after)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, SF)
    problem = compare([tuple(r) for r in got.collect()], got.columns, want.fetchall(), want.columns)
    assert problem is None, problem


def test_only_models_and_libraries_have_no_sql():
    assert {n.split("_")[0] for n in queries.QUERIES if n not in queries.ORACLE_SQL} == {
        "op4", "op5", "op6", "op7", "op8", "op9", "op10"}


CONTRACT = {
    "op1": "doc_id n_shingles component_id", "op2": "query_id rank vec_id score",
    "op3": "doc_id n_words n_removed kept_sha256", "op4": "doc_id keep",
    "op5": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6": "doc_id n_tokens ids_sha256 decoded_sha256", "op7": "doc_id start n_tokens ids_crc32",
    "op8": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9": "doc_id size source_size target taken", "op10": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "doc_id n_lines n_dropped kept_sha256",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_every_row(spark, name):
    made = queries.QUERIES[name](spark, SF)
    assert set(CONTRACT[name.split("_")[0]].split()) <= set(made.columns)
    if name != "op2_posting_lists":
        ids = Counter(r[0] for r in made.select("doc_id").collect())
        assert ids == Counter(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
