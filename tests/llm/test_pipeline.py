"""The pipeline's stages against brute-force versions, and the registered queries at the smallest scale."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from test_operators import brute_fingerprint, brute_mix, brute_repeats, jaccard
from vertexframe.llm import toxicity
from vertexframe.llm.common import hf_tokenizer, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output rows of every stage, written and read again as the driver does."""
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, [tuple(r) for r in docs.collect()], after))
        docs = after
    return out


def test_stage_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "mixing", "packing"]
    assert all(after.columns == list(corpus_pipeline.COLUMNS) for _, _, after in stages[:-1])


def test_toxicity_stage(spark, sf_dir, stages):
    _, before, after = stages[0]
    model = toxicity.fit_labelled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert Counter(map(tuple, after.collect())) == Counter(r for r in before if model.score(r[1]) < toxicity.THRESHOLD)


def test_near_copy_stage(stages):
    _, before, after = stages[1]
    least = {}
    for r in sorted(before):
        least.setdefault(r[1], r[0])
    names = list(least)
    parent = {t: t for t in names}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(names):
        for b in names[:i]:
            if jaccard(a, b) >= 0.8:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for t in names:
        groups[find(t)].append(least[t])
    keep = {min(g) for g in groups.values()}
    assert Counter(map(tuple, after.collect())) == Counter(r for r in before if r[0] in keep)


def test_repeat_stage(stages):
    _, before, after = stages[2]
    masks = brute_repeats(before)
    want = Counter()
    for r in before:
        raw = r[1].encode()
        kept = bytes(np.frombuffer(raw, np.uint8)[~masks[r[0], raw]]).decode(errors="ignore")
        want[r[0], kept, r[2], r[3], len(kept)] += 1
    assert Counter(map(tuple, after.collect())) == want


def test_mix_stage(stages):
    _, before, after = stages[3]
    sizes, total, target = brute_mix(before)
    copies = Counter(r.doc_id for r in after.collect())
    taken, largest = defaultdict(int), defaultdict(int)
    for doc, source, size in sizes:
        assert copies[doc] <= 3
        taken[source] += copies[doc] * size
        largest[source] = max(largest[source], size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)
    assert {tuple(r) for r in after.collect()} <= set(before)


def test_pack_stage(stages):
    _, before, after = stages[4]
    tokenizer = hf_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    want = Counter()
    for r in before:
        want[r[0]] += len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1
    got, fill = Counter(), Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
    assert got == want and max(fill.values()) <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill.values()) <= 0.03 * sum(fill.values())


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()))
def test_registered_queries(spark, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    rows = df.collect()
    sql = __spark_entry__.oracle_sql().get(name)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    if sql is not None:
        names = sorted(df.columns)
        assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())
    elif "conv_id" in df.columns:
        assert len(rows) == con.sql("SELECT count(DISTINCT conv_id) + 1 FROM conversations").fetchall()[0][0]
    else:
        assert {r.doc_id for r in rows} == {r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall()}


def test_op6_and_op10_on_the_smallest_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    masks = brute_repeats(docs)
    for r in __spark_entry__.queries()["op6_suffix_dedup"](spark, sf_dir).collect():
        raw = dict(docs)[r.doc_id].encode()
        assert r.n_removed == int(masks[r.doc_id, raw].sum())
    found = {r.doc_id: r.fingerprint for r in __spark_entry__.queries()["op10_simhash"](spark, sf_dir).collect()}
    assert found == {i: f"{brute_fingerprint(t, 3):016x}" for i, t in docs}
    crcs = {r.doc_id: r.text_crc32 for r in __spark_entry__.queries()["op2_external_shuffle"](spark, sf_dir).collect()}
    assert crcs == {i: zlib.crc32(t.encode()) for i, t in docs}
