"""Every operator against a brute-force version, on nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexframe.llm import chat_format, common, components, media_audio, mixing, packing, rolling, sharding, simhash, suffix_dedup, token_counts, topk_search, toxicity
from vertexframe.llm.common import hf_tokenizer, tokenizer_path
from vertexframe.llm.components import connected_components

#: Columns whose names operators use inside, or add (in another case), or that hold dots and backticks.
CLASHES = ("id", "Size", "spans", "Score", "fp", "bucket", "copies", "place", "whole", "last", "t0", "rest", "row", "t", "key", "doc", "__s", "__hash", "__doc", "feature", "Media", "a.b", "c`d", "_")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES)


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "!\n"]) for _ in range(n))

    passage = prose(60)
    base = prose(150)
    near = base.split()
    near[70] = "changed"
    return [
        None, "", " \n\t ", "one", "Two words", "aé 中文 ✓ 😀", "x" * 5000, "ab" * 3000, prose(9000), prose(40) + passage + prose(20), passage, prose(5) + " " + passage, base, base, " ".join(near),
        base + " tail", "<|endoftext|> inside", "\x1c odd \x1f spaces\x85here", prose(300), "the quick", "the quick",
    ]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(i, x, "en", f"src{i % 4}" if i % 5 else None, len(x or "")) + ("clash",) * len(CLASHES) for i, x in enumerate(t)]
    return out + [out[9], out[1], (None, t[12], None, None, None) + (None,) * len(CLASHES)]  # repeated rows, a null id


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty, rows):
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = hf_tokenizer(path)
    want = Counter((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    found = token_counts.token_counts(docs, path, limit=100, chunk_chars=900, overlap_chars=120).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)
    assert token_counts.token_counts(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_splicing_widens(name):
    path = tokenizer_path(name)
    tokenizer, rule = hf_tokenizer(path), token_counts.boundary_rule(path)
    rng = random.Random(1)
    pieces = ["a", "é", "é", " ", "　", "\n", "1", "'s", "'", "<|endoftext|>", "中", "--", "\x1c", "Σ", "word ", " the", "  ", "😀", "\u0301"]
    for n in range(300):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 500)))
        assert token_counts.count_spliced(tokenizer, rule, text, 60, 40) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_another_vocabulary(docs, rows):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = hf_tokenizer(path)
    found = token_counts.token_counts(docs, path, chunk_chars=900, overlap_chars=120).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)


def test_unproven_vocabularies_are_refused(tmp_path):
    spec = json.load(open(tokenizer_path("word_bpe_49k.json")))
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    changes = [
        lambda s: s["normalizer"]["normalizers"].append({"type": "Strip", "strip_left": True, "strip_right": True}),
        lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=split["pattern"]["Regex"] + "|\\s+"),
        lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex="[^\\p{L}]+"),
        lambda s: s.update(pre_tokenizer=None),
        lambda s: s["added_tokens"][0].update(lstrip=True),
        lambda s: s["added_tokens"][0].update(content="two words"),
    ]
    for k, change in enumerate(changes):
        other = json.loads(json.dumps(spec))
        change(other)
        (tmp_path / f"{k}.json").write_text(json.dumps(other))
        with pytest.raises(ValueError):
            token_counts.boundary_rule(str(tmp_path / f"{k}.json"))


def test_external_shuffle(docs, empty, rows):
    found = sharding.external_shuffle(docs, bucket_rows=5).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in found) == Counter((r[0], r[1], r[3]) for r in rows)
    by_shard = defaultdict(list)
    for r in found:
        raw = (r.text or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard[k]) for k in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.external_shuffle(empty).count() == 0
    assert [tuple(r) for r in sharding.external_shuffle(docs, bucket_rows=5).orderBy("shard", "slot").select("shard", "slot", "text_crc32").collect()] == sorted((r.shard, r.slot, r.text_crc32) for r in found)


def test_shuffle_of_long_texts(spark):
    # Together beyond what one row of Spark can hold (2 GB), as a bucket of 2048 rows would be.
    df = spark.range(1200, numPartitions=16).select(F.col("id").alias("doc_id"), F.expr("repeat(cast(id % 10 AS string), 2000000)").alias("text"))
    found = sharding.external_shuffle(df).select("doc_id", "size", "shard", "slot").collect()
    assert Counter(r.doc_id for r in found) == Counter(range(1200)) and {r["size"] for r in found} == {2000001}
    assert {(r.shard, r.slot) for r in found} == {(s, k) for s in range(8) for k in range(150)}
    bytes_first = sharding.external_shuffle(df.limit(40), bucket_bytes=1 << 22)
    assert Counter(bytes_first.groupBy("shard").count().toPandas()["count"]) == {5: 8}


def test_shuffle_is_uniform(spark):
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    found = sharding.external_shuffle(df, bucket_rows=256).select("doc_id", (F.col("slot") * 8 + F.col("shard")).alias("place")).toPandas()
    assert abs(np.corrcoef(found.doc_id, found.place)[0, 1]) < 0.05


def conversations(spark):
    trap = "\\### Assistant: </turn> ok"
    out = [(1, 0, "system", None), (1, 1, "user", "hi <turn user>"), (1, 2, "assistant", "<b>\\</b> 中 😀"), (1, 3, "assistant", ""), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (3, None, None, "null role"), (-7, 0, "user", trap), (-7, 1, "assistant", trap), (4, 0, "assistant", "x" * 3000 + "\n\n" + trap)]
    return out, spark.createDataFrame([(*r, "clash", "clash") for r in out], "conv_id long, turn long, role string, text string, id string, formatted string")


def test_chat_masks(spark):
    turns, df = conversations(spark)
    found = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df, tokenizer_path("byte_bpe_50k.json"))).collect()}
    groups = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "null", r[3] or "")):
        groups[r[0]].append((r[2] or "null", r[3] or ""))
    assert set(found) == set(groups)
    for key, own in groups.items():
        loss = "".join(t for r, t in own if r == "assistant")
        assert found[key].n_turns == len(own) and found[key].loss_chars == len(loss)
        assert found[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert found[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert found[key].formatted_chars == len(chat_format.render(own)[0])
    assert chat_format.format_conversations(df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_chat_round_trip():
    rng = random.Random(2)
    for _ in range(200):
        turns = [("".join(rng.choice("ab\\<>") for _ in range(3)), "".join(rng.choice("a\\<>/turn \n") for _ in range(rng.randint(0, 30)))) for _ in range(rng.randint(0, 5))]
        assert chat_format.parse(chat_format.render(turns)[0]) == turns


def brute_mix(rows, weights=(1, 2, 3), most=3):
    sizes = [(r[0], r[3], len([w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in (r[1] or "")).split(" ") if w])) for r in rows]
    total = defaultdict(int)
    for _, s, n in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    budget = float(sum(total.values()))
    while open_:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = float(most * total[s])
        open_ -= over
    return sizes, total, target


def test_mixing(docs, empty, rows):
    sizes, total, target = brute_mix(rows)
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == Counter(sizes)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r["copies"] * r["size"]
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for _, s, n in sizes:
        largest[s] = max(largest[s], 2 * n)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()), key=str) == sorted(((r.doc_id, r.taken) for r in found), key=str)
    assert mixing.mix(empty).count() == 0


def test_mixing_one_source_and_a_hot_one(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"))
    sums = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 6 for r in sums)
    one = mixing.mix(df.withColumn("source", F.lit("only"))).agg(F.sum("taken"), F.sum("size")).first()
    assert one[0] == one[1]


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in v], "clash") for i, v in enumerate(rng.normal(size=(700, 9)).astype(np.float32))]
    vectors += [(700, None, "c"), (800, [float("nan")] * 9, "c"), (900, [None] + [1.0] * 8, "c"), (1000, [float("inf")] * 9, "c"), (1001, vectors[3][1], "c"), (1002, [0.0] * 9, "c"), (1100, [], "c"), (1200, [1.0, 2.0], "c"), (1300, [1e9] * 9, "c"), (5, vectors[5][1], "c")]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string").repartition(5)
    usable = [(i, [int(np.floor(1024 * x)) for x in v] + [0] * (9 - len(v))) for i, v, _ in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, qv in {i: v for i, v in usable if i % 100 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in usable if i != q)[:10]
        want |= {(q, rank + 1, i, max(-(2**63), min(2**63 - 1, -s))) for rank, (s, i) in enumerate(scored)}
    for block in (1024, 3):
        found = topk_search.top_k(df, F.pmod("vec_id", F.lit(100)) == 0, query_block=block).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == want
    assert topk_search.top_k(df.limit(0), F.pmod("vec_id", F.lit(100)) == 0).count() == 0
    few = topk_search.top_k(df.where("vec_id in (0, 1, 2)"), F.pmod("vec_id", F.lit(100)) == 0)
    assert few.count() == 2


def brute_repeats(rows):
    """(id, text) -> bytes to remove; rows in order of id, ties by the operator's hash, equal rows at one place."""
    order = sorted({(r[0] if r[0] is not None else -(1 << 63), suffix_dedup._tie((r[1] or "").encode()), (r[1] or "").encode()) for r in rows})
    seen, out = set(), {}
    for doc, _, raw in order:
        mask = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            window = raw[k : k + 100]
            if window in seen:
                mask[k : k + 100] = True
            seen.add(window)
        out[doc, raw] = mask
    return out


def check_repeats(df, rows):
    want = brute_repeats(rows)
    found = suffix_dedup.digest(df).collect()
    assert len(found) == len(rows)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    expected = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        mask = want[r[0] if r[0] is not None else -(1 << 63), raw]
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        expected[r[0], len(raw), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    assert got == expected


def test_suffix_dedup(docs, empty, rows):
    check_repeats(docs, rows)
    assert suffix_dedup.digest(empty).count() == 0
    spans = suffix_dedup.repeated_spans(docs).collect()
    assert Counter((r.doc_id, r.text) for r in spans) == Counter((r[0], r[1] or "") for r in rows)
    cut = suffix_dedup.cut_texts(docs, keep=("lang", "spans"))
    assert cut.columns == ["doc_id", "text", "lang", "spans"] and cut.count() == len(rows)


@pytest.mark.parametrize("common", [4096, 1])
def test_suffix_dedup_random(spark, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    rng = random.Random(8)
    alphabet = "ab"
    stock = ["".join(rng.choice(alphabet) for _ in range(rng.randint(40, 260))) for _ in range(12)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(stock) if rng.random() < 0.6 else "".join(rng.choice("abcdé \n") for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(0, 6)))
        rows.append((i % 50, text))
    rows.append((99, "=" * 700))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows)


def test_interleave_gives_the_suffix_order():
    """Order, common prefixes and intervals against plain sorting, for shards of several sizes."""
    rng = random.Random(17)
    for _ in range(40):
        made = []
        for shard in range(rng.randint(1, 4)):
            e = np.zeros(rng.randint(1, 30), suffix_dedup.CONTEXT)
            for x in e:
                x["a"], x["nr"] = rng.randint(1, 3), rng.choice([suffix_dedup.SIDE, suffix_dedup.SIDE, rng.randint(0, 5)])
                x["right"][: x["nr"]] = [rng.choice([1, 1, 1, 1, 2]) for _ in range(x["nr"])]
                x["doc"] = rng.randint(0, 10**6)
            made.append(suffix_dedup.transform(e))
        entries = np.concatenate(made)
        shard = np.repeat(np.arange(len(made)), [len(x) for x in made])
        start = np.lexsort((np.arange(len(entries)), shard, entries["a"]))
        order, prefix = suffix_dedup.interleave(entries["a"], start, entries["right"], entries["nr"])

        def common(x, y):
            n = min(x["nr"], y["nr"])
            same = next((k for k in range(n) if x["right"][k] != y["right"][k]), n)
            return -1 if x["a"] != y["a"] else same

        assert sorted(order.tolist()) == list(range(len(entries)))
        assert prefix.tolist() == [-1, *(common(entries[a], entries[b]) for a, b in zip(order, order[1:]))]
        for depth in (0, 1, 3, suffix_dedup.SIDE):
            found = suffix_dedup.intervals(order, prefix, depth)
            for i, j in combinations(range(len(entries)), 2):
                long = min(entries["nr"][i], entries["nr"][j]) >= depth
                assert not long or (found[i] == found[j]) == (common(entries[i], entries[j]) >= depth)


def test_long_texts_in_pieces(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 2048)
    monkeypatch.setattr(suffix_dedup, "ENTRIES", 50)
    rng = random.Random(4)
    part = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(30)]
    docs = [(i, 7, "".join(rng.choice(part) for _ in range(20)).encode()) for i in range(3)]
    whole, marks = suffix_dedup.places_of(docs), set()
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1 << 19)
    for p in suffix_dedup.places_of(docs):
        marks.add(tuple(p))
    assert {tuple(p) for p in whole} == marks


def test_toxicity(spark, docs, empty):
    rng = random.Random(6)
    clean = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    data, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        sentences = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(6)]
        if bad:
            sentences[rng.randrange(6)] += f" {rng.choice(['vile', 'nasty'])} thing"
        data.append((i, ". ".join(sentences)))
        labels.append((i, 0, int(bad)))
    df = spark.createDataFrame(data + [(1000, None), (1001, ""), (1002, "vile thing " * 50000)], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_labelled(df, marks)
    found = {r.doc_id: r for r in toxicity.score_documents(df, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [i for i in range(600) if found[i].h]
    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([found[i].predicted == int(i % 4 == 0) for i in held]) > 0.98
    assert found[1000].score == found[1001].score == 0.0 and found[1002].predicted == 1
    assert all(0 <= r.score <= 1 for r in found.values())
    text = data[0][1]
    scores = model.sentence_scores(text)
    assert model.score(text) == pytest.approx(1 - np.prod([1 - s for s in scores]))
    at = toxicity.offending_sentences(df.where("doc_id = 0"), model).collect()
    assert [r.sentence for r in at] == [k for k, s in enumerate(text.split(".")) if "vile" in s or "nasty" in s]
    assert toxicity.score_documents(docs, model).count() == docs.count() and toxicity.score_documents(empty, model).count() == 0
    none = toxicity.fit_labelled(empty, marks)
    assert none.score("vile") == 0.0


def test_toxicity_fit_against_brute_force():
    """Loss and gradient against a plain sum over documents and a numeric derivative; the fit ends where the gradient is small."""
    rng = random.Random(14)
    bags, labels = [], []
    for d in range(60):
        bags.append({tuple(sorted(rng.sample(range(5), rng.randint(1, 3)))): rng.randint(1, 4) for _ in range(rng.randint(0, 4))})
        labels.append(int(any(0 in found or 1 in found and rng.random() < 0.7 for found in bags[-1]) or rng.random() < 0.05))

    def brute(theta, ridge):
        total = 0.0
        for bag, y in zip(bags, labels):
            none = 1.0
            for found, times in bag.items():
                none *= (1 - 1 / (1 + np.exp(-(theta[-1] + sum(theta[w] for w in found))))) ** times
            total -= np.log(max(1 - none, 1e-9)) if y else np.log(none)
        return (total + ridge / 2 * sum(x * x for x in theta[:-1])) / len(bags)

    task = toxicity.Bags(bags, labels, 5)
    for _ in range(5):
        theta = np.array([rng.uniform(-2, 2) for _ in range(5)] + [rng.uniform(-4, 0)])
        loss, gradient = task.loss(theta, 0.01)
        assert loss == pytest.approx(brute(theta, 0.01))
        for k in range(6):
            if any(bags[d] and labels[d] for d in range(60)):
                step = np.eye(6)[k] * 1e-5
                assert gradient[k] == pytest.approx((brute(theta + step, 0.01) - brute(theta - step, 0.01)) / 2e-5, rel=1e-4, abs=1e-6)
    model = toxicity.fit(bags, labels, list("abcde"), rounds=3000, ridge=0.5)
    end = np.array([model.weights.get(w, 0.0) for w in "abcde"] + [model.bias])
    assert np.abs(task.loss(end, 0.5)[1]).max() < 2e-3
    assert brute(end, 0.5) <= min(brute(end + np.array([rng.gauss(0, 0.2) for _ in range(6)]), 0.5) for _ in range(200))


def test_toxicity_of_long_clean_texts(spark):
    rng = random.Random(8)
    clean = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]

    def prose(n):
        return ". ".join(" ".join(rng.choice(clean) for _ in range(6)) for _ in range(n))

    data = [(i, prose(6) + (". a vile thing" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    # Long clean texts that hold a word of toxic ones are fitted on, too.
    data += [(i, prose(8000) + ". an odd thing. " * 3, 0) for i in range(1000, 1008)] + [(i, prose(6) + ". an odd vile thing", 1) for i in range(2000, 2008)]
    df = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    model = toxicity.fit_labelled(df, spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, toxic int"))
    long = prose(30000)
    assert len(long) > 1_000_000 and model.score(long) == 0.0
    assert model.score(long + ". a vile thing") >= toxicity.THRESHOLD
    assert max(model.score(t) for _, t, bad in data if not bad) < toxicity.THRESHOLD <= min(model.score(t) for _, t, bad in data if bad)


def test_best_cuts_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        places = np.cumsum([rng.randint(1, 6) for _ in range(rng.randint(1, 9))])
        penalties = np.array([rng.choice([0, 2, 5]) for _ in places])
        best = None
        for mask in range(1 << (len(places) - 1)):
            cuts = [k for k in range(len(places) - 1) if mask >> k & 1] + [len(places) - 1]
            ends = [0, *(int(places[k]) for k in cuts)]
            if all(b - a <= 10 for a, b in zip(ends, ends[1:])):
                cost = sum(10 - (b - a) for a, b in zip(ends, ends[1:])) + sum(int(penalties[k]) for k in cuts)
                best = cost if best is None else min(best, cost)
        cuts = packing.best_cuts(places, penalties, 10)
        ends = [0, *(int(places[k]) for k in cuts)]
        assert sum(10 - (b - a) for a, b in zip(ends, ends[1:])) + sum(int(penalties[k]) for k in cuts) == best


@pytest.mark.parametrize("length", [2048, 64])
def test_packing(docs, empty, rows, length):
    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = hf_tokenizer(path)
    found = packing.pack(docs, path, length=length).collect()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], tuple(ids)] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        assert len(r.ids) == r.length > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    total = Counter()
    for r in found:
        total[r.doc_id] += r.length
    assert sum(total.values()) == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        if sum(1 for d, _ in want if d == doc) == 1 and n == 1:
            own = sorted(pieces[doc], key=lambda r: r.start)
            assert [i for r in own for i in r.ids] == list(ids) and all(r.doc_tokens == len(ids) for r in own)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding <= 0.1 * sum(total.values())
    assert packing.pack(empty, path).count() == 0


def test_g711_and_adpcm():
    # Values of ITU-T G.711 (fixed values).
    mu, a = media_audio.TABLES["mulaw"], media_audio.TABLES["alaw"]
    assert [mu[0], mu[0x80], mu[0x7F], mu[0xFF], mu[0x0F]] == [-32124, 32124, 0, 0, -16764]
    assert [a[0x55], a[0xD5], a[0x2A], a[0xAA]] == [-8, 8, -32256, 32256]
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (5, 20), dtype=np.uint8)
    out = media_audio.decode_adpcm(blocks)
    for block, got in zip(blocks, out):
        value, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media_audio.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media_audio.INDEX_STEPS[code])))
                want.append(value)
        assert got.tolist() == want


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm", None])
def test_audio(docs, empty, rows, codec):
    found = media_audio.decode_audio(media_audio.store_audio(docs, codec=codec)).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    assert all(r.media_bytes > r.payload_bytes and len(r.pcm) >= 4 * 192 and f"pcm={zlib.crc32(r.pcm):08x}" in r.feature for r in found)
    assert len({r.feature for r in found if r.doc_id in (19, 20)}) == 1
    codecs = {r.feature.split(";")[0] for r in found}
    assert codecs == {codec} if codec else codecs == set(media_audio.CODECS)
    # What is stored expands to the PCM, whatever the codec: file by file, block by block.
    for r in found:
        raw = next((x[1] or "").encode() for x in rows if x[0] == r.doc_id)
        payload = media_audio.payload_of(raw)
        name = r.feature.split(";")[0]
        wave = np.concatenate([media_audio.decode_adpcm(np.frombuffer(payload[k : k + 192], np.uint8)[None])[0] for k in range(0, len(payload), 192)]) if name == "adpcm" else media_audio.TABLES[name][np.frombuffer(payload, np.uint8)]
        assert r.pcm == media_audio.resample(wave, 8000, 16000).tobytes()
    assert media_audio.decode_audio(media_audio.store_audio(empty)).count() == 0
    clashing = media_audio.store_audio(docs, codec=codec).withColumns({"Feature": F.lit("old"), "a.b": F.lit(1), "row": F.lit(2)})
    decoded = media_audio.decode_audio(clashing)
    assert decoded.columns == ["doc_id", "n_bytes", "a.b", "row", *media_audio.ADDED] and "old" not in {r.feature for r in decoded.collect()}


def brute_fingerprint(text, size):
    import xxhash

    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))] if words else []
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(n, find(n)) for p in pairs if p[0] != p[1] for n in p}


def test_simhash(spark, docs, empty, rows):
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = {f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in base for _ in range(12)} | {0, (1 << 64) - 1, 7}
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in prints]
    for distance in (1, 3, 6):
        found = Counter((r.u, r.v) for r in simhash.links(spark.createDataFrame(signed, "fp long"), distance).collect())
        want = {(a[0], b[0]) for a in signed for b in signed if a < b and bin((a[0] ^ b[0]) & (2**64 - 1)).count("1") <= distance}
        assert set(found) == want and set(found.values()) == {1}
        joined = {(r.u, r.v) for r in simhash.joining_links(spark.createDataFrame(signed, "fp long").selectExpr("fp", "fp AS name"), distance).collect()}
        assert joined <= want and components_of(joined) == components_of(want)
    out = simhash.near_duplicates(docs).collect()
    fps = [(r[0], brute_fingerprint(r[1], 3)) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{f:016x}") for i, f in fps)
    roots = {f: f for _, f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a in list(roots):
        for b in list(roots):
            if bin(a ^ b).count("1") <= 3:
                roots[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    assert {(r.doc_id, r.component_id) for r in out} == {(i, least[find(f)]) for i, f in fps}
    assert simhash.near_duplicates(empty).count() == 0


def test_allocation_is_least():
    from itertools import combinations, product

    rng = random.Random(3)
    for _ in range(50):
        costs = [[0.0, *(rng.random() * 10 for _ in range(4))] for _ in range(3)]
        total, chosen = simhash.allocate(costs, 4)
        best = min(sum(row[t] for row, t in zip(costs, ts)) for ts in product(range(5), repeat=3) if sum(ts) == 4)
        assert total == pytest.approx(best) and sum(t + 1 for t in chosen) == 4


def test_drop_near_copies(docs, empty, rows):
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id for r in kept.collect()}
    # 12, 13 are equal, 14 and 15 are near; 19 and 20 are equal; 0, 1 and 2 have no words.
    assert 12 in found and not {13, 14, 15} & found and 19 in found and 20 not in found
    assert {3, 4, 5, 6, 7, 8, 9, 18} <= found and len({0, 1, 2} & found) == 1
    assert simhash.drop_near_copies(empty).count() == 0


def jaccard(a, b, size=5):
    """Similarity of the sets of shingles, as sets of strings; 1 for two texts without words."""
    x, y = ({" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def brute_stay(rows, least=0.8):
    """Ids of the texts that are the first of their group; rows: (id, text) of different texts."""
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in combinations(rows, 2):
        if jaccard(a, b) >= least:
            u, v = sorted((find(i), find(j)))
            parent[v] = u
    return {i for i in parent if find(i) == i}


def test_drop_near_copies_beyond_the_distance(spark):
    rng = random.Random(21)
    made = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 5, 9, 60, 150]))]
        other = list(words)
        for _ in range(rng.randint(1, 3)):
            other[rng.choice([0, -1, rng.randrange(len(other))])] = f"x{rng.randrange(5000)}"
        made += [" ".join(words), " ".join(other), " ".join(words + ["end"])]
    rows = list(enumerate(made))
    far = [
        (i, j) for (i, a), (j, b) in combinations(rows, 2)
        if jaccard(a, b) >= 0.8 and bin(simhash.fingerprint(a, 3) ^ simhash.fingerprint(b, 3)).count("1") > 6
    ]
    assert far
    found = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == brute_stay(rows)


def test_a_crowd_of_near_copies(spark, monkeypatch):
    """Crowds, chains and texts that share a passage only; small sides broadcast or not."""
    rng = random.Random(33)
    passage, made = [f"p{k}" for k in range(40)], []
    for crowd in range(3):
        base = [f"c{crowd}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(30):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(900)}"
            made.append(" ".join(other))
        made += [" ".join(base[:60] + passage + base[60:]), " ".join(passage + [f"o{crowd}{k}" for k in range(50)])]
    chain = [f"s{k}" for k in range(400)]
    made += [" ".join(chain[12 * k : 12 * k + 150]) for k in range(20)]
    rng.shuffle(made)
    first = {}
    for i, t in enumerate(made):
        first.setdefault(t, i)
    want = brute_stay([(i, t) for t, i in first.items()])
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(6)
    assert {r.doc_id for r in simhash.drop_near_copies(df).collect()} == want
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert {r.doc_id for r in simhash.drop_near_copies(df).collect()} == want


def test_an_id_with_several_texts(spark):
    texts = [" ".join(f"{x}{k}" for k in range(80)) for x in "abc"]
    rows = [(1, texts[0]), (2, texts[0] + " end"), (2, texts[1]), (3, texts[2]), (3, texts[2]), (4, texts[1] + " end"), (None, texts[2])]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[2], rows[3], rows[4], rows[6]])


def test_rolling_sets(rows):
    for r in rows:
        raw = (r[1] or "").encode()
        words = raw.lower().split()
        assert len(rolling.word_hashes(raw)) == len(words) and len(set(rolling.word_hashes(raw).tolist())) == len(set(words))
        assert len(rolling.shingle_set(raw, 5)) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
        assert simhash.text_key(raw) >= 0


def test_near_copies_of_one_fingerprint(spark):
    line = " ".join(f"line{k}" for k in range(9)) + " "
    own = [" ".join(f"{x}{k}" for k in range(60)) for x in "abb"]
    rows = [(i, line * 60 + t + tail) for i, (t, tail) in enumerate(zip(own, ("", "", " other end")))]
    assert len({simhash.fingerprint(t, 3) for _, t in rows}) == 1
    assert brute_stay(rows) == {0, 1}
    found = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {0, 1}


@pytest.mark.parametrize("edges", [100_000, 50])
def test_components(spark, monkeypatch, edges):
    monkeypatch.setattr(components, "PART_EDGES", edges)
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7)]
    want = components_of(pairs)
    found = connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {(r.node, r.root) for r in found} == want and len(found) == len(want)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    stars = [(0, i) for i in range(1, 900)] + [(2000, i) for i in range(800, 1500)] + [(3000 + i, 3001 + i) for i in range(100)]
    assert {(r.node, r.root) for r in connected_components(spark.createDataFrame(stars, "u long, v long")).collect()} == components_of(stars)
