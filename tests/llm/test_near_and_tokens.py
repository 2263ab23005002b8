"""Brute-force checks of near-duplicate documents, token files and toxicity."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import near_dedup as nd
from strandloom.llm import token_files as tf
from strandloom.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def words(text):
    return bytes(text or "", "utf8").translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k):
    """doc id -> smallest id reachable, by all pairs of sets."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {n: n for n in range(len(sets))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    posting = {}
    for n, (_, s) in enumerate(sets):
        tried = set()
        for x in s:
            for m in posting.get(x, ()):
                if m not in tried:
                    tried.add(m)
                    both = len(s & sets[m][1])
                    if 100 * both >= 80 * (len(s) + len(sets[m][1]) - both):
                        a, b = find(n), find(m)
                        root[max(a, b)] = min(a, b)
            posting.setdefault(x, []).append(n)
    least = {}
    for n, (i, _) in enumerate(sets):
        r = find(n)
        known = [v for v in (least.get(r), i) if v is not None]
        least[r] = min(known) if known else None
    return [(i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_equals_all_pairs(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.id, r.n_shingles, r.component_id) for r in nd.near_dedup(docs, shingle=k).collect()}
    assert got == set(brute([(r.doc_id, r.text) for r in docs.collect()], k))


def test_near_dedup_chain_and_odd_rows(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    chain = []  # each differs from the next by a few words, the ends by many
    for _ in range(12):
        chain.append(" ".join(base))
        for _ in range(6):
            base[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
    rows = [(i, t) for i, t in enumerate(chain)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "ONE"), (105, "one two"), (None, chain[0]), (None, None), (106, "x " * 30000), (103, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    for limit in (8 << 20, 0):
        got = sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in nd.near_dedup(df, shingle=2, broadcast_bytes=limit, beside_texts=limit).collect())
        assert got == sorted((str(i), n, str(c)) for i, n, c in brute(rows, 2))
    judged = nd.near_dedup(df, shingle=2)
    kept = nd.keep_one_each(df, judged)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {100, 101, 102, 103, 105, 106}
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_one_component_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(7)
    stem = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(stem)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.n_shingles, r.component_id) for r in nd.near_dedup(df, shingle=2).collect()}
    assert got == set(brute(rows, 2))


def test_registers_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 4000, dtype=np.int64).astype(np.uint64)
        b = a.copy()
        n = int(len(a) * (1 - share) / (1 + share))
        b[:n] = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        got, _ = nd.estimate(nd.registers(np.unique(a)), nd.registers(np.unique(b)), 4000, 4000)
        assert abs(got - share) < 0.13


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def expected(path, rows):
    from tokenizers import Tokenizer

    tok, out, at = Tokenizer.from_file(path), [], 0
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        data = b"".join(x.to_bytes(4, "little") for x in ids)
        out.append((i, at, len(ids), zlib.crc32(data)))
        at += len(ids)
    return out


@pytest.mark.parametrize("size", [tf.SHARD_TOKENS, 20_000])
def test_token_files_round_trip(spark, tokenizer_path, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards = tf.write_shards(docs, tokenizer_path, shard_tokens=size)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tf.with_starts(tf.read_documents(shards), shards).collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(got) == expected(tokenizer_path, rows)
    first = tf.Shard(shards.orderBy("shard", "part").first().payload)
    assert first.rules.size and first.sizes.max() > 2


def test_token_files_odd_rows(spark, tokenizer_path):
    texts = [None, "", " ", "a b", "x y z", "É́ ́ é", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΑΣ. İstanbul, İ.", "it's we'll 'S", "a.. b., É. x́̂. ½. 5. a5, ... <|ENDOFTEXT|>.", "a\x1cb\x85c", "ab " * 50000, "z" * 30000, "日本語 text"]
    rows = list(enumerate(texts)) + [(3, "again"), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shards = tf.write_shards(df, tokenizer_path)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in tf.read_documents(shards).collect()}
    assert got == {(i, n, c) for i, _, n, c in expected(tokenizer_path, rows)}
    assert tf.read_documents(tf.write_shards(df.limit(0), tokenizer_path)).count() == 0


def test_a_shard_takes_little_memory(tokenizer_path):
    """Two tasks of an executor build shards beside a JVM that has grown in earlier stages."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    texts = pc.fill_null(pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"], "").combine_chunks()
    upto = int(np.searchsorted(np.cumsum(pc.binary_length(texts).to_numpy()), 2 * tf.SHARD_TOKENS))
    tf.build_shard(tokenizer_path, texts.slice(0, 10), 2)  # loads the tokenizer
    tracemalloc.start()
    try:
        payload, n_tokens = tf.build_shard(tokenizer_path, pa.concat_arrays([texts.slice(0, upto)]), 2)
        now, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert n_tokens > 3_000_000
    assert peak < 110e6 and now - len(payload) < 10e6  # what is held on to are the ids of known words


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = tox.op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    hits = scored.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right")).collect()
    assert {r.toxic for r in hits} == {0, 1} and all(r.right > (0.97, 0.6)[r.toxic] for r in hits), hits
    assert docs.count() == scored.sparkSession.read.parquet("/root/testdata/sf0.1/documents.parquet").count()


def test_toxicity_finds_held_out_rows_that_show_anything(spark):
    """In sf0.1 two toxic labels of five are on texts without any sign; of those with one nearly all are found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    rows = [(r.doc_id, r.toxic, r.part, set(tox.split_words((r.text or "").encode()))) for r in docs.join(labels, "doc_id").select("doc_id", "toxic", "text", part.alias("part")).collect()]
    seen = {k: {} for k in (0, 1)}
    for _, toxic, p, words in rows:
        for w in words if p else ():
            seen[toxic][w] = seen[toxic].get(w, 0) + 1
    signs = {w for w, n in seen[1].items() if n >= 20 and w not in seen[0]}
    told = {i for i, toxic, p, words in rows if toxic and not p and words & signs}
    got = {r.doc_id: r.predicted for r in tox.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(told) > 40 and sum(got[i] for i in told) >= 0.95 * len(told)


def test_toxicity_model_equals_plain_kneser_ney():
    """Class-conditional top order, shared continuation counts below, with dictionaries."""
    vocabulary = [b"ab", b"abc", b"ba", b"cab", b"bad", b"abba", b"dab"]
    counts = [[5, 3, 4, 1, 0, 2, 6], [1, 0, 2, 7, 3, 0, 1]]
    order = tox.ORDER
    grams = [[(b"\x02" * (order - 1) + w + b"\x03")[i : i + order] for i in range(len(w) + 1)] for w in vocabulary]
    top = [{}, {}]
    for c in (0, 1):
        for w, n in zip(grams, counts[c]):
            for g in w:
                top[c][g] = top[c].get(g, 0) + n
    kinds = {order: set().union(*map(set, grams))}
    for n in range(order - 1, 0, -1):
        kinds[n] = {g[1:] for g in kinds[n + 1]}

    def shared(g):
        if not g:
            return 1 / 256
        left = {h: sum(x[1:] == h for x in kinds[len(g) + 1]) for h in kinds[len(g)]}
        d = tox._discount(np.array(list(left.values()), dtype=float))
        same = [k for h, k in left.items() if h[:-1] == g[:-1]]
        return max(left.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * shared(g[1:])

    def likelihood(c, g):
        same = [k for h, k in top[c].items() if h[:-1] == g[:-1] and k > 0]
        if not same:
            return shared(g[1:])
        return max(top[c].get(g, 0) - tox.TOP_DISCOUNT, 0) / sum(same) + tox.TOP_DISCOUNT * len(same) / sum(same) * shared(g[1:])

    model = tox.fit(vocabulary, *(np.array(c, dtype=float) for c in counts))
    got = tox.word_values(model, vocabulary)
    for w, value in zip(grams, got):
        ratio = sum(np.log(likelihood(1, g) / likelihood(0, g)) for g in w)
        assert np.isclose(value, np.log(1 - tox.SHARE + tox.SHARE * np.exp(min(ratio, 15))), rtol=1e-4)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "vile scum here") for i in range(200)] + [(None, "x"), (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(0, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in tox.toxicity(docs, labels).collect()}
    assert len(got) == 203 and got[0].predicted == 1 and got[1].predicted == 0 and 0 <= got[500].score <= 1
    assert tox.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert tox.toxicity(docs.limit(0), labels).count() == 0
