"""The pipeline against its stages replayed plainly, on a corpus of planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(("ba", "ne", "ti", "lo", "ru", "ka")) for _ in range(rng.randrange(1, 4)))
    at = tmp_path_factory.mktemp("corpus")
    passage = [word() + "q" for _ in range(25)]
    docs, labels = [], []
    for i in range(400):
        w = [word() for _ in range(rng.randrange(60, 160))]
        if i % 8 == 0:
            for _ in range(8):
                w[rng.randrange(len(w))] = rng.choice(("vilest", "scummy"))
        labels.append((i, i % 2, int(i % 8 == 0)))
        docs.append([i, w])
    docs[11][1][20:45] = passage
    for k, i in ((401, 1), (402, 3)):
        docs.append([k, list(docs[i][1])])
    docs[-1][1][5] = "changed"
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at)


def test_stages(spark, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    got = {}
    from strandloom.llm.common import Scratch

    scratch = Scratch(spark, "test-pipeline")
    for name, stage in cp.STAGES:
        docs = scratch.write(stage(spark, docs, corpus), name)
        got[name] = docs.collect()
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: sorted(r.doc_id for r in rows) for n, rows in got.items()}
    toxic = {i for i in range(0, 400, 8)}
    assert set(texts) - set(ids["toxicity"]) == toxic
    assert set(ids["toxicity"]) - set(ids["near_dedup"]) == {401, 402}
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {11}
    assert set(ids["mixing"]) == set(ids["decontamination"]) and len(ids["mixing"]) > len(ids["decontamination"])
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in sorted(got["token_output"], key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1)
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got["token_output"], key=lambda r: r.start)] == ids["mixing"]
    assert sorted(map(tuple, cp.run(spark, corpus).collect())) == sorted(map(tuple, got["token_output"]))


def test_empty(spark, corpus, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_columns_of_any_name(spark, corpus, tmp_path):
    """Nulls, repeated rows, a very long text, and columns that operators use themselves."""
    from pyspark.sql import functions as F

    plain = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = plain.where("doc_id % 8 <> 0 AND doc_id NOT IN (11, 401, 402)")
    odd = spark.createDataFrame([(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "no id at all here", "en", "s", 1), (1002, "lone " * 60_000, "en", "s", 2)], plain.schema)
    again = kept.where("doc_id = 1")
    names = ["score", "predicted", "domain", "rate", "copies", "posteriors", "n_tokens", "value", "items", "kept", "n_shingles", "spans"]
    docs = plain.unionByName(odd).unionByName(again).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in names})
    want = {r.doc_id for r in kept.collect()} | {1000, 1001, None, 1002}
    columns = docs.columns
    from strandloom.llm.common import Scratch

    scratch = Scratch(spark, "test-odd")
    for name, stage in cp.STAGES:
        docs = scratch.write(stage(spark, docs, corpus), name)
        if name == "token_output":
            break
        assert docs.columns == columns
        rows = docs.collect()
        assert all(r[c] == c + ("?" if r.doc_id is None else str(r.doc_id)) for r in rows for c in names)
        assert want <= {r.doc_id for r in rows}
        assert sum(r.doc_id == 1 for r in rows) >= 2  # rows that repeat an id with its text share their fate
    assert {r.doc_id for r in rows} == want == {r.doc_id for r in docs.collect()}
    one = {r.doc_id: r.n_tokens for r in docs.collect()}
    assert one[1000] == one[1001] == 1 and one[1002] > 60_000


def test_a_result_outlives_the_pipeline(spark, corpus):
    """Stages clear their own tables and nobody else's."""
    from strandloom.llm import exact_dedup

    held = exact_dedup.exact_dedup(spark.read.parquet(f"{corpus}/documents.parquet"))
    cp.run(spark, corpus).count()
    assert held.where("kept").count() == 402 - 1
