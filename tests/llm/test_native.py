"""Exact dedup, decontamination, WARC and line dedup: SQL oracles and odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from differential import assert_same
from strandloom.llm import contamination as ct
from strandloom.llm import exact_dedup as ed
from strandloom.llm import lines as ln
from strandloom.llm import warc as wc
from strandloom.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], ORACLES[name])


def test_no_python_on_native_paths(spark):
    """Plans of the native operators hold no Python node."""
    for name in ("op2_exact_dedup", "op4_decontaminate", "op8_line_dedup", "op1_mixing"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


ODD = [(1, "same"), (2, "same"), (3, None), (4, ""), (None, "same"), (None, "alone"), (5, "x" * 100_000), (6, "x" * 99_999 + "y"), (2, "same"), (7, "sam")]


@pytest.mark.parametrize("limit", [8 << 20, 0])
@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup_odd_rows(spark, limit, digest_all):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("Kept", F.lit("clash"))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(df, digest_all=digest_all, broadcast_bytes=limit, beside_texts=limit).collect()), key=str)
    want = []
    for i, t in ODD:
        ids = [j for j, u in ODD if (u or "") == (t or "")]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep))
    assert got == sorted(want, key=str)
    assert ed.exact_dedup(df.limit(0), digest_all=digest_all, broadcast_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_exact_dedup_keeps_its_levels_at_every_size(spark, limit):
    df = spark.createDataFrame([(k, "x" * (k % 40) + str(k % 7)) for k in range(200)], "doc_id long, text string")
    plan = ed.exact_dedup(df, broadcast_bytes=limit, beside_texts=limit)._jdf.queryExecution().toString()
    assert "lengths" not in plan and "prefixes" in plan  # the last level's keys decide whose text is hashed


def test_benchmarks_of_several_slices(spark, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(14))) for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"start w{k}x1 " + " ".join(f"w{k}x{j}" for j in range(2, 12)) + " end") for k in range(60)], "doc_id long, text string")
    whole = sorted(map(str, ct.find_contamination(docs, bench).drop("__row").collect()))
    monkeypatch.setattr(ct, "MAX_BITS", 1 << 10)
    assert sorted(map(str, ct.find_contamination(docs, bench).collect())) == whole
    assert sorted(map(str, ct.find_contamination(docs, bench, carry=["doc_id"]).select("doc_id").collect())) == sorted(map(str, docs.select("doc_id").collect()))


def test_exact_dedup_digest(spark):
    df = spark.createDataFrame([(1, "é"), (2, None)], "doc_id long, text string")
    assert {r.text_sha256 for r in ed.exact_dedup(df, digest_all=True).collect()} == {hashlib.sha256(x).hexdigest() for x in ("é".encode(), b"")}


BENCH = [(10, "One two three four five six seven eight nine ten ELEVEN"), (11, "short item"), (12, None), (13, "..."), (14, "Éa ñb")]


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_decontamination_odd_rows(spark, limit):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = [
        (1, "zero one TWO, three four-five six seven eight nine ten zero"),
        (2, "one two three four five six seven eight nine"),
        (3, "a short item, a Short-Item!"),
        (4, None),
        (5, ""),
        (6, "éa ñb Éa ñb"),
        (None, "short item"),
        (7, "w " * 30000 + "short item"),
        (1, "clean"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    judged = ct.find_contamination(df, bench, broadcast_bytes=limit)
    got = {(r.doc_id, r.text): (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in judged.collect()}
    want = [(12, 10, ["10"], True), (9, 0, [], False), (6, 4, ["11"], True), (0, 0, [], False), (0, 0, [], False), (4, 2, ["14"], True), (2, 2, ["11"], True), (30002, 2, ["11"], True), (1, 0, [], False)]
    assert [got[d] for d in docs] == want
    assert sorted(str(r.text) for r in ct.remove_documents(judged).collect()) == sorted(str(d[1]) for d, w in zip(docs, want) if not w[3])
    clean = ct.clean_documents(df, bench, broadcast_bytes=limit)
    assert clean.columns == df.columns and clean.count() == sum(not w[3] for w in want)
    cut = {r.doc_id: r.text for r in ct.remove_spans(judged).where("doc_id IN (3, 6)").collect()}
    assert cut == {3: "a a ", 6: "éa ñb "}
    assert not any(r.contaminated for r in ct.find_contamination(df, bench.limit(0)).collect())
    assert ct.find_contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("chunk", [7, 1 << 18])
def test_warc_round_trip_and_format(spark, chunk):
    big, other = "é" * 700, "b" * 1000
    pages = [(1, "http://a/\r\nx", big), (2, "http://b", big), (3, None, "s"), (4, "http://c", "s"), (5, "http://d", None), (None, "http://e", "null id"), (6, "http://f", other), (7, "http://g", ""), (2, "http://b", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    chunks = wc.write_archives(df, chunk_bytes=chunk)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in wc.read_archives(chunks).collect())
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        first = max(j for j, _, x in pages if j is not None and x == h) if len(data) >= 1000 else i
        want.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "response" if first == i else "revisit", "None" if first == i else str(first)))
    assert got == sorted(want)
    one = b"".join(bytes(r.data) for r in chunks.orderBy("archive", "record_id", "chunk_no").collect())
    records = re.split(rb"(?=WARC/1\.1\r\n)", one)[1:]
    assert len(records) == len(pages)
    for r in records:
        head, body = r.split(b"\r\n\r\n", 1)
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4 and body.endswith(b"\r\n\r\n")
    assert max(len(r.data) for r in chunks.where("running_sha1 IS NOT NULL").collect()) <= chunk
    assert wc.read_archives(wc.write_archives(df.limit(0))).count() == 0


def test_warc_reader_finds_damage():
    rows = [r[1:] for r in wc.record_chunks(0, 1, 5, "http://a", memoryview(b"abcdef"), hashlib.sha1(b"abcdef").hexdigest(), None, 4)]
    assert [r[5] for r in wc.read_records(iter(rows))] == ["response"]
    for broken in (rows[:1] + rows[2:], rows[:-1], rows[:1] + [(rows[1][0], 1, b"abcX", rows[1][3])] + rows[2:]):
        with pytest.raises(ValueError):
            list(wc.read_records(iter(broken)))


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_line_dedup_odd_rows(spark, limit):
    docs = [(i, f" Common\t\nown {i}\n\nTWICE\ntwice") for i in range(4)] + [(50, None), (51, ""), (52, "\n"), (None, "common"), (53, "x\n" * 20000 + "common"), (54, "Écommon"), (50, "common")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in ln.line_dedup(df, min_docs=4, batches=3, fanout=2, broadcast_bytes=limit).collect()), key=str)
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x).strip(" \t\n\x0b\x0c\r")
    seen = {}
    for n, (_, t) in enumerate(docs):
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(n)
    gone = {k for k, v in seen.items() if k and len(v) >= 4}
    want = []
    for i, t in docs:
        parts = (t or "").split("\n")
        kept = [x for x in parts if key(x) not in gone]
        want.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    assert got == sorted(want, key=str)
    assert ln.line_dedup(df.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = ln.LineRuns(spark, fanout=2)
    df = spark.createDataFrame([(i, "a\nb") for i in range(8)], "doc_id long, text string")
    for i in range(5):
        runs.add(df.where(F.col("doc_id") == i))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.n for r in runs.levels[2][0][1].collect()} == {4}
    assert runs.frequent(5).count() == 2 and runs.frequent(6).count() == 0
    assert {r.kept_text for r in runs.strip(df, 5).collect()} == {""}
