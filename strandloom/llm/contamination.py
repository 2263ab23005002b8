"""Benchmark decontamination by a hash set of normalised test n-grams.

Words are runs of digits, letters and bytes above 0x7F after A-Z go to lower case. A
benchmark item gives its windows of ``n`` words (a shorter item is one window). Their
hashes set bits of a table of 16 bits a window, sent with the plan; every window of every
document is tested against it in the scan. A table has at most ``MAX_BITS`` bits: a
larger benchmark is dealt by hash into as many slices as need be, each with a table and a
scan of its own, so that tables are equally thin at every size. A set bit is only a
candidate: candidates carry their words and are verified by an equi-join with the
benchmark's own windows, so the table's size sets speed and never the result.

Defined results: a null text has no words; an item without words has no windows; an
empty benchmark hits nothing. Rows that repeat an id are judged each on its own.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, ascii_lower, left_join_sized, let, passthrough, quoted, table

RESULT = ("n_words", "n_hit", "n_items", "items", "spans", "contaminated")
#: Fixed value: what separates words once A-Z are in lower case.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
MAX_BITS = 1 << 24
BITS_EACH = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATOR), "")


def _windows(w: Column, size: int, test=None) -> Column:
    """The windows of ``size`` words as structs (pos, len, win), those that pass ``test``."""
    at = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(w, i, size)).alias("h")))
    if test is not None:
        at = F.filter(at, lambda x: test(x.h))
    full = F.transform(at, lambda x: F.struct((x.i - 1).alias("pos"), F.lit(size).alias("len"), F.array_join(F.slice(w, x.i, size), " ").alias("win")))
    return F.when(F.size(w) >= size, full).otherwise(F.array().cast("array<struct<pos:int,len:int,win:string>>"))


def benchmark_windows(bench: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, len, win, h) rows of a benchmark table."""
    w = bench.select(quoted(item_col).cast("string").alias("item"), words(F.coalesce(quoted(text_col), F.lit(""))).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    each = w.select("item", size.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, F.least(F.size("w"), F.lit(n))))).alias("x"))
    return each.select("item", "len", F.array_join("x", " ").alias("win"), F.xxhash64("x").alias("h")).distinct()


def _bit_test(bench_windows: DataFrame, n_windows: int):
    """A predicate over window hashes that holds for every benchmark window."""
    bits = 1 << 12
    while bits < min(BITS_EACH * n_windows, MAX_BITS):
        bits *= 2
    slot = F.pmod(F.col("h"), F.lit(bits))
    masks = bench_windows.select(slot.alias("s")).distinct().groupBy(F.shiftright("s", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("mask"))
    table_of = [0] * (bits // 64)
    for row in masks.collect():  # at most MAX_BITS / 64 rows
        table_of[row.word] = row.mask
    literal = F.from_json(F.lit(json.dumps(table_of, separators=(",", ":"))), "array<bigint>")

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(bits))
        mask = F.get(literal, F.shiftright(at, 6).cast("int"))
        return F.getbit(mask, at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test


def find_contamination(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", bench_text_col: str = "text", carry: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``docs`` (their ``carry`` columns, all by default) with the RESULT columns.

    ``spans`` lists hit stretches of words as (first, last), ``items`` the ids of the
    items with occurring windows, as sorted strings.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contamination")
    text = quoted(text_col)
    every = scratch.write(benchmark_windows(bench, n, item_col, bench_text_col), "windows")
    n_windows = every.count()
    lengths = sorted(r[0] for r in every.select("len").distinct().collect())  # at most n
    source = docs if carry is None else docs.select(*[quoted(c) for c in {*carry, text_col}])
    plain = [c for c in passthrough(source, RESULT) if carry is None] if carry is None else [quoted(c) for c in carry]
    none = F.array().cast("array<struct<pos:int,len:int,win:string>>")

    def scanned_for(part: DataFrame, size: int):
        tested = _bit_test(part, size) if size else None
        found = let(words(F.coalesce(quoted(text_col), F.lit(""))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), (F.flatten(F.array(*[_windows(w, n, tested) for n in lengths])) if tested else none).alias("cands")))
        return found.alias("__found")

    slices = max(1, -(-BITS_EACH * n_windows // MAX_BITS))
    of_slice = lambda k: every.where(F.pmod(F.shiftright("h", 40), F.lit(slices)) == k)
    # written once: row numbers are fixed from here on; further slices go by them
    scanned = source.select(*plain, F.monotonically_increasing_id().alias("__row"), *([text.alias("__text")] if slices > 1 else []), scanned_for(of_slice(0), -(-n_windows // slices)))
    scanned = scratch.write(scanned.select(*plain, "__row", "__found.*", *(["__text"] if slices > 1 else [])), "scanned")
    cands = scanned.select("__row", "cands")
    for k in range(1, slices):
        more = scanned.withColumnRenamed("__text", text_col) if text_col not in scanned.columns else scanned.drop(text_col).withColumnRenamed("__text", text_col)
        cands = cands.unionByName(scratch.write(more.select("__row", scanned_for(of_slice(k), -(-n_windows // slices))).select("__row", "__found.cands"), f"slice{k}"))
    cands = cands.where(F.size("cands") > 0).select("__row", F.explode("cands").alias("c")).select("__row", "c.pos", "c.len", "c.win")
    known = every.select("len", "win").distinct()
    small = n_windows * 160 <= broadcast_bytes
    hits = cands.join(F.broadcast(known) if small else known, ["len", "win"], "left_semi")
    hits = scratch.write(hits, "hits")
    spans = hits.groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("len") - 1).alias("last")))).alias("at"))
    merged = F.aggregate(
        "at",
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1).last >= x.pos - 1),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).first.alias("first"), F.greatest(F.element_at(acc, -1).last, x.last).alias("last")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x.pos.alias("first"), x.last.alias("last"))))),
    )
    spans = spans.select("__row", merged.alias("spans"))
    occurring = hits.select("__row", "len", "win").distinct()
    items_of = every.select("len", "win", "item")
    items = occurring.join(F.broadcast(items_of) if small else items_of, ["len", "win"]).groupBy("__row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = scratch.write(spans.join(items, "__row"), "judged")
    out = left_join_sized(scanned.drop("cands", "__text"), judged, ["__row"], 512, F.col("__row"), broadcast_bytes)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda a, x: a + x.last - x.first + 1), F.lit(0)).cast("long")
    return out.select(
        *plain,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size(F.coalesce("items", F.array().cast("array<string>"))), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_documents(judged: DataFrame) -> DataFrame:
    """The clean rows of ``find_contamination``'s result, without its own columns."""
    return judged.where(~F.col("contaminated")).select(*passthrough(judged, RESULT))


def clean_documents(docs: DataFrame, bench: DataFrame, n: int = 10, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` without hits, as they are.

    Whether a text is hit is a function of the text, so the hit ones are known by a
    128-bit hash of it and anti-joined: texts are neither copied nor, while the hit
    ones are few, shuffled.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    keyed = docs.withColumns({"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit("second"), text)})
    judged = find_contamination(keyed, bench, n, text_col, carry=["__t1", "__t2"], broadcast_bytes=broadcast_bytes)
    hit = Scratch(docs.sparkSession, "contaminated").write(judged.where("contaminated").select("__t1", "__t2").distinct(), "texts")
    small = hit.count() * 24 <= broadcast_bytes
    return keyed.join(F.broadcast(hit) if small else hit, ["__t1", "__t2"], "left_anti").select(*[quoted(c) for c in docs.columns])


def remove_spans(judged: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows, with hit words (and what follows each up to the next word) cut from the text."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    head = F.regexp_extract(text, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all(text, F.lit(WORD + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    kept = let(pieces, lambda p: F.filter(p, lambda _, i: ~F.exists("spans", lambda s: (i >= s.first) & (i <= s.last))))
    cut = F.when(F.size("spans") == 0, quoted(text_col)).otherwise(F.concat(head, F.array_join(kept, "")))
    return judged.select(*[cut.alias(c) if c == text_col else quoted(c) for c in judged.columns if c not in RESULT])


def op4_decontaminate(spark, sf_dir):
    judged = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {
    "op4_decontaminate": r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
    bl AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
    sizes AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw USING (n, win)),
    hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
    hi AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)"""
}
