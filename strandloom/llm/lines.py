"""Line deduplication over levelled sorted runs of line hashes.

A run holds, per line key, in how many documents of one batch it occurs: two 64-bit
hashes and a count, sorted by hash within hash partitions. A batch adds a run to
level 0; when a level has ``fanout`` runs they are merged into one run of the next
level. Keys whose counts over all runs reach ``min_docs`` are frequent, and their
lines are anti-joined away from any batch.

Two seeds of a 64-bit hash stand for a key: at 10**13 distinct lines some pair of
keys collides with a probability under 10**-12.

Defined results: a null or empty text is one empty line. Keys under ``min_chars``
code points are never dropped. Rows that repeat an id are documents of their own.
An empty table gives an empty result; columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, ascii_lower, let, left_join_sized, passthrough, quoted, table

RESULT = ("n_lines", "n_dropped", "kept_text")
#: Fixed value: the white space stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """Keys of a text's lines, in order: stripped at both ends, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.trim(x, F.lit(SPACE)))


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class LineRuns:
    """The levelled runs. ``add`` counts a batch of documents, ``strip`` applies the counts."""

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = 1):
        self.scratch = Scratch(spark, "line-runs")
        self.fanout, self.min_chars = fanout, min_chars
        self.levels: list[list[tuple[str, DataFrame]]] = []
        self.made = 0

    def _put(self, level: int, counts: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        name, self.made = f"level{level}/run{self.made}", self.made + 1
        self.levels[level].append((name, self.scratch.write(counts.sortWithinPartitions("h1", "h2"), name)))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._merge([df for _, df in runs]))
            for old, _ in runs:
                self.scratch.drop(old)

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        every = runs[0]
        for df in runs[1:]:
            every = every.unionByName(df)
        return every.groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        keys = F.array_distinct(line_keys(F.coalesce(quoted(text_col), F.lit(""))))
        each = docs.select(F.explode(keys).alias("key")).where(F.char_length("key") >= self.min_chars)
        self._put(0, each.select(*key_hashes(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n")))

    def frequent(self, min_docs: int) -> DataFrame | None:
        runs = [df for level in self.levels for _, df in level]
        if not runs:
            return None
        counts = runs[0] if len(runs) == 1 else self._merge(runs)
        return self.scratch.write(counts.where(F.col("n") >= min_docs).select("h1", "h2"), f"frequent{self.made}-{min_docs}")

    def strip(self, docs: DataFrame, min_docs: int, text_col: str = "text", id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Every row with n_lines, n_dropped and kept_text (its other lines, joined by newline).

        Which line numbers go is a function of the text alone, so decisions are kept
        by a 128-bit hash of the text: rows that repeat a text share one decision.
        """
        text = F.coalesce(quoted(text_col), F.lit(""))
        same = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]
        out = docs.select(*passthrough(docs, RESULT), text.alias("__text"), quoted(id_col).alias("__id"), *same)
        frequent = self.frequent(min_docs)
        if frequent is None:
            out = out.withColumn("drop_at", F.lit(None).cast("array<int>"))
        else:
            at = docs.select(*same, F.posexplode(line_keys(text)).alias("pos", "key")).where(F.char_length("key") >= self.min_chars)
            at = at.select("t1", "t2", "pos", *key_hashes(F.col("key")))
            small = frequent.count() * 32 <= broadcast_bytes
            hits = at.join(F.broadcast(frequent) if small else frequent, ["h1", "h2"])
            gone = self.scratch.write(hits.groupBy("t1", "t2").agg(F.collect_set("pos").alias("drop_at")), f"gone{self.made}")
            # about one decision a text: grows with the corpus, so it is met in a shuffle at every size
            out = left_join_sized(out, gone, ["t1", "t2"], 48, F.col("__id"), limit=-1)
        lines = F.split("__text", "\n")
        kept = let(lines, lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("drop_at")), lambda i: F.get(x, i)))
        whole = F.when(F.col("drop_at").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n"))
        return out.select(
            *passthrough(docs, RESULT),
            F.size(lines).cast("long").alias("n_lines"),
            F.coalesce(F.size("drop_at"), F.lit(0)).cast("long").alias("n_dropped") if frequent is None else F.when(F.col("drop_at").isNull(), F.lit(0)).otherwise(F.size("drop_at")).cast("long").alias("n_dropped"),
            whole.alias("kept_text"),
        )


def line_dedup(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 4, text_col: str = "text", id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop, everywhere, the lines whose keys occur in at least ``min_docs`` documents."""
    runs = LineRuns(docs.sparkSession, fanout)
    for b in range(batches):
        runs.add(docs.where(F.pmod(F.xxhash64(quoted(id_col)), F.lit(batches)) == b), text_col)
    return runs.strip(docs, min_docs, text_col, id_col, broadcast_bytes)


def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLES = {
    "op8_line_dedup": """
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
    k AS (SELECT rid, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
    f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
    m AS (SELECT k.rid, k.pos, k.line, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
    g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                 coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY rid)
    SELECT d.doc_id, g.n_lines, g.n_dropped, sha256(g.kept) AS kept_sha256 FROM d JOIN g USING (rid)"""
}
