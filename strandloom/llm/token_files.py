"""Token ids in grammar-compressed shards (Re-Pair).

Documents are dealt by range of their id and sorted; each task cuts its documents into
shards of about ``shard_tokens`` ids. In a shard the most frequent pairs of neighbouring
symbols are replaced by new symbols until no pair is frequent: first inside the distinct
words, each weighted by how often it occurs, then along the whole text. A shard stores its
rules, each symbol's expansion length, the symbol stream, and per document where its
symbols and its ids start; since no rule reaches over a document's end, any document is
decoded alone. Layout of a shard (little-endian): ``MAGIC``, six uint32 (documents, rules, symbols,
vocabulary, end id, 0), rules 2 x uint32, expansion lengths uint32, symbol starts
uint32 and id starts uint64 (documents + 1 each), symbols uint32. Symbols below the
vocabulary are ids, ``vocabulary`` itself is the end id, those above are rules.
Shards are rows of a table (shard, part, n_tokens, doc_ids, payload) in shared storage.

Ids: the words between ASCII white space are encoded one by one and remembered, which
gives the ids of the whole text, as the tokenizer drops white space and joins nothing
over it; ``encode_batch`` of whole texts is the reference in tests.

Defined results: a null text is empty: the end id alone. Null ids come first. Rows that
repeat an id are documents of their own, ordered by their texts' hash. An empty table
gives no shards.
"""

from __future__ import annotations

import os
import struct
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, quoted, table, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"RPG1"
SHARD_TOKENS = 6_000_000
#: A pair is frequent in a shard from so many places on.
MIN_COUNT = 8
#: Places that are looked at in one go where a whole shard's would take much memory.
STEP = 1 << 18
#: Arrays of so many bytes go back to the system when they are dropped; smaller ones are reused.
MAPPED = 4 << 20
#: Distinct words whose ids a worker remembers.
CACHE = 600_000
SHARDS = "shard int, part int, n_tokens long, doc_ids array<bigint>, payload binary"
#: Fixed value: marks that the tokenizer parts from the letters before them.
MARKS = ".,;:!?"


def _kept() -> types.ModuleType:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_strandloom_kept", types.ModuleType("_strandloom_kept"))


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    kept = _kept()
    if getattr(kept, "path", None) != path:
        kept.tokenizer, kept.path = Tokenizer.from_file(path), path
        _forget(kept)
        kept.closes = np.zeros(kept.tokenizer.get_vocab_size(), dtype=bool)
        kept.closes[[i for k, i in kept.tokenizer.get_vocab().items() if k.endswith("</w>")]] = True
    return kept.tokenizer


def _forget(kept: types.ModuleType) -> None:
    """Remember the empty word alone: no mark, or white space at a text's end."""
    kept.words, kept.sizes, kept.flat = pa.array([""]), np.zeros(1, dtype=np.int32), np.zeros(0, dtype="<u4")


def _encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids one after another) of words.

    A word of letters is one unit of the tokenizer, which ends in an id that closes a
    word: such words are encoded many at a time and told apart by those ids.
    """
    tok, kept = _tokenizer(path), _kept()
    ids = [b""] * len(words)
    letters = [k for k, w in enumerate(words) if w.isalpha()]
    alone = [k for k, w in enumerate(words) if not w.isalpha()]
    for start in range(0, len(letters), 20_000):
        part = letters[start : start + 20_000]
        groups = [part[i : i + 200] for i in range(0, len(part), 200)]
        for group, e in zip(groups, tok.encode_batch_fast([" ".join([words[k] for k in g]) for g in groups], add_special_tokens=False)):
            got = np.array(e.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(kept.closes[got]) + 1)
            if len(ends) != len(group):
                alone += group
                continue
            packed, at = got.tobytes(), 0
            for k, end in zip(group, ends.tolist()):
                ids[k] = packed[at:end]
                at = end
    for start in range(0, len(alone), 20_000):
        part = alone[start : start + 20_000]
        for k, e in zip(part, tok.encode_batch_fast([words[k] for k in part], add_special_tokens=False)):
            ids[k] = np.array(e.ids, dtype="<u4").tobytes()
    return np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4, np.frombuffer(b"".join(ids), dtype="<u4")


def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words as the tokenizer splits them at the least: what is before a last mark, and the mark or nothing.

    A-Z are lower-cased as the tokenizer does itself, unless a special token's opening
    is among the words; a mark is only cut off right after a letter.
    """
    special = pc.match_substring(words, "<|")
    low = pc.if_else(special, words, pc.ascii_lower(words))
    body = pc.utf8_slice_codeunits(low, 0, -1)
    mark = pc.utf8_slice_codeunits(low, -1, 1 << 30)
    cut = pc.and_(pc.is_in(mark, pa.array(list(MARKS))), pc.utf8_is_alpha(pc.utf8_slice_codeunits(body, -1, 1 << 30)))
    cut = pc.and_not(cut, pc.ends_with(body, "\u0130"))  # its lower case ends in a mark of its own
    cut = pc.and_not(cut, pc.or_(special, pc.match_substring(low, "'")))
    return pc.if_else(cut, body, low), pc.if_else(cut, mark, "")


def _encode_distinct(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids one after another) of distinct words."""
    _tokenizer(path)
    kept = _kept()
    both = pa.concat_arrays(_parts(words)).dictionary_encode()
    pieces, at = both.dictionary.cast(pa.string()), both.indices.to_numpy().reshape(2, -1).T.reshape(-1)
    place = pc.index_in(pieces, value_set=kept.words)
    if place.null_count and len(kept.words) + place.null_count > CACHE:
        _forget(kept)
        place = pc.index_in(pieces, value_set=kept.words)
    new = place.is_null().to_numpy(zero_copy_only=False)
    place = pc.fill_null(place, 0).to_numpy().copy()
    if new.any():
        # in arrays they take a tenth of what a dictionary of words would
        missing = pieces.filter(pa.array(new))
        place[new] = np.arange(len(kept.words), len(kept.words) + len(missing))
        sizes, flat = _encode_words(path, missing.to_pylist())
        kept.words = pa.concat_arrays([kept.words, missing])
        kept.sizes, kept.flat = np.append(kept.sizes, sizes), np.append(kept.flat, flat)
    at, sizes = place[at], kept.sizes
    return sizes[at].reshape(-1, 2).sum(axis=1), _expand(kept.flat, np.cumsum(sizes, dtype=np.int64) - sizes, sizes, at)


def _expand(table_of: np.ndarray, starts: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """The entries of each symbol's stretch of a flat table, one after another; some symbols at a time, as places take more room than entries."""
    parts = [symbols[at : at + STEP] for at in range(0, len(symbols), STEP)]
    out = np.empty(sum(int(sizes[part].sum()) for part in parts), dtype=table_of.dtype)
    done = 0
    for part in parts:
        n = sizes[part].astype(np.int64, copy=False)
        ends = np.cumsum(n)
        total = int(ends[-1])
        out[done : done + total] = table_of[np.arange(total) + np.repeat(starts[part] - (ends - n), n)]
        done += total
    return out


class Grammar:
    """Rules of one shard, made by rounds of pair replacement."""

    def __init__(self, vocabulary: int):
        self.first = vocabulary + 1
        self.rules: list[np.ndarray] = []
        self.size = 0

    def reduce(self, seq: np.ndarray, closed: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Rounds over a sequence until no pair is frequent; ``closed[i]`` forbids a pair of i and its next.

        A round replaces, of the frequent pairs, those that no more frequent one overlaps.
        What is not frequent never becomes so, and a new pair has a new symbol in it: later rounds
        look at the places that were left over and at the neighbours of new symbols alone.
        The arrays given may be changed, and what is wanted of places is worked out some
        places at a time, as a task has little memory.
        """
        n = len(seq)
        seq, alive = seq.astype(np.uint32, copy=False), np.ones(n, dtype=bool)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        score = np.zeros(n + 1, dtype=np.float32)
        key_of = lambda x: (seq[x].astype(np.int64) << 32) | seq[after[x]]
        bucket_of = lambda x: ((key_of(x).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        steps = lambda x: [x[k : k + STEP] for k in range(0, len(x), STEP)]
        at = np.concatenate([x[~closed[x]] for x in steps(after[: n - 1] - 1)] or [after[:0]])
        while len(at):
            if len(at) > STEP:
                # pairs whose hash bucket is rare as a whole are rare: most go before they are told apart
                filled = np.zeros(1 << 20)
                for x in steps(at):
                    filled += np.bincount(bucket_of(x), None if weight is None else weight[x], 1 << 20)
                at = np.concatenate([x[filled[bucket_of(x)] >= MIN_COUNT] for x in steps(at)])
                del filled
                if not len(at):
                    break
            coded = pa.chunked_array([pa.array(key_of(x)) for x in steps(at)]).dictionary_encode()
            pairs, code = coded.chunk(coded.num_chunks - 1).dictionary.to_numpy(), np.concatenate([c.indices.to_numpy() for c in coded.chunks])
            del coded
            count = np.zeros(len(pairs))
            for k in range(0, len(at), 4 * STEP):
                part = slice(k, k + 4 * STEP)
                count += np.bincount(code[part], None if weight is None else weight[at[part]], len(pairs))
            count = count.astype(np.float32)
            often = (count >= MIN_COUNT)[code]
            at, code = at[often], code[often]
            if not len(at):
                break
            # of overlapping pairs the more frequent goes first, of equal ones the left
            score[at] = count[code]
            taken = np.concatenate([(score[x] > score[before[x]]) & (score[x] >= score[after[x]]) for x in steps(at)])
            score[at] = 0
            t, rule = at[taken], code[taken]
            at, code = at[~taken], code[~taken]
            r = after[t]
            used = np.zeros(len(pairs), dtype=bool)
            used[rule] = True
            which = pairs[used]
            self.rules.append(np.stack([which >> 32, which & 0xFFFFFFFF], axis=1).astype(np.uint32))
            seq[t] = (np.cumsum(used) + (self.first + self.size - 1)).astype(np.uint32)[rule]
            self.size += len(which)
            alive[r] = False
            closed[t] = closed[r]
            after[t] = follow = after[r]
            inside = follow < n
            before[follow[inside]] = t[inside]
            same = alive[at] & (after[at] < n)
            at, code = at[same], code[same]
            at = np.concatenate([at[:0], *(x[key_of(x) == pairs[c]] for x, c in zip(steps(at), steps(code)))])
            ahead = before[t]
            ahead = ahead[ahead >= 0]
            ahead, t = ahead[~closed[ahead]], t[inside & ~closed[t]]
            del pairs, code, count, often, taken, rule, used, which, r, follow, inside, same
            at = np.sort(np.concatenate([at, ahead, t]), kind="stable")  # three sorted runs
            at = at[np.append(at[1:] != at[:-1], True)] if len(at) else at
        return seq[alive], closed[alive]

    def table(self) -> np.ndarray:
        return np.concatenate(self.rules) if self.rules else np.zeros((0, 2), dtype=np.uint32)


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule stands for; rules refer to earlier ones only."""
    first = vocabulary + 1
    out = np.zeros(len(rules), dtype=np.uint32)
    if len(rules):
        depth_first = rules.max(axis=1)
        done = 0
        while done < len(rules):  # a round's rules use symbols of earlier rounds
            known = depth_first[done:] < first + done
            upto = done + (len(known) if known.all() else int(np.argmin(known)))
            side = [np.where(s < first, 1, out[np.maximum(s.astype(np.int64) - first, 0)]) for s in rules[done:upto].T]
            out[done:upto] = side[0] + side[1]
            done = upto
    return out


def build_shard(path: str, texts: pa.Array, end_id: int) -> tuple[bytes, int]:
    """The payload of documents given as an array of texts without nulls, and its number of ids."""
    vocabulary = _tokenizer(path).get_vocab_size()
    n_docs, split = len(texts), pc.ascii_split_whitespace(texts)
    del texts
    ends = split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
    words = split.flatten()
    coded = words.dictionary_encode()
    empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    flat = coded.indices.to_numpy()
    if empty.any():  # white space at a text's end
        stays = ~empty[flat]
        ends = np.append(0, np.cumsum(stays))[ends]
        flat = flat[stays]
    word_sizes, seq = _encode_distinct(path, coded.dictionary)
    # word 0 is the end of a document, one symbol of its own
    sizes, seq = np.append(1, word_sizes), np.append(vocabulary, seq)
    word_ends = ends + np.arange(1, len(ends) + 1)
    order = np.zeros(len(flat) + len(ends), dtype=np.int32)
    inside = np.ones(len(order), dtype=bool)
    inside[word_ends - 1] = False
    order[inside] = flat + 1
    del split, words, coded, flat, inside
    id_starts = np.append(0, np.append(0, np.cumsum(sizes[order]))[word_ends]).astype("<u8")

    grammar = Grammar(vocabulary)
    word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    closed = np.append(word_of[1:] != word_of[:-1], True)
    weight = np.bincount(order, minlength=len(sizes))[word_of].astype(float)
    seq, closed = grammar.reduce(seq, closed, weight)
    # the words' symbols again by word: each word's last symbol is closed
    filled = np.flatnonzero(sizes > 0)
    ends = np.flatnonzero(closed)
    n_symbols = np.zeros(len(sizes), dtype=np.int64)
    n_symbols[filled] = np.diff(ends, prepend=-1)
    starts = np.cumsum(n_symbols) - n_symbols
    stream = _expand(seq, starts, n_symbols, order)
    last = stream == vocabulary
    closed = last.copy()
    closed[:-1] |= last[1:]
    if len(closed):
        closed[-1] = True
    del seq, word_of, weight, ends, order, last
    stream, closed = grammar.reduce(stream, closed, None)
    rules = grammar.table()
    lengths = expansion_lengths(rules, vocabulary)
    symbol_starts = np.append(0, np.flatnonzero(stream == vocabulary) + 1).astype("<u4")
    header = struct.pack("<6I", n_docs, len(rules), len(stream), vocabulary, end_id, 0)
    parts = (rules.astype("<u4"), lengths.astype("<u4"), symbol_starts, id_starts, stream.astype("<u4", copy=False))
    return b"".join((MAGIC, header, *parts)), int(id_starts[-1])


class Shard:
    """A shard as read: whole or by document."""

    def __init__(self, payload):
        if bytes(payload[:4]) != MAGIC:
            raise ValueError("not a shard")
        self.n_docs, n_rules, n_symbols, self.vocabulary, end_id, _ = struct.unpack_from("<6I", payload, 4)
        at = 28

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += got.nbytes
            return got

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        lengths = take("<u4", n_rules)
        self.symbol_starts, self.id_starts = take("<u4", self.n_docs + 1), take("<u8", self.n_docs + 1)
        self.stream = take("<u4", n_symbols)
        first = self.vocabulary + 1
        self.sizes = np.concatenate([np.ones(first, dtype=np.int64), lengths.astype(np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.zeros(int(self.sizes.sum()), dtype="<u4")
        self.flat[:first] = np.arange(first)
        self.flat[self.vocabulary] = end_id
        top, done = self.rules.max(axis=1) if n_rules else np.zeros(0), 0
        while done < n_rules:
            known = top[done:] < first + done
            upto = done + (len(known) if known.all() else int(np.argmin(known)))
            lo, hi = self.starts[first + done], self.starts[first + upto - 1] + self.sizes[first + upto - 1]
            self.flat[lo:hi] = _expand(self.flat, self.starts, self.sizes, self.rules[done:upto].reshape(-1).astype(np.int64))
            done = upto

    def ids(self) -> np.ndarray:
        """The ids of all documents one after another."""
        return _expand(self.flat, self.starts, self.sizes, self.stream)

    def document(self, k: int) -> np.ndarray:
        """The ids of one document, from its own symbols alone."""
        part = self.stream[self.symbol_starts[k] : self.symbol_starts[k + 1]].astype(np.int64)
        return _expand(self.flat, self.starts, self.sizes, part)


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard table of ``docs`` in ascending order of id, as written and read back."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.large_binary())])
    schema = schema.set(4, pa.field("payload", pa.binary()))
    most_bytes = 2 * shard_tokens  # ids are at least about as rare as every second byte

    def encode(batches):
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        held, names, weight = [], [], 0

        def made():
            payload, n = build_shard(tokenizer_path, pa.concat_arrays(held), end_id)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, sum(map(len, names))], pa.int32()), pa.concat_arrays(names)), pa.array([payload], pa.binary())], schema=schema)

        for b in batches:
            text = pc.fill_null(b.column("text"), "")
            weights = pc.binary_length(text).to_numpy() + 1
            start = 0
            while start < len(text):  # rows until the shard is full
                upto = start + 1 + int(np.searchsorted(np.cumsum(weights[start:]), most_bytes - weight))
                upto = min(upto, len(text))
                held.append(text.slice(start, upto - start))
                names.append(b.column("id").slice(start, upto - start))
                weight += int(weights[start:upto].sum())
                start = upto
                if weight >= most_bytes:
                    yield made()
                    held, names, weight, part = [], [], 0, part + 1
        if held:
            yield made()

    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return Scratch(docs.sparkSession, "token-files").write(dealt.mapInArrow(trimmed(encode, MAPPED), SHARDS), "shards")


def read_documents(shards: DataFrame, visit=None) -> DataFrame:
    """One row per document (shard, part, doc_no, doc_id, local_start, n_tokens, ids_crc32), decoded from the shards."""
    schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("doc_no", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for b in batches:
            payloads = b.column("payload").cast(pa.large_binary())
            for i in range(b.num_rows):
                s = Shard(memoryview(payloads[i].as_buffer()))
                starts = s.id_starts.astype(np.int64)
                ids, ends = memoryview(s.ids().view(np.uint8)), (4 * starts).tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends, ends[1:])]
                n = s.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, b.column("shard")[i].as_py(), np.int32)), pa.array(np.full(n, b.column("part")[i].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), b.column("doc_ids")[i].values, pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    schema=schema,
                )

    return shards.select("shard", "part", "doc_ids", "payload").mapInArrow(trimmed(decode, MAPPED), "shard int, part int, doc_no int, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def with_starts(documents: DataFrame, shards: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``start``, the ids of all documents before, from the shards' totals.

    Totals are one row per shard of millions of ids; the running sum goes over tasks'
    totals first and inside each task's shards then.
    """
    per_task = shards.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_start"))
    offsets = shards.select("shard", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("part_start")).join(per_task, "shard")
    small = shards.count() * 32 <= broadcast_bytes
    joined = documents.join(F.broadcast(offsets) if small else offsets, ["shard", "part"])
    return joined.withColumn("start", F.col("task_start") + F.col("part_start") + F.col("local_start"))


def op10_token_files(spark, sf_dir):
    import public_tokenizers

    shards = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return with_starts(read_documents(shards), shards).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
