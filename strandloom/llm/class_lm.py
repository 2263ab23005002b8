"""Brown class-based bigram model.

Exchange clustering gives every word a class: the ``EXCHANGED`` most frequent words
move one by one to the class that most raises the likelihood of the class bigrams, and
all other words move in ``SIGNATURES`` groups of like word ends. With ``every_word``, as
in the query, each of the others then moves alone as well: to the class that is likeliest
by all of its own neighbours, the classes of the neighbours being those of the exchange; class
counts are taken anew after that. A token's probability
is that of its class after the class before (a document starts after the end class),
times that of the word in its class. Both are smoothed by adding 0.5; an unknown word
has its group's class, and the 0.5 of that class's unseen words, as the base model gives it 0.5 of all.

What grows with the corpus stays distributed: word counts, classes and neighbours' counts
are tables, and texts are numbered once, by the ``LEXICON`` most frequent words, which
are broadcast; their other words are kept as 64-bit hashes and met in a join, by chunks of
texts. Only tables of fixed size reach the driver: the lexicon with its classes, and the
bigram counts of EXCHANGED + SIGNATURES + 1 items. Counts cover every training document.

Defined results: a null text is empty: the end token alone. A null id counts as the
empty text when ids are dealt to training or not. Without training documents every
token has probability 1 in either model. Rows that repeat an id are documents of
their own. An empty table gives an empty result; input columns are not carried.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, quoted, table, trimmed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEXICON, EXCHANGED, SIGNATURES, CLASSES, SWEEPS = 200_000, 2048, 512, 64, 4
#: Shares in which the bigram counts come to the driver.
BIGRAM_PARTS = 16
#: Words outside the lexicon that a worker remembers, or counts before it hands them on.
CACHE = 400_000
#: Documents and bytes of text that are numbered together.
CHUNK_DOCS, CHUNK_BYTES = 1024, 4 << 20
#: Words whose classes are found together, and places whose neighbours a task counts before it hands them on.
WORDS_AT_ONCE, PLACES_AT_ONCE = 50_000, 2_000_000
CHUNKS = "ids array<bigint>, lengths binary, codes binary, tail array<bigint>, tail_sig binary"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def signature(word: bytes, signatures: int) -> int:
    """The group of words that end in the same two bytes."""
    return xxhash.xxh32_intdigest(word[-2:]) % signatures


def count_words(texts: DataFrame, signatures: int) -> DataFrame:
    """(h, word, sig, n) of every distinct word of a one-column table of texts."""
    schema = pa.schema([("h", pa.int64()), ("word", pa.binary()), ("sig", pa.int32()), ("n", pa.int64())])

    def count(batches):
        from collections import Counter

        held: Counter[bytes] = Counter()

        def handed():
            words = list(held)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(map(word_hash, part), pa.int64(), size=len(part)), pa.array(part, pa.binary()), pa.array([signature(w, signatures) for w in part], pa.int32()), pa.array([held[w] for w in part], pa.int64())], schema=schema)
            held.clear()

        for b in batches:
            for t in b.column(0).cast(pa.large_binary()):
                held.update(split_words(t.as_py()))
                if len(held) > CACHE:
                    yield from handed()
        yield from handed()

    partial = texts.mapInArrow(trimmed(count), "h long, word binary, sig int, n long")
    return partial.groupBy("h", "word", "sig").agg(F.sum("n").alias("n"))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, compressed with their bytes by rank, as most of the upper ones are 0."""
    raw = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _ints(value: pa.BinaryScalar, kind: str = "<i4") -> np.ndarray:
    held = value.as_buffer()
    size = int.from_bytes(memoryview(held)[:8], "little")
    raw = pa.decompress(held.slice(8), size, codec="zstd", asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def encode(docs: DataFrame, words: list[bytes], signatures: int) -> DataFrame:
    """Texts of an (id, text) table as numbers, some hundred documents a row (``CHUNKS``).

    0 is the end that closes each document, k the k-th of ``words``; what is beyond them
    numbers the row's own ``tail``, the hashes of its other words.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("codes", pa.binary()), ("tail", pa.list_(pa.int64())), ("tail_sig", pa.binary())])

    def number(batches):
        lex = {w: i + 1 for i, w in enumerate(shipped.value)}
        head = len(lex) + 1
        room = head + CACHE
        hashes, sigs = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int32)
        known, used = dict(lex), head

        def row(ids, split):
            nonlocal known, used, room, hashes, sigs
            fresh = list(set().union(*split).difference(known))
            if used + len(fresh) > room:
                known, used = dict(lex), head
                fresh = list(set().union(*split).difference(known))
                if head + len(fresh) > room:
                    room = head + len(fresh)
                    hashes, sigs = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int32)
            for w in fresh:
                known[w] = used
                hashes[used], sigs[used] = word_hash(w), signature(w, signatures)
                used += 1
            flat: list[int] = []
            for w in split:
                flat.extend(map(known.__getitem__, w))
                flat.append(0)
            seq = np.array(flat, dtype=np.int32)
            rare = np.flatnonzero(seq >= head)
            own, at = np.unique(seq[rare], return_inverse=True)
            seq[rare] = head + at
            lengths = np.array([len(w) + 1 for w in split], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(hashes[own]))]
            blobs = [pa.array([_packed(x)], pa.binary()) for x in (lengths, seq, sigs[own])]
            return pa.RecordBatch.from_arrays([lists[0], blobs[0], blobs[1], lists[1], blobs[2]], schema=schema)

        for b in batches:
            ids, col = b.column(0), b.column(1).cast(pa.large_binary())
            size = pc.fill_null(pc.binary_length(col), 0).to_numpy()
            start = 0
            while start < b.num_rows:
                upto = start + max(1, int(np.searchsorted(np.cumsum(size[start : start + CHUNK_DOCS]), CHUNK_BYTES, side="right")))
                yield row(ids.slice(start, upto - start), [split_words(t.as_py()) for t in col.slice(start, upto - start)])
                start = upto

    return docs.mapInArrow(trimmed(number), CHUNKS).withColumn("chunk", F.monotonically_increasing_id())




def count_bigrams(chunks: DataFrame, item: np.ndarray, exchanged: int, signatures: int) -> DataFrame:
    """(pair, n): neighbouring items, packed as first * items + second; the last item is the end."""
    items = exchanged + signatures + 1
    shipped = chunks.sparkSession.sparkContext.broadcast(np.append(items - 1, item).astype(np.int64))
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for b in batches:
            codes, sigs = b.column(0), b.column(1)
            for k in range(b.num_rows):
                seq = np.append(shipped.value, exchanged + _ints(sigs[k]).astype(np.int64))[_ints(codes[k])]
                before = np.append(items - 1, seq[:-1])
                pair, n = np.unique(before * items + seq, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], schema=schema)

    return chunks.select("codes", "tail_sig").mapInArrow(trimmed(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def class_words(chunks: DataFrame, hashes: np.ndarray, own: int, types: int, model: dict) -> DataFrame:
    """(h, code, n, cls) of every training word but the first ``own``: the class that its own neighbours make likeliest.

    The classes of all other words are those of ``model``. Tasks hand on each word's
    counts of the classes before and after it, dealt by hash; a group of words is then rated
    against all classes at once. ``code`` is the word's number in the lexicon, or 0.
    """
    shipped = chunks.sparkSession.sparkContext.broadcast({"hashes": hashes, **{k: model[k] for k in ("class", "group_class", "size", "move")}})
    groups = types // WORDS_AT_ONCE + 1
    classes = len(model["size"])
    slots = 2 * classes + 1  # classes before, classes after, the word itself after it
    schema = pa.schema([("part", pa.int32()), ("h", pa.binary()), ("size", pa.binary()), ("slot", pa.binary()), ("n", pa.binary())])

    def neighbours(batches):
        m = shipped.value
        end = classes - 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        known_class, known_hash = np.append(end, m["class"]).astype(np.int64), np.append(0, m["hashes"]).astype(np.int64)

        def handed():
            h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            # words by group, and each word's slots together
            part = (h.view(np.uint64) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            place = np.empty(len(h), dtype=np.int64)
            place[order] = np.arange(len(h))
            key, n = np.unique(place[at] * slots + np.concatenate([x for _, x in held]), return_counts=True)
            held.clear()
            h, part, word = h[order], part[order], key // slots
            size, slot, n = np.bincount(word, minlength=len(h)).astype("<i4"), (key % slots).astype("<i2"), n.astype("<i4")
            names, first = np.unique(part, return_index=True)
            ends, cuts = np.append(first[1:], len(h)), np.append(0, np.cumsum(size, dtype=np.int64))
            cols = [[], [], [], []]
            for x, y in zip(first, ends):
                for col, value in zip(cols, (h[x:y], size[x:y], slot[cuts[x] : cuts[y]], n[cuts[x] : cuts[y]])):
                    col.append(_packed(value))
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *[pa.array(c, pa.binary()) for c in cols]], schema=schema)

        for b in batches:
            for k in range(b.num_rows):
                seq = _ints(b.column(0)[k])
                c = np.append(known_class, m["group_class"][_ints(b.column(2)[k])])[seq]
                of = np.append(known_hash, b.column(1)[k].values.to_numpy())
                w = np.flatnonzero(seq > own)  # never the last: that is an end
                if not len(w):
                    continue
                again = seq[w + 1] == seq[w]
                after = np.where(again, 2 * classes, classes + c[w + 1])
                before = np.where(w > 0, c[w - 1], end)
                first = (w == 0) | (seq[w - 1] != seq[w])
                h = of[seq[w]]
                held.append((np.concatenate([h, h[first]]), np.concatenate([after, before[first]])))
                if sum(len(x) for x, _ in held) > PLACES_AT_ONCE:
                    yield handed()
        if held:
            yield handed()

    def rate(group):
        m = shipped.value
        group = group.combine_chunks()
        get = lambda name, kind: np.concatenate([_ints(x, kind) for x in group.column(name)])
        h, at = np.unique(get("h", "<i8"), return_inverse=True)
        key = np.repeat(at, get("size", "<i4")) * slots + get("slot", "<i2")
        seen = np.bincount(key, get("n", "<i4"), len(h) * slots).reshape(len(h), slots)
        before, after, itself = seen[:, :classes], seen[:, classes:-1], seen[:, -1:]
        n = before.sum(axis=1, keepdims=True) + itself
        move = m["move"]
        rating = before @ move + after @ move.T + itself * np.diag(move) - n * m["size"]
        rating[:, -1] = -np.inf  # the end class has the end alone
        order = np.argsort(m["hashes"], kind="stable")
        place = order[np.minimum(np.searchsorted(m["hashes"], h, sorter=order), len(order) - 1)]
        code = np.where(m["hashes"][place] == h, place + 1, 0)
        return pa.table([pa.array(h), pa.array(code.astype(np.int32)), pa.array(n[:, 0].astype(np.int64)), pa.array(rating.argmax(axis=1).astype(np.int32))], names=["h", "code", "n", "cls"])

    handed = chunks.select("codes", "tail", "tail_sig").mapInArrow(trimmed(neighbours), "part int, h binary, size binary, slot binary, n binary")
    return handed.groupBy("part").applyInArrow(rate, "h long, code int, n long, cls int")


def resolved(chunks: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    """Chunks with ``met``: counts and classes of the words of their tails that training texts have."""
    rare = chunks.select("chunk", F.posexplode("tail").alias("at", "h"))
    met = rare.join(F.broadcast(words) if small else words, "h").groupBy("chunk").agg(F.collect_list(F.struct("at", "n", "cls")).alias("met"))
    return chunks.join(met, "chunk", "left")


def _tail(met, sigs: np.ndarray, group_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, classes) of a chunk's tail; a word without a class of its own has its group's."""
    n, c = np.zeros(len(sigs), dtype=np.int64), group_class[sigs]
    if met.is_valid:
        x = met.values
        at, own = x.field("at").to_numpy(zero_copy_only=False), pc.fill_null(x.field("cls"), -1).to_numpy(zero_copy_only=False)
        n[at] = x.field("n").to_numpy(zero_copy_only=False)
        c[at] = np.where(own < 0, c[at], own)
    return n, c


def count_moves(chunks: DataFrame, local: dict) -> np.ndarray:
    """Class bigrams of resolved chunks."""
    shipped = chunks.sparkSession.sparkContext.broadcast({k: local[k] for k in ("class", "group_class")})
    classes = len(local["size"])

    def count(batches):
        m = shipped.value
        total = np.zeros(classes * classes, dtype=np.int64)
        known = np.append(classes - 1, m["class"]).astype(np.int64)
        for b in batches:
            for k in range(b.num_rows):
                _, own = _tail(b.column(2)[k], _ints(b.column(1)[k]), m["group_class"])
                c = np.append(known, own)[_ints(b.column(0)[k])]
                total += np.bincount(np.append(classes - 1, c[:-1]) * classes + c, minlength=classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["pair", "n"])

    got = chunks.select("codes", "tail_sig", "met").mapInArrow(trimmed(count), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most classes ** 2 rows
    out = np.zeros(classes * classes)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(classes, classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """A class for each item of a bigram matrix; the last item keeps the last class for itself.

    Items go from the most to the least frequent; each moves to the class with the
    largest likelihood of the class bigrams, all others staying.
    """
    items = len(counts)
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = [int(i) for i in np.argsort(-weight, kind="stable") if i != items - 1 and weight[i] > 0]
    of = np.zeros(items, dtype=np.int64)
    of[order] = np.arange(len(order)) % (classes - 1)
    of[items - 1] = classes - 1
    hot = np.zeros((items, classes), dtype=np.float64)
    hot[np.arange(items), of] = 1
    after, before = counts @ hot, counts.T @ hot  # per item: counts of the classes after and before it
    n = hot.T @ after
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            a, out, inn, own = of[w], after[w].copy(), before[w].copy(), counts[w, w]
            # take w out of its class
            out[a] -= own
            inn[a] -= own
            n[a] -= out
            n[:, a] -= inn
            n[a, a] -= own
            # what each class gains when w joins it
            rows, cols = n + out, n + inn[:, None]
            gain_rows, gain_cols = _xlogx(rows) - _xlogx(n), _xlogx(cols) - _xlogx(n)
            both = _xlogx(n[diagonal, diagonal] + out + inn + own) - _xlogx(n[diagonal, diagonal])
            gain = gain_rows.sum(axis=1) + gain_cols.sum(axis=0) - gain_rows[diagonal, diagonal] - gain_cols[diagonal, diagonal] + both
            first, second = n.sum(axis=1), n.sum(axis=0)
            total_out, total_in = out.sum() + own, inn.sum() + own
            gain -= _xlogx(first + total_out) - _xlogx(first) + _xlogx(second + total_in) - _xlogx(second)
            gain[classes - 1] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[a] + 1e-9:
                best = a
            n[best] += out
            n[:, best] += inn
            n[best, best] += own
            if best != a:
                moved += 1
                of[w] = best
                after[:, a] -= counts[:, w]
                after[:, best] += counts[:, w]
                before[:, a] -= counts[w]
                before[:, best] += counts[w]
        if moved <= len(order) // 1000:
            break
    return of


def learn(training: DataFrame, scratch: Scratch, lexicon: int = LEXICON, exchanged: int = EXCHANGED, signatures: int = SIGNATURES, classes: int = CLASSES, sweeps: int = SWEEPS, every_word: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> dict:
    """The model of a one-column table of training texts; ``words`` is its distributed part.

    With ``every_word`` the words that did not move alone get a class by their own neighbours too.
    """
    vocabulary = scratch.write(count_words(training, signatures), "vocabulary")
    n_docs = training.count()
    n_words, n_types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = vocabulary.orderBy(F.desc("n"), "word").limit(lexicon).select("word", "n").toArrow()  # at most ``lexicon`` rows; the others are met in joins
    words, counts = head.column("word").to_pylist(), head.column("n").to_numpy().astype(np.float64)
    del head
    own = min(exchanged, len(words))
    items = exchanged + signatures + 1
    item = np.array([i if i < own else exchanged + signature(w, signatures) for i, w in enumerate(words)], dtype=np.int64)
    bigrams = np.zeros((items, items))
    chunks = scratch.write(encode(training.select(F.lit(None).cast("long").alias("id"), quoted(training.columns[0]).alias("text")), words, signatures), "training")
    got = scratch.write(count_bigrams(chunks, item, exchanged, signatures), "bigrams")  # at most items ** 2 rows
    for part in range(BIGRAM_PARTS):  # a small driver never holds them twice
        for b in got.where(F.col("pair") % BIGRAM_PARTS == part).toArrow().to_batches():
            bigrams.reshape(-1)[b.column("pair").to_numpy()] = b.column("n").to_numpy()
    of = exchange(bigrams, classes, sweeps)
    hot = np.zeros((items, classes))
    hot[np.arange(items), of] = 1
    between = hot.T @ bigrams @ hot
    del bigrams
    # a class holds its own words' counts and those of its signature groups, less the words that moved alone
    mass, types = np.zeros(classes), np.zeros(classes)
    for r in vocabulary.groupBy("sig").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # one row per signature
        mass[of[exchanged + r.sig]] += r.n
        types[of[exchanged + r.sig]] += r.k
    for i, w in enumerate(words[:own]):
        group = of[exchanged + signature(w, signatures)]
        mass[group] -= counts[i]
        types[group] -= 1
        mass[of[i]] += counts[i]
        types[of[i]] += 1

    def sizes(mass, types):
        size = np.log10(mass + 0.5 * types + 0.5)
        size[classes - 1] = 0.0  # the end class has the end alone
        return size

    def moves(between):
        return np.log10((between + 0.5) / (between.sum(axis=1, keepdims=True) + 0.5 * classes))

    local = {"words": words, "log_count": np.log10(counts + 0.5), "class": of[item] if len(item) else item, "group_class": of[exchanged : exchanged + signatures], "size": sizes(mass, types), "move": moves(between), "end_log": float(np.log10(n_docs + 0.5)), "signatures": signatures}
    table_of = vocabulary.groupBy("h").agg(F.sum("n").alias("n")).withColumn("cls", F.lit(None).cast("int"))
    if every_word and n_types > own:
        hashes = np.array([word_hash(w) for w in words], dtype=np.int64)
        each = scratch.write(class_words(chunks, hashes, own, n_types, local), "words")
        lexical = each.where("code > 0").select("code", "cls").toArrow()  # at most ``lexicon`` rows
        local["class"] = local["class"].copy()
        local["class"][lexical.column("code").to_numpy() - 1] = lexical.column("cls").to_numpy()
        table_of = each.where("code = 0").select("h", "n", "cls")
        mass = np.bincount(local["class"][:own], counts[:own], classes)
        types = np.bincount(local["class"][:own], minlength=classes).astype(float)
        for r in each.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # one row per class
            mass[r.cls] += r.n
            types[r.cls] += r.k
        local["size"] = sizes(mass, types)
        local["move"] = moves(count_moves(resolved(chunks, table_of, n_types * 40 <= broadcast_bytes), local))
        scratch.drop("vocabulary")
    scratch.drop("training")
    scratch.drop("bigrams")
    return {"words": table_of, "tokens": int(n_words) + n_docs, "types": int(n_types) + (n_docs > 0), "ends": n_docs, "local": local}


def score_chunks(chunks: DataFrame, local: dict) -> DataFrame:
    """(id, n_tokens, n_seen, counted, class_log) per document of resolved chunks; ends count as seen."""
    shipped = chunks.sparkSession.sparkContext.broadcast({k: x for k, x in local.items() if k != "words"})
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_seen", pa.int64()), ("counted", pa.float64()), ("class_log", pa.float64())])

    def score(batches):
        m = shipped.value
        size, move, end = m["size"], m["move"], len(m["size"]) - 1
        of, logs = np.append(end, m["class"]).astype(np.int64), np.append(m["end_log"], m["log_count"])
        for b in batches:
            for k in range(b.num_rows):
                lengths, seq = _ints(b.column(1)[k]).astype(np.int64), _ints(b.column(2)[k])
                n, own = _tail(b.column(4)[k], _ints(b.column(3)[k]), m["group_class"])
                starts = np.cumsum(lengths) - lengths
                c = np.append(of, own)[seq]
                before = np.append(end, c[:-1])
                seen = np.append(np.ones(len(of), dtype=bool), n > 0)[seq]
                counted = np.add.reduceat(np.append(logs, np.log10(n + 0.5))[seq], starts)
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, pa.array(lengths), pa.array(np.add.reduceat(seen.astype(np.int64), starts)), pa.array(counted), pa.array(np.add.reduceat(move[before, c] - size[c], starts))], schema=schema)

    return chunks.select("ids", "lengths", "codes", "tail_sig", "met").mapInArrow(trimmed(score), "id long, n_tokens long, n_seen long, counted double, class_log double")


def held_out_part(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def class_lm(docs: DataFrame, training: DataFrame, text_col: str = "text", id_col: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES, **sizes) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "class-lm")
    model = learn(training.select(quoted(text_col)), scratch, broadcast_bytes=broadcast_bytes, **sizes)
    local, tokens, types, ends = model["local"], model["tokens"], model["types"], model["ends"]
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    chunks = scratch.write(encode(rows, local["words"], local["signatures"]), "chunks")
    out = score_chunks(resolved(chunks, model["words"], types * 40 <= broadcast_bytes), local)
    if tokens:
        base = F.col("counted") - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (types + 1)))
        score = F.col("counted") - local["end_log"] + F.col("class_log")
    else:
        base = score = F.lit(0.0)
    known = F.col("n_seen") - (0 if ends else 1)
    return out.select("id", "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))


def op3_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = held_out_part(F.col("doc_id"))
    scored = class_lm(docs, docs.where(part != 1), every_word=True)
    return scored.select(F.col("id").alias("doc_id"), (held_out_part(F.col("id")) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_class_lm": op3_class_lm}
ORACLES: dict[str, str] = {}
