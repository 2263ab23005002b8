"""The class model, passages and mixing against plain computations."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import class_lm as lm
from strandloom.llm import mixing as mx
from strandloom.llm import near_dedup as nd
from strandloom.llm import passages as ps

SF = "/root/testdata/sf0.01"
SMALL = dict(lexicon=500, exchanged=60, signatures=16, classes=8, sweeps=2)


def split(text):
    return lm.split_words(bytes(text or "", "utf8"))


def test_base_scores_and_counts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    c = Counter(w for i, t in rows if part[i] != 1 for w in split(t))
    ends = sum(part[i] != 1 for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    got = {r.doc_id: r for r in lm.op3_class_lm(spark, SF).collect()}
    assert len(got) == len(rows)
    better = 0
    for i, t in rows:
        w = split(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (part[i] == 1, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, sum(base(c[x]) for x in w) + base(ends), rel_tol=1e-9)
        better += r.held_out and r.score > r.base_score
    assert better > 0.8 * sum(p == 1 for p in part.values())


def test_class_probabilities_sum_to_one_and_paths_agree(spark):
    texts = [("a b c a b d a b",), ("b c d e a b",), ("x y z x y q",), (None,), ("a b x y",)] * 5
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(texts)], "doc_id long, text string")
    from strandloom.llm.common import Scratch

    model = lm.learn(df.select("text"), Scratch(spark, "t"), lexicon=4, exchanged=3, signatures=4, classes=5, sweeps=3)
    local = model["local"]
    assert np.allclose((10 ** local["move"]).sum(axis=1), 1)
    counts = Counter(w for t in texts for w in split(t[0]))
    place = {w: int(k) for w, k in zip(local["words"], local["class"])}
    known = lambda w: place.get(w, int(local["group_class"][lm.signature(w, 4)]))
    sums = Counter()
    for w, k in counts.items():
        sums[known(w)] += k + 0.5
    for k, total in sums.items():
        assert math.isclose(10 ** local["size"][k], total + 0.5)

    def expected(t):
        w, before, out = split(t), 4, 0.0
        for x in w:
            out += local["move"][before, known(x)] + math.log10(counts[x] + 0.5) - local["size"][known(x)]
            before = known(x)
        return out + local["move"][before, 4]

    more = df.unionByName(spark.createDataFrame([(99, "new words a b"), (None, "")], "doc_id long, text string"))
    for limit in (8 << 20, 0):
        got = lm.class_lm(more, df, broadcast_bytes=limit, lexicon=4, exchanged=3, signatures=4, classes=5, sweeps=3).collect()
        assert len(got) == len(texts) + 2
        for r in got:
            assert math.isclose(r.score, expected("new words a b" if r.id == 99 else None if r.id is None else texts[r.id][0]), rel_tol=1e-9)


def test_every_word_has_the_class_of_its_own_neighbours(spark):
    """Against plain counting: words beyond the exchanged ones, inside the lexicon and beyond it."""
    from strandloom.llm.common import Scratch

    rng = np.random.default_rng(4)
    texts = [" ".join(f"{kind}{rng.integers(1, 40) ** 2 // 40}{kind[::-1]}" for kind in ("ab", "cd", "ef") * 4) + " zz zz" * (i % 3 == 0) for i in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes = dict(lexicon=30, exchanged=6, signatures=3, classes=6, sweeps=3)
    plain = lm.learn(df.select("text"), Scratch(spark, "t"), **sizes)["local"]
    old = dict(zip(plain["words"], map(int, plain["class"])))
    first = lambda w: old.get(w, int(plain["group_class"][lm.signature(w, 3)]))
    seqs = [split(t) for t in texts]
    counts = Counter(w for s in seqs for w in s)
    want = {w: old[w] for w in plain["words"][:6]}
    for w in counts.keys() - want.keys():
        rating = -counts[w] * plain["size"]
        for s in seqs:
            for i, x in enumerate(s):
                if x == w:
                    rest = [*s[i + 1 :], None][0]
                    rating = rating + (0 if i and s[i - 1] == w else plain["move"][5 if i == 0 else first(s[i - 1])])
                    rating = rating + (np.diag(plain["move"]) if rest == w else plain["move"][:, 5 if rest is None else first(rest)])
        want[w] = int(rating[:5].argmax())
    assert any(want[w] != first(w) for w in counts) and len(counts) > 40
    unseen = lambda w: want.get(w, int(plain["group_class"][lm.signature(w, 3)]))
    between, mass = np.zeros((6, 6)), np.full(6, 0.5)
    for s in seqs:
        c = [5, *map(unseen, s), 5]
        np.add.at(between, (c[:-1], c[1:]), 1)
    for w, k in counts.items():
        mass[want[w]] += k + 0.5
    move, mass[5] = np.log10((between + 0.5) / (between.sum(axis=1, keepdims=True) + 3)), 1

    def expected(t):
        c = [5, *map(unseen, split(t)), 5]
        return sum(move[a, b] for a, b in zip(c, c[1:])) + sum(math.log10((counts[w] + 0.5) / mass[unseen(w)]) for w in split(t))

    more = df.unionByName(spark.createDataFrame([(99, "new words ab1ba zz")], "doc_id long, text string"))
    for limit in (8 << 20, 0):
        got = lm.class_lm(more, df, broadcast_bytes=limit, every_word=True, **sizes).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert math.isclose(r.score, expected("new words ab1ba zz" if r.id == 99 else texts[r.id]), rel_tol=1e-9)


def test_class_lm_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert {(r.n_known, r.score, r.base_score) for r in lm.class_lm(df, df.limit(0), **SMALL).collect()} == {(0, 0.0, 0.0)}
    assert lm.class_lm(df.limit(0), df, **SMALL).count() == 0


def test_compact_windows_are_the_sliding_minima():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300):
        v = rng.integers(0, 60, n).astype(np.uint64)
        starts, at = ps.compact_windows(v, 7)
        want = [i + int(v[i : i + 7].argmin()) for i in range(n - 6)]
        got = [int(at[np.searchsorted(starts, i, side="right") - 1]) for i in range(n - 6)]
        assert [v[i] for i in got] == [v[i] for i in want]


def repeated(rows, size=50):
    """Ids with an exact stretch of words that another row has too."""
    seen = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), set()).add(i)
    return set().union(*[s for s in seen.values() if len(s) > 1] or [set()])


def test_passages_find_all_exact_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.id: r for r in ps.repeated_passages(docs).collect()}
    exact = repeated(rows)
    assert exact <= got.keys()
    text = dict(rows)
    members = {}
    for i, r in got.items():
        members.setdefault(r.class_id, []).append(i)
        assert r.spans and r.class_id <= i and all(s.first <= s.last < len(split(text[i])) for s in r.spans)
    assert all(len(m) > 1 and min(m) == c for c, m in members.items())
    cut = {r.doc_id: r.text for r in ps.cut_passages(docs, ps.repeated_passages(docs)).collect()}
    assert not repeated([(i, t) for i, t in cut.items()])


def test_passages_inside_longer_texts(spark):
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(10**7)}"
    shared = [word() for _ in range(60)]
    short = [word() for _ in range(30)]
    rows = [(i, " ".join([word() for _ in range(40 + i)] + (shared if i < 30 else short) + [word() for _ in range(30)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " ".join(shared)), (103, " ".join(shared)), (None, " ".join(shared)), (104, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (8 << 20, 0):
        got = {r.id: r for r in ps.repeated_passages(df, broadcast_bytes=limit, beside_texts=limit).collect()}
        assert got.keys() == set(range(30)) | {102, 103, None}
        assert all(r.class_id == 0 for r in got.values())
        assert [(s.first, s.last) for s in got[7].spans] == [(47, 106)]
        assert sum(not got[i].cut_spans for i in [*range(30), 102]) == 1
    assert ps.repeated_passages(df.limit(0)).count() == 0


def test_passages_of_few_words_in_two_documents(spark):
    rng = np.random.default_rng(11)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    rows, where = [], {}
    for k in range(300):
        shared = text(50 + k % 11)
        for i in (2 * k, 2 * k + 1):
            at = int(rng.integers(20, 120))
            rows.append((i, " ".join(text(at) + shared + text(60))))
            where[i] = (at, at + len(shared) - 1)
    got = {r.id: r for r in ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == where.keys()
    assert all([tuple(s) for s in got[i].spans] == [where[i]] and got[i].class_id == i - i % 2 for i in where)


def test_signatures_of_stretches_and_their_recall():
    rng = np.random.default_rng(13)
    least, found, near = 46, 0, 0
    keys = lambda seq: set(ps.signature_intervals([seq], least)[1].tolist())
    seqs = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (200, 0, 46, 45, 300)] + [rng.integers(0, 30, 200).astype(np.uint64)]
    of, key, first, last, anchor = ps.signature_intervals(seqs, least)
    for k, seq in enumerate(seqs):  # each start has each signature once; an interval's stretches have its minima
        n = max(0, len(seq) - least + 1)
        assert sorted(x for f, e in zip(first[of == k], last[of == k]) for x in range(f, e + 1)) == sorted([*range(n)] * ps.SIGNATURES)
        for s, f, e, c in zip(key[of == k], first[of == k], last[of == k], anchor[of == k]):
            assert all(s in keys(seq[x : x + least]) for x in (f, e)) and f <= c < f + least
    for _ in range(1000):  # brute force: pairs of stretches that are alike at 0.8 to 0.84
        a = rng.integers(0, 2**63, least).astype(np.uint64)
        b = a.copy()
        b[int(rng.integers(0, least - 4)) :][:5] = rng.integers(0, 2**63, 5)
        assert ps.alike(a, b, least, 80) == [0] and not ps.alike(a, b, least, 84)
        near += 1
        found += bool(keys(a) & keys(b))
    assert found >= 0.97 * near


def test_passages_that_only_another_member_explains(spark):
    rng = np.random.default_rng(14)
    word = lambda: f"w{rng.integers(10**7)}"
    rows = []
    for k in range(300):  # H and B differ in two places of which A has one each
        a = [word() for _ in range(60)]
        h, b = list(a), list(a)
        h[12] = word()
        b[46] = word()
        for i, p in enumerate((h, a, b)):
            rows.append((3 * k + i, " ".join([word() for _ in range(40)] + p + [word() for _ in range(40)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in ps.repeated_passages(df).collect()}
    want = {}
    for k in range(300):
        seqs = [nd.sequence_hashes(t.encode(), ps.SHINGLE) for _, t in rows[3 * k : 3 * k + 3]]
        assert ps.alike(seqs[0], seqs[1], 46, 80) and ps.alike(seqs[1], seqs[2], 46, 80)
        want |= {3 * k + i: 3 * k for i in range(3)}
    lost = want.keys() - got.keys()
    assert not lost and all(got[i] == want[i] for i in got)


def test_texts_with_a_word_more_are_compared():
    rng = np.random.default_rng(15)
    a = rng.integers(1, 2**40, 48)
    b = np.concatenate([a[:23], [7], a[23:]])
    text = lambda row, seq: (row, np.array([1]), ps.packed(*(np.array([x]) for x in (0, len(seq) - 46, 10))), np.array([0]), np.array([len(seq)]), seq)
    block = ps.Block([text(10, a), text(11, b)], 46, 80)
    block.among({0: {1}})
    assert block.edges == [(0, 1)]
    [(a0, a1, cut_a)], [(b0, b1, cut_b)] = block.spans
    assert (a0, b0) == (0, 0) and a1 >= 45 and b1 >= 45 and (cut_a, cut_b) == (False, True)


def test_near_passages_are_found(spark):
    """Planted passages of 80 words, one or two words changed or one put in, where the similarity of some stretch is 0.8."""
    rng = np.random.default_rng(17)
    word = lambda: f"w{rng.integers(10**7)}"
    rows, near = [], {}
    for k in range(450):
        p = [word() for _ in range(80)]
        q = list(p)
        if k % 3 == 2:
            q.insert(int(rng.integers(1, 79)), word())
        else:
            for at in rng.choice(80, 1 + k % 3, replace=False):
                q[at] = word()
        x, y = (nd.sequence_hashes(" ".join(w).encode(), ps.SHINGLE) for w in (p, q))
        if any(ps.alike(x[i:], y[i + s :], 46, 80) for s in (0, 1) for i in (0,)):
            near[2 * k] = k % 3
        for i, w in ((2 * k, p), (2 * k + 1, q)):
            rows.append((i, " ".join([word() for _ in range(40)] + w + [word() for _ in range(40)])))
    got = {r.id: r.class_id for r in ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for kind in range(3):
        asked = [i for i, k in near.items() if k == kind]
        found = sum(got.get(i) == i and got.get(i + 1) == i for i in asked)
        assert len(asked) > 20 and found >= 0.95 * len(asked), (kind, found, len(asked))
    assert all(got.get(i, i - i % 2) == i - i % 2 for i, _ in rows)


def test_units_of_several_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(18)
    word = lambda: f"w{rng.integers(10**7)}"
    base, rows = [word() for _ in range(60)], []
    for i in range(40):  # each differs from the first in two places, and from its neighbour in one
        w = list(base)
        w[12] = f"x{i // 2}" if i else w[12]
        w[46] = f"y{(i + 1) // 2}" if i else w[46]
        rows.append((i, " ".join([word() for _ in range(30)] + w + [word() for _ in range(30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = {r.id: (r.class_id, r.spans) for r in ps.repeated_passages(df).collect()}
    monkeypatch.setattr(ps, "BLOCK", 4)
    blocks = {r.id: (r.class_id, r.spans) for r in ps.repeated_passages(df, broadcast_bytes=0, beside_texts=0).collect()}
    assert whole == blocks and len(whole) >= 38


def _block(seqs, keys, places):
    """A block of texts of one stretch each, with a place of no more than one start for each (key, start)."""
    return ps.Block([(row, np.array(k), ps.packed(*(np.array(at),) * 3), np.array([0]), np.array([len(x)]), np.array(x)) for row, (x, k, at) in enumerate(zip(seqs, keys, places))], 46, 80)


def test_texts_that_one_signature_cannot_link_meet_by_the_others():
    one, two, both = (np.arange(46) + 1000 * n for n in (1, 2, 3))
    block = _block([np.concatenate([one, two]), np.concatenate([one, both]), np.concatenate([two, both])], [[7, 7], [7, 8], [7, 8]], [[0, 46]] * 3)
    block.among({1: {7}, 2: {7, 8}})
    assert (46, 91, True) in block.spans[2] and (46, 91, False) in block.spans[1]


def test_places_that_share_too_little_are_not_compared(monkeypatch):
    seqs = [np.arange(92) + 1000 * n for n in range(1, 11)]
    block = _block([np.concatenate(seqs), *seqs], [[7], *[[7, 7]] * 10], [[0], *[[0, 46]] * 10])
    met, pair = [], ps.Block.pair
    monkeypatch.setattr(ps.Block, "pair", lambda self, a, b, keys: met.append((a, b)) or pair(self, a, b, keys))
    block.among({m: {7} for m in range(1, 11)})
    assert met == [(1, 0)]  # the one that holds its stretches, of 55 pairs


def test_passages_in_two_places_of_a_document(spark):
    rng = np.random.default_rng(16)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 10**7, n)]
    shared, alone = text(60), text(60)
    twice = lambda p: " ".join(text(40) + p + text(30) + p + text(20))
    rows = [(0, twice(shared)), (1, " ".join(text(10) + shared)), (2, twice(shared)), (3, twice(alone))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ps.repeated_passages(df)
    got = {r.id: r for r in found.collect()}
    assert got.keys() == {0, 1, 2}
    for i in (0, 2):
        assert [tuple(s) for s in got[i].spans] == [(40, 99), (130, 189)]
    assert all(r.class_size == 3 for r in got.values())
    cut = {r.doc_id: r.text for r in ps.cut_passages(df, found).collect()}
    assert sum(" ".join(shared) in t for t in cut.values()) == 1


def test_stretches_alike_equal_sets():
    rng = np.random.default_rng(12)
    for values in (6, 60):
        a = rng.integers(0, values, 90)
        b = np.where(rng.random(90) < 0.9, a, rng.integers(0, values, 90))
        sets = [(set(a[k : k + 20]), set(b[k : k + 20])) for k in range(71)]
        for percent in (60, 80):
            assert ps.alike(a, b, 20, percent) == [k for k, (x, y) in enumerate(sets) if 100 * len(x & y) >= percent * len(x | y)]


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.2], 400)
    n = rng.integers(1, 500, 400)
    bins = spark.createDataFrame([(int(k), [float(x) for x in q]) for k, q in zip(n, p)], "n long, p array<double>").coalesce(1)
    for target, total, floor in (([0.2, 0.2, 0.6], 1.0, 0), ([0.45, 0.4, 0.15], None, 1), ([0.9, 0.05, 0.05], 1.0, 0)):
        pushes, log = mx.fit_rates(bins, np.array(target), total, floor)
        rate = np.array([r.rate for r in bins.withColumn("rate", mx.rate_of(F.col("p"), pushes, floor)).collect()])
        # plain projected gradient, a great many short steps
        base, got = (p * n[:, None]).sum(axis=0) / n.sum(), np.ones(400)
        goal = np.array(target) * (total or mx.ROOM * max(1.0, (base / np.array(target)).max()))
        for _ in range(5_000):
            got = np.maximum(floor, got - 0.5 * p @ ((p * n[:, None]).T @ got / n.sum() - goal))
        want = np.abs((p * n[:, None]).T @ got / n.sum() - goal).max()
        off = np.abs((p * n[:, None]).T @ rate / n.sum() - goal).max()
        assert rate.min() >= floor and off <= max(1e-4, 1.05 * want) and np.allclose(np.abs(log[-1]["off"]).max(), off, atol=1e-9)
    assert mx.fit_rates(bins.limit(0), np.ones(3))[0] == []


def test_op1_against_plain_computations(spark):
    import xxhash

    from strandloom.llm.mixing import BUCKETS, EFFECTIVE, GRID, SMOOTH

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r.doc_id, f"q{r.quality}t{r.toxic}") for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    bucket = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42)) % BUCKETS
    words = {i: [bucket(w.decode()) for w in (t or "").encode().split()] for i, t in texts.items()}
    names = sorted({d for _, d in labels})
    weights = np.full((len(names), BUCKETS), SMOOTH)
    prior = np.zeros(len(names))
    for i, d in labels:
        prior[names.index(d)] += 1
        np.add.at(weights[names.index(d)], words.get(i, []), 1)
    weights, prior = np.log(weights / weights.sum(axis=1, keepdims=True)), np.log(prior / prior.sum())
    target = np.array([mx.TARGETS.get(d, 0.0) for d in names])
    rows = {r.doc_id: r for r in mx.op1_mixing(spark, SF).collect()}
    assert rows.keys() == texts.keys()
    expected, tokens, seen = np.zeros(len(names)), 0, {}
    for i, b in words.items():
        x = prior + (weights[:, b].mean(axis=1) * min(len(b), EFFECTIVE) if b else 0)
        q = np.exp(x - x.max())
        q /= q.sum()
        r = rows[i]
        grid = np.floor(q * GRID + 0.5)
        grid[0] = GRID - grid[1:].sum()
        expected += len(b) * r.rate * grid / GRID
        tokens += len(b)
        assert r.n_tokens == len(b) and abs(r.posterior - q.max()) < 1e-3 and (r.domain == names[int(np.argmax(q))] or sorted(q)[-1] - sorted(q)[-2] < 2e-3)
        even = signed(xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), _seeded("mix"))) % 1_000_000 / 1_000_000
        assert r.rate >= 0 and r.copies == math.floor(r.rate + even) or abs(r.rate + even - round(r.rate + even)) < 1e-6
        if np.abs(q * GRID - np.floor(q * GRID) - 0.5).min() > 0.05:
            seen.setdefault(tuple(grid), set()).add(r.rate)
    assert all(len(x) == 1 for x in seen.values())  # documents of one rounded posterior are rated alike
    assert np.abs(expected / tokens - target / target.sum()).max() < 2e-3


def _seeded(word):
    """The state of Spark's hash after a first column: the seed for the next."""
    import xxhash

    return xxhash.xxh64_intdigest(word.encode(), 42)


def test_posteriors_equal_plain_bayes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    from strandloom.llm.common import Scratch

    domains = mx.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    names, prior, weights = mx.learn(docs, domains, Scratch(spark, "t"))
    got = docs.select("text", mx.with_posteriors(docs, names, prior, weights).alias("m"), F.transform(mx._words(F.col("text")), mx._bucket).alias("b")).limit(50).collect()
    for r in got:
        b = np.array(r.b, dtype=int)
        assert r.m.n == len(b)
        x = prior + (weights[:, b].mean(axis=1) if len(b) else 0) * min(len(b), mx.EFFECTIVE)
        q = np.exp(x - x.max())
        assert np.allclose(r.m.p, q / q.sum(), atol=1e-3)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1.0), (2, None, 2.0), (None, "c", 3.0), (2, "", 4.0)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = mx.mix(docs, mx.label_domains(labels), {"q1t0": 1.0, "nowhere": 3.0})
    assert out.count() == 4 and all(r.rate >= 0 and r.copies >= 0 for r in out.collect())
    every = mx.repeat_rows(docs.withColumns({"copies": F.lit(7), "domain": F.lit("mine")}), mx.label_domains(labels), {"q1t0": 1.0}, total=None, at_least=1)
    assert every.columns == ["doc_id", "text", "rate", "copies", "domain"] and {(r.rate, r.copies, r.domain) for r in every.collect()} == {(x, 7, "mine") for x in (1.0, 2.0, 3.0, 4.0)}
    assert [r.rate for r in mx.mix(docs, mx.label_domains(labels.limit(0)), {}).collect()] == [1.0] * 4
    assert mx.mix(docs.limit(0), mx.label_domains(labels), {"q1t0": 1.0}).count() == 0
