"""Top-k search, vector codes and spelling variants against brute force, and their odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.llm import codes, spelling, topk, vectors

KIND = "vec_id long, embedding array<float>, label int, score double, code string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0.5, "x") for i, v, lab in rows], KIND)


def _usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def _floor(v, scale, dims):
    return [math.floor(scale * float(np.float32(x))) for x in v] + [0] * (dims - len(v))


def _odd(r, n, dims=8, copies=40):
    one = [r.uniform(-1, 1) for _ in range(dims)]
    rows = [(k, [r.gauss(0, 0.3) for _ in range(dims)], r.choice([0, 1, 2, None])) for k in range(n)]
    rows += [(n + k, list(one), 7) for k in range(copies)]
    rows += [(9001, None, 1), (9002, [0.1, None] + [0.0] * (dims - 2), 1), (9003, [float("nan")] * dims, 1), (9004, [float("inf")] + [0.0] * (dims - 1), None)]
    return rows + [(9005, [0.5, -0.5], None), (None, list(one), 3), (50, rows[50][1], 1), (9006, [], 2)]


def _brute_top(rows, k, every, scale=256):
    dims = max((len(v) for _, v, _ in rows if _usable(v)), default=0)
    own = [(i, _floor(v, scale, dims)) for i, v, _ in rows if _usable(v)]
    out = []
    for i, q in own:
        if i is None or i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, c)), math.inf if j is None else j) for j, c in own if j != i)
        out += [(i, n + 1, None if j == math.inf else j, -s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [topk.TopK(), topk.TopK(block_rows=4, strip_blocks=4, pack_queries=3, packs=2, lane_strips=3, pivots=5)])
def test_top_k(spark, how):
    rows = _odd(random.Random(1), 300)
    got = topk.top_k(_vectors(spark, rows), F.col("vec_id") % 10 == 0, how)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute_top(rows, 5, 10)


@pytest.mark.parametrize("rows", [[], [(0, [0.1, 0.2], 1)], [(0, [0.1, 0.2], 1), (1, [0.3, -2.0], 1)], [(0, None, 1)], [(0, [], 1), (5, [], 1)], [(None, [1.0], 1)]])
def test_top_k_of_few_rows(spark, rows):
    got = topk.top_k(_vectors(spark, rows), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute_top(rows, 5, 5)


def test_large_components_are_exact(spark):
    r = random.Random(2)
    rows = [(k, [r.uniform(-3e4, 3e4) for _ in range(6)], 0) for k in range(60)]
    got = topk.top_k(_vectors(spark, rows), F.col("vec_id") % 7 == 0, topk.TopK(block_rows=8))
    assert sorted(map(tuple, got.collect()), key=repr) == _brute_top(rows, 5, 7)


def test_blocks_are_pruned_and_nothing_is_lost():
    """Vectors in tight groups: a query scores few blocks, and gets what scoring all would give."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 200, (40, 16))
    own = np.concatenate([np.round(c + r.normal(0, 5, (64, 16))) for c in centres]).astype(np.int32)
    ids = r.permutation(len(own)).astype(np.int64)
    strip = topk.Strip(ids, own, 64)
    q = own[::97]
    score, ident = strip.search(q, ids[::97], 5)
    full = q.astype(np.int64) @ own.astype(np.int64).T
    for k in range(len(q)):
        want = sorted((-s, i) for s, i in zip(full[k].tolist(), ids.tolist()) if i != ids[::97][k])[:5]
        assert [(-s, i) for s, i in zip(score[k].tolist(), ident[k].tolist())] == want
    assert strip.scored < full.size / 5


def test_bounds_hold():
    r = np.random.default_rng(4)
    own, q = r.integers(-99, 99, (50, 7)), r.integers(-99, 99, (9, 7))
    most = topk.bounds(q, own.max(0)[None], own.min(0)[None])[:, 0]
    assert (most >= (q @ own.T).max(1)).all()
    assert (topk.bounds(q, own, own) == q @ own.T).all()  # of one vector, the bound is its score


def _brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    dims = max([math.ceil(len(v) / parts) for _, v, _ in rows if _usable(v)] + [1]) * parts
    own = [(math.inf if i is None else i, [float(np.float32(x)) for x in v], _floor(v, scale, dims), lab) for i, v, lab in rows if _usable(v)]
    own.sort(key=lambda x: (x[0], x[1]))
    w = dims // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    book = [[cut(x[2])[p] for x in own[:entries]] for p in range(parts)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for x in own:
                members[near(p, cut(x[2])[p])[1]].append(cut(x[2])[p])
            for e, m in members.items():
                book[p][e] = [sum(c) // len(m) for c in zip(*m)]
    found = [(x[0], x[3], [near(p, cut(x[2])[p]) for p in range(parts)]) for x in own]
    total = collections.Counter()
    for _, lab, n in found:
        total[lab] += sum(f for f, _ in n)
    sha = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    return sorted([(None if i == math.inf else i, "".join(f"{e:02x}" for _, e in n), sum(f for f, _ in n), total[lab], sha) for i, lab, n in found], key=repr)


@pytest.mark.parametrize("how", [codes.Codebook(), codes.Codebook(entries=16, rounds=3), codes.Codebook(parts=2, entries=5, rounds=2)])
def test_codes(spark, how):
    rows = _odd(random.Random(5), 150)
    got = codes.vector_codes(_vectors(spark, rows), how)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == _brute_codes(rows, how.parts, how.entries, how.rounds)


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(3, [0.25], None)], [(None, [], 1), (1, [], None)]])
def test_codes_of_few_rows(spark, rows):
    assert sorted(map(tuple, codes.vector_codes(_vectors(spark, rows)).collect()), key=repr) == _brute_codes(rows)


def test_intervals_hold_where_float32_errs():
    """Entries that float32 can't tell apart, and components that it can't hold."""
    r = np.random.default_rng(6)
    for spread, shift in ((3, 1 << 20), (1, 1 << 26), (200, 0), (0, 5)):
        x = r.integers(-spread, spread + 1, (400, 16)) + shift
        book = np.concatenate([r.integers(-spread, spread + 1, (60, 16)) + shift, np.full((4, 16), shift)]).astype(np.int64)
        full = ((x[:, None, :] - book[None]) ** 2).sum(2)
        index, error = codes.nearest(x, book)
        assert (index == full.argmin(1)).all() and (error == full.min(1)).all()
        assert codes.overlapping(x, book)[np.arange(len(x)), full.argmin(1)].all()
    x = r.integers(-300, 300, (2000, 16))
    assert codes.overlapping(x, x[:256].astype(np.int64)).sum() < 1.01 * len(x)  # ordinary rows have one entry to look at


def test_integers_of_ragged_lists():
    import pyarrow as pa

    col = pa.array([[0.5, -0.001], [], [1e30]], pa.list_(pa.float64()))
    assert vectors.integers(col, 10, 3).tolist() == [[5, -1, 0], [0, 0, 0], [vectors.LARGEST, 0, 0]]
    assert vectors.integers(col.slice(1), 10, 3).tolist() == [[0, 0, 0], [vectors.LARGEST, 0, 0]]


def _one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _brute_words(docs, least=5):
    n = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least}


def _brute_variants(n):
    near = {w: sorted((x for x in n if _one_edit(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 5 * n[w] else None for w, x in near.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def _typo(r, w):
    k = r.randrange(len(w))
    return r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])


def test_spelling_of_texts(spark):
    r = random.Random(7)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(5, 12))) for _ in range(40)]
    base += [_typo(r, r.choice(base)) for _ in range(80)]
    weight = [r.choice([1, 5, 30, 200]) for _ in base]
    docs = [(k, r.choice([" ", "-", ", 7 "]).join(r.choice([str, str.upper, str.title])(w) for w in r.choices(base, weight, k=60))) for k in range(250)]
    docs += [(900, None), (901, ""), (902, "÷×ÿÀÉabc " * 3000), (None, docs[0][1]), (3, docs[3][1]), (903, base[0].join("\n" * 5000)), (904, "chainab " * 5 + "chainabc " * 40 + "chainabcd " * 300)]
    frame = spark.createDataFrame([(i, t, "en", 1, "w") for i, t in docs], "doc_id long, text string, lang string, n long, word string")
    words = spelling.corpus_words(frame)
    want = _brute_words(docs)
    assert dict(map(tuple, words.collect())) == want
    got = spelling.spelling_variants(words)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = _brute_variants(want)
    assert sorted(map(tuple, got.collect()), key=repr) == rows
    assert sum(x[3] is not None for x in rows) > 5 and any(x[5] not in (x[0], x[3]) for x in rows if x[3])


def test_near_words_in_hot_segments(spark):
    """Many words with one first half or one second half, met in small groups."""
    from massloom.llm.workspace import Workspace

    r = random.Random(8)
    words = sorted({"stem" + "".join(r.choice("ab") for _ in range(r.randint(3, 6))) for _ in range(400)} | {"".join(r.choice("ab") for _ in range(r.randint(3, 6))) + "ending" for _ in range(300)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = sorted((x.a, x.b) for x in spelling.near_words(Workspace(spark, "near"), frame, group=7).collect())
    want = sorted(tuple(sorted((a, b), key=lambda w: (len(w), w))) for k, a in enumerate(words) for b in words[:k] if _one_edit(a, b))
    assert got == want and len(want) > 300


def test_spelling_of_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([("ab", 1), ("b", 9)], "word string, n long")).where("root = 'b'").count() == 2


def test_automaton_by_brute_force():
    from massloom.llm.substrings import Automaton, Phrases

    r, how = random.Random(9), Phrases(window=6, phrase=2)
    for _ in range(200):
        letters = [b"a", b"b", b"c"][: r.randint(1, 3)]
        passages = [(r.randint(1, 5), [r.choice(letters) for _ in range(r.randint(6, 30))]) for _ in range(r.randint(1, 4))]
        machine = Automaton([(d, b" ".join(w)) for d, w in passages], how)
        own, doc = [r.choice(letters) for _ in range(r.randint(0, 40))], r.randint(1, 6)
        known = {tuple(w[k : k + 6]) for d, w in passages if d < doc for k in range(len(w) - 5)}
        want = np.zeros(len(own), bool)
        for k in range(len(own) - 5):
            if tuple(own[k : k + 6]) in known:
                want[k : k + 6] = True
        assert (machine.covered(own, doc) == want).all()


@pytest.mark.parametrize("line", [["word"], [f"w{k}" for k in range(10)]])
def test_long_texts_that_repeat_themselves(spark, line):
    """A million words twice, within seconds."""
    from massloom.llm.substrings import Phrases, removed_report

    text = " ".join(line * (1_000_000 // len(line)))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "word " * 49)], "doc_id long, text string")
    assert {x.doc_id: (x.n_words, x.n_removed) for x in removed_report(docs, Phrases()).collect()} == {1: (1_000_000, 0), 2: (1_000_000, 1_000_000), 3: (49, 0)}


def test_neighbours_are_summed_in_steps(spark):
    """Many shards and a fan of two give the scores of one step."""
    from massloom.llm.brown import Brown, language_model

    r = random.Random(11)
    words = ["the", "of", *("".join(r.choice("bcdgkl") + r.choice("aeiou") for _ in range(2)) for _ in range(60))]
    docs = spark.createDataFrame([(k, " ".join(r.choices(words, [20, 10] + [1] * 60, k=r.randint(5, 40)))) for k in range(300)], "doc_id long, text string")
    how = dict(frequent=6, endings=8, classes=4, sweeps=2, shard_mb=0.002)
    one, steps = (sorted(map(tuple, language_model(docs, Brown(**how, fan=fan)).collect())) for fan in (256, 2))
    assert [x[:5] for x in one] == [x[:5] for x in steps] and all(abs(a[6] - b[6]) < 1e-9 for a, b in zip(one, steps))


def _nnpu(positive, unlabelled, size, prior, how):
    """The non-negative risk, its gradient by finite differences, and the same steps."""

    def parts(theta):
        z = lambda x: theta[-1] + sum(theta[k] for k in x)
        plus = sum(math.log1p(math.exp(-z(x))) for x in positive) / len(positive)
        as_negative = sum(math.log1p(math.exp(z(x))) for x in positive) / len(positive)
        return prior * plus, sum(math.log1p(math.exp(z(x))) for x in unlabelled) / len(unlabelled) - prior * as_negative

    theta, m, v = [0.0] * size + [math.log(prior / (1 - prior))], [0.0] * (size + 1), [0.0] * (size + 1)
    signs = set()
    for step in range(1, how.steps + 1):
        _, negative = parts(theta)
        signs.add(negative >= 0)
        risk = (lambda t: sum(parts(t))) if negative >= 0 else (lambda t: -parts(t)[1])
        g = []
        for k in range(size + 1):
            up, down = list(theta), list(theta)
            up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
            g.append((risk(up) - risk(down)) / 2e-5 + (how.decay * theta[k] if k < size else 0))
        m = [0.9 * a + 0.1 * b for a, b in zip(m, g)]
        v = [0.999 * a + 0.001 * b * b for a, b in zip(v, g)]
        theta = [t - how.rate * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8) for t, a, b in zip(theta, m, v)]
    return theta, signs


def test_nnpu_fit_by_finite_differences():
    from massloom.llm.toxicity import NnPU, fit

    how = NnPU(steps=60)
    positive, unlabelled = [[0, 1], [0, 2], [1]], [[0, 3], [3], [2, 3], [4], []]
    seen = set()
    for prior in (0.3, 0.85):  # with the larger one the negative part of the risk falls below 0
        want, signs = _nnpu(positive, unlabelled, 5, prior, how)
        w, bias = fit([np.array(x, np.int64) for x in positive], [np.array(x, np.int64) for x in unlabelled], 5, prior, how)
        assert np.abs(np.append(w, bias) - np.array(want)).max() < 2e-3
        seen |= signs
    assert seen == {True, False}


def test_toxicity_scores_by_plain_counts():
    import pyarrow as pa

    from massloom.llm import toxicity as tx

    r = random.Random(12)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 11))) for _ in range(40)]

    def bases(word):
        """Names of a word and its beginnings, in the order of their hashes."""
        raw = word.lower().encode() if word.isascii() else "".join(c.lower() if c.isascii() else c for c in word).encode()
        return [raw] + [raw[:n] + b"..." for n in tx.STEMS if len(raw) > n]

    number = {}
    for w in words:
        _, hashes = tx._bases(pa.RecordBatch.from_pydict({"text": [w]}))
        number |= dict(zip(bases(w), hashes.tolist()))
    keys = np.array(sorted(set(number.values()))[::2], np.uint64)
    weights = np.array([[r.uniform(-1, 1) for _ in range(tx.LEVELS)] for _ in keys])
    model = tx.Linear(keys, weights, -0.25)
    texts = [" ".join(r.choice([str, str.upper])(r.choice(words)) if w.isascii() else w for w in r.choices(words, k=r.randint(0, 30))) for _ in range(60)] + ["", None, (words[0] + ", ") * 5000]
    got = model.scores(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))
    place = {k: i for i, k in enumerate(keys.tolist())}
    for text, score in zip(texts, got):
        n = collections.Counter(b for w in re.split("[\x00-\x2f:-@\\[-`{-\x7f]+", text or "") if w for b in bases(w))
        z = -0.25 + sum(weights[place[number[b]]][: min(c, tx.LEVELS)].sum() for b, c in n.items() if number.get(b) in place)
        assert abs(score - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_with_clashing_columns(spark):
    from massloom.llm import toxicity as tx

    docs = spark.createDataFrame([(k, f"word{k % 7} " * (k + 1), 5.0, 1, True) for k in range(30)] + [(99, "long " * 50_000, 5.0, 1, True)], "doc_id long, text string, score double, predicted int, held_out boolean")
    labels = spark.createDataFrame([(k, int(k % 7 == 1), 0.5, "x") for k in range(30)], "doc_id long, toxic int, score double, text string")
    got = tx.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score between 0 and 1").count() == 31
    assert tx.drop_toxic(docs, labels).columns == docs.columns


def _plain_states(p, d, own):
    h = p[f"{d}_hn"].shape[0]
    state, out = [0.0] * h, []
    for byte in own if d == "f" else own[::-1]:
        gate = [1 / (1 + math.exp(-(float(p[f"{d}_xg"][byte][k]) + sum(state[i] * float(p[f"{d}_hg"][i][k]) for i in range(h))))) for k in range(2 * h)]
        back = [sum(state[i] * float(p[f"{d}_hn"][i][k]) for i in range(h)) for k in range(h)]
        new = [math.tanh(float(p[f"{d}_xn"][byte][k]) + gate[k] * back[k]) for k in range(h)]
        state = [gate[h + k] * state[k] + (1 - gate[h + k]) * new[k] for k in range(h)]
        out.append(state)
    return out if d == "f" else out[::-1]


def test_language_probabilities_by_plain_loops():
    """Every position's label probabilities, both directions, pooled over a text's segments."""
    import pyarrow as pa

    from massloom.llm import langid
    from massloom.llm.textcols import utf8

    net = langid.Network(["a", "b", "c"], 4, seed=3)
    texts = ["short", "", "é" * 40 + " and a text of more than one segment of bytes " * 2, "x", None]
    x, length, row = langid.segments(*utf8(pa.array(texts, pa.string())), 64)
    got = np.zeros((len(texts), 3))
    np.add.at(got, row, net.probabilities(x, length))
    for k, text in enumerate(texts):
        raw, want = list((text or "").encode()), np.zeros(3)
        for at in range(0, len(raw), 64):
            own = raw[at : at + 64]
            for f, b in zip(_plain_states(net.p, "f", own), _plain_states(net.p, "b", own)):
                z = np.array([*f, *b]) @ net.p["out"].astype(float) + net.p["bias"]
                want += np.exp(z) / np.exp(z).sum()
        assert np.abs(got[k] - want).max() < 1e-3
