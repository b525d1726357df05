"""Scores of the trained operators against plain models, held-out accuracy on the driver's tables, and odd rows."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from massloom.llm import brown, decontam, langid, packing, quality, substrings, toxicity

from test_text_operators import _text, corpus, frame


def _fold(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def test_quality_scores_and_threshold(spark):
    """Score, threshold and verdict by a plain model over the same buckets."""
    r = random.Random(21)
    good = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(r.randint(5, 80))) for _ in range(40)]
    texts = good + [_text(r, r.randint(5, 90)) for _ in range(60)] + [good[0], None, ""]
    bits, weight = 10, 4.0 * (1 << 10)
    docs, trusted = frame(spark, texts), {*range(40)}
    got = {x["doc_id"]: x for x in quality.quality(docs, docs.where("doc_id < 40").select("doc_id"), bits=bits).collect()}

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def buckets(t):
        h = [xxhash.xxh64(w.encode(), 42).intdigest() for w in (t or "").split()]
        pairs = [xxhash.xxh64(b.to_bytes(8, "little"), xxhash.xxh64(a.to_bytes(8, "little"), 42).intdigest()).intdigest() for a, b in zip(h, h[1:])]
        return [signed(x) & ((1 << bits) - 1) for x in h + pairs]

    raw, target = collections.Counter(), collections.Counter()
    for k, t in enumerate(texts):
        raw.update(buckets(t))
        if k in trusted and _fold(k, 5):
            target.update(buckets(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    model = {k: round(math.log((target[k] + n / n_raw * weight) / (n_target + weight) / (n / n_raw)) * 10_000) for k, n in raw.items()}
    total = {k: (sum(model[b] for b in buckets(t)), len(buckets(t))) for k, t in enumerate(texts)}
    held = sorted(math.floor(total[k][0] / total[k][1]) for k in trusted if not _fold(k, 5) and not got[k]["base_failed"])
    least = held[len(held) * 20 // 1000]
    for k, x in got.items():
        value, n = total[k]
        assert x["score"] is None if not n else abs(x["score"] - value / n / 10_000) < 2e-4
        if n and abs(value / n - least) > 2:
            assert x["kept"] == (not x["base_failed"] and value >= n * least)
    kept = [got[k]["kept"] for k in got if not got[k]["base_failed"]]
    assert any(kept) and not all(kept)


def test_language_model_scores(spark):
    """The whole model by plain loops: units, exchanged classes, classes of the other words, class bigrams, emissions."""
    r = random.Random(22)
    texts = [" ".join(r.choice(("the a of to in and he it".split(), "".join(r.choice("bcdgjklmnprst") + r.choice("aeiou") for _ in range(2)).split())[r.random() < 0.6]) for _ in range(r.randint(0, 60))) for _ in range(120)] + [None, "", "The THE the"]
    how = brown.Brown(frequent=6, endings=8, classes=4, sweeps=2, shard_mb=0.002)
    got = {x["doc_id"]: x for x in brown.language_model(frame(spark, texts), how).collect()}
    end, table = "</s>", {}

    def shape(w):
        if w not in table:
            t = brown.Tokens(pa.array([w]), how)
            table[w] = (int(t.hashes[0]), int(t.endings[0]))
        return table[w]

    words = [[w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [end] for t in texts]
    train = [w for k, w in enumerate(words) if _fold(k, 5) != 1]
    count = collections.Counter(w for t in train for w in t)
    total, vocabulary = sum(count.values()), len(count)
    top = sorted((w for w in count if w != end), key=lambda w: (-count[w], np.uint64(shape(w)[0]).astype(np.int64)))[: how.frequent]
    place = {w: k for k, w in enumerate(sorted(top, key=lambda w: shape(w)[0]))}
    unit = lambda w: how.units - 1 if w == end else place.get(w, how.frequent + shape(w)[1])
    pairs = np.zeros((how.units, how.units))
    for t in train:
        for a, b in zip([end, *t], t):
            pairs[unit(a), unit(b)] += 1
    own = brown.exchange(pairs, how.classes, how.sweeps)
    grid = np.zeros((how.classes, how.classes))
    for (a, b), n in np.ndenumerate(pairs):
        grid[own[a], own[b]] += n
    everyone = grid.sum() + how.classes
    g = [[grid[a, b] + how.prior * (grid[a].sum() + 1) * (grid[:, b].sum() + 1) / everyone / everyone for b in range(how.classes)] for a in range(how.classes)]
    gain = lambda before, after, c: sum(n * (math.log(g[a][c]) - math.log(sum(g[x][c] for x in range(how.classes)))) for a, n in before.items()) + sum(n * (math.log(g[c][b]) - math.log(sum(g[c][y] for y in range(how.classes)))) for b, n in after.items())
    near = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    of_ending = collections.defaultdict(lambda: (collections.Counter(), collections.Counter()))
    for t in train:
        for a, b in zip([end, *t], t):
            for w, which, other in ((b, 0, a), (a, 1, b)):
                if w != end and w not in place:
                    near[w][which][own[unit(other)]] += 1
                if how.frequent <= unit(w) < how.units - 1:
                    of_ending[shape(w)[1]][which][own[unit(other)]] += 1
    chosen = {}
    for w, sides in near.items():
        prior = of_ending[shape(w)[1]]
        many = max(1.0, (sum(prior[0].values()) + sum(prior[1].values())) / 2)
        mixed = [{c: sides[s][c] + how.prior * prior[s][c] / many for c in range(how.classes)} for s in (0, 1)]
        chosen[w] = int(np.argmax([np.float32(gain(*mixed, c)) for c in range(how.classes)]))
    cls = lambda w: chosen.get(w, own[unit(w)])
    last = np.zeros_like(grid)
    for t in train:
        for a, b in zip([end, *t], t):
            last[cls(a), cls(b)] += 1
    share = (last.sum(axis=0) + 1) / (last.sum() + how.classes)
    members = collections.Counter(cls(w) for w in count)
    for k, t in enumerate(words):
        x = got[k]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (vocabulary + 1))) for w in t)
        score = sum(math.log10((last[cls(a), cls(b)] + how.prior * share[cls(b)]) / (last[cls(a)].sum() + how.prior)) + math.log10((count[b] + 0.5) / (last[:, cls(b)].sum() + 0.5 * (members[cls(b)] + 1))) for a, b in zip([end, *t], t))
        assert x["held_out"] == (_fold(k, 5) == 1) and x["train_tokens"] == total and x["n_tokens"] == len(t) and x["n_known"] == sum(count[w] > 0 for w in t)
        assert abs(x["base_score"] - base) < 1e-6 and abs(x["score"] - score) < 1e-6


def test_held_out_accuracy(spark, data_dir):
    """Language and toxicity on the rows that nothing was learned from."""
    docs, labels = (spark.read.parquet(f"{data_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = langid.language(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(found) > 100 and np.mean([x["lang"] == x["lang_pred"] for x in found]) >= 0.97
    marked = toxicity.toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").collect()
    clean, toxic = ([x["predicted"] for x in marked if x["toxic"] == k] for k in (0, 1))
    assert np.mean(clean) <= 0.02 and sum(toxic) >= 0.6 * len(toxic)


def test_more_than_64_languages(spark):
    r = random.Random(23)
    rows = [(k, "".join(chr(0x4E00 + 40 * (k % 70) + r.randrange(3)) for _ in range(60)), f"l{k % 70:02d}") for k in range(700)] + [(None, "abc", "l00"), (None, "abc", "l00"), (5000, "一" * 90_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    got = langid.language(docs, langid.BiGRU(epochs=1)).collect()
    assert len(got) == len(rows) and len({x["lang_pred"] for x in got}) > 20
    assert sum(x["doc_id"] is None for x in got) == 2 and {x["held_out"] for x in got if x["doc_id"] is None} == {zlib.crc32(b"") % 3 == 1}


def test_odd_rows(spark):
    """Null ids and repeated rows give a row each; equal rows give equal results."""
    texts = corpus(9, 40)
    docs = frame(spark, texts)
    odd = docs.unionAll(docs.where("doc_id < 9")).unionAll(docs.where("doc_id between 20 and 25").withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 40, 3)] + [(None, 1), (3, 1)], "doc_id long, toxic int")
    runs = {
        "toxicity": toxicity.toxicity(odd, labels),
        "quality": quality.quality(odd, labels.select("doc_id")),
        "substrings": substrings.removed_report(odd, substrings.Phrases(12, 4, shard_mb=0.02)),
        "brown": brown.language_model(odd, brown.Brown(frequent=20, endings=8, classes=4)),
        "language": langid.language(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))),
    }
    for name, run in runs.items():
        rows = run.collect()
        assert sorted(x["doc_id"] is None for x in rows) == [False] * 49 + [True] * 6, name
        for k in range(9):
            own = {tuple(x) for x in rows if x["doc_id"] == k}
            assert len(own) == 1 and sum(x["doc_id"] == k for x in rows) == 2, name


def test_packing_of_odd_rows(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "x"), (None, None), (2, "word " * 40_000)], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048).collect()
    assert sum(x["doc_id"] == 1 for x in rows) == 3 and sum(x["doc_id"] is None for x in rows) == 2
    long_ = sorted((x["piece"], x["start"], x["length"]) for x in rows if x["doc_id"] == 2)
    assert all(n == 2048 for *_, n in long_[:-1]) and [s for _, s, _ in long_] == [2048 * k for k in range(len(long_))]
    places = collections.defaultdict(list)
    for x in rows:
        places[x["sequence_id"]].append((x["offset"], x["length"]))
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048


def test_contamination_of_odd_rows(spark):
    """Items are those of the row itself, with null and with repeated ids."""
    r = random.Random(24)
    items = [(f"i{k}", _text(r, 15)) for k in range(4)]
    rows = [(None, items[0][1] + " x"), (None, "y " + items[1][1]), (5, items[2][1]), (5, items[3][1] + " and " + items[0][1]), (5, items[2][1]), (6, "nothing here"), (None, None), (7, _text(r, 20_000) + " " + items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(0))
    got = sorted((x["doc_id"] or 0, x["n_hit"], x["items"]) for x in decontam.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect())
    assert got == sorted([(0, 15, ["i0"]), (0, 15, ["i1"]), (5, 15, ["i2"]), (5, 30, ["i0", "i3"]), (5, 15, ["i2"]), (6, 0, []), (0, 0, []), (7, 15, ["i1"])])
    near = decontam.proximity_matches(docs.where("doc_id = 7"), spark.createDataFrame(items, "item_id string, text string"), slop=0).collect()
    assert {x["item_id"] for x in near} == {"i1"}


def test_repeated_ids_of_near_duplicates(spark):
    """A document has the links of all its texts; each row its own set's size."""
    from massloom.llm.minhash import MinHash, near_duplicates

    r = random.Random(25)
    a, b, c = (_text(r, 60) for _ in range(3))
    rows = [(4, a), (4, b), (2, a + " more"), (3, b), (9, c), (9, c), (None, a), (8, "")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted((x["doc_id"] or 0, x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(docs, MinHash(3, 85)).collect())
        n = {t: len({tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)}) for t in (a, b, c, a + " more")}
        assert got == sorted([(4, n[a], 2, False), (4, n[b], 2, False), (2, n[a + " more"], 2, True), (3, n[b], 2, False), (9, n[c], 9, True), (9, n[c], 9, True), (0, n[a], None, True), (8, 0, 8, True)], key=lambda x: (x[0], x[1]))
