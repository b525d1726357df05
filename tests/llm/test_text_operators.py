"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from massloom.llm import brown, decontam, edits, langid, licenses, lines, minhash, packing, quality, substrings, toxicity
from massloom.llm.components import components
from massloom.llm.folds import remainder
from massloom.llm.textcols import Words, chunks, ngrams, utf8
from massloom.llm.workspace import Workspace

WORDS = [a + b for a in ("ba", "de", "fi", "go", "lu", "ma", "ne", "po") for b in ("ra", "te", "si", "no", "ku", "é", "x", "yl")]


def _text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(seed=0, n=60):
    """Texts with exact and near copies, shared passages, nulls, empties, one very long one."""
    r = random.Random(seed)
    out = [_text(r, r.randint(1, 120)) for _ in range(n)]
    passage = _text(r, 70)
    for k in range(0, n, 7):
        out[k] = out[k] + "\n" + passage + "\n" + _text(r, 20)
    for k in range(3, n, 9):
        out[k] = out[k - 1]
    for k in range(5, n, 11):
        words = out[k - 2].split(" ")
        words[len(words) // 2] = "changed"
        out[k] = " ".join(words)
    out[10], out[11], out[12], out[13] = None, "", " \n\t ", _text(r, 30_000)
    return out


def frame(spark, texts, start=0):
    rows = [(start + k, t, "x", "src", 1, 2.0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_hit int, score double").repartition(3)


def empty(spark):
    return frame(spark, ["x"]).limit(0)


def test_words_and_ngrams():
    texts = pa.array(["Hello  wORLD\tx", None, "", "é a\x0bb", "a"])
    w = Words(*utf8(texts))
    assert [w.buf[a:b].tobytes() for a, b in zip(w.start, w.end)] == [b"Hello", b"wORLD", b"x", "é".encode(), b"a", b"b", b"a"]
    h = w.hashes(lower=True)
    assert h[4] == h[6] and len(set(h.tolist())) == 6
    g, rows = ngrams(h, w.rows, 2)
    assert rows.tolist() == [0, 2, 2, 2, 4, 4]
    again = pa.array(["world X", "b"])
    v = Words(*utf8(again))
    assert ngrams(v.hashes(lower=True), v.rows, 2)[0][0] == g[1]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 100, "b", "c" * 300, "d"])], ["text"])
    assert [b.num_rows for b in chunks(iter([batch]), limit=150)] == [2, 1, 1]


def test_components(spark):
    work = Workspace(spark, "t")
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100 + r.randint(0, 30), 100 + r.randint(0, 30)) for _ in range(30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r_["id"]: r_["component"] for r_ in components(work, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) >= {x for a, b in edges if a != b for x in (a, b)}
    assert components(work, spark.createDataFrame([], "a long, b long")).count() == 0


def _shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_minhash(spark, n, percent):
    texts = corpus()
    sets = [_shingles(t, n) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(sets)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, minhash.MinHash(n, percent)).collect()}
    assert got == {k: (len(sets[k]), comp[k], comp[k] == k) for k in range(len(texts))}
    kept = minhash.drop_near_duplicates(docs, minhash.MinHash(n, percent))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k in range(len(texts)) if comp[k] == k}


def test_minhash_nulls_repeats_and_empty(spark):
    docs = frame(spark, ["a b c d e f", "a b c d e f"]).union(frame(spark, ["a b c d e f"])).union(frame(spark, ["a b c d e f"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == [(0, 0, True), (0, 0, True), (1, 0, False), (None, None, True)]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_group_that_one_hub_does_not_link(spark):
    """A chain of texts, each near the next one only."""
    r = random.Random(9)
    base = [r.choice(WORDS) + str(k) for k in range(120)]
    texts = [" ".join([f"n{k}" for k in range(s)] + base[s:]) for s in range(0, 60, 6)]
    sets = [_shingles(t, 3) for t in texts]
    near = [(a, b) for a in range(10) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert near and len(near) < 45
    got = minhash.near_duplicates(frame(spark, texts), minhash.MinHash(3, 85)).collect()
    assert {r_["component_id"] for r_ in got} == {0}


def test_quality(spark):
    r = random.Random(2)
    texts = [_text(r, 60) for _ in range(30)] + ["# * bad | bad | " * 30, "short", None, "", "same line here now\n" * 12, "A" + "b" * 70_000]
    docs = frame(spark, texts)
    got = {x["doc_id"]: x for x in quality.quality(docs, docs.where("doc_id < 20")).collect()}
    for k, t in enumerate(texts):
        w = [x for x in re.split("[\x09-\x0d\x20]+", t or "") if x]
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(hit))
        x = got[k]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        assert x["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
    assert all(got[k]["kept"] for k in range(20)) and got[30]["score"] < min(got[k]["score"] for k in range(30)) and got[32]["score"] is None
    nothing = quality.quality(docs, docs.limit(0).select("doc_id")).collect()
    assert all(x["score"] in (None, 0.0) for x in nothing)
    assert quality.quality(empty(spark), docs.select("doc_id")).count() == 0


@pytest.mark.parametrize("window, phrase", [(50, 10), (12, 4)])
def test_substrings(spark, window, phrase):
    texts = corpus(4)
    texts[20] = (texts[7] + " ") * 2
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    docs = frame(spark, texts)
    how = substrings.Phrases(window, phrase, shard_mb=0.02)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removed_report(docs, how).collect()}
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[d] == (len(w), len(gone), hashlib.sha256(left).hexdigest())
    assert any(v[1] for v in got.values())
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["n_removed"] for r in substrings.removed_report(nulls, how).collect()} == {0}
    assert substrings.removed_report(empty(spark), how).count() == 0


def test_packing(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["It's we'll, \"x.\" 3.14 ..., <|endoftext|>. <|ENDOFTEXT|> don't.\nÀ la É. Σας ΣΑΣ. İx. y z. a.\n b", "rock'n'roll’s a’s. É, é;; ñ: œ. "]
    texts = corpus(5) + odd
    docs = frame(spark, texts)
    rows = packing.pack(docs, path, 64, with_ids=True).collect()
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}
    back, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == 64 * r["piece"] and r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        back[r["doc_id"]] += r["ids"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(back) == ids
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 64) * 1.01
    assert packing.pack(empty(spark), path, 64).count() == 0
    small = packing.CachedEncoder(path, most=50)
    for _ in range(2):
        for k in range(0, len(texts), 10):
            got = small.encode(pa.array(texts[k : k + 10]))
            assert [g.tolist() for g in got] == [ids[k + i][:-1] for i in range(len(got))]


def test_fullest_combination():
    r = random.Random(1)
    for _ in range(60):
        have = {r.randint(1, 30): r.randint(1, 3) for _ in range(5)}
        room = r.randint(1, 60)
        sums = {0}
        for size, n in have.items():
            sums = {s + size * k for s in sums for k in range(n + 1)}
        got = packing.fullest(have, room)
        assert sum(s * n for s, n in got) == max(s for s in sums if s <= room) and all(n <= have[s] for s, n in got)


def test_lines(spark):
    r = random.Random(6)
    base = [_text(r, 14) for _ in range(25)]
    near = base[3][:-1] + "q"
    texts = ["\n".join(base[:5]), "\n".join([base[3].upper() + "!", base[6], "ok"]), near + "\n" + base[7], None, "", "ok\nok\nok", "\n".join(base[:5]), base[8] + "\n\n" + base[0]]
    docs = frame(spark, texts)
    how = lines.FuzzyLines()
    up = {c: c + 32 for c in [*range(65, 91), *(x for x in range(0xC0, 0xDF) if x != 0xD7)]}

    def compared(t):
        forms = (" ".join(re.findall("[0-9A-Za-z\x80-\U0010ffff]+", x.translate(up))) for x in (t or "").split("\n"))
        return [(k, f) for k, f in enumerate(forms) if f]

    first = {}
    for d, t in enumerate(texts):
        for k, f in compared(t):
            first.setdefault(f, (d, k))
    forms = list(first)
    group = {first[f]: first[f] for f in forms}
    for _ in forms:
        for i, a in enumerate(forms):
            for b in forms[:i]:
                if min(a.count(" "), b.count(" ")) >= 4 and _distance(a, b) <= max(len(a), len(b)) * 20 // 100:
                    group[first[a]] = group[first[b]] = min(group[first[a]], group[first[b]])
    got = {x["doc_id"]: x for x in lines.line_report(docs, how).collect()}
    left = {x["doc_id"]: x for x in lines.dedup_lines(docs, how).collect()}
    for d, t in enumerate(texts):
        gone = {k for k, f in compared(t) if group[first[f]] != (d, k)}
        assert got[d]["n_removed"] == len(gone)
        if t is None:
            assert got[d]["kept_sha256"] is None and left[d]["text"] is None
            continue
        kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert got[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and got[d]["n_lines"] == t.count("\n") + 1
        assert (d in left) == (not (gone and not kept.strip())) and (d not in left or left[d]["text"] == kept)
    assert lines.dedup_lines(docs).columns == docs.columns and lines.line_report(empty(spark)).count() == 0
    clash = docs.withColumn("stay", F.lit(1)).withColumn("n_chars", F.length("text"))
    assert {x["n_chars"] for x in lines.dedup_lines(clash).where("text is not null").select("n_chars", "text").collect() if x["n_chars"] != len(x["text"])} == set()
    many = np.repeat(np.array([5], np.uint64), 40_000)
    assert lines.simhashes(many, np.array([0]), np.array([40_000])).tolist() == [5]


def test_lines_of_which_words_changed(spark):
    """Pairs by edit similarity alone, with no SimHash in what is expected."""
    r = random.Random(12)
    texts = []
    for k in range(150):
        words = _text(r, r.randint(8, 60)).split(" ")
        other = list(words)
        for at in r.sample(range(len(words)), max(1, len(words) // 12)):
            other[at] = "".join(r.choice("abcdefghik") for _ in other[at])
        texts += [" ".join(words), " ".join(other)]
    assert all(_distance(a, b) * 5 <= max(len(a), len(b)) for a, b in zip(texts[::2], texts[1::2]))
    got = {x["doc_id"]: x["n_removed"] for x in lines.line_report(frame(spark, texts)).collect()}
    assert sum(got[k] for k in range(1, len(texts), 2)) >= 0.97 * 150 and sum(got[k] for k in range(0, len(texts), 2)) == 0


def test_lines_recall(spark):
    """One letter changed, one word replaced, dropped or added, in lines of 5 to 60 words: expected by edit similarity alone."""
    r = random.Random(13)
    texts, kinds = [], []
    for kind in ("letter", "replaced", "dropped", "added"):
        for k in range(90):
            words = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.choice((5, 6, 8, 11, 12, 13, 16, 20, 30, 60)))]
            other, at = list(words), r.randrange(len(words))
            if kind == "letter":
                other[at] = "z" + other[at][1:]
            elif kind == "replaced":
                other[at] = "xyz"
            else:
                other[at : at + 1] = [] if kind == "dropped" else [other[at], "qqq"]
            if min(len(other), len(words)) < 5 or _distance(" ".join(words), " ".join(other)) * 5 > max(len(" ".join(words)), len(" ".join(other))):
                continue
            texts += [" ".join(words), " ".join(other)]
            kinds.append(kind)
    got = {x["doc_id"]: x["n_removed"] for x in lines.line_report(frame(spark, texts)).collect()}
    share = {kind: np.mean([got[2 * k + 1] for k, x in enumerate(kinds) if x == kind]) for kind in set(kinds)}
    assert len(kinds) > 300 and min(share.values()) >= 0.9, share
    assert sum(got[k] for k in range(0, len(texts), 2)) == 0


def test_lines_of_odd_rows(spark):
    """Repeated ids with other texts, null ids, copies of short lines and of very long ones, scripts without spaces."""
    r = random.Random(14)
    long_ = _text(r, 30_000)
    cjk = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(30))
    rows = [(1, "one two\nthree\nfour"), (1, "x"), (1, "one two\nthree\nfour"), (2, "x\nthree"), (None, "x"), (None, None), (3, long_), (4, long_ + " more\n!!"), (5, cjk), (6, cjk[:12] + "一" + cjk[13:]), (7, "三"), (8, "三")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted(((x["doc_id"] or 0, x["n_lines"] if x["kept_sha256"] else 0, x["n_removed"]) for x in lines.line_report(docs).collect()))
        same = [(1, 1, 0), (1, 3, 0), (1, 3, 0)]
        assert got == [(0, 0, 0), (0, 1, 0), *same, (2, 2, 2), (3, 1, 0), (4, 2, 1), (5, 1, 0), (6, 1, 1), (7, 1, 0), (8, 1, 1)]
        assert sorted(x["doc_id"] or 0 for x in lines.dedup_lines(docs).collect()) == [0, 0, 1, 1, 1, 3, 4, 5, 7]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    r = random.Random(3)
    for _ in range(300):
        a = "".join(r.choice("abc é") for _ in range(r.randint(0, 40)))
        b = a if r.random() < 0.2 else "".join(c for c in a if r.random() > 0.1) + r.choice(["", "x", "abc"])
        b = b[::-1] if r.random() < 0.2 else b
        d = _distance(a, b)
        assert [edits.within(a, b, k) for k in (d - 1, d, d + 1)] == [d == 0 and False, True, True]


def test_edit_distances_of_many_pairs(monkeypatch):
    monkeypatch.setattr(edits, "LEAST_PAIRS", 0)
    r = random.Random(4)
    for _ in range(6):
        pairs, most = [], []
        for _ in range(40):
            a = "".join(r.choice("abcé d") for _ in range(r.choice([1, 5, 60, 63, 64, 65, 127, 128, 129, 200]) + r.randint(0, 3)))
            b = "".join((r.choice("abc一") if r.random() < 0.15 else c) + ("b" if r.random() < 0.04 else "") for c in a if r.random() > 0.08)
            b = "".join(r.choice("abcé d") for _ in a) if r.random() < 0.2 else b
            pairs.append((a, b))
            most.append(max(0, _distance(a, b) + r.choice([-10, -2, -1, 0, 0, 1, 5])))
        assert edits.all_within(pairs, most).tolist() == [_distance(a, b) <= m for (a, b), m in zip(pairs, most)]


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    texts = [mit, "Copyright 2020 A\n" + mit.upper().replace(",", " , "), "// " + mit.replace("\n", "\n// ").replace("license", "licence"), mit + " more", None, "", "!!!", "Released under the MIT Licence"]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in licenses.license_scan(docs, licenses.known_licenses(spark)).collect()}
    assert [got[k]["license_id"] for k in range(8)] == ["MIT", "MIT", "MIT", None, None, None, None, "notice:MIT"]
    assert got[4]["digest"] is None and got[5]["digest"] == hashlib.sha256(b"").hexdigest() and got[6]["n_words"] == 0
    assert licenses.license_scan(empty(spark), licenses.known_licenses(spark)).count() == 0
    # titles, copyright statements, wrapped lines; repeated rows and null ids; long texts
    wrapped = "ISC License\n\nCopyright (c) 2004, A B\n(c) 2005 C\n\n" + licenses.KNOWN["ISC"].replace("above copyright", "above\ncopyright")
    apache = dict(licenses.known_texts())["Apache-2.0"]
    bsd = "Copyright <YEAR> <COPYRIGHT HOLDER>\nAll rights reserved.\n\n" + licenses.KNOWN["BSD-3-Clause"]
    more = [(1, wrapped), (1, wrapped), (2, "The MIT License (MIT)\n\n© 2020 D\n\n" + mit), (None, apache.replace("\n", "\r\n").upper()), (3, mit * 400), (4, bsd), (5, "Copyright law\n" + mit), (6, apache)]
    got = licenses.license_scan(spark.createDataFrame(more, "doc_id long, text string"), licenses.known_licenses(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["license_id"] or "") for r in got) == [(0, "Apache-2.0"), (1, "ISC"), (1, "ISC"), (2, "MIT"), (3, ""), (4, "BSD-3-Clause"), (5, ""), (6, "Apache-2.0")]
    twins = spark.createDataFrame([("b", "Some text."), ("a", "some, TEXT")], "license_id string, text string")
    assert licenses.license_scan(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), twins).first()["license_id"] == "a"


def test_decontamination(spark):
    r = random.Random(8)
    items = [(k, _text(r, n)) for k, n in enumerate((40, 25, 13, 6, 0, 30))] + [(6, None), (7, "Same, as; ITEM"), (8, "same as item")]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    long = items[0][1].split()
    texts = [_text(r, 40) + " " + items[1][1].upper().replace(" ", ", ") + " " + _text(r, 9), " ".join(long[:13]) + " " + _text(r, 400), " ".join(long[:12]), items[3][1], None, "", "x same AS -item", items[2][1] + " " + items[2][1], _text(r, 20_000) + " " + items[5][1]]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(k)
    got = {x["doc_id"]: x for x in decontam.contamination(docs, bench).collect()}
    for d, t in enumerate(texts):
        w, hit, own = words(t), set(), set()
        for win, ks in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    own |= ks
        x = got[d]
        assert (x["n_words"], x["n_hit"], x["items"], x["contaminated"]) == (len(w), len(hit), sorted(map(str, own)), bool(hit) and 20 * len(hit) >= len(w))
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {x["doc_id"] for x in clean.collect()} == {d for d in got if not got[d]["contaminated"]}
    exact = {(x["doc_id"], x["item_id"]) for x in decontam.proximity_matches(docs, bench, slop=0).collect()}
    assert exact == {(d, int(k)) for d in got for k in got[d]["items"]}
    gap = frame(spark, [" ".join([*long[:5], "between", *long[5:13]])])
    assert {x["item_id"] for x in decontam.proximity_matches(gap, bench, slop=2).collect()} >= {0} and not decontam.contamination(gap, bench).first()["n_hit"]
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and decontam.contamination(empty(spark), bench).count() == 0


def test_toxicity(spark):
    r = random.Random(11)
    texts = [_text(r, 40) + (" vile awful nasty" if k % 4 == 0 else "") for k in range(600)] + [None, "", "vile awful nasty vile"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0 and k % 8 != 4)) for k in range(0, 600, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, labels).collect()}
    held = {k for k in got if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {k for k, x in got.items() if x["held_out"]} == held and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got.values())
    right = [got[k]["predicted"] == (k % 4 == 0) for k in held if k < 600]
    assert np.mean(right) > 0.95 and got[602]["predicted"] == 1
    changed = labels.withColumn("toxic", F.when(remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {k: x["score"] for k, x in got.items()} == {x["doc_id"]: x["score"] for x in toxicity.toxicity(docs, changed).collect()}
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.where("doc_id = 602").count() == 0
    assert max(x["score"] for x in toxicity.toxicity(docs, labels.limit(0)).collect()) < 1e-9 and toxicity.toxicity(empty(spark), labels).count() == 0


def test_language(spark):
    r = random.Random(12)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    rows = [(k, "".join(r.choice(kinds[("aa", "bb")[k % 2]] + " ") for _ in range(r.randint(20, 200))), ("aa", "bb")[k % 2]) for k in range(240)] + [(240, None, "aa"), (241, "123 !", "bb"), (242, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.language(docs).collect()}
    assert [got[k]["lang_pred"] for k in (240, 241, 242)] == ["und"] * 3
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in range(240) if got[k]["held_out"]]) > 0.95
    assert {x["lang_pred"] for x in langid.language(docs.where("lang is null")).collect()} == {"und"} and langid.language(docs.limit(0)).count() == 0


def test_gradients():
    net = langid.Network(["a", "b"], 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, length = np.array([[1, 2, 3, 0], [4, 5, 0, 0]], np.uint8), np.array([4, 2])
    loss, g = net.gradients(x, length, np.array([0, 1]))
    for name, at in (("f_xg", (2, 1)), ("b_xn", (4, 0)), ("f_hg", (0, 4)), ("b_hn", (1, 2)), ("out", (2, 1)), ("bias", (0,))):
        net.p[name][at] += 1e-3
        up = net.gradients(x, length, np.array([0, 1]))[0]
        net.p[name][at] -= 2e-3
        down = net.gradients(x, length, np.array([0, 1]))[0]
        net.p[name][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[name][at], abs=2e-4), name


def test_language_model(spark):
    texts = corpus(7) + ["UPPER Upper upper"]
    docs = frame(spark, texts)
    got = {x["doc_id"]: x for x in brown.language_model(docs, brown.Brown(frequent=20, endings=8, classes=5, shard_mb=0.03)).collect()}
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    train = [zlib.crc32(str(k).encode()) % 5 != 1 for k in range(len(texts))]
    count = collections.Counter(w for t, own in zip(tokens, train) if own for w in t)
    n, v = sum(count.values()), len(count)
    for k, t in enumerate(tokens):
        x = got[k]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (not train[k], len(t), sum(count[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) and x["score"] < 0
    assert brown.language_model(empty(spark)).count() == 0


def test_rare_words_are_classed_by_their_neighbours(spark):
    r = random.Random(4)
    name = lambda end: "".join(r.choice("bcdfgh") for _ in range(4)) + end
    after_x = [name("aq") for _ in range(60)] + [name("oz") for _ in range(4)]  # a few end like the other kind
    after_y = [name("oz") for _ in range(60)] + [name("aq") for _ in range(4)]
    texts = [" ".join(f"xx {r.choice(after_x)} yy {r.choice(after_y)}" for _ in range(20)) for _ in range(300)]
    asked = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 1][:8]
    for k, (right, wrong) in zip(asked[::2], zip(after_x[-4:], after_y[-4:])):
        texts[k], texts[asked[asked.index(k) + 1]] = f"xx {right} yy", f"xx {wrong} yy"
    got = {x["doc_id"]: x["score"] - x["base_score"] for x in brown.language_model(frame(spark, texts), brown.Brown(frequent=2, endings=8, classes=5)).collect()}
    assert all(got[a] > got[b] for a, b in zip(asked[::2], asked[1::2]))


def test_exchange_gains_likelihood():
    r = np.random.default_rng(0)
    counts = np.zeros((12, 12))
    for _ in range(4000):  # even units follow odd ones
        a = r.integers(0, 12)
        counts[a, r.choice([k for k in range(12) if k % 2 != a % 2])] += 1

    def likelihood(own):
        grid = np.zeros((2, 2))
        np.add.at(grid, (own[:, None], own[None, :]), counts)
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(grid) - f(grid.sum(0)) - f(grid.sum(1))

    own = brown.exchange(counts, 2, 10)
    assert likelihood(own) >= likelihood(np.arange(12) % 2) - 1e-6 and len(set(own[::2])) == 1


def test_model_is_a_distribution():
    how = brown.Brown(frequent=3, endings=2, classes=2)
    r = np.random.default_rng(1)
    pairs = r.integers(0, 9, (6, 6)).astype(float)
    words = np.array([1, 1, 1, 4, 2, 1.0])
    m = brown.fit(np.array([1, 2, 3], np.uint64), pairs, words, int(pairs.sum()), int(words.sum()), how)
    assert (10**m.follows).sum(axis=1) == pytest.approx(np.ones(2))


def test_lines_meet_within_their_components(spark, monkeypatch):
    """Buckets of all kinds (all pairs at once, across components, by hubs) give the same groups; pairs in one component are not written, and of odd bits those of negative words count in full."""
    import pandas as pd

    how = lines.FuzzyLines()
    r = random.Random(15)
    common = "alpha beta gamma delta epsilon zeta"
    texts = [f"{common} {_text(r, 5)}" for _ in range(40)]
    texts += [x[:-1] + "q" for x in texts[:20]] + ["same words of many lines here " + c for c in "abcdefghijklmnopqrst"]
    docs, got = frame(spark, texts), []
    for full, pairs in ((2000, 4), (2000, 0), (5, 0)):
        monkeypatch.setattr(lines, "MOST_FULL", full)
        monkeypatch.setattr(lines, "MOST_PAIRS", pairs)
        got.append({x["doc_id"]: x["n_removed"] for x in lines.line_report(docs, how).collect()})
    assert got[0] == got[1] == got[2]
    assert [got[0][k] for k in range(20)] == [0] * 20 and [got[0][k] for k in range(40, 60)] == [1] * 20 and sum(got[0][k] for k in range(60, 80)) == 19
    rows = [(7, k, None, 60, 10, 1 if k < 30 else k) for k in range(32)] + [(8, 40, 0, 300, 50, 40), (8, 41, 0, 300, 50, 41)]
    rest = pd.DataFrame(rows, columns=["bucket", "id", "s", "n", "w", "component"]).astype({"s": "Int64"})
    for p in lines.BITMAP:
        rest[p] = pd.array([None] * 32 + [-1, 0], "Int64")
    kinds = "bucket long, id long, s long, n int, w int, component long, " + ", ".join(f"{p} long" for p in lines.BITMAP)
    across = lines._across(spark.createDataFrame(rest.astype(object).where(rest.notna(), None).values.tolist(), kinds), how, 4)
    assert {(x["a"], x["b"]) for x in across.collect()} == {*((k, 30) for k in range(30)), *((k, 31) for k in range(31))}


def test_lines_forms_of_a_batch():
    texts = pa.array(["Ab,, C\n\n ÀÉ!x  \nno", None, "", "é\n--\nZ z\n"])
    found = lines.Lines(texts)
    assert found.worded().tolist() == [True, False, True, True, True, False, True, False]
    own = np.flatnonzero(found.worded())
    assert lines.Lines(found.texts(own[::-1])).forms().to_pylist() == ["z z", "é", "no", "àé x", "ab c"]
    h = np.random.default_rng(1).integers(0, 1 << 63, 900, dtype=np.uint64)
    at, n = np.array([0, 255, 500]), np.array([255, 245, 200])
    assert lines.majority_of_bytes(lines.lanes(h, at, n, 8), n).tolist() == lines.majority(lines.lanes(h, at, n), n).tolist()
