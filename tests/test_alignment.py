"""The batched kernel, the template index and profiles, against the pairwise kernel, full products and recorded results."""

from __future__ import annotations

import random

import numpy as np
import pytest

from massloom.operators import alignment as al
from massloom.operators import alignment_index as ix
from massloom.operators import profiles as pr
from massloom.operators.alignment_batch import Table, align_many, align_rows, score_all

RESIDUES = "ARNDCQEGHILKMFPSTWYV"


def _sequence(r, lo=0, hi=14):
    return "".join(r.choice(RESIDUES if r.random() < 0.5 else "AGNQLIVSK") for _ in range(r.randint(lo, hi)))


def _changed(r, s, most=3):
    s = list(s)
    for _ in range(r.randint(0, most)):
        k, how = r.randrange(len(s) + 1), r.random()
        if how < 0.3:
            s.insert(k, r.choice(RESIDUES))
        elif k < len(s):
            if how < 0.6:
                s[k] = r.choice(RESIDUES)
            elif how < 0.8:
                del s[k]
            elif k + 1 < len(s):
                s[k], s[k + 1] = s[k + 1], s[k]
    s = "".join(s).replace("N", "GG", int(r.random() < 0.3))
    return s.replace("M", "M[Oxidation]", 1) if r.random() < 0.3 else s


@pytest.mark.parametrize("scoring", [al.Scoring(), al.Scoring(mismatch=-1, pair="peptide_to_database", mass_mismatch=-2), al.Scoring(mismatch=12), al.Scoring(matrix=al.IDENTITY)])
def test_batches_equal_single_alignments(scoring):
    r = random.Random(1)
    own = [_sequence(r) for _ in range(60)]
    pairs = [(x, _changed(r, x)) for x in own] + [(r.choice(own), r.choice(own)) for _ in range(60)]
    pairs += [("ABZA", "ANQA"), (None, "A"), ("A1", "A"), ("A[unheard of]", "A"), ("", ""), ("", "AAA")]
    for kind in al.TYPES:
        for (x, y), got in zip(pairs, align_many(pairs, kind, scoring, 4)):
            try:
                want = al.align(x, y, kind, scoring, 4) if x is not None and y is not None else None
            except (ValueError, KeyError):
                want = None
            if want is None:
                assert isinstance(got, str) and got
            else:
                assert (want.path, want.score, want.maximum, want.start_a, want.start_b) == (got.path, got.score, got.maximum, got.start_a, got.start_b)


def _families(r, n, families):
    base = [_sequence(r, 9, 18) for _ in range(families)]
    return [_changed(r, base[k % families], 2) for k in range(n)]


@pytest.mark.parametrize("kind", ["global", "local", "either_global"])
@pytest.mark.parametrize("scoring", [al.Scoring(), al.Scoring(mismatch=1, isobaric=4, rotated=2)])
def test_index_gives_the_rows_of_all_pairs(kind, scoring):
    r = random.Random(2)
    queries, templates = ([al.residues(s) for s in _families(random.Random(3), 60, 12) + ["ABZN", "A"]] for _ in range(2))
    r.shuffle(templates)
    kinds: dict = {}
    a, b = Table(queries, kinds), Table(templates, kinds)
    qi, ti = np.divmod(np.arange(len(queries) * len(templates)), len(templates))
    full = align_rows(a, qi, b, ti, kind, scoring, 4, len(kinds), paths=False)[0].reshape(len(queries), -1)
    for keep in (1, 4):
        got, aligned = ix.search(queries, templates, keep, kind, scoring, 4)
        for k, row in enumerate(full):
            assert got[k] == [(int(row[x]), int(x)) for x in np.lexsort((np.arange(len(row)), -row))[:keep]]
        assert aligned < full.size


@pytest.mark.parametrize("scoring", [al.Scoring(), al.Scoring(mismatch=-1, pair="peptide_to_database", mass_mismatch=-2), al.Scoring(matrix=al.IDENTITY)])
def test_all_scores_are_those_of_single_alignments(scoring):
    r = random.Random(7)
    queries = [al.residues(s) for s in _families(r, 9, 3) + ["", "A", "AAAAAAAA", "NGGN", "[Acetyl]-AGAG"]]
    templates = [al.residues(s) for s in _families(random.Random(7), 9, 3) + ["", "GGGG", "AAAAAA"]]
    for kind in al.TYPES:
        kinds: dict = {}
        want = [[al.align(x, y, kind, scoring).score for y in templates] for x in queries]
        for cells in (1_000_000, 700):
            assert score_all(Table(queries, kinds), Table(templates, kinds), kind, scoring, 4, cells).tolist() == want


def test_ranking_with_and_without_several_masses():
    r = random.Random(8)
    queries = [al.residues(s) for s in _families(r, 30, 6) + ["ABZN", "A", "GGZZK"]]
    templates = [al.residues(s) for s in _families(r, 40, 6) + ["BAZ", "AA", "GGQEK"] + _families(r, 20, 6)]
    for keep in (1, 4):
        got = ix.ranked(queries, templates, keep, "either_global", al.Scoring(), 4)
        for q, row in zip(queries, got):
            assert row == [(-s, at) for s, at in sorted((-al.align(q, t, "either_global").score, at) for at, t in enumerate(templates))[:keep]]


def test_plain_words_are_ranked_without_alignment(monkeypatch):
    """A word against all part names costs no alignment of its own, however many words there are."""
    r = random.Random(9)
    own = [al.residues(_sequence(r, 8, 12)) for _ in range(300)]
    monkeypatch.setattr(ix, "align_rows", None)
    monkeypatch.setattr(ix.Bounds, "of_query", None)
    assert all(len(x) == 3 for x in ix.ranked(own, own[:64], 3, "either_global", al.Scoring(), 4))


def test_bounds_are_never_exceeded():
    r = random.Random(4)
    own = [al.residues(_changed(r, _sequence(r, 1, 12), 4)) for _ in range(50)] + [al.residues(s) for s in ("BZBZ", "N[deamidated]GD", "LLI", "OUXJ")]
    own = [o for o in own if o.letters]
    for scoring in (al.Scoring(), al.Scoring(mismatch=2, mass_mismatch=3, pair="peptide_to_database"), al.Scoring(matrix=al.IDENTITY, isobaric=3, mass_base=0)):
        kinds: dict = {}
        table, masses = Table(own, kinds), ix.Masses(own, 4, scoring.ppm)
        ix._pad(masses, table.letters, 4)
        bounds = ix.Bounds(scoring, 4, masses.counts.sum(0) > 0)
        for k, q in enumerate(own):
            most = bounds.of_query(q, masses, k, masses, table.letters)
            for t, other in enumerate(own):
                assert al.align(q, other, "local", scoring).score <= most[t]


def test_few_pairs_are_aligned():
    """Families of ten, all residues alike: from a tenth of the pairs."""
    r = random.Random(5)
    base = ["".join(r.choice(RESIDUES) for _ in range(r.randint(9, 18))) for _ in range(60)]
    own = [al.residues(_changed(r, base[k % 60], 2)) for k in range(600)]
    got, aligned = ix.search(own, own, 5, "either_global", al.Scoring(), 4)
    assert aligned < len(own) ** 2 / 10
    assert all(x[0][0] >= x[-1][0] and len(x) == 5 for x in got)


def test_best_templates(spark):
    r = random.Random(6)
    queries, templates = _families(r, 40, 8), _families(r, 60, 8)
    q = spark.createDataFrame([(k, s, "x") for k, s in enumerate(queries)] + [(90, None, "x"), (91, "A1", "x")], "query_id long, query string, score string")
    t = spark.createDataFrame([(f"t{k:02}", s) for k, s in enumerate(templates)] + [("bad", "?"), ("none", None)], "template_id string, template string")
    got = ix.best_templates(q, t, keep=3, pack=9, strip=13, common=5).collect()
    want = []
    for k, s in enumerate(queries):
        scored = sorted((-al.align(s, other, "either_global").score, f"t{n:02}", other) for n, other in enumerate(templates))[:3]
        want += [(k, n + 1, x[1], s, x[2], al.align(s, x[2], "either_global").cigar, -x[0]) for n, x in enumerate(scored)]
    assert sorted((x.query_id, x.rank, x.template_id, x.query, x.template, x.cigar, x.score) for x in got if x.error is None) == want
    assert sorted((x.query_id, x.rank, x.template_id) for x in got if x.error) == [(90, None, None), (91, None, None)]
    assert ix.best_templates(q.where("query_id < 3"), t.limit(0)).count() == 0 and ix.best_templates(q.limit(0), t).count() == 0


#: Sequences, ends, tolerance and the recorded rows of their alignment, in the order of merging.
MULTIPLE = [
    (["AGGWHD", "ANWHN[Deamidated]", "AHYDH"], "global", 10, ["AGGWHD", "AN·WHN", "AHY·DH"]),
    (["WRGGDGFYAMDYWGQG", "RWGDGFYAMYDWGQG", "RWNDGYAMEDYWGQG", "RWGGDGFMDYWGQG"], "global", 10, ["WRGGDGFYAM-DYWGQG", "RWGGDGF--M-DYWGQG", "RWG-DGFYAM-YDWGQG", "RWN·DG-YAMEDYWGQG"]),
    (["WRGGDGFYAMDYWGQG", "RWGDGFYAMYD", "RWNDGYAMDYWGQG", "GDGFMDYWGQG"], "either_global", 10, ["WRGGDGFYAMDYWGQG", "---GDGF--MDYWGQG", "RWN·DG-YAMDYWGQG", "RWG-DGFYAMYD----"]),
    (
        ["CSRWRGGDGF", "WRNDGFYAM", "RWGGDGFYAMDYWG", "YW[Oxidation]DYWGQG", "RWGGNGFYW[Oxidation]DYWGQG"],
        "either_global",
        20,
        ["CSRWRGGDGF---------", "---WRN·DGFYAM------", "---RWGGDGFYAMDYWG--", "----------YW·DYWGQG", "---RWGGNGFYW·DYWGQG"],
    ),
    (["HYTTPPTFGQGT", "WGG", "VTC[Carboxymethyl]QGLSSPKSL"], "either_global", 20, ["----HYTTPPTFGQGT", "-----------WG-G-", "VTCQGLSSPKSL----"]),
    (["RWGGDGFYAMDYWGQG", "RWNDGFYW[Oxidation]DYWGQG"], "global", 20, ["RWGGDGFYAMDYWGQG", "RWN·DGFYW·DYWGQG"]),
    (["ATRNK", "AGRTGK", "ARGTGK"], "ragged_left", 10, ["ATRN·K", "AGRTGK", "ARGTGK"]),
]


def test_multiple_alignments(spark):
    """All recorded groups at once for each kind of ends and tolerance."""
    for kind, ppm in {(k, p) for _, k, p, _ in MULTIPLE}:
        groups = [(n, k, s) for n, (own, kd, p, _) in enumerate(MULTIPLE) for k, s in enumerate(own) if (kd, p) == (kind, ppm)]
        df = spark.createDataFrame([*groups, (99, 0, None), (99, 1, "A?"), (99, 2, "AGA"), (98, 0, "")], "family int, k int, s string")
        rows, merges = pr.multiple_alignment(df, "family", "k", "s", kind, al.Scoring(ppm=ppm))
        got = rows.collect()
        for n in {g[0] for g in groups}:
            assert sorted(x.aligned for x in got if x.family == n) == sorted(MULTIPLE[n][3])
        assert {(x.k, x.aligned, x.error is None) for x in got if x.family == 99} == {(0, None, False), (1, None, False), (2, "AGA", True)}
        assert merges.count() == len(groups) - len({g[0] for g in groups})


def test_merges_keep_sequences_and_columns():
    r = random.Random(7)
    for _ in range(25):
        base = _sequence(r, 6, 12)
        own = [_changed(r, base).replace("[Oxidation]", "") or "A" for _ in range(r.randint(2, 6))]
        rows = [pr.Row.of(k, al.residues(s)) for k, s in enumerate(own)]
        far = np.array([[abs(hash((min(x, y), max(x, y))) % 7) for y in own] for x in own], float)
        for kind in ("global", "either_global"):
            found, merges = pr.cluster(rows, (far + far.T) / 2, kind, al.Scoring(), 4)
            assert len(found) == 1 and len(merges) == len(own) - 1
            assert len({len(x.text) for x in found[0]}) == 1
            for x in found[0]:
                assert x.text.replace("-", "").replace("·", "") == own[x.key] and x.upto[-1] == len(own[x.key]) and x.upto == sorted(x.upto)


def test_two_rows_merge_as_pairs_align():
    r = random.Random(8)
    for _ in range(60):
        a, b = _sequence(r, 1), _sequence(r, 1)
        for kind in ("global", "either_global"):
            assert pr.merge([pr.Row.of(0, al.residues(a))], [pr.Row.of(1, al.residues(b))], kind)[1] == al.align(a, b, kind).score


def test_distant_clusters_stay_apart():
    rows = [pr.Row.of(k, al.residues(s)) for k, s in enumerate(["AAAA", "AAAC", "WWWW"])]
    far = np.array([[0, 0.25, 1], [0.25, 0, 1], [1, 1, 0]])
    found, merges = pr.cluster(rows, far, "global", al.Scoring(), 4, most=0.5)
    assert [[x.key for x in c] for c in found] == [[0, 1], [2]] and [m[:4] for m in merges] == [(0, 0, 1, 0.25)]


def test_consecutive_genes_of_one_species(spark):
    queries = spark.createDataFrame([(1, "AGWTHKLMFP"), (2, "WWWWHKLMFP")], "query_id long, query string")
    first = spark.createDataFrame([("v1", "AGWT", "human"), ("v2", "WWWW", None)], "template_id string, template string, species string")
    second = spark.createDataFrame([("j1", "HKLMFP", "mouse"), ("j2", "HKLMFA", "human")], "template_id string, template string, species string")
    free = {(x.query_id, x.gene): x.template_id for x in al.consecutive(queries, [first, second]).collect()}
    assert free == {(1, 0): "v1", (1, 1): "j1", (2, 0): "v2", (2, 1): "j1"}
    rows = al.consecutive(queries, [first, second], together=("species",)).collect()
    assert {(x.query_id, x.gene): x.template_id for x in rows} == {(1, 0): "v1", (1, 1): "j2", (2, 0): "v2", (2, 1): "j1"}
    assert [(x.start_query, x.end_query) for x in rows if (x.query_id, x.gene) == (1, 0)] == [(0, 4)]
