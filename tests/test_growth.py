"""What keeps the work in proportion to the tables: equal texts and values are worked on once, and generated sides aren't broadcast."""

from __future__ import annotations

import pyarrow as pa

from massloom.functions.text import of_distinct
from massloom.session import spread


def test_equal_texts_are_worked_on_once():
    asked = []

    def one(text):
        asked.append(text)
        return {"n": None if text is None else len(text)}

    got = of_distinct(pa.array(["ab", None, "ab", "", None, "c"]), one, pa.struct([("n", pa.int32())]))
    assert [x["n"] for x in got.to_pylist()] == [2, None, 2, 0, None, 1] and len(asked) == 4


def test_tasks_grow_with_rows(spark):
    assert spread(spark.range(1000), "id", each=10).rdd.getNumPartitions() == 100
    assert spread(spark.range(0)).count() == 0 and spread(spark.range(50), each=7).distinct().count() == 50


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_generated_sides_are_not_broadcast(spark, data_dir):
    from massloom.plans import QUERIES

    for name in ("annotate_scores", "series_scores"):
        plan = QUERIES[name](spark, data_dir)._jdf.queryExecution().sparkPlan().toString()
        assert "fragment_id" in plan or "peak_idx" in plan
        for line in plan.splitlines():
            assert "BroadcastHashJoin" not in line or "asked_" not in line and "bin_" not in line and "fragment_id" not in line, line


def test_nearest_compares_values_not_rows(spark):
    from pyspark.sql import functions as F

    from massloom.functions.tolerance import Tolerance
    from massloom.operators import joins

    a = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") % 3).cast("double").alias("x"))
    b = spark.range(3000).select(F.col("id").alias("j"), (F.col("id") % 2 + 0.5).alias("y"))
    met = joins.nearest_join(a, b, ("x", "y"), Tolerance.absolute(0.5), ["i"], [F.col("y"), F.col("j")])
    assert {(r.i % 3, r.j, r.y) for r in met.collect()} == {(0, 0, 0.5), (1, 0, 0.5), (2, 1, 1.5)} and met.count() == 3000
    joined = [int(n.split(",")[0].rstrip(")").split()[-1]) for n in _rows_of_joins(met)]
    assert joined and max(joined) <= 3000


def _rows_of_joins(df):
    """Rows out of each join of a run, as its metrics tell."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        kind = p.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if "Join" in kind and p.metrics().contains("numOutputRows"):
            found.append(str(p.metrics().apply("numOutputRows").value()))
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_shifted_places_are_moved_once(spark):
    """Peaks of one place and fragments of one place are each one row of the semi-join."""
    from pyspark.sql import functions as F

    from massloom.functions.tolerance import Tolerance
    from massloom.operators import spectra

    peaks = spark.range(2000).select(F.lit(1).alias("spectrum_id"), F.col("id").alias("peak_idx"), F.lit(100.0).alias("mz"), F.lit(2).alias("intensity"))
    ions = spark.range(2000).select(F.lit(1).alias("spectrum_id"), F.lit(100.01).alias("mz"))
    out = spectra.shift_fdr(ions, peaks, Tolerance.absolute(0.05), intensity="intensity")
    row = out.collect()[0]
    assert (row.n_peaks, row.actual, row.average, row.intensity_actual) == (2000, 1.0, 0.0, 1.0)
    assert max(map(int, _rows_of_joins(out))) <= 52
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "fragment_bin" in x]


def test_closure_takes_each_way_once(spark, monkeypatch):
    """A graph without rings needs no doubling of ways."""
    from massloom.sources import ontology as on

    monkeypatch.setattr(on, "_doubled", None)
    links = spark.createDataFrame([(f"N:{k}", f"N:{p}") for k in range(1, 40) for p in {k // 2, k * 2 // 3}], "child string, parent string")
    got = {(x.id, x.ancestor): x.distance for x in on.closure(links).collect()}
    assert got["N:39", "N:0"] == 6 and got["N:39", "N:26"] == 1 and got["N:39", "N:17"] == 2 and ("N:39", "N:20") not in got


def test_values_meet_before_rows(spark):
    from pyspark.sql import functions as F

    from massloom.functions.tolerance import Tolerance
    from massloom.operators import joins
    from massloom.plans import QUERIES

    a, b = (spark.range(60).select(F.col("id").alias(i), (F.col("id") % 3).cast("double").alias(x)) for i, x in (("i", "x"), ("j", "y")))
    out = joins.band_join_of_values(a, b, ("x", "y"), Tolerance.absolute(1.0), d=F.col("x") - F.col("y"))
    assert out.count() == out.distinct().count() == 7 * 400 and out.where("d <> x - y").count() == 0
    assert min(map(int, _rows_of_joins(out))) == 7
    assert "band_join_of_values" in QUERIES["ppm_join"].__code__.co_names


def test_few_rows_are_met_again_and_again(spark):
    """A frequent value: right rows of a written result repeat after a few, packs are bounded, and nulls and further columns stay."""
    from pyspark.sql import functions as F

    from massloom.functions.tolerance import Tolerance
    from massloom.operators import joins

    a = spark.range(5000).select(F.nullif(F.col("id"), F.lit(7)).alias("i"), F.when(F.col("id") < 4999, 1.0).alias("x"))
    b = spark.range(1300).select(F.col("id").alias("j"), F.lit(1.0).alias("y"), F.nullif(F.col("id") % 5, F.lit(3)).alias("k"))
    assert sorted(len(r.p) for r in joins.packs(a, "x", "p").collect()) == [967, 4032]
    out = joins.band_join_of_values(a.where("i is null or i < 700"), b, ("x", "y"), Tolerance(0.1), d=F.col("x") - F.col("y"))
    assert out.columns == ["y", "x", "i", "d", "j", "k"] and out.count() == out.distinct().count() == 700 * 1300
    assert out.where("i is null").count() == 1300 and out.where("k is null").count() == 700 * 260 and out.where("d <> 0 or k <> j % 5").count() == 0
    found = [r.j for r in out.select("j").limit(1008).collect()]
    assert found[:504] == found[504:] and len(set(found)) == 504


def test_structures_are_summed_where_they_are(spark, data_dir):
    from massloom.operators import glycans as gl
    from massloom.plans import QUERIES

    assert "Aggregate" not in QUERIES["glycan_structures"](spark, data_dir)._jdf.queryExecution().sparkPlan().toString()
    df = spark.createDataFrame([("Man[Man]Man",), (None,), ("?",)], "g string")
    rows = gl.structure_fragments(df, "g", by_node=False).collect()
    assert {(x.part, x.breaks): x.ways for x in rows if x.g == "Man[Man]Man"} == {("Hex1", 0): 2, ("Hex1", 2): 1, ("Hex2", 1): 2, ("Hex3", 0): 1}
    assert [x.error is not None for x in rows if x.g != "Man[Man]Man"] == [True]


def test_spectra_are_grouped_once(spark, data_dir, monkeypatch):
    from massloom.plans import QUERIES
    from massloom.sources import mzml

    plans, write = [], mzml.write_mzml
    monkeypatch.setattr(mzml, "write_mzml", lambda rows, *a, **k: (plans.append(rows._jdf.queryExecution().sparkPlan().toString()), write(rows, *a, **k)))
    QUERIES["mzml_files"](spark, data_dir)
    assert len(plans) == 2 and not any("Aggregate" in p for p in plans)


def test_letters_are_counted_in_place(spark, data_dir):
    from massloom.plans import QUERIES

    plan = _plan(QUERIES["composition_key"](spark, data_dir))
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_equal_masses_are_searched_once(spark, tmp_path):
    from massloom.functions.chemistry import MONO, WATER
    from massloom.plans import QUERIES

    mass = sum(MONO[x] for x in "AAAAAGK") + WATER
    spark.createDataFrame([(k, "AAAAAGK AAAAGAK AAAGAAK AAGAAAK"[8 * (k % 4) :][:7] + "R") for k in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k % 50, mass) for k in range(100)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    out = QUERIES["mass_search"](spark, str(tmp_path))
    rows = out.collect()
    assert len(rows) == 150 and all(x.peptide == "AAAAAGK AAAAGAK AAAGAAK"[8 * ((x["rank"] - 1) // 2) :][:7] for x in rows)
    assert max(map(int, _rows_of_joins(out))) == 300


def test_every_piece_of_a_line_is_a_block():
    import random

    from massloom.llm import lines as ln

    r = random.Random(4)
    made = ln.Lines(pa.array([" ".join(f"w{r.randrange(10**6)}" for _ in range(400))]))
    how = ln.FuzzyLines()
    units = ln.Units(made, made.words.hashes(lower=True), made.n_words > 0)
    size = [int(x) for x in ln.np.diff(ln.np.flatnonzero(ln.cuts(units, how.reach)), append=400)]
    assert len(ln.blocks(units, how)[2]) == sum(x >= how.least for x in size) > 40


def test_hubs_are_of_the_largest_component_too(spark):
    """A chain of ids, each linked to those within 60, in forty buckets that all share: few pairs are compared, and each once."""
    from pyspark.sql import functions as F

    from massloom.llm.components import meet_hubs
    from massloom.llm.workspace import Workspace

    work, compared = Workspace(spark, "hubs"), []

    def links(pairs):
        compared.append(pairs.count())
        return pairs.where("abs(a - b) <= 60")

    own = spark.range(1, 601).crossJoin(spark.range(40).withColumnRenamed("id", "bucket")).select("bucket", "id", F.lit(0).alias("x"))
    label = meet_hubs(work, work.save(own, "members"), None, lambda a, b: F.lit(True), links, once=True)
    assert {tuple(r) for r in label.collect()} == {(k, 1) for k in range(1, 601)} and sum(compared) < 40_000
    few = spark.createDataFrame([(b, i, 0) for b, ids in enumerate(([1, 2, 3], [2, 3, 4, 5], [5, 6, 9], [7, 8, 1])) for i in ids], "bucket long, id long, x int")
    compared.clear()
    assert meet_hubs(work, work.save(few, "few"), None, lambda a, b: F.lit(True), lambda p: links(p).where("false"), turns=(2, "rest"), once=True) is None
    assert sum(compared) == 3 + 6 + 3 + 3 - 1  # 2 and 3 share two buckets
