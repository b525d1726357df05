"""The pipeline's contract, stage by stage, and the guard of the entry module."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from massloom.llm.workspace import Workspace

import __spark_entry__
import corpus_pipeline

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, data_dir):
    work = Workspace(spark, "test")
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = work.save(stage(spark, docs, data_dir), name.replace(" ", "-"))
        assert docs.columns == columns and 0 < docs.count() <= before
        assert docs.groupBy("doc_id").count().where("count > 1").count() == 0
        before = docs.count()
    assert before < spark.read.parquet(f"{data_dir}/documents.parquet").count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


def test_entry_without_the_package(tmp_path):
    for p in ("__spark_entry__.py", "massloom"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else None
    own = tmp_path / "massloom"
    own.mkdir()
    for p in (ROOT / "massloom").iterdir():
        if p.name != "llm":
            (own / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr


_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, component_id long"


def _tables(spark, root, docs, labels, items):
    rows = [(i, t, "en", "web", len(t or ""), 0.5, "w", 1) for i, t in docs]
    for name, own, kind in (("documents", rows, _COLUMNS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(own, kind).write.parquet(f"{root}/{name}.parquet")


def test_odd_rows_by_a_plain_model(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns: what goes is what a plain reading says."""
    import random

    r = random.Random(1)
    words = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(4000)]

    def text(n):
        return " ".join(r.choices(words, k=n))

    item = text(30)
    clean = [(k, text(r.randint(30, 80))) for k in range(60)]
    near = clean[3][1].split()
    near[10] = "changed"
    docs = clean + [(100, None), (101, ""), (None, text(40)), (102, text(20_000)), (103, clean[5][1]), (104, " ".join(near) + " more"), (105, text(25) + " " + item + " " + text(5)), (7, clean[7][1])]
    _tables(spark, tmp_path, docs, [(k, 1, 0) for k in range(0, 60, 3)] + [(None, None, None)], [(1, item), (2, None), (3, "")])
    columns = [c.split()[0] for c in _COLUMNS.split(", ")]
    work, now, left = Workspace(spark, "odd"), spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = work.save(stage(spark, now, str(tmp_path)), name.replace(" ", "-"))
        assert now.columns == columns and now.where("score is distinct from 0.5 or word is distinct from 'w'").count() == 0
        left.append({(x.doc_id, x.text) for x in now.select("doc_id", "text").collect()})
    ids = [{i for i, _ in x} for x in left]
    assert ids[0] >= set(range(60)) | {100, 101, None, 102, 104, 105}  # no label says that anything is toxic
    assert dict(left[0])[102] == docs[63][1] and len(dict(left[1])[102].split()) == 20_000  # whole texts
    assert not {103} & {i for i, t in left[1] if t and t.strip()}  # its only line is that of 5
    assert 105 in ids[2] and 105 not in ids[3] and ids[3] >= set(range(60)) - {3}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.select("doc_id").distinct().collect()} == ids[3]
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
