"""The pipeline's stages on the smallest tables, and that the rest stands without the subpackage."""

import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline

REPO = Path(__file__).resolve().parents[2]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf))
        seen.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    raw, good, unique, apart, mixed, packed = seen
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    fine = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert not kept & bad and fine <= kept
    last = {}
    for r in good.collect():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    assert sorted(last.values()) == sorted(r.doc_id for r in unique.collect())
    assert {r.doc_id for r in apart.collect()} <= set(last.values())
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in apart.collect()}
    ids = packed.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in ids} == {r.doc_id for r in mixed.collect()}
    assert hashlib.sha256(b"".join(bytes(r.input_ids) for r in packed.orderBy("sequence_id", "offset").collect())).digest()


def test_entry_stands_without_the_subpackage(tmp_path):
    for name in ("graphloom", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else subprocess.run(["cp", "-r", REPO / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "graphloom/llm"], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "HOME": "/tmp"}, check=True)
