import os
import shutil
import subprocess
import sys

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from trustmill.llm import language, packing, quality

from .test_joins import brute_classes

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_run_equals_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = {r.doc_id for r in quality.predictions(docs, labels).where("score >= 0.3").collect()}
    docs = docs.where(F.col("doc_id").isin(list(good)))
    told = {r.doc_id for r in language.predictions(docs).where("lang_pred <> 'und'").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in told]
    alone = {i for i, (_, c) in brute_classes(rows, 5, 80).items() if c == i}
    want = packing.pieces(docs.where(F.col("doc_id").isin(list(alone))), public_tokenizers.path("byte_bpe_50k.json"))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end or n > 2048").count() == 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("size", F.lit("extra"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        docs = out


def test_cases(spark, tmp_path):
    from .conftest import words

    long = words(1, 20_000)
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "same text of five words here"), (5, "same text of five words here"), (6, long), (7, long + " end"), (8, "alone"), (8, "alone"), (None, "no id at all here now"), (None, "no id at all here now")]
    docs = spark.createDataFrame([(i, t, None, "x", k, "clash") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, score int, first string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.score) for r in kept.collect()) == [(0, 9), (0, 10), (4, 3), (6, 5), (8, 7), (8, 8)]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {None, 4, 6, 8} and sum(r.doc_id == 8 for r in out) == 2 and max(r.piece for r in out) > 5
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_package_that_cannot_be_imported_is_left_out(tmp_path):
    for name in ("trustmill", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    (tmp_path / "trustmill/llm/common.py").write_text("import no_such_library_here")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'pending_topk' in q and 'op8_licences' not in e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0


def test_the_rest_works_without_this_package(tmp_path):
    for name in ("trustmill", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "trustmill/llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)\n"
    code += "from pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
    code += "d = '/root/testdata/sf0.001'\nassert all(q[k](s, d).count() > 0 for k in ('status_counts', 'trust_fold', 'discovery_rows')) and e.entry(s).count() > 0"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
