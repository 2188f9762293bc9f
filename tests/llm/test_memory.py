"""What workers and executors keep: one Python worker a task, heaps given back between stages."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

from tapeworks.llm import ngram_join

CLUSTER = """
import sys
import psutil
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline

conf = {"spark.master": "local-cluster[2,1,1200]", "spark.executor.memory": "1000m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}
conf["spark.checkpoint.dir"] = "file://" + sys.argv[1]
spark = SparkSession.builder.config(map=conf).getOrCreate()

def used():
    found = [p for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
    return sum(p.memory_info().rss for p in found) >> 20

rows = spark.range(0, 6_000_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
rows.repartition(4, "h").sortWithinPartitions("h").write.format("noop").mode("overwrite").save()
docs = spark.read.parquet(sys.argv[2] + "/documents.parquet")
before = used()
dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, sys.argv[2])
print("MB", before, used())
spark.stop()
"""


def test_stages_give_heaps_back(sf, tmp_path):
    home = tmp_path / "home"  # executors work in Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), sf], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [x.split()[1:] for x in run.stdout.splitlines() if x.startswith("MB ")]
    assert said, run.stderr[-2000:]
    before, after = map(int, said[0])
    assert after < 0.75 * before


def test_one_python_worker_a_task(spark, frame, monkeypatch):
    kind, seen = type(spark.range(0)), []
    plain = kind.mapInArrow

    def watched(self, *args, **kwargs):
        seen.append("MapInArrow" in self._jdf.queryExecution().analyzed().toString())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join([*words, "y"]), "another text of words"]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(frame(texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3}
    assert seen and not any(seen)


WRAPPERS = CLUSTER.replace("import corpus_pipeline", "from tapeworks.llm import wrappers").replace("documents.parquet", "pages.parquet")
WRAPPERS = WRAPPERS.replace('dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, sys.argv[2])', "wrappers.main_text(docs)")


def test_main_text_gives_heaps_back(sf, tmp_path):
    """Before the last pass, which writes as many files as it has tasks, heaps are small again and
    of what was stored only the wrappers are left."""
    home, shared = tmp_path / "home", tmp_path / "shared"
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1"}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    assert "wrappers.main_text(docs)" in WRAPPERS
    run = subprocess.run([sys.executable, "-c", WRAPPERS, str(shared), sf], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    said = [x.split()[1:] for x in run.stdout.splitlines() if x.startswith("MB ")]
    assert said, run.stderr[-2000:]
    before, after = map(int, said[0])
    assert after < before  # else the steps add half as much again
    assert [p.name[:-33] for p in shared.glob("*/") if "-" in p.name and p.name.startswith("wrapper")] == ["wrappers"]
