"""The digest index across processes, with other numbers of shuffle partitions, and its compaction."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from peakloom.llm import exact_dedup

SESSION = """
import sys
from peakloom.session import local_session
from peakloom.llm import exact_dedup
path, partitions, texts = sys.argv[1], int(sys.argv[2]), sys.argv[3:]
spark = local_session("index", cpus=2, memory="1g")
spark.conf.set("spark.sql.shuffle.partitions", partitions)
docs = spark.createDataFrame([(int(t.split("=")[0]), t.split("=")[1]) for t in texts], "doc_id long, text string")
index = exact_dedup.DigestIndex(spark, path)
for r in exact_dedup.exact_dedup(docs, index=index).orderBy("id").collect():
    print("GOT", r["id"], r["keep_id"], r["group_size"], r["kept"])
print("GOT digests", index.read().count(), index.layout()["buckets"])
"""


def session(path, partitions, *texts):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([repo, *filter(None, [os.environ.get("PYTHONPATH")])])}
    run = subprocess.run([sys.executable, "-c", SESSION, path, str(partitions), *texts], env=env, capture_output=True, text=True, timeout=300, check=True)
    return [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("GOT")]


def test_index_survives_sessions(tmp_path):
    path = str(tmp_path / "index")
    assert session(path, 3, "1=one", "2=Two", "3=two") == [["1", "1", "1", "True"], ["2", "3", "2", "False"], ["3", "3", "2", "True"], ["digests", "2", "3"]]
    # another process, another number of partitions: known digests stay known and keep their documents
    got = session(path, 5, "7=TWO", "8=three", "9=one")
    assert got == [["7", "3", "3", "False"], ["8", "8", "1", "True"], ["9", "1", "2", "False"], ["digests", "3", "3"]]


def test_index_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 2)
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=2)
    for k in range(7):
        docs = spark.range(20).select((F.col("id") + 100 * k).alias("doc_id"), (F.col("id") % 10 + k).cast("string").alias("text"))
        index.append(exact_dedup.groups_of(exact_dedup.digests(docs)))
        files = len(index.rows().inputFiles())
        assert files <= 2 * (2 + 1)
    assert index.layout()["generation"] > 0 and sorted(os.listdir(tmp_path / "index")) == sorted(["layouts", f"data-{index.layout()['generation']}"])
    found = index.read()
    assert found.count() == 16 and found.agg(F.sum("group_size")).first()[0] == 140
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    index.drop()
    assert not index.exists() and not os.path.exists(tmp_path / "index")


def test_unfinished_generations_do_not_count(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=2)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    index.append(exact_dedup.groups_of(exact_dedup.digests(docs)))
    (tmp_path / "index" / "layouts" / "_000000001.json").write_text('{"gen')  # a writer was lost before the layout was whole
    (tmp_path / "index" / "data-1").mkdir()
    assert index.layout()["generation"] == 0 and index.read().count() == 2
    index.compact()
    assert index.layout()["generation"] == 1 and index.read().count() == 2
