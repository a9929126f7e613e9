"""Workers that hold no copy of the package, and rows that earlier rounds answered wrongly."""

import os
import subprocess
import sys

from standlab.llm import language, ngram_join, warc

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {work!r}).config("spark.driver.memory", "4g").getOrCreate())
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name in {names!r}:
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    names = ["op6_main_text", "op9_decontamination", "op10_bpe", "op11_simhash", "op12_collocations", "op13_hard_negatives"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = ALONE.format(root=ROOT, work=str(tmp_path / "work"), names=names)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert {line.split()[1] for line in done.stdout.splitlines() if line.startswith("ran")} == set(names)


def test_large_ids_stay_whole_beside_a_null(spark, docs_of):
    big = (1 << 53) + 1
    docs = docs_of([(big, "one two three four five"), (None, "one two three four five"), (big + 2, "other words are in here")])
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {(big, big), (None, big), (big + 2, big + 2)}


def test_marks_alone_are_no_letters(spark):
    docs = spark.createDataFrame([("́́",), ("hello there",), (None,)], "text string")
    found = language.identify(spark, {"en": b"hello there you", "fr": b"bonjour vous"})
    assert [r[0] for r in docs.select(found("text")["lang"]).collect()] == ["und", "en", "und"]


def test_pages_that_share_an_id_keep_their_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.x/1", "a"), (1, "http://a.x/2", "bb"), (2, "http://a.x/3", "bb")], "page_id long, url string, html string")
    got = warc.page_records(spark, warc.write(pages, str(tmp_path / "archive")), pages).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [
        (1, 1, "response", None), (1, 2, "response", None), (2, 2, "revisit", 1)]
