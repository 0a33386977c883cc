"""What costly steps in Python get at once, and how evenly."""

from __future__ import annotations

import subprocess
import sys
import zlib
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.functions import discovery, media, privacy
from weftline.operators import references, reports
from weftline.session import batches
from weftline.sources.tables import dealt


def test_library_queries_get_small_batches_and_operators_the_session_s_own(spark, sf):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    entry.queries()["html_references"](spark, sf)
    most = spark.range(5000).mapInPandas(lambda parts: (pd.DataFrame({"n": [len(p)]}) for p in parts), "n long").agg(F.max("n")).first()[0]
    assert most <= 500
    batches(spark, None)
    assert spark.conf.get(name) == before


def test_a_file_of_one_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    """Its splits but one are empty, so they say nothing about its tasks."""
    spark.range(50_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        assert table.rdd.getNumPartitions() > 3  # local[3]
        rows = [r["count"] for r in dealt(table).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) >= 12
    assert max(rows) < 2 * 50_000 / 12


def test_equal_metadata_is_cleaned_alike(spark):
    texts = ['{"a":"https://u:p@h.test/"}', None, "no json password=abcdefgh12345", '{"a":"https://u:p@h.test/"}', None]
    got = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").coalesce(1).select("n", privacy.sanitized_metadata("t").alias("s")).orderBy("n").collect()
    rows = [r["s"] for r in got]
    assert rows[0] == rows[3] and rows[1] == rows[4]
    assert rows[1]["json"] is None and len(rows[0]["findings"]) == 2 and rows[2]["findings"]


def test_large_rows_come_to_python_by_bytes(spark, sf):
    """Rows of 200,000 bytes: all 100 came at once when only rows were counted."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    batches(spark, None)
    before = spark.conf.get(name)
    entry.queries()["resolved_references"](spark, sf)
    texts = spark.range(0, 100, 1, 1).select(F.repeat(F.lit("x"), 200_000).alias("t"))
    most = texts.mapInPandas(lambda parts: (pd.DataFrame({"n": [len(p)]}) for p in parts), "n long").agg(F.max("n"), F.sum("n")).first()
    assert most[0] <= 25 and most[1] == 100
    batches(spark, None)
    assert spark.conf.get(name) == before


def test_references_of_one_text_go_back_in_parts(spark):
    text = "".join(f'<a href="/{n}">' for n in range(12_000))
    frame = pd.DataFrame({"owner": ["a", "b"], "base_url": ["https://h.test/"] * 2, "text": [text, "<!-- breaks off"], "syntax": ["html"] * 2})
    parts = list(references._discovered(iter([frame])))
    assert [len(p) for p in parts] == [5000, 5000, 2001]
    rows = pd.concat(parts)
    assert list(rows["n"]) == [*range(12_000), -1] and list(rows["raw_value"][:12_000]) == [f"/{n}" for n in range(12_000)]
    assert rows["fault"].iloc[-1] and references.discover(spark.createDataFrame(frame)).count() == 12_001


def test_large_references_go_back_by_characters(spark):
    """60 files of 200,000 characters inside their pages: all came back in one part when only references were counted."""
    texts = [(str(n), "https://h.test/", f'<img src="data:image/png;base64,{"A" * 200_000}"><img src="/{n}.png">', "html") for n in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts, strict=True)], list(discovery.TEXT))
    found = list(discovery.in_arrow(iter([batch])))
    assert max(part.nbytes for part in found) < 6 << 20
    assert [(r["owner"], r["n"], len(r["raw_value"])) for part in found for r in part.to_pylist()] == [(t[0], n, size) for t in texts for n, size in ((0, 200_022), (1, len(t[0]) + 5))]
    frame = spark.createDataFrame(pd.DataFrame(texts, columns=list(discovery.TEXT)))
    assert references.discover(frame).agg(F.count("n"), F.sum(F.length("raw_value"))).first() == (120, sum(200_022 + len(t[0]) + 5 for t in texts))


def test_references_are_found_without_pandas(spark, sf):
    """It was more than a third of a worker's memory, in each of them."""
    for name in ("reference_diagnostics", "resolved_references"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "EvalPython" not in plan
    code = """
import sys, pyarrow as pa, pyspark.worker
from weftline.functions import discovery as d
texts = [("a", "https://h.test/", '<a href="\\u00e9?x">', "html"), ("b", None, None, "html"), ("c", None, "<!-- breaks off", "html")]
batch = pa.RecordBatch.from_arrays([d.strings(c) for c in zip(*texts)], list(d.TEXT))
rows = [r for part in d.in_arrow(iter([batch])) for r in part.to_pylist()]
assert [(r["owner"], r["base_url"], r["n"], r["raw_value"], r["normalized_url"], bool(r["fault"])) for r in rows] == [("a", "https://h.test/", 0, "\\u00e9?x", "https://h.test/%C3%A9?x", False), ("c", None, -1, "", None, True)], rows
assert "pandas" not in sys.modules
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, timeout=60, check=True)


def test_urls_of_documents_are_resolved_once(spark, sf):
    """The filter on the resolved URL called the function below the one that gives it as well."""
    plan = entry.queries()["gltf_files"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInPandas") == 2
    texts = spark.createDataFrame([("a", "https://h.test/g/x.gltf", '{"b":[{"uri":"m.bin"},{"uri":"./m.bin"},{"uri":"http://"},{"uri":"mailto:x"}]}'), ("b", "https://h.test/", "no json")], "owner string, base_url string, text string")
    assert [tuple(r) for r in reports.gltf_urls(texts).collect()] == [("a", "https://h.test/g/m.bin")]


def test_large_bodies_are_deflated_by_bytes(spark, sf):
    """Column functions get large bodies by bytes too, and all sizes are right."""
    entry.queries()["deflated_archive"](spark, sf)

    @F.pandas_udf("long")
    def seen(bodies: pd.Series) -> pd.Series:
        return pd.Series([len(bodies)] * len(bodies))

    body = F.repeat(F.lit("x"), 200_000).cast("binary")
    most, rows, size = spark.range(0, 100, 1, 1).select(body.alias("b")).select(seen("b").alias("n"), media.deflated_size("b").alias("size")).agg(F.max("n"), F.count("n"), F.sum("size")).first()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    assert most <= 25 and rows == 100 and size == 100 * len(packer.compress(b"x" * 200_000) + packer.flush())
