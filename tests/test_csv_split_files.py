"""csv_scan_split writes a file a partition of its table, and reads records with line breaks from each."""

from loomwright.plans import catalog, files


def test_no_task_writes_the_whole_table(spark, tmp_path, monkeypatch):
    rows = [(i, f'line {i}\n"quoted", {i}\r\n' + "x" * (1 + i % 5), f"s{i % 3}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.option("maxRecordsPerFile", 10).parquet(f"{tmp_path}/documents.parquet")
    seen, write = [], files.writers.csv
    monkeypatch.setattr(files.writers, "csv", lambda frame, path: (seen.append((frame, path)), write(frame, path)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 128 << 20)  # a file a partition
    try:
        got = catalog.QUERIES["csv_scan_split"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(map(tuple, got)) == sorted((str(i), x.replace("\r\n", "\n"), s) for i, x, s in rows)
    assert spark.read.text(seen[0][1]).select("_metadata.file_path").distinct().count() > 1
