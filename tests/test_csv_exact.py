"""csv_scan_split returns the texts of its table as its SQL does: white space at their ends, carriage returns, NUL, empty strings and nulls."""

from loomwright.plans import catalog, files  # noqa: F401  adds the query to the catalog

ODD = ["", None, " ", "  ahead", "behind \t", "behind\n", "\nahead", "\n", "\r", "a\rb", "a\r\nb", "a\r\n", "\r\n\r", '"', '""', '"\r\n', ' "q" ', '\0', 'a\0"b"\0\n', "\x01", "null", "-", '"null"', "a,b\r", "\\", '\\"', "x" * 150_000, '"\r\n' * 40_000]


def test_odd_texts_are_read_as_they_are(spark, tmp_path):
    rows = [(3 * i, x, f"s{i}") for i, x in enumerate(ODD)] + [(3 * i + 1, f"line\n{i}", x) for i, x in enumerate(ODD)] + [(3 * i + 2, x, x) for i, x in enumerate(ODD)] + [(None, x, None) for x in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["csv_scan_split"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i if i is None else str(i), x, s)) for i, x, s in rows)
