"""A table as a stream, whether it is one file or a folder of files."""

from cloakframe.streaming import jobs


def _read(spark, path, tmp_path, name):
    stream = jobs.read_table_stream(spark, path, spark.read.parquet(path).schema)
    jobs.append_to(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect())


def test_folder_and_file(spark, tmp_path):
    folder = str(tmp_path / "docs.parquet")
    spark.range(0, 20, 1, 3).write.parquet(folder)
    spark.range(90, 99).coalesce(1).write.parquet(str(tmp_path / "others.parquet"))
    assert _read(spark, folder, tmp_path, "folder") == list(range(20))
    (tmp_path / "single").mkdir()
    (part,) = (tmp_path / "others.parquet").glob("part-*.parquet")
    (tmp_path / "single" / "docs.parquet").write_bytes(part.read_bytes())
    assert _read(spark, str(tmp_path / "single" / "docs.parquet"), tmp_path, "file") == list(range(90, 99))
