"""Readers, writers and the incremental forms."""

import pytest

from lexmill.sources import files
from lexmill.streaming import labels


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null, "z": 3}\n')
    assert files.read_jsonl(spark, str(p), "a int, b string").orderBy("a").collect() == [(1, "x"), (2, None)]
    assert files.unknown_fields(spark, str(p), spark.createDataFrame([], "a int, b string").schema).collect() == [("z", 1)]
    p.write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), "a int").collect()


def test_tables(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text("a\tb\n1\t2\n3\n")
    assert files.read_table(spark, str(p), ["a", "b"], "\t", strict=False).collect() == [("1", "2"), ("3", "")]
    df = spark.createDataFrame([("x,y", 'say "z"'), ("1", None)], "a string, b string")
    files.write_table(df, str(tmp_path / "out"))
    back = files.read_table(spark, str(tmp_path / "out"), ["a", "b"])
    assert sorted(map(tuple, back.fillna("").collect())) == [("1", ""), ("x,y", 'say "z"')]


def test_manifest_and_listing(spark, tmp_path):
    from lexmill.operators.catalog import manifest

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    row = manifest(df, "k", "v").first()
    assert files.complete(df.orderBy("v"), {"rows": row["rows"], "digest": row["digest"]})
    assert not files.complete(df.limit(1), {"rows": row["rows"], "digest": row["digest"]})
    (tmp_path / "x.txt").write_text("abc")
    assert [r["bytes"] for r in files.listing(spark, str(tmp_path), "*.txt").collect()] == [3]


def test_label_cache_is_resumable(spark, tmp_path):
    src, sink, cp = (str(tmp_path / d) for d in ("src", "sink", "cp"))
    schema = "key string, label string, labelled_at timestamp"
    for name, keys in (("1", ["a", "b", "a"]), ("2", ["b", "c"])):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / f"{name}.json").write_text("\n".join(f'{{"key": "{k}", "label": "followed", "labelled_at": "2024-01-0{name}T00:00:00Z"}}' for k in keys))
        labels.start_label_cache(labels.label_stream(spark, src, schema), sink, cp).awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_new_rows_only(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "key string")
    assert files.append_only_new(df, str(tmp_path / "none"), "key").count() == 2
    df.limit(1).write.parquet(str(tmp_path / "some"))
    assert files.append_only_new(df, str(tmp_path / "some"), "key").count() == 1
