import json

import pytest
from conftest import collect

from polderlake.sources import readers, recut

SCHEMA = "id long, text string, deep struct<a: array<struct<b: long>>, s: string>"


def documents(n):
    nasty = ['plain', '}', '{', '"', '\\', '\\"}', ']', '[{"value": [', 'é\n\t😀', '', '},{', '\\\\"']
    return [{"id": i, "text": nasty[i % len(nasty)] * (1 + i % 3),
             "deep": {"a": [{"b": j} for j in range(i % 4)], "s": nasty[(i * 7) % len(nasty)]}}
            for i in range(n)]


def want(rows):
    return sorted(((r["id"], r["text"], r["deep"]["s"], len(r["deep"]["a"])) for r in rows), key=repr)


def got(spark, path):
    df = readers.read_pages(spark, path, SCHEMA)
    return collect(df.selectExpr("id", "text", "deep.s", "size(deep.a)"))


@pytest.mark.parametrize("indent", [None, 2])
def test_every_split_finds_its_rows(spark, tmp_path, indent):
    rows = documents(400)
    (tmp_path / "in").mkdir()
    for name, part in (("a", rows[:250]), ("b", rows[250:])):
        doc = {"odata": "x}{[\"", "meta": {"n": {"m": 1}}, "value": part, "next": None}
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900")  # some forty splits
        assert recut._pieces(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 20
        n = recut.recut(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert n == 400
    assert got(spark, str(tmp_path / "out")) == want(rows)


def test_feature_collections_empty_arrays_and_damage(spark, tmp_path):
    def run(name, text, column="value"):
        (tmp_path / f"{name}.json").write_text(text)
        return recut.recut(spark, str(tmp_path / f"{name}.json"), str(tmp_path / f"{name}-out"), column)

    rows = documents(5)
    assert run("f", json.dumps({"type": "FeatureCollection", "features": rows}), "features") == 5
    assert got(spark, str(tmp_path / "f-out")) == want(rows)
    assert run("empty", '{"a": 1, "value": []}') == 0
    assert run("blank", json.dumps({"value": rows}) + "\n\n") == 5
    for name, text in (("error", '{"error": "busy"}'), ("cut", json.dumps({"value": rows})[:-40]),
                       ("short", '{"value": [{"id": 1'),
                       ("brace", '{"value": [{"id": 1}]'), ("row", '{"value": [{"id": 1}'),
                       ("string", '{"value": [{"id": 1}], "next": "}')):
        with pytest.raises(Exception, match="no array|breaks off"):
            run(name, text)
