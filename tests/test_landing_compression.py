from conftest import collect

from polderlake.sources import landing, readers


def test_compressed_envelopes_take_fewer_bytes_and_read_the_same(spark, tmp_path):
    rows = spark.range(2_000).selectExpr("id AS RegioS", "'a text' AS RegioNaam")
    size = lambda path: sum(f.stat().st_size for f in path.iterdir() if f.name.startswith("part"))
    for pretty in (True, False):
        plain, packed = tmp_path / f"plain{pretty}", tmp_path / f"packed{pretty}"
        landing.land_envelopes(rows, str(plain), 500, pretty=pretty)
        landing.land_envelopes(rows, str(packed), 500, pretty=pretty, compression="lz4")
        assert 0 < size(packed) < size(plain) / 2
        assert collect(readers.read_envelope(spark, str(packed), rows.schema, multi_line=pretty)) == collect(rows)
