"""A stream of cells gives what the table gives."""

from shoalgrid.plans.fixtures import view
from shoalgrid.streaming.cells import prepared, read_cells


def test_prepared(spark, tmp_path):
    table = view(spark, "/root/testdata/sf0.001", "spectra")
    table.write.parquet(f"{tmp_path}/in")
    stream = prepared(read_cells(spark, f"{tmp_path}/in", table.schema))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(prepared(spark.read.parquet(f"{tmp_path}/in")).collect())
