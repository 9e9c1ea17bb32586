"""Counts kept over a stream equal those of the whole table."""

from lodeseam.functions.selectors import Equality, Interval
from lodeseam.operators.targets import binary
from lodeseam.sources.synth import tie_stress
from lodeseam.streaming.patterns import pattern_counts, subgroup_counts


def test_stream_equals_batch(spark, tmp_path):
    df = tie_stress(spark)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    sel = [Equality("c1", "A0"), Equality("c2", "B1"), Interval("_rid", hi=50)]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = pattern_counts(stream, sel, binary("y", 1)).writeStream.outputMode("complete").format("memory").queryName("patterns").start()
    run.processAllAvailable()
    run.stop()
    counts = lambda p: sorted(map(str, subgroup_counts(p, 2).collect()))
    assert counts(spark.table("patterns")) == counts(pattern_counts(df, sel, binary("y", 1)))
    assert len(counts(spark.table("patterns"))) == 6
