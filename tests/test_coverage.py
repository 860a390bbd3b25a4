"""Coverage of sources, what is represented as a table or as a condition."""

from pyspark.sql import functions as F

from verdict.operators import guidance


def test_a_condition_stands_for_the_table_of_what_is_represented(spark):
    members = spark.createDataFrame([(r, g) for r in range(40) for g in range(5) if (r + g) % 3], "root long, region long")
    spans = spark.createDataFrame([(s % 5, s, str(s % 4) if s % 2 else None) for s in range(30)], "region long, span long, target string")
    regions = spark.createDataFrame([(g, str(g), 0, True) for g in range(5)], "region long, label string, edition int, complete boolean")
    # Null, and so not represented, for one span.
    rule = F.when(F.col("span") != 7, (F.col("span") + F.col("root")) % 60 != 0)
    listed = members.join(spans, "region").where(rule).select("root", "region", "span")
    plain, short = (guidance.covered_roots(members, spans, r, regions) for r in (listed, rule))
    assert sorted(short.collect()) == sorted(plain.collect())
    assert len({r["covered"] for r in short.collect()}) == 2
