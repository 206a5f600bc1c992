"""The per-project map holds every event of every user."""

from usagemill.plans import catalog

SF = "/root/testdata/sf0.001"


def test_map_covers_the_whole_table(spark):
    assert "project_daily_map" in catalog.QUERIES
    rows = catalog.QUERIES["project_daily_map"](spark, SF).collect()
    told = [line.split(" ") for r in rows for line in r.rows.split(";")]
    whole = catalog.costed(spark, SF).selectExpr("sum(input_tokens) AS a", "sum(output_tokens) AS b", "count(DISTINCT coalesce(project, 'unknown'), to_date(ts)) AS n").first()
    assert (sum(int(x[1]) for x in told), sum(int(x[2]) for x in told), len(told)) == (whole.a, whole.b, whole.n)
