"""Physical-plan shape of the operators that matter at scale."""

from leadloom.plans.catalog import q_best_two_phones, q_import_leads, q_search_leads

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_import_reads_the_file_once(spark):
    p = plan(q_import_leads(spark, SF))
    assert p.count("FileScan parquet") == 4 and p.count("orders.parquet") == 1 and "LeftAnti" in p
    assert "TakeOrdered" not in p


def test_site_phones_reduce_before_the_shuffle(spark):
    p = plan(q_best_two_phones(spark, SF))
    assert "Window" not in p and "partial_min" in p and "RoundRobin" not in p


def test_search_is_narrow(spark):
    p = plan(q_search_leads(spark, SF))
    assert "Exchange hashpartitioning" not in p and "Aggregate" not in p


def test_building_a_query_reads_no_footer(spark):
    sc = spark.sparkContext
    sc.setJobGroup("build", "no job may run")
    q_search_leads(spark, SF)
    assert not sc.statusTracker().getJobIdsForGroup("build")


def test_no_shuffle_of_the_website_check_carries_a_page(spark):
    import re
    from leadloom.plans.catalog import QUERIES
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = QUERIES["verify_captured"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().explainString(
            spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    assert len(moved) > 4
    assert not any(re.search(r"\b(html|body_text|_h|_p)#", m) for m in moved), moved
