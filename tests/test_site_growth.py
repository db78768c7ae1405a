"""What the queries of sites do as customers grow: no table of all sites at the driver, and pages dealt over tasks."""

from pyspark.sql import functions as F

from leadforge.operators import assembly, links
from leadforge.plans import site_queries
from leadforge.sources.html import html_elements


def customers(spark, root, n):
    spark.range(1, n + 1).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{root}/customer.parquet")
    return site_queries.sites(spark, str(root))


def plan_after(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_and_credits_meet_their_pages_by_a_shuffle(spark, tmp_path):
    pages = customers(spark, tmp_path, 200)
    found = links.links(html_elements(pages, "k", "html"), pages, "k")
    plans = [plan_after(found), plan_after(site_queries.credits(spark, str(tmp_path))), plan_after(site_queries.site_links(spark, str(tmp_path)))]
    statuses = spark.createDataFrame([("https://www.site3.in/terms", 404)], "href string, status int")
    plans.append(plan_after(assembly.dead_links(found, statuses, "k")))
    assert all("Join" in p and "BroadcastHashJoin" not in p for p in plans)


def test_pages_of_a_small_file_are_made_and_parsed_in_several_tasks(spark, tmp_path):
    pages = customers(spark, tmp_path, 9000)
    assert spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.getNumPartitions() == 1
    tasks = html_elements(pages.where("k < 500"), "k", "html").groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("k").alias("n")).collect()
    assert len(tasks) == 4 and pages.count() == 9000


def test_elements_of_some_tags(spark, tmp_path):
    pages = customers(spark, tmp_path, 300)
    every, some = html_elements(pages, "k", "html"), html_elements(pages, "k", "html", links.CONTACT_TAGS)
    row = F.xxhash64("k", "pos", "tag", F.to_json("attrs"), "text", "parent_year", "landmarks")
    of = lambda df: sorted(r[0] for r in df.select(row).collect())
    assert of(every.where(F.col("tag").isin("a", "body"))) == of(some)
    kept = links.credit_elements(every)
    assert sorted(map(tuple, links.agency_credits(every, "k").collect())) == sorted(map(tuple, links.agency_credits(kept, "k").collect()))
