"""Work and memory of a task stay bounded, and results whole, whatever the groups, nulls and copies in the tables."""

from pyspark.sql import functions as F


def test_feed_titles_keep_entities_of_their_own(spark, tmp_path):
    from trustmill.plans.pages import feed_parse

    titles = ['<title>say &quot;a &#39; b &lt;i&gt; &amp; c</title>', "<p>none</p>", "<title>a < b > c</title>"]
    spark.createDataFrame([(k, f"https://x{k}.org/p", t) for k, t in enumerate(titles)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.pos): (r.kind, r.title) for r in feed_parse(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[0, 0] == ("rss", "say &quot;a &#39; b <i> & c & <b>") and got[1, 0] == ("atom", None) and got[2, 0] == ("rss", "a < b > c & <b>")


def test_deletes_are_dealt_by_rows_and_keep_null_references(spark, monkeypatch):
    from trustmill import session
    from trustmill.operators import admin

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    n = 400
    tables = {
        "events": spark.range(n).withColumnRenamed("id", "event_id"), "event_links": spark.range(n).select(F.col("id").alias("link_id"), F.col("id").alias("event_id")),
        "security_flags": spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("event_id"), F.col("id").alias("link_id")),
    }
    out = admin.delete_rows(tables, "events", tables["events"].where("event_id % 5 = 0"))
    assert {k: v.count() for k, v in out.items()} == {"events": 320, "event_links": 320, "security_flags": 360} and out["security_flags"].where("link_id is null").count() == 40
    assert out["event_links"].rdd.getNumPartitions() >= n // 10
    # rows without a reference do not pass through the join
    assert "isnull(" in out["security_flags"]._jdf.queryExecution().optimizedPlan().toString()


def test_leases_without_a_budget_need_no_join(spark):
    import datetime as dt

    from trustmill.operators import retries

    at = dt.datetime(2026, 1, 1)
    queue = spark.createDataFrame([(1, "q", "{}", "QUEUED", 0, at, None, None, None), (2, "q", "{}", "QUEUED", 5, at, None, None, None)], retries.QUEUE)
    out = retries.lease(queue, "w", F.expr("TIMESTAMP '2026-01-02 00:00:00'"))
    assert sorted((r.id, r.status) for r in out["queue"].collect()) == [(1, "LEASED"), (2, "DEAD")] and out["dead_letters"].count() == 1
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in out.values())


def test_redirects_are_dealt_by_rows(spark, monkeypatch):
    from trustmill import session
    from trustmill.operators.transitions import redirect_chains

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    hops = spark.range(400).select(F.col("id").cast("string").alias("u"), "id").select(F.concat(F.lit("https://x.org/"), "u").alias("url"), F.when(F.col("id") % 2 == 0, 302).otherwise(200).alias("status"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), F.expr("id div 2"))).alias("target"))
    out = redirect_chains(hops.select("url"), hops)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and out.rdd.getNumPartitions() >= 40
    got = {r.url: (r.final_url, r.redirects, r.error) for r in out.collect()}
    assert len(got) == 400 and got["https://x.org/12"] == ("https://x.org/3", 2, None) and got["https://x.org/0"][2] == "TOO_MANY_REDIRECTS"


def test_copies_of_one_row_are_paired_in_bounded_tasks(spark, monkeypatch):
    from trustmill.functions import matching

    monkeypatch.setattr(matching, "PACK", 7)
    monkeypatch.setattr(matching, "TASK_PAIRS", 50)
    rows = spark.range(120).select("id", F.when(F.col("id") % 2 == 0, "open data summit of oslo").otherwise("open data summit of osle").alias("name"), F.lit("v").alias("org"))
    out = matching.alike_pairs(rows, "org")
    got = {(r.id_a, r.id_b): r.distance for r in out.collect()}
    assert got == {(a, b): (a + b) % 2 for a in range(120) for b in range(a + 1, 120)} and out.count() == len(got)
    assert out.rdd.getNumPartitions() > 100


def test_one_address_is_paired_in_bounded_tasks(spark, monkeypatch):
    from trustmill.functions import matching

    monkeypatch.setattr(matching, "PACK", 7)
    rows = spark.range(60).select("id", F.concat(F.lit("t"), "id").alias("title"), F.lit(None).cast("string").alias("organizer"), F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("city"), F.lit("https://e.org/x").alias("event_url"), F.lit("https://e.org/form").alias("registration_url"))
    got = [(r.id_a, r.id_b) for r in matching.duplicate_pairs(rows).collect()]
    assert sorted(got) == [(a, b) for a in range(60) for b in range(a + 1, 60)]


def test_streamed_windows_are_not_two_tasks(spark, tmp_path, sf_dir):
    import glob

    from trustmill.plans.catalogue import QUERIES

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(glob.glob(f"{folder}/*/stream-*/part-*"))
    got = QUERIES["streamed_windows"](spark, str(tmp_path)).count()
    assert got == QUERIES["tumbling_counts"](spark, sf_dir).count()
    assert len({x for x in glob.glob(f"{folder}/*/stream-*/part-*") if "-out" not in x} - before) > 2


def test_rechecked_links_are_joined_once(spark):
    from trustmill.operators.links import recheck

    links = spark.createDataFrame([(1, 7, "REGISTRATION", "https://a.org/x", None, None)], "link_id long, event_id long, url_type string, final_url string, domain string, last_checked timestamp")
    resolved = spark.createDataFrame([(1, "https://b.org/x", 200, None, False)], "link_id long, new_url string, status int, error string, failed boolean")
    out = recheck(links, resolved, F.expr("TIMESTAMP '2026-01-02 00:00:00'"))
    assert [r.details for r in out["flags"].collect()] == ["a.org -> b.org"]
    assert all("Join" not in df._jdf.queryExecution().optimizedPlan().toString() for df in out.values())


def test_texts_are_sent_to_python_in_batches_bounded_by_bytes(spark, monkeypatch):
    import pandas as pd

    from trustmill.functions import html

    monkeypatch.setattr(html, "BATCH_BYTES", 1 << 16)
    pages = spark.range(0, 1000, 1, 1).select("id", F.lit("https://x.org/").alias("url"), F.repeat(F.lit("é"), 500).alias("html"))
    html.extract_events(pages)

    @F.pandas_udf("long")
    def together(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    most = pages.select(together("html").alias("n")).agg(F.max("n")).first()[0]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    assert most < 200


def test_ports_are_told_without_casts_that_fail(spark):
    from trustmill.functions.urls import normalize_url

    ports = ["", ":", ":0", ":80", ":00080", ":8080", ":65535", ":65536", ":99999", ":123456", ":x"]
    out = spark.createDataFrame([(p,) for p in ports], "port string").select("port", normalize_url(F.concat(F.lit("http://e.org"), "port", F.lit("/p"))).alias("u"))
    assert "try_cast" not in out._jdf.queryExecution().analyzed().toString()
    got = {r.port: (r.u.canonical, r.u.reason) for r in out.collect()}
    bad, plain = (None, "UNPARSABLE"), ("http://e.org/p", None)
    assert got == {"": plain, ":": plain, ":80": plain, ":0": ("http://e.org:0/p", None), ":00080": ("http://e.org:00080/p", None), ":8080": ("http://e.org:8080/p", None), ":65535": ("http://e.org:65535/p", None), ":65536": bad, ":99999": bad, ":123456": bad, ":x": bad}


def test_events_are_prepared_once(spark, monkeypatch):
    from trustmill.functions import matching

    told, stored = [], matching.stored
    monkeypatch.setattr(matching, "stored", lambda df, name: told.append((name, "regexp_replace" in df._jdf.queryExecution().analyzed().toString())) or stored(df, name))
    rows = spark.createDataFrame([(1, "Open Data 2026", "Univ of X", "2026-01-01", None, "https://e.org/x", None), (2, "open data", "X", "2026-01-01", None, "https://e.org/x?utm_source=y", None)], "id long, title string, organizer string, start_date string, city string, event_url string, registration_url string")
    assert [(r.id_a, r.id_b, r.reason) for r in matching.duplicate_pairs(rows).collect()] == [(1, 2, matching.PAGE)]
    assert [name for name, normalised in told if normalised] == ["prepared"] and len(told) == 7
