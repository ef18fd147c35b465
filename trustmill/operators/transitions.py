"""State as snapshots: merges, keyed unions, ordered folds, and the transitions of the event catalogue.

Every transition takes the current snapshot and what happened, and returns the next one; nothing is changed in place, so
that a lost executor only means computing again. `publish` makes a snapshot current by renaming a pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trustmill.functions.dates import stale_reason
from trustmill.functions.scoring import trust_step
from trustmill.functions.urls import absolutize
from trustmill.session import dealt, stored

#: Steps of one source folded in one row.
RUN = 1000


def merge_snapshot(current: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `changes` replace those with their key; the rest stay."""
    return current.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_or_ignore(current: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key is new are added, the first of each key in the given order."""
    first = Window.partitionBy(*key).orderBy(*order)
    fresh = new.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
    return current.unionByName(fresh.join(current.select(*key), key, "left_anti"), allowMissingColumns=True)


def next_ids(current_max: int, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive ids after the given one in the given order: each range of the order is numbered on its own, after the
    counts of those before it. The ranges are stored, so that ranks and counts see the same ones."""
    ranged = stored(rows.withColumn("_key", F.struct(*order)).repartitionByRange(F.col("_key")).withColumn("_part", F.spark_partition_id()), "ranges")
    own = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.lit(current_max) + F.col("_rank") + F.col("_before")).drop("_key", "_part", "_rank", "_before")


def folded(rows: DataFrame, starts: DataFrame, key: str, order: list[str], value: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """key and trust (0..100) after a key's steps in the given order, from its start. starts: key, start (null: none).

    Steps clamp and may be damped, so their order matters. Rows are dealt by ranges of key and order, each range cut into
    runs of at most RUN rows. A key with one run is folded from its start. A key with more is neither one task nor one
    row: each of its runs becomes a map from trust to trust, the maps of a range are composed, and then those of ranges.
    """
    ranged = rows.select(key, value, F.struct(*order).alias("_order")).select("*", F.struct(key, "_order", value).alias("_key")).repartitionByRange(F.col("_key")).withColumn("_part", F.spark_partition_id())
    own = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_part").orderBy("_key")))
    runs = own.groupBy(key, "_part", F.floor((F.col("_rank") - 1) / RUN).alias("_run")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_order", value))), lambda s: s[value]).alias("_steps"))
    # stored, as two branches read the runs and ranges must be the same for both
    runs = stored(runs, "runs")
    known = starts.select(F.col(key).alias("_id"), F.least(F.greatest(F.coalesce(F.col("start").cast("int"), F.lit(START_TRUST)), F.lit(0)), F.lit(100)).alias("_start"))
    count = runs.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias("_runs")).join(known, "_id", "left").select("_id", "_runs", F.coalesce("_start", F.lit(START_TRUST)).alias("_start"))
    counted = runs.join(count, runs[key].eqNullSafe(count["_id"]))
    single = counted.where("_runs = 1").select(key, F.aggregate("_steps", F.col("_start"), step).alias("trust"))
    several = counted.where("_runs > 1")
    all_starts = F.sequence(F.lit(0), F.lit(100))
    maps = several.select(key, "_start", "_part", "_run", F.transform(all_starts, lambda t: F.aggregate("_steps", t, step)).alias("_after"))
    ordered = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by, "_after"))), lambda s: s["_after"])
    whole = lambda maps: F.transform(all_starts, lambda t: F.aggregate(maps, t, lambda x, m: m[x]))
    parts = maps.groupBy(key, "_start", "_part").agg(ordered("_run").alias("_maps")).select(key, "_start", "_part", whole(F.col("_maps")).alias("_after"))
    joined = parts.groupBy(key, "_start").agg(ordered("_part").alias("_maps")).select(key, F.aggregate("_maps", F.col("_start"), lambda t, m: m[t]).alias("trust"))
    return single.unionByName(joined)


#: Trust of a source that has none yet.
START_TRUST = 50


def fold_trust(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, trust after all its outcomes in the order of observation (see `folded`). outcomes: source_id,
    observed_at, seq, outcome; sources: source_id, trust_score."""
    starts = sources.select("source_id", F.col("trust_score").alias("start"))
    return folded(outcomes, starts, "source_id", ["observed_at", "seq"], "outcome", trust_step)


def count_outcomes(outcomes: DataFrame) -> DataFrame:
    kinds = {"valid_events": "valid", "dead_links": "dead_link", "fake_events": "fake", "duplicates": "duplicate"}
    return outcomes.groupBy("source_id").agg(*(F.count_if(F.col("outcome") == v).alias(k) for k, v in kinds.items()))


def add_counters(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Counters of both snapshots added up."""
    names = [c for c in new.columns if c != key]
    a, b = current.select(key, *names), new.select(key, *names)
    return a.unionByName(b).groupBy(key).agg(*(F.sum(c).alias(c) for c in names))


def expire(events: DataFrame, now: Column) -> DataFrame:
    """Events past their end or deadline become EXPIRED."""
    reason = stale_reason(F.col("status"), F.col("end_date"), F.col("registration_deadline"), now)
    return events.withColumn("stale_reason", reason).withColumn("status", F.when(F.col("stale_reason").isNotNull(), "EXPIRED").otherwise(F.col("status")))


def apply_feedback(sources: DataFrame, feedback: DataFrame) -> DataFrame:
    """Trust and counters after feedback (source_id, label, seq) in order: negative labels -8 and one fake event more,
    LEGITIMATE +3 without damping, DUPLICATE nothing."""
    negative = lambda x: x.isin("FALSE_POSITIVE", "FALSE_LINK", "WRONG_EVENT", "WRONG_DATE")
    step = lambda t, x: F.when(negative(x), F.greatest(t - 8, F.lit(0))).when(x == "LEGITIMATE", F.least(t + 3, F.lit(100))).otherwise(t)
    counts = feedback.groupBy("source_id").agg(F.count_if(negative(F.col("label"))).alias("fake_events"), F.count_if(F.col("label") == "LEGITIMATE").alias("valid_events"))
    counted = sources.join(counts, "source_id", "left").select("source_id", "trust_score", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fake_events", "valid_events")))
    told = folded(feedback, sources.select("source_id", F.col("trust_score").alias("start")), "source_id", ["seq"], "label", step)
    return counted.join(told, "source_id", "left").select("source_id", F.coalesce("trust", "trust_score").alias("trust_score"), "fake_events", "valid_events")


def cluster(items: DataFrame, known: DataFrame, order: list[Column]) -> DataFrame:
    """items with `action`: the first of a new dedupe_key in arrival order INSERTs, all others ATTACH. The first is found
    by an aggregate that is combined before the shuffle, so that a key with very many items is not one sorted group."""
    seen = known.select("dedupe_key").distinct().withColumn("_known", F.lit(True))
    # a row's number tells equal rows apart; stored, as both sides of the join must see the same
    numbered = stored(items.withColumn("_at", F.struct(*order, F.monotonically_increasing_id().alias("_row"))), "sightings")
    first = numbered.groupBy(F.col("dedupe_key").alias("_key")).agg(F.min("_at").alias("_first"))
    ranked = numbered.join(first, numbered["dedupe_key"].eqNullSafe(first["_key"])).join(seen, "dedupe_key", "left")
    return ranked.withColumn("action", F.when(F.col("_known").isNull() & (F.col("_at") == F.col("_first")), "INSERT").otherwise("ATTACH")).drop("_at", "_key", "_first", "_known")


def follow_redirects(urls: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """url, final_url, redirects after at most so many hops. urls: url; hops: url, target."""
    found = urls.select("url", F.col("url").alias("final_url"), F.lit(0).alias("redirects"))
    step = hops.select(F.col("url").alias("_from"), "target")
    for _ in range(most):
        found = found.join(step, found["final_url"] == step["_from"], "left").select("url", F.coalesce("target", "final_url").alias("final_url"), (F.col("redirects") + F.col("target").isNotNull().cast("int")).alias("redirects"))
    return found


REDIRECTS = "array<struct<url:string,status:int>>"
#: Before the key of an address that is done. What such a key finds is not read.
DONE = "\0"


def redirect_chains(urls: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """url, final_url, chain, redirects, error, loops of each address, followed for at most so many redirects.

    urls: url; hops: url, status, target, what each address answers; addresses that are not in it answer 200. A target may
    be relative. chain: every address asked, with its answer. error: DANGEROUS_REDIRECT_SCHEME where a target is no web
    address (it is not followed), TOO_MANY_REDIRECTS where the last address allowed still leads on. loops: an address is
    asked twice. A step is one equi-join of the addresses that still lead on, whose side of hops has a row an address;
    those that are done ask under a key of their own, as null would bring them all to one task.
    """
    step = hops.groupBy(F.col("url").alias("_from")).agg(F.max_by(F.struct("status", "target"), F.struct("status", "target")).alias("_hop"))
    found = urls.select("url").distinct().select("url", F.col("url").alias("_at"), F.array().cast(REDIRECTS).alias("chain"), F.lit(None).cast("string").alias("error"))
    rows = urls.count()
    for k in range(most + 1):
        asking, answers = dealt(found.withColumn("_from", F.coalesce("_at", F.concat(F.lit(DONE), "url"))), step, "_from", rows)
        asked = asking.join(answers, "_from", "left")
        status, target = F.coalesce("_hop.status", F.lit(200)), F.col("_hop.target")
        leads = F.col("_at").isNotNull() & status.between(300, 399) & (F.coalesce(target, F.lit("")) != "")
        scheme = F.lower(F.regexp_extract(target, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
        web = scheme.isin("", "http", "https")
        chain = F.when(F.col("_at").isNotNull(), F.concat("chain", F.array(F.struct(F.col("_at").alias("url"), status.alias("status"))))).otherwise(F.col("chain"))
        onward = F.when(scheme == "", absolutize(target, F.col("_at"))).otherwise(target)
        late = F.lit(k == most)
        error = F.when(leads & ~web, "DANGEROUS_REDIRECT_SCHEME").when(leads & late, "TOO_MANY_REDIRECTS").otherwise(F.col("error"))
        found = asked.select("url", F.when(leads & web & ~late, onward).alias("_at"), chain.alias("chain"), error.alias("error"))
    visited = F.transform("chain", lambda c: c["url"])
    return found.select(
        "url", F.element_at("chain", -1)["url"].alias("final_url"), "chain", (F.size("chain") - 1).alias("redirects"), "error", (F.size(F.array_distinct(visited)) < F.size(visited)).alias("loops"),
    )


def publish(spark: SparkSession, df: DataFrame, folder: str) -> str:
    """Writes df as a new version of the folder's table and makes it current; readers see the old or the new one whole."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), conf)
    system = path(folder).getFileSystem(conf)
    out = system.create(path(f"{folder}/NEXT"), True)
    out.write(bytearray(version.encode()))
    out.close()
    context.rename(path(f"{folder}/NEXT"), path(f"{folder}/CURRENT"), _overwriting(spark))
    return version


def _overwriting(spark: SparkSession):
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    return options


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The current version of the folder's table."""
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    return spark.read.parquet(f"{folder}/{version}")
