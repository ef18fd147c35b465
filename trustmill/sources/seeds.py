"""Source registry entries and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOURS = 3_600_000
PLATFORM = ("sitemap", "PLATFORM", 5)
UNIVERSITY = ("sitemap", "UNIVERSITY", 3)
GOVERNMENT = ("sitemap", "GOVERNMENT", 3)
#: The registry's first entries, as slug, (kind, type, level), address, trust, enabled, rate limit, pages.
SEEDS = (
    ("devfolio", PLATFORM, "https://devfolio.co", 65, True, HOURS, 10), ("unstop", PLATFORM, "https://unstop.com", 65, True, HOURS, 10),
    ("hackerearth", PLATFORM, "https://hackerearth.com", 60, True, HOURS, 10), ("hack2skill", PLATFORM, "https://hack2skill.com", 60, True, 6 * HOURS, 10),
    ("devpost", PLATFORM, "https://devpost.com", 60, True, 6 * HOURS, 10), ("mlh", PLATFORM, "https://mlh.io", 65, True, 6 * HOURS, 10),
    ("kaggle", PLATFORM, "https://www.kaggle.com", 65, True, 6 * HOURS, 10), ("townscript", PLATFORM, "https://www.townscript.com", 55, True, 6 * HOURS, 10),
    ("allevents", PLATFORM, "https://allevents.in", 50, True, 6 * HOURS, 10),
    ("iit-bombay", UNIVERSITY, "https://www.iitb.ac.in", 85, True, 6 * HOURS, 8), ("iit-delhi", UNIVERSITY, "https://home.iitd.ac.in", 85, True, 6 * HOURS, 8),
    ("iit-kharagpur", UNIVERSITY, "https://www.iitkgp.ac.in", 85, True, 6 * HOURS, 8), ("iit-madras", UNIVERSITY, "https://www.iitm.ac.in", 85, True, 6 * HOURS, 8),
    ("iit-kanpur", UNIVERSITY, "https://www.iitk.ac.in", 85, True, 6 * HOURS, 8), ("nit-trichy", UNIVERSITY, "https://www.nitt.edu", 85, True, 6 * HOURS, 8),
    ("iiit-hyderabad", UNIVERSITY, "https://www.iiit.ac.in", 85, True, 6 * HOURS, 8), ("bits-pilani", UNIVERSITY, "https://www.bits-pilani.ac.in", 80, True, 6 * HOURS, 8),
    ("iit-guwahati", UNIVERSITY, "https://www.iitg.ac.in", 85, True, 6 * HOURS, 8), ("iit-roorkee", UNIVERSITY, "https://www.iitr.ac.in", 85, True, 6 * HOURS, 8),
    ("nit-warangal", UNIVERSITY, "https://www.nitw.ac.in", 85, True, 6 * HOURS, 8), ("nit-calicut", UNIVERSITY, "https://nitc.ac.in", 85, True, 6 * HOURS, 8),
    ("nit-surathkal", UNIVERSITY, "https://www.nitk.ac.in", 85, True, 6 * HOURS, 8), ("iiit-bangalore", UNIVERSITY, "https://www.iiitb.ac.in", 85, True, 6 * HOURS, 8),
    ("iiit-delhi", UNIVERSITY, "https://www.iiitd.ac.in", 85, True, 6 * HOURS, 8), ("dtu", UNIVERSITY, "https://www.dtu.ac.in", 80, True, 6 * HOURS, 8),
    ("vit-vellore", UNIVERSITY, "https://vit.ac.in", 80, True, 6 * HOURS, 8),
    ("sih", GOVERNMENT, "https://www.sih.gov.in", 80, True, 6 * HOURS, 8), ("mygov-innovate", GOVERNMENT, "https://innovateindia.mygov.in", 75, True, 6 * HOURS, 8),
    ("startup-india", GOVERNMENT, "https://www.startupindia.gov.in", 75, True, 6 * HOURS, 8),
    ("search-api", ("search", "SEARCH", 7), None, 40, False, HOURS // 2, None),
)
SEED = "slug string, kind string, level int, base_url string, feed_url string, trust int, enabled boolean, rate_limit_ms long, max_pages int"


def first_seeds(spark: SparkSession) -> DataFrame:
    """The registry's first entries as seeds."""
    rows = [(slug, kind, level, base, None, trust, on, limit, pages) for slug, (kind, _, level), base, trust, on, limit, pages in SEEDS]
    return spark.createDataFrame(rows, SEED)


def validate(seeds: DataFrame) -> DataFrame:
    """seeds with errors, what is wrong with each entry; of several with one slug, all but the first (by address) are duplicates."""
    again = F.row_number().over(Window.partitionBy("slug").orderBy("base_url")) > 1
    checks = {
        "DUPLICATE_SLUG": F.col("_again"), "BAD_TRUST": ~F.col("trust").between(0, 100), "NON_HTTPS_BASE": ~F.col("base_url").startswith("https://"),
        "RSS_WITHOUT_FEED": (F.col("kind") == "rss") & F.col("feed_url").isNull(), "RATE_LIMIT_TOO_LOW": F.col("rate_limit_ms") < 60_000,
    }
    errors = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))
    return seeds.withColumn("_again", again).select(*seeds.columns, errors.alias("errors"))


def refresh_registry(registry: DataFrame, seeds: DataFrame) -> DataFrame:
    """The registry with every seed's fields as the seed has them; what runs have recorded stays."""
    fields = ["kind", "level", "base_url", "trust", "enabled", "rate_limit_ms"]
    own = seeds.select("slug", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_seed"))
    joined = registry.join(own, "slug", "full")
    return joined.select("slug", *(F.when(F.col("_seed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), "last_run", "last_status")
