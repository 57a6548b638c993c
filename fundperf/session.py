"""The session of the command line and of the bench."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

# The collector matters: the aggregation over holdings took several times the CPU with the default one.
# The code cache holds the generated code of a whole report.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
    "spark.executor.extraJavaOptions": "-XX:+UseParallelGC",
    "spark.sql.codegen.cache.maxEntries": "2000",
}


def session(name: str, **conf: str) -> SparkSession:
    """A session with the defaults above where the submit options set nothing else, and with ``conf``."""
    submitted = SparkConf()
    builder = SparkSession.builder.appName(name)
    for key, value in DEFAULTS.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
