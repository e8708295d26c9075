"""Session defaults. A cluster session made elsewhere works as well; these are the settings
the operators are designed around."""

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed join partitions and drops empty branches at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.parquet.filterPushdown": "true",
}

#: The JVM does not compile methods above 8,000 bytes, it interprets them. Stages whose generated method is larger run by
#: their operators' own, smaller methods instead.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def compiled(spark: SparkSession) -> SparkSession:
    """``spark`` with stages kept to methods that the JVM compiles, unless the session has a limit of its own."""
    name, limit = HUGE_METHOD
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, limit)
    return spark


def local_session(cpus: int | str = 8, app: str = "plateflow", **extra: str) -> SparkSession:
    """Local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
