"""Worker rows from IP reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import IP_REPORT


def classify_workers(reports: DataFrame) -> DataFrame:
    """(worker_id, report JSON, timestamp) to worker rows; unreadable reports drop out.

    Residential means none of VPN, proxy and data centre.
    """
    read = reports.withColumn("r", F.from_json("report", IP_REPORT))
    risk = F.col("r.risk")
    risky = risk["is_vpn"] | risk["is_proxy"] | risk["is_datacenter"]
    return read.filter(F.col("r.location.country_code").isNotNull() & risky.isNotNull()).select(
        "worker_id",
        F.col("r.location.country_code").alias("country_code"),
        (~risky).alias("is_residential"),
        F.col("timestamp").cast("double").alias("timestamp"),
    )


def only_residential(workers: DataFrame) -> DataFrame:
    return workers.filter("is_residential")
