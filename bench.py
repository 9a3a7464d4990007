"""Headline queries on the supplied tables; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) as given by the
caller.  Every query runs twice to the end (noop sink); the second time counts,
so that JVM and code generation warm-up do not.  ``table_masking`` holds the
by number of rows; ``table_masking_reversible`` the same with a reversible name.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

HEADLINE = [
    "summary_by_pattern", "findings_scored", "phones_found", "emails_in_documents", "redact_fixed", "redact_documents",
    "redact_reversible", "redact_corpus", "text_job", "rules_in_sequence", "job_totals", "mask_contact_table",
    "mask_reversible_orders", "mask_jabber_keyed", "mask_multiply_fixed", "mask_multiply_per_value", "mask_shuffle",
    "restore_documents", "restore_corpus", "restore_table", "error_rate_trailing_hour", "duration_percentiles",
    "error_status", "column_pii_profile", "csv_round_trip", "docx_texts", "xlsx_table", "stream_redact",
]
TABLE_SIZES = [10_000, 50_000, 100_000]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def finish(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run, rounds: int = 2) -> float:
    """Seconds of the last round, planning included."""
    seconds = 0.0
    for _ in range(rounds):
        started = time.perf_counter()
        finish(run())
        seconds = time.perf_counter() - started
    return round(seconds, 3)


def masked_contacts(spark: SparkSession, sf_dir: str, rows: int, reversible: bool = False) -> DataFrame:
    from cloakframe import mask_table
    from workload.inputs import from_sql
    from workload.masking import CONTACTS

    contacts = from_sql(spark, sf_dir, CONTACTS, "orders").where(f"id < {rows}")
    rules = [
        {"id": "1", "columnName": "naam", "replaceWith": "[NAAM]", "reversible": reversible},
        {"id": "2", "columnName": "email", "anonymizationType": "jabber", "preserveUniqueness": True},
    ]
    return mask_table(contacts, rules, row_id="id").table


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    import workload

    finish(workload.QUERIES["error_status"].run(spark, sf_dir))
    times = {name: timed(lambda name=name: workload.QUERIES[name].run(spark, sf_dir)) for name in HEADLINE}
    masking = {str(rows): timed(lambda rows=rows: masked_contacts(spark, sf_dir, rows)) for rows in TABLE_SIZES}
    undone = {str(rows): timed(lambda rows=rows: masked_contacts(spark, sf_dir, rows, reversible=True)) for rows in TABLE_SIZES}
    result = {
        "metric": "total of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "table_masking": masking,
        "table_masking_reversible": undone,
        "sf": Path(sf_dir).name,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
