"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import time

from pyspark.sql import SparkSession

from cargolens.plans import catalog

HEADLINE = ["cmp_field_mismatch_report", "cmp12_mail_verdicts", "cls9_category", "ver4_version_chain",
            "agg1_report_stats", "rpy13_dispatch_match", "gte2_source_trust", "ovr4_shipment_status"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_PARTITIONS", str(2 * int(cpus))))
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else HEADLINE:
        start = time.time()
        catalog.run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    mails = catalog.run("cls9_category", spark, sf_dir).count()  # every mail gets a verdict
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "cpus": int(cpus),
                      "mails_per_second": round(mails / times["cmp12_mail_verdicts"], 1) if "cmp12_mail_verdicts" in times else None}))


if __name__ == "__main__":
    main()
