"""Time the headline queries; one JSON line on standard output.

Each query runs to the end into Spark's no-op sink, so that all of its rows
and columns are computed. Set BENCH_SF_DIR and BENCH_CPUS to change the tables
and the number of cores, BENCH_QUERIES to name other queries. A query that
takes longer than BENCH_LIMIT seconds is cancelled, and none begins after
BENCH_SECONDS; what did not end is named beside the times of the others. A run
that is asked to end tries to write the line first.
"""

from __future__ import annotations

import json
import os
import re
import signal
import sys
import time
from threading import Timer

from townsquare.plans import all_plans
from townsquare.session import build_session

HEADLINE = [
    # temporal
    "frequency_minute", "frequency_hour", "symbol_frequency_wide", "symbol_frequency_many", "threads_by_day",
    # ingest and extract
    "ingest_tweets", "unified_posts", "user_names", "user_ids", "tweets_by_id_once", "tweets_by_user",
    "users_by_domain", "link_counts_top", "reddit_domain_edges",
    # search and words
    "keyword_filter", "keyword_filter_many", "fielded_documents", "cooccurring_terms", "expand_query_all",
    "tweet_tokens", "topic_tokens", "plain_text",
    # networks
    "mention_edges", "trimmed_edges", "louvain_half_cycle", "modularity", "louvain_level",
    # topics
    "term_counts", "topic_similarity", "topics_of_documents", "held_out_likelihood", "topics_of_tweets", "topic_purity",
    "model_similarity", "month_ahead",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    here = os.path.dirname(os.path.abspath(__file__))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__sql__files__maxPartitionBytes="8m",
        spark__sql__warehouse__dir=f"{here}/spark-warehouse",
        spark__checkpoint__dir=os.environ.get("TOWNSQUARE_SCRATCH", f"{here}/spark-warehouse/scratch"),
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = all_plans()
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()  # warm up
    limit, until = float(os.environ.get("BENCH_LIMIT", "240")), float(os.environ.get("BENCH_SECONDS", "1200"))
    seconds: dict[str, float] = {}
    missing: dict[str, str] = {}
    began = time.perf_counter()

    def report() -> None:
        scale = re.search(r"sf([\d.]+)", folder)
        line = {
            "metric": "total time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": float(scale.group(1)) if scale else folder,
        }
        unfinished = missing | {name: "not begun" for name in names if name not in seconds and name not in missing}
        print(json.dumps(line | ({"unfinished": unfinished} if unfinished else {})), flush=True)

    def asked_to_end(*_: object) -> None:
        report()
        os._exit(1)

    signal.signal(signal.SIGTERM, asked_to_end)
    for name in names:
        left = min(limit, until - (time.perf_counter() - began))
        if left <= 0:
            break
        start = time.perf_counter()
        timer = Timer(left, spark.sparkContext.cancelAllJobs)
        timer.start()
        try:
            plans[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        except Exception as error:  # the others are still timed
            missing[name] = f"ended after {time.perf_counter() - start:.0f} s: {str(error)[:200]}"
        finally:
            timer.cancel()
        print(f"{name} {seconds.get(name, missing.get(name))}", file=sys.stderr, flush=True)
    report()
    spark.stop()


if __name__ == "__main__":
    main()
