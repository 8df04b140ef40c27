"""Times the reports on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

The ledger is first stored in files, as a database would export it, and the reports are timed on
those, so that no rule of the adapter helps a plan. Each figure is the median of warm runs,
planning included. A report is run to its last row and the rows are dropped. ``*_by_year``
reads the layout of ``save_ledger``; ``*_from_rollup`` reads a rollup stored beforehand;
``store_*`` is the time to write them.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from itertools import count

import finstat
from finstat.registry.queries import REPORTS, YEAR, statements_as_rows
from finstat.session import local_session
from finstat.sources import tpch
from finstat.sources.ledger import TABLES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = [
    "r01_line_count",
    "r02_section_totals",
    "r03_pl_by_year",
    "r04_pl_one_year",
    "r05_pl_yoy",
    "r06_section_crosstab",
    "r07_master_lines",
    "r08_distinct_sections",
    "r09_master_classified",
    "r10_bs_by_account",
    "r11_equation",
    "r12_bs_yoy",
    "p_financial_statements",
]


def drain(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def median_time(action) -> float:
    action()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 4)


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    generated = tpch.load_ledger(spark, SF_DIR)
    with tempfile.TemporaryDirectory(prefix="bench-") as root:
        numbers = count()

        def folder(name: str) -> str:
            return f"{root}/{name}-{next(numbers)}"

        plain = folder("plain")
        for role, (table, _) in TABLES.items():
            getattr(generated, role).write.parquet(f"{plain}/{table}")
        book = finstat.from_parquet(spark, plain)
        times = {"load_ledger": median_time(lambda: finstat.from_parquet(spark, plain))}
        for key in HEADLINES:
            times[key] = median_time(lambda key=key: drain(REPORTS[key](book)))

        times["store_by_year"] = median_time(lambda: finstat.save_ledger(book, folder("by_year")))
        finstat.save_ledger(book, by_year := folder("by_year"))
        dated = finstat.load_ledger(spark, by_year)
        for key in ("r04_pl_one_year", "r07_master_lines", "r10_bs_by_account", "r11_equation"):
            times[key + "_by_year"] = median_time(lambda key=key: drain(REPORTS[key](dated)))

        times["store_rollup"] = median_time(lambda: finstat.save_rollup(finstat.rollup(book), folder("rollup")))
        finstat.save_rollup(finstat.rollup(book), rollup := folder("rollup"))
        stored = finstat.load_rollup(spark, rollup)
        from_rollup = {
            "r03_pl_by_year": lambda: finstat.pl_by_year(book, amounts=stored),
            "r05_pl_yoy": lambda: finstat.pl_yoy(book, YEAR, amounts=stored),
            "r10_bs_by_account": lambda: finstat.bs_by_account(book, YEAR, amounts=stored),
            "r11_equation": lambda: finstat.accounting_equation(book, YEAR, amounts=stored),
            "r12_bs_yoy": lambda: finstat.bs_yoy(book, YEAR, amounts=stored),
            "p_financial_statements": lambda: statements_as_rows(book, stored),
        }
        for key, report in from_rollup.items():
            times[key + "_from_rollup"] = median_time(lambda report=report: drain(report()))

        print(
            json.dumps(
                {
                    "metric": "total of median report times",
                    "value": round(sum(times.values()), 4),
                    "unit": "sec",
                    "queries": times,
                    "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                }
            )
        )
        spark.stop()


if __name__ == "__main__":
    main()
