"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

HEADLINE = (
    "a01_hotspots", "a02_file_edges", "a04_coupling", "a06_layer_matrix", "a09_validation_report", "a12_co_change", "a13_ownership", "a17_near_miss_clones",
    "d01_api_diff", "g03_impact_of", "g07_cycles", "j05_call_resolution", "j06_range_join", "j07_as_of_join", "r02_endpoint_paths", "t03_bm25", "t05_vector_search", "t06_hybrid_search", "w04_dedupe", "x01_debounce",
)


def duckdb_seconds(sf_dir: str, sql: str, cpus: int) -> float:
    """What DuckDB takes for the same rows of the same files, read to the end."""
    import duckdb

    c = duckdb.connect(config={"threads": cpus})
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    began = time.perf_counter()
    c.execute(sql).fetchall()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    from plexgraph.catalog import ORACLES, QUERIES
    from plexgraph.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(master=f"local[{cpus}]", partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    seconds("a01_hotspots")  # starts the executor and compiles
    first, warm, duck = {}, {}, {}
    for name in HEADLINE:
        first[name], warm[name] = seconds(name), seconds(name)
        duck[name] = duckdb_seconds(sf_dir, ORACLES[name], cpus) if name in ORACLES else None
    spark.stop()
    print(
        json.dumps(
            {
                "metric": f"sum of {len(HEADLINE)} headline queries, second run", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm, "sf": Path(sf_dir).name.removeprefix("sf"),
                "first_run": first, "duckdb": duck, "partitions": cpus, "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
