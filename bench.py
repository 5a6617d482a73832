"""Benchmark: ETL + headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``

``etl`` is the one-off load (derive the star from the TPC-H tables, write
the snapshot, refresh the two materialised panels); every other entry is a
query over the loaded warehouse, timed to its last row. ``value`` is the
sum of all entries. Each query is run ``BENCH_REPEAT`` times (default 2)
and the best time is kept (the first run also pays JIT/codegen warm-up);
the ETL runs once. An untimed warm-up on a synthetic range runs first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from terrapanel import registry  # noqa: E402
from terrapanel.plans import panels  # noqa: E402
from terrapanel.plans import queries as nq  # noqa: E402
from terrapanel.plans.warehouse import build  # noqa: E402
from terrapanel.session import local_session, scratch_path  # noqa: E402

BANDS = registry.TPCH_BANDS


def _consume(df) -> int:
    """Run the plan to its last row without pulling large results."""
    return len(df.collect())


def _noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def _warm_up(spark) -> None:
    """Untimed JVM/codegen warm-up on a synthetic range (not the benchmark
    data): a join, aggregations, a window and a Parquet round trip, so the
    timings reflect steady-state work rather than first-use compilation."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    a = spark.range(200_000).select((F.col("id") % 5000).alias("k"), (F.col("id") * 3 % 97).alias("v"))
    b = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"))
    j = a.join(b, "k").groupBy("g", "k").agg(F.sum("v").alias("s"), F.max("v").alias("m"))
    j = j.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc())))
    path = scratch_path(spark, "bench-warmup")
    j.write.parquet(path)
    spark.read.parquet(path).agg(F.sum("s"), F.count("*")).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="terrapanel-bench")
    _warm_up(spark)

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    star = build(spark, sf_dir, scratch_path(spark, "bench-star"), BANDS)
    times["etl"] = time.perf_counter() - t0

    headline = {
        "top_municipios": lambda: _consume(nq.run("top_municipios", star, BANDS)),
        "top_municipios_pib": lambda: _consume(nq.run("top_municipios", star, BANDS, metrica="pib", limite=50)),
        "concentracao": lambda: _consume(nq.run("concentracao", star, BANDS)),
        "declinio_populacional": lambda: _consume(nq.run("declinio_populacional", star, BANDS)),
        "porte_populacional": lambda: _consume(nq.run("porte_populacional", star, BANDS)),
        "quociente_locacional": lambda: _consume(nq.run("quociente_locacional", star, BANDS)),
        "regioes": lambda: _consume(nq.run("regioes", star, BANDS)),
        "serie_uf": lambda: _consume(nq.run("serie_uf", star, BANDS)),
        "descolamento_pib_populacao": lambda: _consume(nq.run("descolamento_pib_populacao", star, BANDS)),
        "densidade_extremos": lambda: _consume(nq.run("densidade_extremos", star, BANDS)),
        "perfil_municipio": lambda: _consume(nq.run("perfil_municipio", star, BANDS, municipio="0000007")),
        "qualidade": lambda: _consume(nq.run("qualidade", star, BANDS)),
        "ranking_view": lambda: _noop(panels.ranking_view(star.mv_painel_municipio)),
        "concentration_table": lambda: _noop(panels.concentration_table(star.mv_painel_municipio)),
        "municipality_panel_live": lambda: _noop(panels.municipality_panel(star, BANDS, live=True)),
        "population_view": lambda: _noop(panels.population_view(star)),
    }
    for name, run in headline.items():
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            run()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = best

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in times.items()},
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
