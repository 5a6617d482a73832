"""Write the physical plans of the key queries to docs/PLANS.md.

Large-table behaviour is emulated on the small tables: automatic
broadcasts are disabled (only explicit, size-proven broadcast hints
remain), and the prefix operators have one distributed path.
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from terrapanel import registry  # noqa: E402
from terrapanel.plans import panels  # noqa: E402
from terrapanel.plans import queries as nq  # noqa: E402
from terrapanel.plans.warehouse import build  # noqa: E402
from terrapanel.session import local_session  # noqa: E402
from terrapanel.sources.tpch import customer_years  # noqa: E402

BANDS = registry.TPCH_BANDS


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="simple")
    return buf.getvalue().strip()


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    star = build(spark, sf, bands=BANDS, buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    items = [
        ("ETL: customer-year aggregate (lineitem ⋈ part ⋈ orders)", lambda: customer_years(spark, sf)),
        ("Municipality panel over the bucketed star (live)",
         lambda: panels.municipality_panel(star, BANDS, live=True)),
        ("Ranking view (distributed rank path)", lambda: panels.ranking_view(star.mv_painel_municipio)),
        ("Lorenz / concentration table (distributed prefix)",
         lambda: panels.concentration_table(star.mv_painel_municipio)),
        ("top_municipios (metric = pib)", lambda: nq.run("top_municipios", star, BANDS, metrica="pib")),
        ("concentracao (threshold crossings)", lambda: nq.run("concentracao", star, BANDS)),
        ("declinio_populacional", lambda: nq.run("declinio_populacional", star, BANDS)),
    ]
    out = ["# Physical plans", "",
           "Generated by `tools/explain_plans.py` on the sf0.01 tables with automatic broadcasts disabled "
           "to show the large-input plan shapes. Explicit broadcasts "
           "left in the plans are size-proven (one-row totals, per-range offsets, the territory-bounded "
           "state/region dimensions). Ranking and Lorenz plans start from tables staged by the prefix "
           "operator (written during plan construction).", "",
           "What to look for:", "",
           "* ETL: `lineitem` is shuffled once on `partkey` (for `part`) and the per-order aggregate is hash-"
           "partitioned on `orderkey`, which the `orders` join reuses; the customer-year aggregate is partial "
           "before its exchange.",
           "* Municipality panel: six sort-merge joins over bucketed scans of the star with no hash exchange; "
           "year partitions pruned by the scalar-subquery partition filter; only single-partition exchanges "
           "inside the tiny max-year subqueries.",
           "* Lorenz table: the staged, range-tagged rows (bucketed on group keys + range) feed the window "
           "without an exchange; only the per-range totals (≤ N rows per group) move.",
           "* Ranking view: per-value counts staged once; the per-value lookup is broadcast to the long rows when "
           "it is provably small (≤ 1M rows, else a shuffle join with AQE skew handling); one shuffle on the id "
           "for the conditional-aggregate pivot; the final join uses the panel's bucketing.",
           ""]
    for title, make in items:
        out += [f"## {title}", "", "```", plan(make()), "```", ""]
    os.makedirs(os.path.join(ROOT, "docs"), exist_ok=True)
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w", encoding="utf-8") as f:
        f.write("\n".join(out))
    print("wrote docs/PLANS.md")


if __name__ == "__main__":
    main()
