"""Write PLANS.md: the final adaptive plan tree of each headline query at SF_DIR,
with its scans' pushed filters and read schemas.

Usage: python tools/plan_digest.py SF_DIR > PLANS.md
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cumulus.plans import fixtures as fx  # noqa: E402
from cumulus.plans.catalog import QUERIES  # noqa: E402
from cumulus.session import local_session  # noqa: E402

KEYS = ["global_count_unpacked", "global_count_vertical", "growth_unpacked", "incidence",
        "tropical_vs_non_tropical", "death_rates", "us_percent_by_quarter", "us_all_percent_by_quarter",
        "global_percent_by_quarter", "merge_global", "clean_observation_log"]


def digest(spark, df):
    df.collect()
    qe = df._jdf.queryExecution()
    plan = qe.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = plan.split("\n\n")[0].split("+- == Initial Plan ==")[0]
    tree = "\n".join(ln for ln in tree.splitlines() if ln.strip())
    scans = re.findall(r"\(\d+\) Scan \w+.*?\n(?:.*\n)*?ReadSchema: .*", plan)
    lines = []
    for s in scans:
        loc = re.search(r"Location: .*?\[(.*?)\]", s)
        pushed = re.search(r"PushedFilters: (.*)", s)
        schema = re.search(r"ReadSchema: (.*)", s)
        name = re.sub(r"-[0-9a-f]{32}$", "", os.path.basename(loc.group(1))) if loc else "?"
        lines.append(f"- `{name}`: pushed {pushed.group(1) if pushed else '[]'}; reads `{schema.group(1)}`")
    return tree, sorted(set(lines))


def main():
    sf_dir = sys.argv[1]
    spark = local_session(8)
    fx.prepare(spark, sf_dir)
    print(f"# Physical plans at {os.path.basename(sf_dir.rstrip('/'))}\n")
    print("Final adaptive plans (after execution) of the headline queries, read from the derived tables that")
    print("`fixtures.prepare` writes once per session. Generated by `tools/plan_digest.py`.\n")
    for k in KEYS:
        tree, scans = digest(spark, QUERIES[k](spark, sf_dir))
        print(f"## {k}\n\n```\n{tree}\n```\n")
        print("Scans:\n" + "\n".join(scans) + "\n")


if __name__ == "__main__":
    main()
