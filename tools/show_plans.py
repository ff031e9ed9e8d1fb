"""Print the formatted physical plan of registered queries (after running them, so
the adaptive plan is final). Usage: python tools/show_plans.py SF_DIR key [key ...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cumulus.plans.catalog import QUERIES  # noqa: E402
from cumulus.session import local_session  # noqa: E402


def main():
    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    for k in keys:
        df = QUERIES[k](spark, sf_dir)
        df.collect()
        print(f"===== {k}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
