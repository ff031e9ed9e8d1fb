"""Wide CSV sink -> header-driven source -> cleaning loses nothing (SURVEY §5 "Shape")."""

import datetime as dt
import itertools

from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from cumulus.operators import cleaning
from cumulus.sinks import write_wide_csv
from cumulus.sources import read_wide_csv

H = "region string, country string, latitude float, longitude float, counts array<bigint>"
IDS = ["region", "country", "latitude", "longitude"]
_run = itertools.count()

names = st.text(alphabet='ab ,"xé-', min_size=1, max_size=8).filter(lambda s: s.strip() == s and s.strip())
coords = st.one_of(st.none(), st.sampled_from([0.0, -45.0, 23.5, 36.0, 128.0]))


def _key(row):
    return tuple((v is None, v if not isinstance(v, list) else [(x is None, x or 0) for x in v]) if v is not None
                 else (True, 0) for v in row)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.integers(1, 5).flatmap(lambda n: st.lists(
    st.tuples(st.one_of(st.none(), names), names, coords, coords,
              st.lists(st.one_of(st.none(), st.integers(0, 2**40)), min_size=n, max_size=n)),
    min_size=1, max_size=6, unique_by=lambda r: (r[0], r[1]))))
def test_wide_csv_round_trip(spark, tmp_path_factory, rows):
    start = dt.date(2020, 1, 22)
    n = len(rows[0][4])
    path = str(tmp_path_factory.mktemp("wide")) + f"/w{next(_run)}"
    write_wide_csv(spark.createDataFrame(rows, H), path, IDS, "counts", start, n)
    wide = read_wide_csv(spark, path)
    assert wide.start_date == start and wide.n_days == n
    got = sorted((tuple(r) for r in cleaning.global_horizontal(wide).collect()), key=_key)
    want = sorted(((r, c, la if la is not None else 0.0, lo if lo is not None else 0.0, v)
                   for r, c, la, lo, v in rows), key=_key)
    assert got == want
