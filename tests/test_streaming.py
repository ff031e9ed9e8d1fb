import datetime as dt
import os

from cumulus.streaming import start_log_ingest

LOG = ("SNo,ObservationDate,Province/State,Country/Region,Last Update,Confirmed,Deaths,Recovered\n"
       "1,01/22/2020,Grand Princess,US,1/22/2020 17:00,12.0,1.0,0.0\n"
       '2,01/23/2020,Unknown,"Bahamas, The",2020-02-01T19:53:03,3.0,,1.0\n')


def test_log_stream_ingest_available_now(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    (src / "a.csv").write_text(LOG)
    out = str(tmp_path / "out")
    q = start_log_ingest(spark, str(src), out, checkpoint=str(tmp_path / "cp"))
    q.awaitTermination(120)
    rows = {r.id: r for r in spark.read.parquet(out).collect()}
    assert rows[1].region == "Grand Princess" and rows[1].confirmed == 12
    assert rows[2].country == "Bahamas" and rows[2].deaths is None
    assert rows[2].observed_date == dt.date(2020, 1, 23) and rows[2].last_updated == dt.date(2020, 2, 1)


def test_log_stream_resumes_exactly_once(spark, tmp_path):
    src = tmp_path / "in"
    os.makedirs(src)
    (src / "a.csv").write_text(LOG)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    start_log_ingest(spark, str(src), out, checkpoint=cp).awaitTermination(120)
    (src / "b.csv").write_text(LOG.splitlines()[0] + "\n3,01/24/2020,,Spain,1/24/20 8:00,7.0,0.0,1.0\n")
    start_log_ingest(spark, str(src), out, checkpoint=cp).awaitTermination(120)
    ids = sorted(r.id for r in spark.read.parquet(out).collect())
    assert ids == [1, 2, 3]  # a.csv not re-read after the restart
