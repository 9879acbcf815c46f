"""A log replayed by its own clock: every row once, none early, across a restart."""

import datetime
import time

import pytest

from plumbline.sources.replay import replay

BEGIN = datetime.datetime(2024, 5, 1, 23, 59, 58)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_rows_wait_and_come_once(spark, tmp_path, kind):
    rows = [(i, BEGIN + datetime.timedelta(seconds=i * 0.5)) for i in range(40)] + [(40, None)]
    log = spark.createDataFrame(rows, f"id int, ts {kind}").repartition(3)
    log.write.parquet(str(tmp_path / "log"))
    log, came = spark.read.parquet(str(tmp_path / "log")), []

    def put(batch, number):
        came.append((time.time(), sorted(r.id for r in batch.select("id").collect()), number))

    began = time.time()
    run = replay(log, put, str(tmp_path / "state"), speed=4.0)
    while not came and time.time() < began + 60:
        time.sleep(0.05)
    time.sleep(1.2)
    run.query.stop()
    assert not run.ended
    again = replay(log, put, str(tmp_path / "state"), speed=4.0)
    assert again.wait(60)
    ids = [i for _, batch, _ in came for i in batch]
    assert ids == list(range(40)) and len({n for *_, n in came}) == len(came)
    for at, batch, _ in came:
        # tick k is due k seconds after the clock began, and holds 4 seconds of the log
        assert all(at >= began + i * 0.5 // 4.0 for i in batch)


def test_empty_logs_and_speeds(spark, tmp_path):
    log = spark.createDataFrame([], "id int, ts timestamp")
    run = replay(log, lambda *_: pytest.fail("nothing to release"), str(tmp_path / "s"))
    assert run.ended and run.wait(5)
    with pytest.raises(ValueError):
        replay(log, print, str(tmp_path / "t"), speed=0.0)
