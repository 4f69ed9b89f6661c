import datetime as dt
from pathlib import Path
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from caseframe.plans import maps, rollup, weekly
from caseframe.sources.workdir import new_folder
from caseframe.streaming import live
from caseframe.streaming.snapshot import Snapshot
from tests.frames import CODES, FLU, attributes, fact, org, rows_of

EVENTS = "event_id long, ts timestamp_ntz, event_type string"


def event_stream(spark, folder, rows):
    stamped = [(i, dt.datetime.fromisoformat(t), kind) for i, t, kind in rows]
    spark.createDataFrame(stamped, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENTS).parquet(folder)


def test_live_curve_counts_an_id_once(spark, tmp_path):
    stream = event_stream(spark, str(tmp_path / "events"), [
        (1, "2024-01-01 00:00:00", "case"), (1, "2024-01-01 00:05:00", "case"),
        (2, "2024-01-07 23:59:59", "case"), (3, "2024-01-08 00:00:00", "case"),
        (4, "2024-01-08 00:00:00", "other")])
    curve = live.settled(spark, live.live_epi_curve(stream, F.col("event_type") == "case"))
    assert sorted(rows_of(curve)) == [(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 8), 1)]


def test_rolling_day_has_a_window_per_hour(spark, tmp_path):
    stream = event_stream(spark, str(tmp_path / "events"), [
        (1, "2024-01-01 10:30:00", "case"), (2, "2024-01-01 12:00:00", "case")])
    counts = dict(rows_of(live.settled(
        spark, live.live_rolling_24h(stream, F.col("event_type") == "case"))))
    assert len(counts) == 26
    assert counts[dt.datetime(2024, 1, 1, 11)] == 1
    assert counts[dt.datetime(2024, 1, 1, 13)] == 2
    assert counts[dt.datetime(2024, 1, 2, 11)] == 1


def test_no_events_give_an_empty_result(spark, tmp_path):
    stream = event_stream(spark, str(tmp_path / "events"), [(4, "2024-01-08 00:00:00", "other")])
    curve = live.settled(spark, live.live_epi_curve(stream, F.col("event_type") == "case"))
    assert curve.collect() == []


def test_snapshot_follows_batches_and_late_rows(spark, tmp_path):
    source = str(tmp_path / "fact")
    persons, places = attributes(spark, [(1, "SEX", "male")]), org(spark)
    whole = None

    def arrive(rows):
        nonlocal whole
        batch = fact(spark, rows)
        batch.coalesce(1).write.mode("append").parquet(source)
        whole = batch if whole is None else whole.unionByName(batch)
        return spark.readStream.schema(batch.schema).parquet(source)

    for grain in ("day", "month"):
        snapshot = Snapshot(new_folder(spark, "snapshot"), persons, FLU, CODES, grain)
        for rows in ([(1, 1, "2024-01-30", 1), (2, 1, "2024-02-01", 1), (3, 1, None, 1)],
                     [(4, 2, "2024-02-01", 2), (2, 1, "2024-02-01", 1),
                      (1, 1, "2024-01-30", 1, "OUT", "Case outcome", "died")],
                     [(5, 2, None, 2)]):
            snapshot.follow(arrive(rows))
        daily = snapshot.table(spark)
        direct = rollup.daily_rollup(whole, persons, FLU, CODES)
        assert sorted(map(str, rows_of(daily))) == sorted(map(str, rows_of(direct)))
        assert rows_of(rollup.weekly_table_from_rollup(daily)) == rows_of(
            weekly.weekly_table(whole, FLU))
        assert rows_of(rollup.map_cumulative_from_rollup(daily, places)) == rows_of(
            maps.map_cumulative_cases(whole, places, FLU))


def test_a_batch_run_twice_counts_once(spark):
    persons = attributes(spark, [])
    snapshot = Snapshot(new_folder(spark, "snapshot"), persons, FLU, CODES)
    batch = fact(spark, [(1, 1, "2024-01-30", 1), (2, 1, "2024-01-30", 1)])
    snapshot.refresh(batch, 0)
    snapshot.refresh(batch, 0)
    assert [row.cases for row in snapshot.table(spark).collect()] == [2]


def test_outcomes_elsewhere_and_events_with_two_days(spark):
    """An undated outcome, one dated elsewhere, and an event that moves to an earlier month."""
    persons = attributes(spark, [])
    batches = [[(1, 1, "2024-01-30", 1), (2, 1, "2024-01-30", 1), (3, 2, "2024-02-20", 2),
                (4, 1, "2024-03-05", 1)],
               [(1, 1, None, 1, "OUT", "Case outcome", "died")],
               [(2, 1, "2024-02-20", 1, "OUT", "Case outcome", "died")],
               [(3, 1, "2024-01-30", 1), (4, 1, "2024-01-02", 1)]]
    for grain in ("day", "month"):
        snapshot = Snapshot(new_folder(spark, "snapshot"), persons, FLU, CODES, grain)
        whole = None
        for number, rows in enumerate(batches):
            batch = fact(spark, rows)
            whole = batch if whole is None else whole.unionByName(batch)
            snapshot.refresh(batch, number)
            daily = snapshot.table(spark)
            direct = rollup.daily_rollup(whole, persons, FLU, CODES)
            assert sorted(map(str, rows_of(daily))) == sorted(map(str, rows_of(direct)))


def test_an_event_counts_where_its_first_row_is(spark):
    """Date, place and person come from one row of the event."""
    rows = fact(spark, [(1, 2, "2024-01-30", 1), (1, 1, "2024-02-20", 2)])
    daily = rollup.daily_rollup(rows, attributes(spark, []), FLU, CODES).collect()
    assert [(str(r.event_date), r.cases) for r in daily] == [("2024-01-30", 1)]
    assert daily[0][1] == rows.filter("event_date = '2024-01-30'").first()["dim_org_hierarchy_key"]


def closed_rows(spark, folder):
    return sorted(rows_of(live.closed_panes(spark, folder)))


def test_closed_hours_are_appended_once_and_leave_the_state(spark, tmp_path):
    source, folder = str(tmp_path / "events"), str(tmp_path / "live")
    days = [[(10 * d + k, f"2024-01-{d:02d} {h:02d}:30:00", "case") for k, h in enumerate((1, 1, 5, 9, 20))]
            for d in range(1, 13)]
    whole, held = [], []
    assert live.live_rolling_24h(event_stream(spark, source, []), F.col("event_type") == "case").table(
        spark, folder).collect() == []
    for first in (0, 4, 8):
        batch = [row for day in days[first:first + 4] for row in day]
        whole += batch
        stream = event_stream(spark, source, batch)
        counts = live.live_rolling_24h(stream, F.col("event_type") == "case")
        counts.follow(folder)
        got = dict(rows_of(counts.table(spark, folder)))
        ends = {}
        for _, text, _ in whole:
            hour = dt.datetime.fromisoformat(text).replace(minute=0)
            for h in range(1, 25):
                ends[hour + dt.timedelta(hours=h)] = ends.get(hour + dt.timedelta(hours=h), 0) + 1
        assert got == ends
        held.append(live.open_panes(spark, folder).count())
    # Two days of hours are open, whatever went before; the others were appended.
    assert held[0] == held[1] == held[2] <= 12
    closed = closed_rows(spark, folder)
    assert len(closed) == len(set(closed)) and len(closed) + held[-1] == 12 * 4
    # The last batch ran, but its commit was lost: it runs again and adds nothing.
    commits = Path(folder, "checkpoint", "commits")
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for file in (last, commits / f".{last.name}.crc"):
        file.unlink(missing_ok=True)
    counts.follow(folder)
    assert closed_rows(spark, folder) == closed and dict(rows_of(counts.table(spark, folder))) == ends


def test_an_event_is_counted_in_one_pane(spark, tmp_path):
    stream = event_stream(spark, str(tmp_path / "events"), [(1, "2024-01-01 10:30:00", "case")])
    counts = live.live_rolling_24h(stream, F.col("event_type") == "case")
    assert "Expand" not in counts.panes._jdf.queryExecution().analyzed().toString()
    assert "Expand" not in live.settled(spark, counts)._jdf.queryExecution().toString()


def test_other_time_zones_are_refused(spark, tmp_path):
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "Africa/Nairobi")
    stream = event_stream(session, str(tmp_path / "events"), [(1, "2024-01-01 10:30:00", "case")])
    with pytest.raises(ValueError, match="UTC"):
        live.live_epi_curve(stream, F.col("event_type") == "case")


class Watched(Snapshot):
    """Counts the bytes of landed files that a refresh opens."""

    read_bytes = 0

    def read(self, *arguments):
        frame = super().read(*arguments)
        self.read_bytes += sum(Path(unquote(urlparse(f).path)).stat().st_size for f in frame.inputFiles())
        return frame


def test_a_refresh_reads_its_own_buckets_and_periods_only(spark):
    """As many bytes after 30 earlier batches as after 3."""
    persons, read = attributes(spark, []), []
    first = dt.date(2023, 1, 1)
    for earlier in (3, 30):
        snapshot, whole = Watched(new_folder(spark, "snapshot"), persons, FLU, CODES, buckets=16_384), None
        for number in range(earlier + 1):
            day = str(first + dt.timedelta(days=7 * number))
            rows = [(10 * number + k, k, day, 1 + k % 2) for k in range(8)]
            if number == earlier:  # late outcomes of the first batch, and a case of its own
                rows = [(k, k, None, 1, "OUT", "Case outcome", "died") for k in range(4)] + [(999, 1, day, 1)]
            batch = fact(spark, rows).coalesce(1)
            whole = batch if whole is None else whole.unionByName(batch)
            snapshot.read_bytes = 0
            snapshot.refresh(batch, number)
        read.append(snapshot.read_bytes)
        direct = rollup.daily_rollup(whole, persons, FLU, CODES)
        assert sorted(map(str, rows_of(snapshot.table(spark)))) == sorted(map(str, rows_of(direct)))
    assert read[1] <= 1.1 * read[0]


def test_rows_of_events_without_a_case_wait(spark):
    """The outcome lands first, the case later, then the batch of the case runs again."""
    persons = attributes(spark, [])
    batches = [[(1, 1, "2024-01-30", 1, "OUT", "Case outcome", "died"), (2, 1, None, 1, "OUT", "Case outcome", "died")],
               [(1, 1, "2024-02-01", 1)], [(2, 1, "2024-02-01", 2), (1, 1, "2024-01-15", 1)]]
    snapshot, whole = Snapshot(new_folder(spark, "snapshot"), persons, FLU, CODES), None
    for number, rows in enumerate(batches):
        batch = fact(spark, rows)
        whole = batch if whole is None else whole.unionByName(batch)
        snapshot.refresh(batch, number)
        if number:
            snapshot.refresh(batch, number)
            direct = rollup.daily_rollup(whole, persons, FLU, CODES)
            assert sorted(map(str, rows_of(snapshot.table(spark)))) == sorted(map(str, rows_of(direct)))
    snapshot.refresh(fact(spark, []), 9)
    assert sum(row.cases for row in snapshot.table(spark).collect()) == 2
