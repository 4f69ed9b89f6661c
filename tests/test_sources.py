import contextlib
import io
import json

import pytest
from pyspark.sql import functions as F

from caseframe.model import Scope
from caseframe.operators.cases import case_rows
from caseframe.plans import districts, maps
from caseframe.sources import workdir
from caseframe.sources.geojson import read_shapes
from caseframe.sources.jdbc import Slices, Warehouse
from caseframe.sources.tables import Star, read_star, write_star
from tests.frames import FLU, attributes, fact, org, rows_of


def plan_of(frame):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        frame.explain("formatted")
    return out.getvalue()


def test_star_round_trip_prunes_elements_and_years(spark, tmp_path):
    rows = [(i, i, f"202{i % 4}-03-0{1 + i % 9}", 1 + i % 2) for i in range(40)]
    rows += [(i, i, "2023-01-01", 1, "OUT", "Outcome", "Died") for i in range(5)]
    rows += [(99, 9, None, 1)]
    star = Star(fact(spark, rows), attributes(spark, [(1, "AGE", "7")]), org(spark))
    write_star(star, str(tmp_path), files=4)
    back = read_star(spark, str(tmp_path))
    assert sorted(rows_of(back.fact.drop("event_year")), key=str) == sorted(rows_of(star.fact), key=str)
    assert rows_of(back.attributes) == rows_of(star.attributes)
    assert rows_of(districts.top_districts(back.fact, back.org, FLU)) == rows_of(
        districts.top_districts(star.fact, star.org, FLU))
    plan = plan_of(case_rows(back.fact, FLU, Scope(year=2022)))
    partition_filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "data_element_id" in partition_filters and "event_year" in partition_filters
    pushed = plan.split("PushedFilters: [")[1]
    assert "EqualTo(data_value,flu)" in pushed and "GreaterThanOrEqual(event_date,2022-01-01)" in pushed


def test_report_date_reaches_the_scan(spark, tmp_path):
    star = Star(fact(spark, [(i, i, f"2024-03-{10 + i}", 1) for i in range(20)]),
                attributes(spark, []), org(spark))
    write_star(star, str(tmp_path), files=1)
    back = read_star(spark, str(tmp_path))
    recent = maps.map_cases_21d(back.fact, back.org, FLU, days=3)
    assert rows_of(recent) == [("North District", 4)]
    assert "GreaterThanOrEqual(event_date,ScalarSubquery" in plan_of(recent)


def test_shapes_from_geojson(spark, tmp_path):
    features = [
        {"type": "Feature", "properties": {"name": "North District", "id": 1},
         "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}},
        {"type": "Feature", "properties": {"name": "Lake"}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": None}]
    path = tmp_path / "shapes.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2))
    shapes = {row.name: row.geometry for row in read_shapes(spark, str(path)).collect()}
    assert set(shapes) == {"North District", "Lake"}
    assert json.loads(shapes["North District"])["coordinates"] == [1.5, 2.0]
    assert shapes["Lake"] is None


def test_jdbc_reader_takes_slices(spark):
    warehouse = Warehouse("jdbc:none:", {"user": "reader", "password": "hidden"})
    assert "hidden" not in repr(warehouse)
    reader = warehouse.reader(spark, "events", Slices("event_id", 0, 1000, 8))
    with pytest.raises(Exception, match="(?i)driver"):
        reader.load()


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get(workdir.SETTING, None)
    if named:
        assert workdir.shared_folder(spark) == named.rstrip("/")
    first, second = (workdir.new_folder(spark, "x") for _ in range(2))
    assert first != second and first.startswith(workdir.shared_folder(spark))


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        workdir.shared_folder(Session())
