from caseframe.model import Scope
from caseframe.plans import report, weekly
from caseframe.sources.tables import Star, read_star, write_star
from tests.frames import CODES, FLU, attributes, fact, org, rows_of
from tests.test_sources import plan_of


def test_sections_are_the_same_from_kept_cases(spark):
    rows = [(i, i % 11, f"2024-0{1 + i % 5}-1{i % 9}", 1 + i % 4) for i in range(60)]
    rows += [(i, 1, "2024-01-02", 1, "O", "Case outcome", "Died") for i in range(0, 60, 7)]
    persons = [(i, "SEX", "male" if i % 2 else "Female") for i in range(11)]
    persons += [(i, "AGE", str(7 * i)) for i in range(11)] + [(i, "OUT", "dead") for i in range(4)]
    persons += [(i, "SEX2", "female") for i in range(11)]
    star = Star(fact(spark, rows), attributes(spark, persons), org(spark).cache())
    shapes = spark.createDataFrame([("North District",), ("Lake",)], "name string")
    cases = report.keep_cases(star.fact, FLU)
    kept = report.situation_report(star, FLU, CODES, scope=Scope(year=2024), cases=cases,
                                   shapes=shapes)
    direct = report.situation_report(star, FLU, CODES, scope=Scope(year=2024), shapes=shapes)
    assert set(kept) == set(direct) and len(kept) == 21
    for name, section in kept.items():
        got = rows_of(section)
        assert got and sorted(map(str, got)) == sorted(map(str, rows_of(direct[name]))), name
    assert rows_of(kept["weekly_table"]) == rows_of(weekly.weekly_table(star.fact, FLU))
    assert "InMemoryTableScan" in cases._jdf.queryExecution().executedPlan().toString()
    cases.unpersist()


def test_a_report_scans_the_cases_of_the_fact_once(spark, tmp_path):
    rows = [(i, i % 11, f"2024-0{1 + i % 5}-1{i % 9}", 1 + i % 4) for i in range(60)]
    rows += [(i, 1, "2024-01-02", 1, "O", "Case outcome", "Died") for i in range(0, 60, 7)]
    star = Star(fact(spark, rows), attributes(spark, [(1, "SEX", "male")]), org(spark))
    write_star(star, str(tmp_path), files=2)
    back = read_star(spark, str(tmp_path))
    sections = report.situation_report(back, FLU, CODES, scope=Scope(year=2024))
    for name, section in sections.items():
        read = [line for line in plan_of(section).splitlines()
                if "Location:" in line and "/fact_event]" in line]
        assert not read or name == "top_districts" and len(read) == 1, name
        assert rows_of(section) is not None
    assert rows_of(sections["weekly_table"]) == rows_of(weekly.weekly_table(star.fact, FLU))
