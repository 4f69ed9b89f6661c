"""Deaths by place, age and sex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions.bands import ELEVEN_BANDS, FIVE_BANDS, AgeScheme
from caseframe.functions.text import FEMALE, MALE
from caseframe.model import AttributeCodes, CaseDefinition, Scope
from caseframe.operators.cases import case_rows
from caseframe.operators.names import Names
from caseframe.operators.outcomes import dead_persons
from caseframe.operators.persons import person_traits
from caseframe.operators.places import (
    add_districts, at_place, name_districts, only_places, valid_district)
from caseframe.schemas import DISTRICT_KEY, ORG_KEY, PERSON


def total_deaths(fact: DataFrame, attributes: DataFrame, definition: CaseDefinition, *,
                 names: Names | None = None) -> DataFrame:
    """Persons with a dated case whose attributes tell a death, as one row."""
    affected = (case_rows(fact, definition).filter(F.col(PERSON).isNotNull())
                .select(PERSON).distinct())
    return (dead_persons(attributes, names).join(affected, PERSON)
            .agg(F.count("*").alias("total_deaths")))


def _persons_per_district(persons: DataFrame, org: DataFrame, keep: Column) -> DataFrame:
    """Distinct persons per district, from unique rows of person and place."""
    counted = (add_districts(persons, org, keep)
               .groupBy(DISTRICT_KEY).agg(F.count_distinct(PERSON).alias("deaths")))
    return (name_districts(counted, org)
            .orderBy(F.desc("deaths"), "district"))


def _persons_at_places(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(PERSON).isNotNull()).select(PERSON, ORG_KEY).distinct()


def deaths_by_district_text(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                            definition: CaseDefinition, *, k: int = 15,
                            keep: Column | None = None,
                            names: Names | None = None) -> DataFrame:
    """Districts with most dead persons, deaths found by attribute text.

    Districts are the valid ones; ``keep`` changes that.
    """
    persons = _persons_at_places(case_rows(fact, definition))
    dead = persons.join(dead_persons(attributes, names), PERSON)
    return _persons_per_district(dead, org, valid_district() if keep is None else keep).limit(k)


def deaths_by_district(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                       definition: CaseDefinition, codes: AttributeCodes, *,
                       scope: Scope = Scope(), keep: Column | None = None) -> DataFrame:
    """Districts with persons whose coded outcome is death.

    Districts are the valid ones; ``keep`` changes that.
    """
    dead = (person_traits(attributes, outcome=codes.outcome)
            .filter("dead").select(PERSON))
    persons = _persons_at_places(case_rows(fact, definition, scope, dated=False))
    keep = (valid_district() if keep is None else keep) & at_place(scope)
    return _persons_per_district(persons.join(dead, PERSON), org, keep)


def _dead_cases(fact, org, attributes, definition, codes, scope: Scope, unit: str,
                sex: str | None) -> DataFrame:
    """Dead persons with a numeric age and the number of cases each stands for.

    ``unit`` is what counts as a case: each fact row, each event, or the person.
    The counting is done per person before the attributes are joined.
    """
    counts = {"rows": F.count("*"), "events": F.count_distinct("event_id"), "persons": F.lit(1)}
    if unit not in counts:
        raise ValueError(f"unit is one of {sorted(counts)}, not {unit!r}")
    rows = (case_rows(fact, definition, scope, dated=False)
            .filter(F.col(PERSON).isNotNull()).select("event_id", PERSON, ORG_KEY))
    if scope.has_place and unit == "rows":
        per_place = rows.groupBy(PERSON, ORG_KEY).agg(F.count("*").alias("n"))
        cases = (only_places(per_place, org, scope)
                 .groupBy(PERSON).agg(F.sum("n").alias("n")))
    else:
        cases = only_places(rows, org, scope).groupBy(PERSON).agg(counts[unit].alias("n"))
    traits = person_traits(attributes, sex=sex, age=codes.age, outcome=codes.outcome)
    known = F.col("dead") & F.col("age_years").isNotNull()
    if sex:
        known = known & F.col("sex_code").isNotNull()
    return cases.join(traits.filter(known), PERSON)


def deaths_by_age(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                  definition: CaseDefinition, codes: AttributeCodes, *,
                  scope: Scope = Scope(), unit: str = "rows",
                  scheme: AgeScheme = FIVE_BANDS) -> DataFrame:
    """Deaths by age band; bands without deaths are left out."""
    return (_dead_cases(fact, org, attributes, definition, codes, scope, unit, None)
            .groupBy(scheme.index(F.col("age_years")).alias("band"))
            .agg(F.sum("n").alias("deaths"))
            .orderBy("band")
            .select(scheme.label(F.col("band")).alias("age_group"), "deaths"))


def deaths_by_age_sex(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                      definition: CaseDefinition, codes: AttributeCodes, *,
                      scope: Scope = Scope(), unit: str = "rows",
                      scheme: AgeScheme = ELEVEN_BANDS) -> DataFrame:
    """Deaths by age band and sex, among persons with a recorded sex."""
    def of(code: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("sex_code") == code, F.col("n"))), F.lit(0))

    dead = _dead_cases(fact, org, attributes, definition, codes, scope, unit,
                       codes.sex_of_deaths)
    return (dead.groupBy(scheme.index(F.col("age_years")).alias("band"))
            .agg(of(MALE).alias("male_deaths"), of(FEMALE).alias("female_deaths"))
            .orderBy("band")
            .select(scheme.label(F.col("band")).alias("age_group"),
                    "male_deaths", "female_deaths"))


def mortality_summary(deaths: DataFrame) -> DataFrame:
    """One row over deaths by district: total, districts with deaths, the worst one."""
    # The worst district has most deaths; of equals, the first by name.
    worst = F.min(F.struct(-F.col("deaths"), F.col("district")))
    return (deaths.agg(F.coalesce(F.sum("deaths"), F.lit(0)).alias("total_deaths"),
                       worst["district"].alias("top_district"),
                       F.count_if(F.col("deaths") > 0).alias("districts_with_deaths")))
