"""Age and sex of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseframe.functions import ratios
from caseframe.functions.bands import (
    EIGHT_BANDS, ELEVEN_BANDS, FIVE_BANDS, TEN_BANDS, AgeScheme)
from caseframe.functions.text import (
    AGE_WORDS, BIRTH_WORDS, FEMALE, MALE, SEX_NAME_WORDS, UNKNOWN_SEX, age_from_text,
    mentions, one_sex, sex_by_substring, sex_by_word, sex_label, whole_number)
from caseframe.model import AttributeCodes, CaseDefinition, Scope
from caseframe.operators.cases import AsOf, case_rows, report_date
from caseframe.operators.names import Names, attributes_named, elements_named
from caseframe.operators.persons import first_events, join_traits, person_traits
from caseframe.operators.sifting import sift
from caseframe.operators.totals import total_of
from caseframe.schemas import PERSON

TOTAL = "TOTAL"


def _count_sex(code: int, name: str) -> Column:
    """Persons of one sex; rows without a person do not count."""
    return F.count(F.when(F.col("sex_code") == code, F.col(PERSON))).alias(name)


def _with_traits(firsts: DataFrame, attributes: DataFrame, codes: AttributeCodes,
                 with_age: bool = True) -> DataFrame:
    traits = person_traits(attributes, sex=codes.sex, age=codes.age if with_age else None)
    return (join_traits(firsts, traits)
            .withColumn("sex_code", F.coalesce("sex_code", F.lit(UNKNOWN_SEX))))


def gender_distribution(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                        definition: CaseDefinition, codes: AttributeCodes, *,
                        scope: Scope = Scope()) -> DataFrame:
    """Incident cases by sex."""
    firsts = first_events(fact, org, definition, scope)
    return (_with_traits(firsts, attributes, codes, with_age=False)
            .groupBy("sex_code").agg(F.count(PERSON).alias("cases"))
            .orderBy("sex_code")
            .select(sex_label(F.col("sex_code")).alias("gender"), "cases"))


def _by_age(fact, org, attributes, definition, codes, scope: Scope,
            scheme: AgeScheme) -> DataFrame:
    """Incident cases per age-band index, by sex."""
    firsts = first_events(fact, org, definition, scope)
    return (_with_traits(firsts, attributes, codes)
            .groupBy(scheme.index(F.col("age_years")).alias("band"))
            .agg(_count_sex(MALE, "male_cases"), _count_sex(FEMALE, "female_cases"),
                 _count_sex(UNKNOWN_SEX, "unknown_cases")))


def age_sex_distribution(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                         definition: CaseDefinition, codes: AttributeCodes, *,
                         scope: Scope = Scope(),
                         scheme: AgeScheme = ELEVEN_BANDS) -> DataFrame:
    """Incident cases by age band and sex, unknown ages last."""
    return (_by_age(fact, org, attributes, definition, codes, scope, scheme)
            .orderBy("band")
            .select(scheme.label(F.col("band")).alias("age_group"),
                    "male_cases", "female_cases", "unknown_cases"))


def age_sex_percentages(distribution: DataFrame) -> DataFrame:
    """An age-sex distribution with shares of all cases and of each sex, and a total row."""
    sexes = ("male", "female", "unknown")
    cases = {sex: F.sum(f"{sex}_cases").alias(f"{sex}_cases") for sex in sexes}
    summed = (distribution.rollup("age_group")
              .agg(*cases.values(), F.grouping("age_group").alias("is_total"))
              .withColumn("total_cases", sum((F.col(f"{sex}_cases") for sex in sexes[1:]),
                                             F.col("male_cases"))))

    def whole(name: str) -> Column:
        return F.max(F.when(F.col("is_total") == 1, F.col(name))).over(Window.partitionBy())

    def share(name: str) -> Column:
        return ratios.percent_or_zero(F.col(name), whole(name), 1)

    columns = [F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col("age_group"))
               .alias("age_group"),
               F.col("total_cases"), share("total_cases").alias("percentage")]
    for sex in sexes:
        columns += [F.col(f"{sex}_cases"), share(f"{sex}_cases").alias(f"{sex}_percentage")]
    return summed.select(*columns)


def age_sex_rate(fact: DataFrame, org: DataFrame, attributes: DataFrame,
                 definition: CaseDefinition, codes: AttributeCodes, *,
                 scope: Scope = Scope(), population: DataFrame | None = None,
                 scheme: AgeScheme = TEN_BANDS) -> DataFrame:
    """Incident cases per 100,000 by age band and sex.

    Without a population the proxy relates a band to all cases of that sex, which is
    a share and no rate. With one (``age_group``, ``sex``, ``population``), cases are
    related to the people of the band.
    """
    sexes = ("female", "male")
    bands = _by_age(fact, org, attributes, definition, codes, scope, scheme).withColumn(
        "age_group", scheme.label(F.col("band")))
    counts = [F.col(f"{sex}_cases") for sex in sexes]
    if population is None:
        rates = [ratios.rate(count, total_of(count)).alias(f"{sex}_rate_proxy")
                 for sex, count in zip(sexes, counts)]
    else:
        people = population.groupBy("age_group").agg(*(
            F.sum(F.when(F.lower("sex") == sex, F.col("population"))).alias(f"{sex}s")
            for sex in sexes))
        bands = bands.join(people, "age_group", "left")
        rates = [ratios.rate(count, F.col(f"{sex}s")).alias(f"{sex}_rate")
                 for sex, count in zip(sexes, counts)]
    return bands.select("band", "age_group", *counts, *rates).orderBy("band").drop("band")


def age_sex_by_name(fact: DataFrame, attributes: DataFrame, definition: CaseDefinition, *,
                    age_words: tuple[str, ...] = AGE_WORDS,
                    sex_words: tuple[str, ...] = SEX_NAME_WORDS,
                    scheme: AgeScheme = EIGHT_BANDS,
                    names: Names | None = None) -> DataFrame:
    """Persons by age band and sex, with attributes found by their names.

    Each person becomes one row of band flags and a sex in a single aggregation, so
    a person in two bands counts in both; one whose sexes contradict counts in neither sex.
    Ages that are no number are left out.
    """
    name, value = F.col("display_name"), F.col("attribute_value")
    is_age, is_sex = mentions(name, age_words), mentions(name, sex_words)
    flags = [F.max(F.col("band") == number).alias(f"band_{number}")
             for number in range(1, scheme.unknown_index)]
    told = attributes_named(attributes, lambda n: mentions(n, age_words + sex_words), names)
    persons = (told
               .select(F.col("entity_id").alias(PERSON),
                       F.when(is_age, scheme.index(whole_number(value))).alias("band"),
                       F.when(is_sex, sex_by_word(value, short_codes=True)).alias("sex_code"))
               .groupBy(PERSON)
               .agg(*flags, one_sex(F.col("sex_code")).alias("sex_code")))
    affected = (case_rows(fact, definition).filter(F.col(PERSON).isNotNull())
                .select(PERSON).distinct())
    sums = []
    for number in range(1, scheme.unknown_index):
        in_band = F.col(f"band_{number}")
        sums.append(F.struct(
            F.lit(number).alias("band"),
            F.count_if(in_band).alias("persons"),
            F.count_if(in_band & (F.col("sex_code") == MALE)).alias("male_cases"),
            F.count_if(in_band & (F.col("sex_code") == FEMALE)).alias("female_cases")))
    return (persons.join(affected, PERSON)
            .agg(F.array(*sums).alias("bands"))
            .select(F.inline("bands"))
            .filter(F.col("persons") > 0)
            .orderBy("band")
            .select(scheme.label(F.col("band")).alias("age_group"),
                    "male_cases", "female_cases"))


def event_traits(fact: DataFrame, definition: CaseDefinition, age_on: Column,
                 scope: Scope = Scope(), elements: Sequence[str] | None = None,
                 names: Names | None = None) -> DataFrame:
    """Age and sex of each case event, from the event's own data elements.

    Elements are found by name: birth dates before ages, and sex before gender
    before other names that tell a sex. Case rows are read by element, value and period; rows
    with traits only where the name's ids are, given or from the dictionaries, and few of
    those of other events than cases get to the shuffle. Both meet in one aggregation on the
    event. Values are normalised first, so the shuffled rows hold integers; of several values
    the least counts. Events without any birth date or age are left out, those with an
    unreadable one have a null age.
    """
    name, value = F.col("data_element_display_name"), F.col("data_value")
    words_of_traits = AGE_WORDS + BIRTH_WORDS + SEX_NAME_WORDS + ("male",)
    unreadable = F.lit(2**31 - 1)
    age = F.coalesce(age_from_text(value, age_on), unreadable)
    sex = sex_by_substring(value)
    traits = {"by_birth": (BIRTH_WORDS, age), "by_age": (AGE_WORDS, age),
              "by_sex": (("sex",), sex), "by_gender": (("gender",), sex),
              "by_other": (("male",), sex)}
    cases = case_rows(fact, definition, scope, dated=False).select("event_id")
    told = elements_named(fact, lambda n: mentions(n, words_of_traits), names)
    if elements:
        told = told.filter(F.col("data_element_id").isin(list(elements)))
    told = told.filter(value.isNotNull()).select(
        "event_id", *(F.when(mentions(name, words), code).alias(trait)
                      for trait, (words, code) in traits.items()))
    rows = (sift(told, cases, "event_id").withColumn("is_case", F.lit(False))
            .unionByName(cases.withColumn("is_case", F.lit(True)), allowMissingColumns=True))
    return (rows.groupBy("event_id")
            .agg(F.max("is_case").alias("is_case"), F.min("by_birth").alias("by_birth"),
                 F.min("by_age").alias("by_age"),
                 *(one_sex(F.col(t)).alias(t) for t in ("by_sex", "by_gender", "by_other")))
            .select("event_id", "is_case", F.coalesce("by_birth", "by_age").alias("age"),
                    F.coalesce("by_sex", "by_gender", "by_other", F.lit(UNKNOWN_SEX))
                    .alias("sex_code"))
            .filter(F.col("is_case") & F.col("age").isNotNull())
            .select("event_id", F.nullif(F.col("age"), unreadable).alias("age_years"),
                    "sex_code"))


def demographic_breakdown(fact: DataFrame, definition: CaseDefinition, *,
                          scope: Scope = Scope(), as_of: AsOf = None,
                          scheme: AgeScheme = FIVE_BANDS,
                          elements: Sequence[str] | None = None,
                          names: Names | None = None) -> DataFrame:
    """Case events by age band: cases, males, females, and their shares."""
    reference = report_date(fact, definition, as_of)
    counted = (event_traits(fact, definition, reference, scope, elements, names)
               .groupBy(scheme.index(F.col("age_years")).alias("band"))
               .agg(F.count("*").alias("total_cases"),
                    F.count_if(F.col("sex_code") == MALE).alias("males"),
                    F.count_if(F.col("sex_code") == FEMALE).alias("females")))
    shares = {
        "pct_cases": ratios.percent(F.col("total_cases"), total_of("total_cases"), 1),
        "pct_males": ratios.percent_or_zero(F.col("males"), total_of("males"), 1),
        "pct_females": ratios.percent_or_zero(F.col("females"), total_of("females"), 1),
    }
    return (counted.withColumns(shares).orderBy("band")
            .select(scheme.label(F.col("band")).alias("age_group"), "total_cases", "pct_cases",
                    "males", "pct_males", "females", "pct_females"))
