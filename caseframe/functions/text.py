"""Normalisers for the free text held in entity-attribute-value tables.

Sex is carried as a small integer until the result is labelled, so that
aggregations over it stay in fixed-width hash buffers.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions.dates import age_in_years

MALE, FEMALE, UNKNOWN_SEX = 1, 2, 3
SEX_LABELS = ("Male", "Female", "Unknown")

# Words that tell a death, by where the text comes from.
DEATH_ATTRIBUTE_WORDS = ("death", "died", "dead")
DEATH_OUTCOME_WORDS = ("death", "died", "fatal")
OUTCOME_ELEMENT_WORDS = ("outcome", "status", "result")

# How texts that hold a date or a plain number begin.
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
DAY_MONTH_YEAR = "^[0-9]{2}/[0-9]{2}/[0-9]{4}"
DIGITS = "^[0-9]+$"

# Words in element and attribute names that hint at a person's traits.
AGE_WORDS = ("age",)
BIRTH_WORDS = ("birth", "dob")
SEX_NAME_WORDS = ("sex", "gender")
DEMOGRAPHIC_WORDS = ("age", "sex", "gender", "male", "female", "demographic")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, as written."""
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, whatever its case."""
    return contains_any(F.lower(text), words)


def whole_number(text: Column) -> Column:
    """Digits-only text as an integer; anything else, or an overflow, is null."""
    return F.when(text.rlike(DIGITS), text.try_cast("int"))


def sex_by_substring(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(low.contains("female"), FEMALE)
            .when(low.contains("male"), MALE)
            .otherwise(UNKNOWN_SEX))


def sex_by_word(text: Column, short_codes: bool = False) -> Column:
    """Exact words; ``short_codes`` also takes one-letter and numeric codes."""
    low = F.lower(text)
    male = ["male", "m", "1"] if short_codes else ["male"]
    female = ["female", "f", "2"] if short_codes else ["female"]
    return (F.when(low.isin(male), MALE)
            .when(low.isin(female), FEMALE)
            .otherwise(UNKNOWN_SEX))


def one_sex(code: Column) -> Column:
    """Aggregate: the known sex of all values, Unknown if they contradict, NULL without any."""
    known = F.when(code.isin(MALE, FEMALE), code)
    return (F.when(F.min(known) == F.max(known), F.min(known))
            .when(F.count(code) > 0, UNKNOWN_SEX))


def sex_label(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEX_LABELS)), code)


def is_death_attribute(name: Column) -> Column:
    return mentions(name, ("death",))


def is_outcome_element(name: Column) -> Column:
    return contains_any(name, OUTCOME_ELEMENT_WORDS)


def death_attribute(name: Column, value: Column) -> Column:
    """A person attribute about death whose value says so."""
    says_so = mentions(value, DEATH_ATTRIBUTE_WORDS) | (F.lower(value) == "yes")
    return is_death_attribute(name) & says_so


def death_outcome(element_name: Column, value: Column) -> Column:
    """An outcome element of an event whose value tells a death."""
    return is_outcome_element(element_name) & mentions(value, DEATH_OUTCOME_WORDS)


def coded_death(value: Column) -> Column:
    return F.lower(value) == "dead"


def age_from_text(text: Column, reference: Column) -> Column:
    """Age in years from a birth date, a number or a phrase such as "25 years".

    ISO and day/month/year dates give the age on the reference date; a phrase
    with months or weeks is an infant; otherwise the first number counts.
    """
    first_ten = F.substring(text, 1, 10)
    return (
        F.when(text.rlike(ISO_DATE),
               age_in_years(F.try_to_date(first_ten, "yyyy-MM-dd"), reference))
        .when(text.rlike(DAY_MONTH_YEAR),
              age_in_years(F.try_to_date(first_ten, "dd/MM/yyyy"), reference))
        .when(text.rlike(DIGITS), text.try_cast("int"))
        .when(mentions(text, ("month", "week")), F.lit(0))
        .when(text.rlike("[0-9]"), F.regexp_extract(text, "([0-9]+)", 1).try_cast("int"))
    )
