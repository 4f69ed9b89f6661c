"""SQL for DuckDB that answers each report, written on its own over the same tables.

The queries count and join the way the reports are defined, with distinct counts over
case events and one join per attribute, and share nothing with the Spark plans.
"""

from __future__ import annotations

STAR = """
WITH b AS (
  SELECT o_orderkey AS k,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_custkey END AS person,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
         CAST(FLOOR(SQRT(o_orderkey % 625)) AS INT) AS org,
         o_orderpriority, o_orderstatus
  FROM orders),
fact_event AS (
  SELECT k AS event_id, person, day, org, 'DX' AS element, 'Diagnosis' AS element_name,
         o_orderpriority AS value FROM b
  UNION ALL
  SELECT k, person, day, org, 'OUT', 'Case outcome',
         CASE WHEN o_orderstatus = 'F' AND k % 10 = 3 THEN 'Died' ELSE 'Recovered' END FROM b
  UNION ALL
  SELECT k, person, day, org, 'DOB', 'Date of birth',
         CASE k % 5 WHEN 0 THEN CONCAT(1950 + k % 45, '-02-', 10 + k % 19)
                    WHEN 1 THEN CONCAT(10 + k % 19, '/07/', 1950 + k % 45)
                    WHEN 2 THEN CAST(k % 70 AS VARCHAR)
                    WHEN 3 THEN CONCAT(1 + k % 11, ' months')
                    ELSE CONCAT(k % 60, ' years') END FROM b
  UNION ALL
  SELECT k, person, day, org, 'SEX', 'Sex of patient',
         CASE k % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN 'MALE' WHEN 2 THEN 'Female'
                    WHEN 3 THEN 'male' ELSE 'female' END FROM b),
visits AS (
  SELECT l_orderkey AS event_id, l_partkey AS person, CAST(l_shipdate AS DATE) AS day,
         CAST(l_suppkey % 30 AS INT) AS org, l_returnflag AS value FROM lineitem),
entity_attr AS (
  SELECT c_custkey AS entity_id, 'AGE' AS attribute_id, 'Age in years' AS name,
         CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(c_custkey % 71 AS VARCHAR) END AS value
  FROM customer
  UNION ALL
  SELECT c_custkey, 'SEX', 'Sex',
         CASE c_custkey % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'male'
                            WHEN 3 THEN 'FEMALE' ELSE 'other' END FROM customer
  UNION ALL
  SELECT c_custkey, 'OUTCOME', 'Outcome (death)',
         CASE WHEN c_custkey % 11 = 0 THEN 'Dead' ELSE 'Alive' END FROM customer),
dim_org AS (
  SELECT n_nationkey AS org,
         CASE n_nationkey WHEN 24 THEN 'Unknown' WHEN 23 THEN '1 Test District'
                          ELSE CONCAT(n_name, ' District') END AS district,
         r_name AS region, 3 AS leaf_level
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT -1, 'National', NULL, 1),
valid AS (
  SELECT * FROM dim_org
  WHERE district IS NOT NULL AND district NOT IN ('Unknown', '1 Test District')),
shapes AS (
  SELECT CASE WHEN n_nationkey = 22 THEN 'Lake District' ELSE CONCAT(n_name, ' District') END
         AS name
  FROM nation),
population AS (
  SELECT CONCAT('NATION_', c_nationkey, ' District') AS district,
         CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS sex,
         CASE c_custkey % 3 WHEN 0 THEN '0-4' WHEN 1 THEN '5-14' ELSE '50+' END AS age_group,
         COUNT(*) * 1000 AS people
  FROM customer GROUP BY ALL),
urgent AS (
  SELECT DISTINCT event_id, person, day, org FROM fact_event
  WHERE element = 'DX' AND value = '1-URGENT'),
returned AS (SELECT DISTINCT event_id, person, day, org FROM visits WHERE value = 'R'),
outcomes AS (
  SELECT DISTINCT event_id FROM fact_event
  WHERE REGEXP_MATCHES(element_name, 'outcome|status|result')
    AND REGEXP_MATCHES(LOWER(value), 'death|died|fatal'))
"""


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"ROUND(CAST({part} AS DOUBLE) * 100.0 / NULLIF({whole}, 0), {digits})"


def per_100k(cases: str, whole: str) -> str:
    return f"ROUND(CAST({cases} AS DOUBLE) * 100000.0 / NULLIF({whole}, 0), 2)"


def back(days: int, cases: str = "urgent") -> str:
    return f"(SELECT CAST(MAX(day) - INTERVAL '{days} days' AS DATE) FROM {cases})"


# One-row summaries ---------------------------------------------------------------------

def last_24h(cases: str = "urgent") -> str:
    return f"(SELECT COUNT(DISTINCT event_id) FROM {cases} WHERE day >= {back(1, cases)})"


def summary_stats(cases: str, where: str = "TRUE", as_of: str | None = None) -> str:
    last = f"DATE '{as_of}'" if as_of else f"(SELECT MAX(day) FROM {cases})"

    def recent(days: int) -> str:
        return (f"COUNT(DISTINCT CASE WHEN day >= {last} - INTERVAL '{days} days' "
                f"AND day <= {last} THEN event_id END)")

    return f"""{STAR}
SELECT COUNT(DISTINCT event_id) AS total_cases, COUNT(DISTINCT district) AS affected_districts,
       {recent(7)} AS cases_last_7_days, {recent(30)} AS cases_last_30_days
FROM {cases} JOIN dim_org USING (org) WHERE {where} AND (day IS NULL OR day <= {last})"""


# Weeks ---------------------------------------------------------------------------------

def weekly_counts(cases: str, where: str = "TRUE", year: str = "YEAR(day)") -> str:
    return f"""SELECT CAST({year} AS INT) AS year, CAST(WEEK(day) AS INT) AS epi_week,
       COUNT(DISTINCT event_id) AS weekly_cases
  FROM {cases} WHERE day IS NOT NULL AND {where} GROUP BY ALL"""


def change(neighbour: str) -> str:
    return pct(f"(weekly_cases - {neighbour})", neighbour)


def weekly_table(cases: str = "urgent", weeks: int = 10, year: str = "YEAR(day)",
                 shift: str = "LAG") -> str:
    return f"""{STAR}, weeks AS ({weekly_counts(cases, year=year)}),
compared AS (
  SELECT *, {shift}(weekly_cases) OVER (ORDER BY year, epi_week) AS other FROM weeks)
SELECT year, epi_week, weekly_cases,
       (SELECT CAST(SUM(w.weekly_cases) AS BIGINT) FROM weeks w
        WHERE w.year < c.year OR (w.year = c.year AND w.epi_week <= c.epi_week))
         AS cumulative_cases,
       {change("other")} AS pct_change
FROM compared c ORDER BY year DESC, epi_week DESC LIMIT {weeks}"""


def weekly_table_year(where: str, shift: str = "LAG") -> str:
    return f"""{STAR}, weeks AS (
  {weekly_counts("urgent", where)} ORDER BY year DESC, epi_week DESC LIMIT 10),
compared AS (
  SELECT *, {shift}(weekly_cases) OVER (ORDER BY year, epi_week) AS other,
         SUM(weekly_cases) OVER (ORDER BY year, epi_week ROWS UNBOUNDED PRECEDING) AS so_far
  FROM weeks)
SELECT year, epi_week, weekly_cases, CAST(so_far AS BIGINT) AS cumulative_cases,
       {change("other")} AS pct_change FROM compared"""


def weekly_by_distance(cases: str, weeks: int, step: int = 1, where: str = "TRUE") -> str:
    """Weeks by their Mondays; a change needs cases in the week exactly before (or after)."""
    return f"""{STAR}, born AS (
  SELECT DISTINCT event_id, day FROM fact_event WHERE element = 'DOB' AND value = '1975-02-15'),
mondays AS (
  SELECT CAST(DATE_TRUNC('week', day) AS DATE) AS monday, COUNT(DISTINCT event_id) AS n
  FROM {cases} WHERE day IS NOT NULL AND {where} GROUP BY ALL
  {"" if where == "TRUE" else f"ORDER BY monday DESC LIMIT {weeks}"})
SELECT CAST(ISOYEAR(a.monday) AS INT) AS year, CAST(WEEK(a.monday) AS INT) AS epi_week,
       a.n AS weekly_cases,
       (SELECT CAST(SUM(m.n) AS BIGINT) FROM mondays m WHERE m.monday <= a.monday)
         AS cumulative_cases,
       {pct("(a.n - b.n)", "b.n")} AS pct_change
FROM mondays a LEFT JOIN mondays b ON b.monday = a.monday - {7 * step}
ORDER BY a.monday DESC LIMIT {weeks}"""


def weeks_at(where: str) -> str:
    return f"""SELECT CAST(DATE_TRUNC('week', day) AS DATE) AS week_start,
       COUNT(DISTINCT event_id) AS weekly_cases
  FROM urgent JOIN dim_org USING (org) WHERE day IS NOT NULL AND {where} GROUP BY ALL"""


def moving_average(where: str = "TRUE", weeks: int = 20, filled: bool = False) -> str:
    series = "counts"
    fill = ""
    if filled:
        series = "filled"
        fill = """, filled AS (
  SELECT CAST(w AS DATE) AS week_start, COALESCE(weekly_cases, 0) AS weekly_cases
  FROM (SELECT UNNEST(GENERATE_SERIES(MIN(week_start), MAX(week_start), INTERVAL '7 days')) AS w
        FROM counts) LEFT JOIN counts ON week_start = CAST(w AS DATE))"""
    return f"""{STAR}, counts AS ({weeks_at(where)}){fill}
SELECT week_start, weekly_cases,
       ROUND(AVG(weekly_cases) OVER (ORDER BY week_start ROWS 6 PRECEDING), 1) AS moving_avg_7w
FROM {series} ORDER BY week_start DESC LIMIT {weeks}"""


def weekly_by_sex(where: str = "TRUE") -> str:
    return f"""{STAR}, sexed AS (
  SELECT event_id, CAST(DATE_TRUNC('week', day) AS DATE) AS week_start, LOWER(a.value) AS sex
  FROM urgent JOIN dim_org USING (org)
  LEFT JOIN entity_attr a ON a.entity_id = person AND a.attribute_id = 'SEX'
  WHERE day IS NOT NULL AND person IS NOT NULL AND {where})
SELECT week_start, COUNT(DISTINCT CASE WHEN sex = 'male' THEN event_id END) AS male_cases,
       COUNT(DISTINCT CASE WHEN sex = 'female' THEN event_id END) AS female_cases
FROM sexed GROUP BY week_start HAVING male_cases > 0 OR female_cases > 0
ORDER BY week_start DESC LIMIT 20"""


CONFLICTS = """sexes AS (
  SELECT person, CASE WHEN MIN(sex) = MAX(sex) THEN MIN(sex) ELSE 'unknown' END AS sex
  FROM (SELECT o_custkey AS person, CASE WHEN (o_custkey % 2 = 0) <> (o_orderkey % 13 = 0)
               THEN 'male' ELSE 'female' END AS sex FROM orders) GROUP BY person)"""

WEEKLY_CONFLICTS = f"""{STAR}, {CONFLICTS}, sexed AS (
  SELECT event_id, CAST(DATE_TRUNC('week', day) AS DATE) AS week_start, sex
  FROM urgent JOIN dim_org USING (org) JOIN sexes USING (person) WHERE day IS NOT NULL)
SELECT week_start, COUNT(DISTINCT CASE WHEN sex = 'male' THEN event_id END) AS male_cases,
       COUNT(DISTINCT CASE WHEN sex = 'female' THEN event_id END) AS female_cases
FROM sexed GROUP BY week_start HAVING male_cases > 0 OR female_cases > 0
ORDER BY week_start DESC LIMIT 20"""

GENDER_CONFLICTS = f"""{STAR}, {CONFLICTS}, firsts AS (
  SELECT DISTINCT person, org FROM urgent WHERE day IS NOT NULL)
SELECT CASE sex WHEN 'male' THEN 'Male' WHEN 'female' THEN 'Female' ELSE 'Unknown' END AS gender,
       COUNT(person) AS cases
FROM firsts LEFT JOIN sexes USING (person) GROUP BY 1"""


def epicurves(ranked_where: str, where: str) -> str:
    return f"""{STAR}, {ranking("urgent", ranked_where)}
SELECT district, CAST(DATE_TRUNC('week', day) AS DATE) AS week_start,
       CAST(WEEK(day) AS INT) AS epi_week, COUNT(DISTINCT event_id) AS weekly_cases
FROM urgent JOIN valid USING (org)
WHERE {where} AND district IN (SELECT district FROM ranked LIMIT 12) GROUP BY ALL"""


def weekly_share(where: str) -> str:
    return f"""{STAR}, weekly AS (
  SELECT CAST(DATE_TRUNC('week', day) AS DATE) AS week_start, district,
         COUNT(DISTINCT event_id) AS cases
  FROM urgent JOIN valid USING (org) WHERE {where} GROUP BY ALL),
totals AS (SELECT week_start, SUM(cases) AS total FROM weekly GROUP BY week_start),
top AS (SELECT district FROM weekly GROUP BY district
        ORDER BY SUM(cases) DESC, district LIMIT 5)
SELECT week_start, district, {pct("cases", "total", 2)} AS proportion
FROM weekly JOIN totals USING (week_start) WHERE district IN (SELECT district FROM top)"""


# Districts -----------------------------------------------------------------------------

def ranking(cases: str, where: str = "TRUE") -> str:
    in_last = "DATE_TRUNC('week', day) = monday"
    before = "DATE_TRUNC('week', day) = monday - INTERVAL '7 days'"

    def events(when: str) -> str:
        return f"COUNT(DISTINCT CASE WHEN {when} THEN event_id END)"

    return f"""latest AS (
  SELECT DATE_TRUNC('week', MAX(day)) AS monday FROM {cases} WHERE {where}),
ranked AS (
  SELECT district, COUNT(DISTINCT event_id) AS total_cases,
         {events("o.event_id IS NOT NULL")} AS total_deaths,
         {events(in_last)} AS cases_last_epiweek,
         {events(f"{in_last} AND o.event_id IS NOT NULL")} AS deaths_last_epiweek,
         {events(before)} AS cases_previous
  FROM {cases} CROSS JOIN latest JOIN valid USING (org)
  LEFT JOIN outcomes o USING (event_id)
  WHERE day IS NOT NULL AND {where}
  GROUP BY district
  ORDER BY total_cases DESC, cases_last_epiweek DESC, district)"""


RANKED_COLUMNS = f"""district, total_cases, total_deaths, cases_last_epiweek, deaths_last_epiweek,
       {pct("(cases_last_epiweek - cases_previous)", "cases_previous")} AS pct_change"""


def top_districts(cases: str = "urgent", where: str = "TRUE") -> str:
    return f"{STAR}, {ranking(cases, where)} SELECT {RANKED_COLUMNS} FROM ranked LIMIT 12"


def total_share(where: str = "TRUE") -> str:
    return f"""{STAR}, counts AS (
  SELECT district, COUNT(DISTINCT event_id) AS cases
  FROM urgent JOIN valid USING (org) WHERE day IS NOT NULL AND {where} GROUP BY district)
SELECT district, cases, {pct("cases", "(SELECT SUM(cases) FROM counts)", 2)} AS proportion
FROM counts ORDER BY cases DESC, district LIMIT 5"""


def reporting(place: str = "TRUE", period: str = "TRUE") -> str:
    total = f"(SELECT COUNT(DISTINCT district) FROM valid WHERE {place})"
    reached = f"""(SELECT COUNT(DISTINCT district) FROM urgent JOIN valid USING (org)
   WHERE day IS NOT NULL AND {place} AND {period})"""
    return f"""{STAR}, counts AS (SELECT {total} AS total, {reached} AS reached)
SELECT total AS total_districts, reached AS districts_with_cases,
       total - reached AS districts_without_cases, {pct("reached", "total")} AS pct_with_cases,
       {pct("(total - reached)", "total")} AS pct_without_cases FROM counts"""


def unique_by_district(where: str) -> str:
    return f"""{STAR}
SELECT district, COUNT(DISTINCT event_id) AS events, COUNT(DISTINCT person) AS persons
FROM returned JOIN valid USING (org) WHERE day IS NOT NULL AND {where} GROUP BY district"""


def line_summary(cases: str, last: str) -> str:
    return f"""{STAR}
SELECT district, COUNT(DISTINCT event_id) AS total_cases,
       COUNT(DISTINCT CASE WHEN day BETWEEN {last} - INTERVAL '30 days' AND {last}
                           THEN event_id END) AS cases_last_30_days,
       MIN(day) AS first_case, MAX(day) AS latest_case
FROM {cases} JOIN valid USING (org) WHERE day <= {last} GROUP BY district"""


# Age, sex and deaths -------------------------------------------------------------------

def bands(age: str, bounds: list[tuple[str, int]], unknown: str = "'Unknown'") -> str:
    """CASE over whole-number ages; ``bounds`` are label and first age, in order."""
    cases = " ".join(f"WHEN {age} >= {start} THEN '{label}'" for label, start in bounds[::-1])
    return f"CASE WHEN {age} IS NULL THEN {unknown} {cases} ELSE {unknown} END"


EIGHT = [("0-4", 0), ("5-9", 5), ("10-14", 10), ("15-19", 15), ("20-29", 20), ("30-39", 30),
         ("40-49", 40), ("50+", 50)]
ELEVEN = [("0-4", 0), ("5-9", 5), ("10-14", 10), ("15-19", 15), ("20-24", 20), ("25-29", 25),
          ("30-34", 30), ("35-39", 35), ("40-44", 40), ("45-49", 45), ("50+", 50)]
TEN = [("0-4", 0), ("5-14", 5), *ELEVEN[3:]]
FIVE = [("<1 year", 0), ("1-4 years", 1), ("5-14 years", 5), ("15-44 years", 15),
        ("45+ years", 45)]

WHOLE = "CASE WHEN REGEXP_MATCHES({v}, '^[0-9]+$') THEN TRY_CAST({v} AS INT) END"
SEX = """CASE WHEN {v} ILIKE '%female%' THEN 'Female' WHEN {v} ILIKE '%male%' THEN 'Male'
              ELSE 'Unknown' END"""


def first_events(scheme: list[tuple[str, int]], where: str = "TRUE") -> str:
    return f"""firsts AS (
  SELECT person, org, MIN(day) AS day FROM urgent WHERE day IS NOT NULL GROUP BY person, org),
grouped AS (
  SELECT person, {bands(WHOLE.format(v="a.value"), scheme)} AS age_group,
         {SEX.format(v="s.value")} AS sex
  FROM firsts LEFT JOIN dim_org USING (org)
  LEFT JOIN entity_attr a ON a.entity_id = person AND a.attribute_id = 'AGE'
  LEFT JOIN entity_attr s ON s.entity_id = person AND s.attribute_id = 'SEX'
  WHERE {where})"""


def gender(where: str = "TRUE") -> str:
    return f"""{STAR}, {first_events(ELEVEN, where)}
SELECT sex AS gender, COUNT(person) AS cases FROM grouped GROUP BY sex"""


def counted_sexes(*sexes: str) -> str:
    return ", ".join(f"COUNT(CASE WHEN sex = '{sex.capitalize()}' THEN person END) AS {sex}_cases"
                     for sex in sexes)


AGE_SEX = f"SELECT age_group, {counted_sexes('male', 'female', 'unknown')} FROM grouped GROUP BY ALL"


def age_sex(where: str = "TRUE") -> str:
    return f"{STAR}, {first_events(ELEVEN, where)} {AGE_SEX}"


def share_of_sum(name: str) -> str:
    return f"COALESCE({pct(name, f'(SELECT SUM({name}) FROM wide)')}, 0.0)"


AGE_SEX_PERCENTAGES = f"""{STAR}, {first_events(ELEVEN)}, counts AS ({AGE_SEX}),
wide AS (SELECT *, male_cases + female_cases + unknown_cases AS total_cases FROM counts),
summed AS (
  SELECT * FROM wide
  UNION ALL SELECT 'TOTAL', SUM(male_cases), SUM(female_cases), SUM(unknown_cases),
                   SUM(total_cases) FROM wide)
SELECT age_group, CAST(total_cases AS BIGINT) AS total_cases,
       {share_of_sum("total_cases")} AS percentage,
       CAST(male_cases AS BIGINT) AS male_cases,
       {share_of_sum("male_cases")} AS male_percentage,
       CAST(female_cases AS BIGINT) AS female_cases,
       {share_of_sum("female_cases")} AS female_percentage,
       CAST(unknown_cases AS BIGINT) AS unknown_cases,
       {share_of_sum("unknown_cases")} AS unknown_percentage
FROM summed"""

RATE_COUNTS = f"""counts AS (
  SELECT age_group, {counted_sexes('female', 'male')} FROM grouped GROUP BY age_group)"""

AGE_SEX_RATE = f"""{STAR}, {first_events(TEN)}, {RATE_COUNTS}
SELECT age_group, female_cases, male_cases,
       {per_100k("female_cases", "(SELECT SUM(female_cases) FROM counts)")} AS female_rate_proxy,
       {per_100k("male_cases", "(SELECT SUM(male_cases) FROM counts)")} AS male_rate_proxy
FROM counts"""

def people_aged(sex: str) -> str:
    return f"""(SELECT SUM(people) FROM population p
   WHERE p.age_group = counts.age_group AND sex = '{sex}')"""


AGE_SEX_RATE_POPULATION = f"""{STAR}, {first_events(TEN, "YEAR(day) = 1999")}, {RATE_COUNTS}
SELECT age_group, female_cases, male_cases,
       {per_100k("female_cases", people_aged("Female"))} AS female_rate,
       {per_100k("male_cases", people_aged("Male"))} AS male_rate
FROM counts"""

AGE_SEX_BY_NAME = f"""{STAR}, persons AS (SELECT DISTINCT person FROM urgent WHERE day IS NOT NULL),
ages AS (
  SELECT entity_id, {bands(WHOLE.format(v="value"), EIGHT)} AS age_group
  FROM entity_attr JOIN persons ON person = entity_id WHERE LOWER(name) LIKE '%age%'),
sexes AS (
  SELECT entity_id, CASE WHEN LOWER(value) IN ('male', 'm', '1') THEN 'Male'
                         WHEN LOWER(value) IN ('female', 'f', '2') THEN 'Female' END AS sex
  FROM entity_attr JOIN persons ON person = entity_id
  WHERE REGEXP_MATCHES(LOWER(name), 'sex|gender'))
SELECT age_group, COUNT(DISTINCT CASE WHEN sex = 'Male' THEN entity_id END) AS male_cases,
       COUNT(DISTINCT CASE WHEN sex = 'Female' THEN entity_id END) AS female_cases
FROM ages LEFT JOIN sexes USING (entity_id) WHERE age_group != 'Unknown' GROUP BY age_group"""


def demographics(where: str, as_of: str) -> str:
    iso = "TRY_CAST(SUBSTR(birth, 1, 10) AS DATE)"
    slashed = "CAST(TRY_STRPTIME(SUBSTR(birth, 1, 10), '%d/%m/%Y') AS DATE)"
    return f"""{STAR}, events AS (SELECT DISTINCT event_id FROM urgent WHERE {where}),
told AS (
  SELECT e.event_id, COALESCE(d.value, a.value) AS birth,
         COALESCE(s.value, 'Unknown') AS sex_text
  FROM events e
  LEFT JOIN fact_event d ON d.event_id = e.event_id AND d.element_name ILIKE '%birth%'
  LEFT JOIN fact_event a ON a.event_id = e.event_id AND a.element_name ILIKE '%age%'
  LEFT JOIN fact_event s ON s.event_id = e.event_id AND s.element_name ILIKE '%sex%'),
aged AS (
  SELECT event_id, {SEX.format(v="sex_text")} AS sex,
         CASE WHEN REGEXP_MATCHES(birth, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')
                THEN EXTRACT(YEAR FROM AGE({as_of}, {iso}))
              WHEN REGEXP_MATCHES(birth, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')
                THEN EXTRACT(YEAR FROM AGE({as_of}, {slashed}))
              WHEN REGEXP_MATCHES(birth, '^[0-9]+$') THEN TRY_CAST(birth AS INT)
              WHEN LOWER(birth) LIKE '%month%' OR LOWER(birth) LIKE '%week%' THEN 0
              WHEN REGEXP_MATCHES(birth, '[0-9]')
                THEN TRY_CAST(REGEXP_EXTRACT(birth, '[0-9]+') AS INT) END AS age
  FROM told WHERE birth IS NOT NULL),
grouped AS (
  SELECT *, CASE WHEN age < 0 THEN '<1 year' ELSE {bands("age", FIVE)} END AS age_group FROM aged),
counts AS (
  SELECT age_group, COUNT(DISTINCT event_id) AS total_cases,
         COUNT(DISTINCT CASE WHEN sex = 'Male' THEN event_id END) AS males,
         COUNT(DISTINCT CASE WHEN sex = 'Female' THEN event_id END) AS females
  FROM grouped GROUP BY age_group)
SELECT age_group, total_cases, {pct("total_cases", "(SELECT SUM(total_cases) FROM counts)")}
         AS pct_cases,
       males, COALESCE({pct("males", "(SELECT SUM(males) FROM counts)")}, 0) AS pct_males,
       females, COALESCE({pct("females", "(SELECT SUM(females) FROM counts)")}, 0) AS pct_females
FROM counts"""


DEAD_TEXT = """SELECT DISTINCT entity_id FROM entity_attr
  WHERE name ILIKE '%death%' AND REGEXP_MATCHES(LOWER(value), 'death|died|dead|^yes$')"""
DEATH_COUNT = f"""(SELECT COUNT(DISTINCT entity_id) FROM ({DEAD_TEXT})
   JOIN urgent ON person = entity_id WHERE day IS NOT NULL)"""


DEATHS_BY_DISTRICT = """
SELECT district, COUNT(DISTINCT person) AS deaths
FROM urgent JOIN dim_org USING (org)
JOIN entity_attr o ON o.entity_id = person AND o.attribute_id = 'OUTCOME'
WHERE LOWER(o.value) = 'dead' AND district IS NOT NULL AND {where} GROUP BY district"""


def deaths_by_district(where: str = "TRUE") -> str:
    return f"{STAR} {DEATHS_BY_DISTRICT.format(where=where)}"


def dead_rows(rows: str, where: str) -> str:
    return f"""SELECT event_id, person, a.value AS age_text, {SEX.format(v="s.value")} AS sex
  FROM {rows} LEFT JOIN dim_org USING (org)
  JOIN entity_attr a ON a.entity_id = person AND a.attribute_id = 'AGE'
  JOIN entity_attr s ON s.entity_id = person AND s.attribute_id = 'SEX'
  JOIN entity_attr o ON o.entity_id = person AND o.attribute_id = 'OUTCOME'
  WHERE LOWER(o.value) = 'dead' AND REGEXP_MATCHES(a.value, '^[0-9]+$') AND {where}"""


URGENT_ROWS = "(SELECT * FROM fact_event WHERE element = 'DX' AND value = '1-URGENT') f"


def deaths_by_age(counted: str = "COUNT(person)", where: str = "TRUE") -> str:
    return f"""{STAR}, dead AS ({dead_rows(URGENT_ROWS, where)})
SELECT {bands("CAST(age_text AS INT)", FIVE)} AS age_group, {counted} AS deaths
FROM dead GROUP BY 1"""


def deaths_by_age_sex(rows: str) -> str:
    def of(when: str) -> str:
        return f"COUNT(CASE WHEN {when} THEN event_id END)"

    return f"""{STAR}, dead AS ({dead_rows(rows, "TRUE")})
SELECT {bands("CAST(age_text AS INT)", ELEVEN)} AS age_group,
       {of("sex = 'Male'")} AS male_deaths, {of("sex = 'Female'")} AS female_deaths
FROM dead GROUP BY 1"""


# Maps ----------------------------------------------------------------------------------

def per_district(name: str, where: str = "TRUE", cases: str = "urgent") -> str:
    return f"""SELECT district, COUNT(DISTINCT event_id) AS {name}
  FROM {cases} JOIN valid USING (org) WHERE day IS NOT NULL AND {where} GROUP BY district"""


def people_of(district: str) -> str:
    return f"(SELECT SUM(people) FROM population p WHERE p.district = {district})"


def layer(values: str, value: str, floor: int) -> str:
    return f"""layer AS (
  SELECT name, COALESCE({value}, 0) AS value
  FROM shapes LEFT JOIN ({values}) v ON v.district = shapes.name),
scaled AS (SELECT *, GREATEST({floor}, MAX(value) OVER ()) AS scale_max FROM layer)"""


def binned(values: str, value: str, floor: int, classes: list[tuple[str, int]]) -> str:
    def ladder(results: list[str], none: str) -> str:
        steps = " ".join(f"WHEN value >= {start} THEN {result}"
                         for (_, start), result in list(zip(classes, results))[::-1])
        return f"CASE WHEN COALESCE(value, 0) <= 0 THEN {none} {steps} ELSE {results[0]} END"

    numbers = [str(n) for n in range(1, len(classes) + 1)]
    labels = [f"'{label}'" for label, _ in classes]
    return f"""{STAR}, {layer(values, value, floor)}
SELECT name, value, scale_max, {ladder(numbers, '0')} AS class_index,
       {ladder(labels, "'0'")} AS class_label FROM scaled"""


RATED = per_100k("n", people_of("counted.district"))
ATTACK_BY_PEOPLE = f"""SELECT district, {RATED} AS rate
  FROM ({per_district("n")}) counted"""
CURRENT_BY_PEOPLE = f"""SELECT district, {RATED} AS rate
  FROM ({per_district("n", f"day >= {back(365)}")}) counted"""

SAMPLE = """sampled AS (
  SELECT f.* FROM fact_event f
  WHERE event_id IN (SELECT DISTINCT event_id FROM urgent ORDER BY event_id LIMIT {n}))"""

EVERY_CASE = "fact_event WHERE event_id IN (SELECT event_id FROM urgent)"

ROLLUP = f"""{STAR}
SELECT day AS event_date, org AS dim_org_hierarchy_key,
       {bands(WHOLE.format(v="a.value"), ELEVEN)} AS age_group,
       {SEX.format(v="s.value")} AS sex, o.event_id IS NOT NULL AS died,
       COUNT(DISTINCT urgent.event_id) AS cases
FROM urgent LEFT JOIN outcomes o ON o.event_id = urgent.event_id
LEFT JOIN entity_attr a ON a.entity_id = person AND a.attribute_id = 'AGE'
LEFT JOIN entity_attr s ON s.entity_id = person AND s.attribute_id = 'SEX'
WHERE day IS NOT NULL GROUP BY ALL"""

MARCH = "day BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'"
SPRING = "day BETWEEN DATE '1999-03-01' AND DATE '1999-06-15'"
ASIA = "region ILIKE '%asia%' AND YEAR(day) = 1997"
ASIA_1998 = "region ILIKE '%asia%' AND YEAR(day) = 1998"
NATION_5 = "district ILIKE '%nation_5%'"
LAST_YEAR = "day >= (SELECT CAST(MAX(day) - INTERVAL '12 months' AS DATE) FROM urgent)"

def executive_summary(as_of: str | None = None) -> str:
    """Figures from the urgent cases up to a day; every later row is out before anything else."""
    star, last = STAR, last_24h()
    if as_of is not None:
        star = STAR.replace("FROM orders)", f"""FROM orders
  WHERE o_orderkey % 101 = 0 OR CAST(o_orderdate AS DATE) <= DATE '{as_of}')""", 1)
        last = f"(SELECT COUNT(DISTINCT event_id) FROM urgent WHERE day >= DATE '{as_of}' - 1)"
    return f"""{star}, mondays AS (
  SELECT DATE_TRUNC('week', day) AS monday, COUNT(DISTINCT event_id) AS n
  FROM urgent WHERE day IS NOT NULL GROUP BY 1),
trend AS (
  SELECT CASE WHEN a.n > b.n THEN 'Increasing' WHEN a.n < b.n THEN 'Decreasing'
              ELSE 'Stable' END AS trend
  FROM mondays a LEFT JOIN mondays b ON b.monday = a.monday - INTERVAL 7 DAY
  WHERE a.monday = (SELECT MAX(monday) FROM mondays)),
{ranking("urgent")},
counts AS (SELECT (SELECT CAST(SUM(n) AS BIGINT) FROM mondays) AS total_cases,
                  {DEATH_COUNT} AS deaths)
SELECT total_cases, {last} AS cases_last_24h, deaths,
       {pct("deaths", "total_cases", 2)} AS cfr_pct,
       (SELECT COUNT(DISTINCT district) FROM ranked) AS affected_districts,
       (SELECT district FROM ranked LIMIT 1) AS top_district,
       (SELECT total_cases FROM ranked LIMIT 1) AS top_district_cases,
       (SELECT trend FROM trend) AS trend FROM counts"""


ORACLES: dict[str, str] = {
    "cases_last_24h": f"{STAR} SELECT {last_24h()} AS cases_24h",
    "summary_stats": summary_stats("urgent"),
    "summary_stats_between": summary_stats("urgent", SPRING, "1999-05-31"),
    "summary_stats_visits": summary_stats("returned"),
    "executive_summary": executive_summary(),
    "executive_summary_as_of": executive_summary("1998-06-30"),
    "weekly_table": weekly_table(),
    "weekly_table_next": weekly_table(shift="LEAD"),
    "weekly_table_iso_year": weekly_table(weeks=400, year="ISOYEAR(day)"),
    "weekly_table_visits": weekly_table("returned", 60),
    "weekly_table_year": weekly_table_year("YEAR(day) = 1997"),
    "weekly_table_last_year": weekly_table_year(
        "YEAR(day) = (SELECT YEAR(MAX(day)) FROM urgent)"),
    "weekly_table_year_bounds": weekly_table_year(f"YEAR(day) = 1999 AND {SPRING}", "LEAD"),
    "weekly_table_weeks": weekly_by_distance("urgent", 400),
    "weekly_table_gaps": weekly_by_distance("born", 400),
    "weekly_table_gaps_next": weekly_by_distance("born", 400, -1),
    "weekly_table_year_weeks": weekly_by_distance("urgent", 10, where="YEAR(day) = 1997"),
    "weekly_table_last_year_weeks": weekly_by_distance(
        "urgent", 60, where="YEAR(day) = (SELECT YEAR(MAX(day)) FROM urgent)"),
    "weekly_moving_average": moving_average(),
    "weekly_moving_average_region": moving_average(ASIA),
    "weekly_moving_average_filled": moving_average(NATION_5, 100, True),
    "weekly_by_sex": weekly_by_sex(),
    "weekly_by_sex_region": weekly_by_sex(ASIA),
    "weekly_by_sex_conflicts": WEEKLY_CONFLICTS,
    "district_epicurves": epicurves("TRUE", LAST_YEAR),
    "district_epicurves_year": epicurves("YEAR(day) = 1998", "YEAR(day) = 1998"),
    "district_weekly_share": weekly_share(LAST_YEAR),
    "district_weekly_share_month": weekly_share(MARCH),
    "top_districts": top_districts(),
    "top_districts_year": top_districts(where="YEAR(day) = 1998"),
    "top_districts_visits": top_districts("returned"),
    "top_districts_totals": f"""{STAR}, {ranking("urgent")},
top AS (SELECT {RANKED_COLUMNS} FROM ranked LIMIT 12)
SELECT * FROM top
UNION ALL
SELECT 'TOTAL', CAST(SUM(total_cases) AS BIGINT), CAST(SUM(total_deaths) AS BIGINT),
       CAST(SUM(cases_last_epiweek) AS BIGINT), CAST(SUM(deaths_last_epiweek) AS BIGINT), NULL
FROM top""",
    "district_total_share": total_share(),
    "district_total_share_month": total_share(MARCH),
    "district_reporting": reporting(),
    "district_reporting_region": reporting("region ILIKE '%asia%'", MARCH),
    "district_reporting_21d": reporting(period=f"day >= {back(21)}"),
    "district_reporting_24h": reporting(period=f"day >= {back(1)}"),
    "district_reporting_request": reporting("region ILIKE '%asia%'", MARCH),
    "district_line_summary": line_summary("urgent", "(SELECT MAX(day) FROM urgent)"),
    "district_line_summary_visits": line_summary("returned", "DATE '2000-06-30'"),
    "location_options": f"""{STAR}, listed AS (
  SELECT 1 AS rank, 'national' AS level, 0 AS cases, 'National' AS location
  UNION ALL
  SELECT DISTINCT 2, 'region', 0, CONCAT(region, ' Region') FROM dim_org
  WHERE region IS NOT NULL AND region != 'unknown'
  UNION ALL
  SELECT * FROM (
    SELECT 3, 'district', COUNT(DISTINCT event_id) AS n, district
    FROM urgent JOIN dim_org USING (org) WHERE district IS NOT NULL
    GROUP BY district ORDER BY n DESC, district LIMIT 15))
SELECT CAST(ROW_NUMBER() OVER (ORDER BY rank, cases DESC, location) AS INT) AS position,
       level, location FROM listed""",
    "time_period_options": f"""{STAR}
SELECT CAST(YEAR(day) AS INT) AS year, CAST(MONTH(day) AS INT) AS month,
       MONTHNAME(day) AS month_name, COUNT(DISTINCT event_id) AS cases,
       CONCAT(MONTHNAME(day), ' ', YEAR(day)) AS display
FROM urgent WHERE day IS NOT NULL GROUP BY ALL""",
    "time_period_options_nested": f"""{STAR}
SELECT CAST(year AS INT) AS year,
       STRING_AGG(CONCAT(name, ' ', year), ', ' ORDER BY month DESC) AS months
FROM (SELECT DISTINCT YEAR(day) AS year, MONTH(day) AS month, MONTHNAME(day) AS name
      FROM urgent WHERE day IS NOT NULL) GROUP BY year""",
    "hierarchical_locations": f"""{STAR}, listed AS (
  SELECT 1 AS rank, 'National Level' AS location
  UNION ALL SELECT DISTINCT 2, district FROM valid WHERE leaf_level = 3)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY rank, location) AS INT) AS position, location
FROM listed""",
    "age_sex_by_name": AGE_SEX_BY_NAME,
    "demographic_breakdown": demographics("TRUE", "(SELECT MAX(day) FROM urgent)"),
    "demographic_breakdown_between": demographics(SPRING, "DATE '2000-02-29'"),
    "gender_distribution": gender(),
    "gender_distribution_region": gender(ASIA),
    "gender_distribution_conflicts": GENDER_CONFLICTS,
    "age_sex_distribution": age_sex(),
    "age_sex_distribution_district": age_sex(NATION_5),
    "age_sex_percentages": AGE_SEX_PERCENTAGES,
    "age_sex_rate": AGE_SEX_RATE,
    "age_sex_rate_population": AGE_SEX_RATE_POPULATION,
    "total_deaths": f"{STAR} SELECT {DEATH_COUNT} AS total_deaths",
    "deaths_by_district_text": f"""{STAR}
SELECT district, COUNT(DISTINCT entity_id) AS deaths
FROM urgent JOIN ({DEAD_TEXT}) ON entity_id = person JOIN dim_org USING (org)
WHERE day IS NOT NULL AND district IS NOT NULL
GROUP BY district ORDER BY deaths DESC, district LIMIT 15""",
    "deaths_by_district": deaths_by_district(),
    "deaths_by_district_region": deaths_by_district(ASIA_1998),
    "deaths_by_age": deaths_by_age(),
    "deaths_by_age_region": deaths_by_age(where=ASIA_1998),
    "deaths_by_age_persons": deaths_by_age("COUNT(DISTINCT person)"),
    "deaths_by_age_sex": deaths_by_age_sex(URGENT_ROWS),
    "deaths_by_age_sex_visits": deaths_by_age_sex(
        "(SELECT DISTINCT event_id, person, NULL::INT AS org FROM returned) r"),
    "mortality_summary": f"""{STAR}, deaths AS ({DEATHS_BY_DISTRICT.format(where="TRUE")})
SELECT CAST(SUM(deaths) AS BIGINT) AS total_deaths,
       (SELECT district FROM deaths ORDER BY deaths DESC, district LIMIT 1) AS top_district,
       COUNT(*) AS districts_with_deaths FROM deaths""",
    "map_cumulative_cases": f"{STAR} {per_district('total_cases')}",
    "map_cumulative_cases_visits": f"{STAR} {per_district('total_cases', cases='returned')}",
    "map_cases_21d": f"{STAR} {per_district('cases_last_21_days', f'day >= {back(21)}')}",
    "map_cases_21d_as_of": f"""{STAR} {per_district("cases_last_21_days",
        "day BETWEEN DATE '1998-06-30' - INTERVAL '21 days' AND DATE '1998-06-30'")}""",
    "map_attack_rate": f"""{STAR}, counted AS ({per_district("total_cases")})
SELECT *, {per_100k("total_cases", "GREATEST(total_cases, 1000)")} AS attack_rate_proxy_per_100k
FROM counted""",
    "map_attack_rate_population": f"""{STAR}, counted AS ({per_district("total_cases")})
SELECT *, {per_100k("total_cases", people_of("counted.district"))} AS attack_rate_per_100k
FROM counted""",
    "map_case_rate_21d": f"""{STAR}, counted AS (
  {per_district("current_cases", f"day >= {back(21)}")})
SELECT *, {per_100k("current_cases", "GREATEST(current_cases, 500)")}
         AS current_rate_proxy_per_100k FROM counted""",
    "map_layer": f"""{STAR}, {layer(per_district("n"), "n", 500)}
SELECT name, value, scale_max FROM scaled""",
    "map_bins": binned(per_district("n"), "n", 500, [
        ("1-9", 1), ("10-49", 10), ("50-99", 50), ("100-499", 100), ("500+", 500)]),
    "map_bins_21d": binned(per_district("n", f"day >= {back(21)}"), "n", 50, [
        ("1-9", 1), ("10-49", 10), ("50+", 50)]),
    "map_bins_attack_rate": binned(ATTACK_BY_PEOPLE, "rate", 25, [
        ("0.1-4.9", 0), ("5-10.9", 5), ("11-15.9", 11), ("16-20.9", 16), ("21+", 21)]),
    "map_bins_case_rate": binned(CURRENT_BY_PEOPLE, "rate", 11, [
        ("0.1-4.9", 0), ("5-10.9", 5), ("11+", 11)]),
    "profile_demographic_elements": f"""{STAR}
SELECT element_name AS data_element_display_name, COUNT(DISTINCT event_id) AS event_count,
       COUNT(DISTINCT value) AS unique_values
FROM {EVERY_CASE}
  AND REGEXP_MATCHES(LOWER(element_name), 'age|sex|gender|male|demographic') GROUP BY 1""",
    "profile_demographic_values": f"""{STAR}
SELECT element_name AS data_element_display_name, value AS data_value,
       COUNT(DISTINCT event_id) AS event_count
FROM {EVERY_CASE}
  AND REGEXP_MATCHES(LOWER(element_name), 'age|sex|gender|male|demographic') GROUP BY 1, 2""",
    "profile_demographic_sample": f"""{STAR}, {SAMPLE.format(n=100)}
SELECT element_name AS data_element_display_name, COUNT(DISTINCT event_id) AS event_count,
       COUNT(DISTINCT value) AS unique_values,
       STRING_AGG(DISTINCT value, ' | ' ORDER BY value) AS sample_values
FROM sampled
WHERE REGEXP_MATCHES(LOWER(element_name), 'age|sex|gender|male|demographic') GROUP BY 1""",
    "profile_all_elements": f"""{STAR}
SELECT element_name AS data_element_display_name, COUNT(DISTINCT event_id) AS event_count
FROM {EVERY_CASE} GROUP BY 1 ORDER BY event_count DESC, 1 LIMIT 20""",
    "profile_all_sample": f"""{STAR}, {SAMPLE.format(n=50)}
SELECT element_name AS data_element_display_name, COUNT(DISTINCT event_id) AS event_count
FROM sampled GROUP BY 1 ORDER BY event_count DESC, 1 LIMIT 20""",
    "dq_multi_date_events": f"""{STAR}
SELECT event_id, COUNT(DISTINCT day) AS dates, COUNT(DISTINCT org) AS places,
       COUNT(DISTINCT person) AS persons
FROM returned GROUP BY event_id HAVING dates > 1 OR places > 1 OR persons > 1""",
    "dq_duplicate_attributes": f"""{STAR}, every AS (
  SELECT entity_id, attribute_id, value FROM entity_attr
  UNION ALL SELECT o_custkey, 'STATUS', o_orderstatus FROM orders)
SELECT entity_id, attribute_id, COUNT(*) AS rows, COUNT(DISTINCT value) AS distinct_values
FROM every GROUP BY ALL HAVING COUNT(*) > 1""",
    "dq_orphan_keys": f"""{STAR}
SELECT org AS dim_org_hierarchy_key, COUNT(*) AS rows, COUNT(DISTINCT event_id) AS events
FROM visits WHERE value = 'R' AND org NOT IN (SELECT org FROM dim_org) GROUP BY org""",
    "dq_unmatched_geo": f"""{STAR}
SELECT name, 'map' AS only_in FROM shapes WHERE name NOT IN (SELECT district FROM dim_org)
UNION ALL
SELECT DISTINCT district, 'hierarchy' FROM dim_org
WHERE district NOT IN (SELECT name FROM shapes)""",
    "daily_rollup": ROLLUP,
    "weekly_table_from_rollup": weekly_table(),
    "map_cumulative_from_rollup": f"{STAR} {per_district('total_cases')}",
    "top_districts_from_rollup": top_districts(),
    "weekly_table_visits_from_rollup": weekly_table("returned", 60),
    "map_cumulative_visits_from_rollup": f"{STAR} {per_district('total_cases', cases='returned')}",
    "top_districts_visits_from_rollup": top_districts("returned"),
    "unique_by_district": unique_by_district("TRUE"),
    "unique_by_district_month": unique_by_district(MARCH),
    "live_epi_curve": """
SELECT CAST(DATE_TRUNC('week', ts) AS DATE) AS week_start,
       COUNT(DISTINCT event_id) AS weekly_cases
FROM events WHERE event_type = 'error' GROUP BY 1""",
    "live_rolling_24h": """
WITH hours AS (SELECT UNNEST(RANGE(1, 25)) AS h)
SELECT DATE_TRUNC('hour', ts) + INTERVAL '1 hour' * h AS window_end,
       COUNT(DISTINCT event_id) AS cases_24h
FROM events CROSS JOIN hours WHERE event_type = 'error' GROUP BY 1""",
    "live_snapshot_weekly": weekly_table(),
    "live_snapshot_districts": top_districts(),
    "live_snapshot_map": f"{STAR} {per_district('total_cases')}",
    "shapes_from_geojson": """
SELECT CONCAT(n_name, ' District') AS name, CASE WHEN n_nationkey % 5 <> 0 THEN
       CONCAT('{"type":"Point","coordinates":[', n_nationkey, ',', n_nationkey + 1, ']}') END
       AS geometry FROM nation""",
    "report_weekly_moving_average": moving_average(ASIA),
    "report_weekly_by_sex": weekly_by_sex(ASIA),
    "report_gender_distribution": gender(ASIA),
}
for name, districts in {"location_options": "dim_org", "deaths_by_district": "dim_org",
                        "mortality_summary": "dim_org"}.items():
    ORACLES[f"{name}_valid"] = ORACLES[name].replace(
        f"JOIN {districts} USING (org)", "JOIN valid USING (org)")
ORACLES["weekly_cases_from_cube"] = f"""{STAR}
SELECT CAST(DATE_TRUNC('week', day) AS DATE) AS week_start, COUNT(DISTINCT event_id) AS weekly_cases
FROM returned JOIN valid USING (org) WHERE day IS NOT NULL GROUP BY 1"""
ORACLES["district_total_share_from_cube"] = ORACLES["district_total_share_month"]
ORACLES["district_weekly_share_from_cube"] = ORACLES["district_weekly_share_month"]
ORACLES["district_epicurves_from_cube"] = f"""{STAR}, ahead AS (
  SELECT district FROM returned JOIN valid USING (org) WHERE YEAR(day) = 1997
  GROUP BY district ORDER BY COUNT(DISTINCT event_id) DESC, district LIMIT 12)
SELECT district, CAST(DATE_TRUNC('week', day) AS DATE) AS week_start,
       CAST(WEEK(day) AS INT) AS epi_week, COUNT(DISTINCT event_id) AS weekly_cases
FROM returned JOIN valid USING (org)
WHERE YEAR(day) = 1997 AND district IN (SELECT district FROM ahead) GROUP BY ALL"""
ORACLES["report_top_districts"] = ORACLES["top_districts_totals"]
ORACLES |= {f"{name}_star": ORACLES[name] for name in (
    "total_deaths", "deaths_by_district_text", "age_sex_by_name", "top_districts",
    "top_districts_totals", "executive_summary", "daily_rollup")}
ORACLES["demographic_breakdown_star"] = ORACLES["demographic_breakdown_between"]
