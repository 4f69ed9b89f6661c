"""Building blocks of the reports: case rows, places, persons, deaths."""
