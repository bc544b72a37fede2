"""The core's queries by name, and their SQL."""

from cuelight.plans import intervals, periods, report, text

QUERIES = {**periods.QUERIES, **intervals.QUERIES, **text.QUERIES, **report.QUERIES}
SQL = {**periods.SQL, **intervals.SQL, **text.SQL, **report.SQL}
