"""The registered queries and the SQL each of them is checked against."""

from queryset import charts, cleaning, jobs, profiling, reports, sampling

_MODULES = (profiling, charts, cleaning, sampling, reports, jobs)


def all_queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
