"""Queries by name, each with the SQL that must give the same rows."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            from staycheck.catalog.duck import with_views

            ORACLES[name] = with_views(sql)
        return fn
    return register
