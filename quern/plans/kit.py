"""Registration of queries with their SQL."""

from __future__ import annotations

from quern.sources.standins import MEMORY_SQL, MESSAGES_SQL, USAGE_SQL

_VIEWS = {"logs": USAGE_SQL, "messages": MESSAGES_SQL, "memory": MEMORY_SQL}


class Catalog:
    """Queries of a module and their SQL."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def query(self, sql: str | None = None, *views: str):
        """Register a query; ``sql`` may use the named views, and begin with a comma to go on with their WITH list."""

        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                head = ", ".join(_VIEWS[v] for v in views)
                self.sql[f.__name__] = f"WITH {head} {sql}" if head else sql
            return f

        return keep
