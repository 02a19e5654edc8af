"""Named reports and the query catalogue (``queries()`` / ``oracle_sql()``)."""
