"""All queries outside the subpackage for training text."""

from loamworks.plans import analytics, extra, quality, relational, search, signals, views

FLAGSHIP = "score_chain"
QUERIES = {**analytics.QUERIES, **extra.QUERIES, **search.QUERIES, **signals.QUERIES, **views.QUERIES, **relational.QUERIES, **quality.QUERIES}
SQL = {**analytics.SQL, **extra.SQL, **search.SQL, **signals.SQL, **views.SQL, **relational.SQL, **quality.SQL}
