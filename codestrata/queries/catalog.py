"""All driver queries."""

from codestrata.queries import Catalog, corpus, findings, history, inputs, snapshots, streams


def full_catalog() -> Catalog:
    whole = Catalog()
    for part in (findings, snapshots, history, corpus, inputs, streams):
        whole.queries.update(part.CATALOG.queries)
        whole.sql.update(part.CATALOG.sql)
    return whole
