"""The named queries over the driver's tables, and the same results as DuckDB SQL."""


def _modules():
    from weftline.catalog import basic, generated, procedural, relations, search

    return (basic, search, relations, procedural, generated)


def queries():
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in _modules() for k, s in m.SQL.items()}
