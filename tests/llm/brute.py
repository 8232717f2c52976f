"""Plain versions of the operators, and a reader of the small tables."""

import duckdb


def rows(sf_dir, name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{name}.parquet'").fetchall()


def groups(nodes, links):
    """node -> smallest node reachable."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
