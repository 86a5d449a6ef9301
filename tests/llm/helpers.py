"""Small tables with the awkward cases, and brute-force versions."""

SF = "/root/testdata/sf0.001"


def docs_df(spark, rows):
    """rows of (doc_id, text, source), with columns whose names clash with those of the operators."""
    data = [(i, t, "en", s, None if t is None else len(t), "x", 1, 2.5, 7, i, "a", 0) for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, component_id string, unit long, p double, _row long, _doc long, `a.b` string, _unit long")


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
