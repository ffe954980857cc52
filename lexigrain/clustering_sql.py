"""SQL of the iterative clusterings, for engines with recursive queries.

Each recursion keeps its whole state in one row a step (or a run and step):
lists of labels, of chosen rows or of clusters.
"""

from __future__ import annotations


def kmeans(points: str, k: int, n_init: int, farthest: bool, last: str, seed: int = 42, most: int = 100) -> str:
    """Spherical k-means over ``points`` (a query for ``id, v`` with ``v`` of length 1), best of ``n_init`` runs.

    ``last`` selects from ``best`` (id, cluster_id, similarity, score).
    """
    first = "far(run, ids) AS (SELECT run, ids FROM grown WHERE len(ids) = {k})".format(k=k)
    if farthest:
        starts = (
            "sims AS MATERIALIZED (SELECT a.pos AS a, b.pos AS b, round(1 - list_dot_product(a.v, b.v), 12) AS gap FROM pts a, pts b), "
            f"grown(run, ids) AS (SELECT run, list(pos ORDER BY md5(({seed} + run) || ':' || id), id)[1:1] FROM pts, range({n_init}) r(run) GROUP BY run "
            f"UNION ALL SELECT run, list_append(any_value(ids), list(a ORDER BY gap DESC, a)[1]) FROM (SELECT run, any_value(ids) AS ids, a, min(gap) AS gap FROM (SELECT run, ids, unnest(ids) AS c FROM grown WHERE len(ids) < {k}) JOIN sims ON b = c WHERE NOT list_contains(ids, a) GROUP BY run, a) GROUP BY run)"
        )
    else:
        starts = f"grown(run, ids) AS (SELECT run, list(pos ORDER BY md5(({seed} + run) || ':' || id), id)[1:{k}] FROM pts, range({n_init}) r(run) GROUP BY run)"
    sims = "list_transform(c, lambda x: round(list_dot_product(v, x), 12))"
    best = f"list_position({sims}, list_max({sims}))"
    means = (  # from labels: the centroids of every run and step
        "SELECT run, it, any_value(labels) AS labels, list(m ORDER BY label) AS c FROM (SELECT run, it, any_value(labels) AS labels, label, list(x / n ORDER BY d) AS m FROM "
        "(SELECT *, sqrt(sum(x * x) OVER (PARTITION BY run, label)) AS n FROM (SELECT run, it, any_value(labels) AS labels, label, d, sum(x) AS x FROM "
        "(SELECT run, it, labels, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS d FROM (SELECT run, it, labels, unnest(labels) AS label, unnest(range(1, len(labels) + 1)) AS p FROM {0}) JOIN pts ON pos = p) GROUP BY run, it, label, d)) GROUP BY run, it, label) GROUP BY run, it"
    )
    return (
        f"WITH RECURSIVE e AS ({points}), pts AS MATERIALIZED (SELECT id, v, row_number() OVER (ORDER BY id) AS pos FROM e), {starts}, {first}, "
        "start AS (SELECT run, list(v ORDER BY i) AS c FROM (SELECT run, unnest(ids) AS p, unnest(range(1, len(ids) + 1)) AS i FROM far) JOIN pts ON pos = p GROUP BY run), "
        f"km(run, it, labels, done) AS (SELECT run, 1, list({best} ORDER BY pos), false FROM start, pts GROUP BY run "
        f"UNION ALL SELECT run, it + 1, list(b ORDER BY pos), list(b ORDER BY pos) = any_value(labels) FROM (SELECT run, it, labels, pos, {best} AS b FROM ({means.format(f'(SELECT * FROM km WHERE NOT done AND it < {most})')}), pts) GROUP BY run, it), "
        f"ended AS (SELECT run, it, labels FROM km WHERE done OR it = {most}), cents AS ({means.format('ended')}), "
        "final AS (SELECT run, id, label - 1 AS cluster_id, round(list_dot_product(v, c[label]), 6) AS similarity FROM (SELECT run, c, unnest(labels) AS label, unnest(range(1, len(labels) + 1)) AS p FROM cents) JOIN pts ON pos = p), "
        "scores AS (SELECT run, round(sum(similarity), 6) AS score FROM final GROUP BY run), won AS (SELECT run, score FROM scores ORDER BY score DESC, run LIMIT 1), "
        f"best AS (SELECT id, cluster_id::INT AS cluster_id, similarity, score FROM final JOIN won USING (run)) {last}"
    )


def leaders(pairs: str, last: str) -> str:
    """Leader clustering in the order of ids.  ``pairs`` ends with CTEs ``t`` (doc_id) and ``pairs`` (a < b, similarity).

    The state is the list of leaders after each row; ``last`` selects from
    ``led`` (doc_id, leader, similarity).
    """
    return pairs.replace("WITH ", "WITH RECURSIVE ", 1) + (
        ", docs AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM (SELECT DISTINCT doc_id FROM t)), "
        "earlier AS MATERIALIZED (SELECT d.pos, d.doc_id, coalesce(list(a) FILTER (a IS NOT NULL), []) AS near FROM docs d LEFT JOIN pairs ON b = d.doc_id GROUP BY ALL), "
        "walk(pos, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT e.pos, CASE WHEN list_has_any(e.near, w.leaders) THEN w.leaders ELSE list_append(w.leaders, e.doc_id) END FROM walk w JOIN earlier e ON e.pos = w.pos + 1), "
        "all_leaders AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM walk ORDER BY pos DESC LIMIT 1)), "
        "joined AS (SELECT b AS doc_id, a AS leader, similarity FROM pairs WHERE a IN (SELECT leader FROM all_leaders) AND b NOT IN (SELECT leader FROM all_leaders) QUALIFY row_number() OVER (PARTITION BY b ORDER BY similarity DESC, a) = 1), "
        f"led AS (SELECT d.doc_id, coalesce(j.leader, d.doc_id) AS leader, j.similarity FROM docs d LEFT JOIN joined j USING (doc_id)) {last}"
    )


def linkage(pairs: str, threshold: float) -> str:
    """Average linkage, one merge a step.  ``pairs`` ends with CTEs ``t`` (doc_id) and ``pairs`` (a < b, similarity).

    The state is the label (smallest id) of every row and, for every label, the
    distance of its last merge.
    """
    return pairs.replace("WITH ", "WITH RECURSIVE ", 1) + (
        ", docs AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS pos FROM (SELECT DISTINCT doc_id FROM t)), "
        "near AS MATERIALIZED (SELECT x.pos AS a, y.pos AS b, similarity AS s FROM pairs JOIN docs x ON x.doc_id = a JOIN docs y ON y.doc_id = b), "
        "state(it, labels, d) AS (SELECT 0, list(pos ORDER BY pos), list(NULL::DOUBLE ORDER BY pos) FROM docs "
        "UNION ALL SELECT it + 1, list_transform(labels, lambda l: CASE WHEN l = hi THEN lo ELSE l END), list_transform(d, lambda x, i: CASE WHEN i = lo THEN dist ELSE x END) FROM ("
        "SELECT any_value(it) AS it, any_value(labels) AS labels, any_value(d) AS d, list(lo ORDER BY dist, lo, hi)[1] AS lo, list(hi ORDER BY dist, lo, hi)[1] AS hi, min(dist) AS dist FROM ("
        "SELECT it, labels, d, lo, hi, round(1 - s / (len(list_filter(labels, lambda l: l = lo)) * len(list_filter(labels, lambda l: l = hi))), 12) AS dist FROM ("
        "SELECT any_value(it) AS it, any_value(labels) AS labels, any_value(d) AS d, least(labels[a], labels[b]) AS lo, greatest(labels[a], labels[b]) AS hi, sum(s) AS s FROM state, near WHERE labels[a] <> labels[b] GROUP BY lo, hi)"
        f") WHERE dist <= {threshold}) WHERE lo IS NOT NULL), "
        "ended AS (SELECT labels, d FROM state ORDER BY it DESC LIMIT 1), "
        "members AS (SELECT unnest(labels) AS label, unnest(range(1, len(labels) + 1)) AS pos FROM ended), "
        "merged AS (SELECT m.label, (SELECT d[m.label] FROM ended) AS d FROM (SELECT DISTINCT label FROM members) m) "
        "SELECT docs.doc_id, (dense_rank() OVER (ORDER BY merged.d IS NOT NULL, coalesce(merged.d, -1), merged.label) - 1)::INT AS cluster_id FROM members JOIN docs USING (pos) JOIN merged USING (label)"
    )
