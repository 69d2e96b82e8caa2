"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from latticevec.functions import bits
from latticevec.operators.boxes import BINS
from latticevec.plans.queries import CAPACITY, DEGREE, DIMS, MATRIX, TRAINING, WIDTH, K
from latticevec.sources.formats import KINDS

AXES = "xyz"


def l2(a: str, b: str, dims: int | None = None) -> str:
    cut = f"[1:{dims}]" if dims else ""
    return f"list_sum(list_transform(list_zip({a}{cut}, {b}{cut}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


def knn(k: int = K, dims: int | None = None, skip_self: bool = False) -> str:
    where = "WHERE q.vec_id <> b.vec_id" if skip_self else ""
    pairs = f"SELECT q.vec_id AS qid, b.vec_id AS id, {l2('q.embedding', 'b.embedding', dims)} AS dist FROM embeddings q, embeddings b {where}"
    return f"(SELECT qid, CAST(n AS INTEGER) AS rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM ({pairs})) WHERE n <= {k})"


def edges(degree: int) -> str:
    return f"(SELECT qid AS id, rank, id AS neighbor FROM {knn(degree, None, True)})"


def times(scale: str = "", extra: str = "") -> str:
    """The columns of a row's product with the fixed matrix."""
    out = []
    for j, a in enumerate(AXES):
        column = "[" + ", ".join(repr(row[j]) + "::DOUBLE" for row in MATRIX) + "]"
        product = f"list_sum(list_transform(list_zip(embedding, {column}), lambda z: z[1]::DOUBLE * z[2]))"
        out.append(f"round({scale}{product}{extra.format(j + 1)}, 6) AS {a}")
    return ", ".join(out)


POINTS = "(SELECT vec_id AS qid, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS {a}" for k, a in enumerate(AXES)) + " FROM embeddings)"
TIGHT = "(SELECT label AS box_id, " + ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in AXES) + f" FROM {POINTS} GROUP BY label)"


def wider(ratio: float) -> str:
    sides = ", ".join(f"lo_{a} - (hi_{a} - lo_{a}) * ({ratio}::DOUBLE) AS lo_{a}, hi_{a} + (hi_{a} - lo_{a}) * ({ratio}::DOUBLE) AS hi_{a}" for a in AXES)
    return f"(SELECT box_id, {sides} FROM {TIGHT})"


SIDES = ", ".join(f"round({s}_{a}, 6) AS {s}_{a}" for s in ("lo", "hi") for a in AXES)
INSIDE = " AND ".join(f"p.{a} >= b.lo_{a} AND p.{a} <= b.hi_{a}" for a in AXES)
HITS = f"(SELECT p.qid, b.box_id FROM {POINTS} p JOIN {wider(-0.3)} b ON {INSIDE})"
BOX_OF = f"(SELECT p.qid, coalesce(min(b.box_id), 0) AS box_id FROM {POINTS} p LEFT JOIN {wider(-0.3)} b ON {INSIDE} GROUP BY p.qid)"
MEMBERS = "(SELECT label AS box_id, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings)"
CANDIDATES = f"(SELECT h.qid, m.id FROM {BOX_OF} h JOIN {MEMBERS} m ON h.box_id = m.box_id WHERE m.n <= {WIDTH})"
COUNTS = "(SELECT label AS box_id, count(*) AS n FROM embeddings GROUP BY label)"


def found(results: str, truth: str) -> str:
    return f"(SELECT t.qid, count(r.id) AS found FROM {truth} t LEFT JOIN (SELECT DISTINCT qid, id FROM {results}) r ON t.qid = r.qid AND t.id = r.id GROUP BY t.qid)"


RECALL = f"sum(found)::DOUBLE / (count(*) * {K})"
LCG = f"(s * {bits.LCG_MULTIPLIER} + {bits.LCG_INCREMENT}) % {bits.WORD}"
_NEXT = lambda s: f"(({s}) * {bits.LCG_MULTIPLIER} + {bits.LCG_INCREMENT}) % {bits.WORD}"
SAMPLE = f"(SELECT vec_id, embedding FROM embeddings ORDER BY {_NEXT(_NEXT('vec_id + 43'))}, vec_id LIMIT {TRAINING})"


def sampled(k: int) -> str:
    """The k nearest rows of each of the training sample."""
    pairs = f"SELECT q.vec_id AS qid, b.vec_id AS id, {l2('q.embedding', 'b.embedding')} AS dist FROM {SAMPLE} q, embeddings b"
    return f"(SELECT qid, CAST(n AS INTEGER) AS rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM ({pairs})) WHERE n <= {k})"


#: Distances by the first d components, for every d, of the sample to all rows; and whether a true neighbour is among the nearest.
_RECALLS = f"""(WITH q AS MATERIALIZED (SELECT * FROM {SAMPLE}), t AS MATERIALIZED (SELECT qid, id FROM {sampled(K)}),
    p AS MATERIALIZED (SELECT q.vec_id AS qid, b.vec_id AS id, d, list_sum(list_transform(list_zip(q.embedding[1:d], b.embedding[1:d]), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS dist
        FROM q, embeddings b, (SELECT unnest(range({min(DIMS)}, {max(DIMS) + 1})) AS d)),
    r AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid, d ORDER BY dist, id) AS n FROM p)
    SELECT CAST(d AS INTEGER) AS dim, sum(CASE WHEN n <= {WIDTH} THEN 1 ELSE 0 END)::DOUBLE / count(*) AS recall FROM t JOIN r ON t.qid = r.qid AND t.id = r.id GROUP BY d)"""
_SPAN = lambda p: f"CASE axis WHEN 0 THEN {p}_x WHEN 1 THEN {p}_y ELSE {p}_z END"


def kd_leaves(levels: int = 14) -> str:
    """CTEs, one set for each level of the tree, and ``leaves`` (box_id, id, x, y, z)."""
    out, limits = [f"n0 AS MATERIALIZED (SELECT '' AS node, qid AS id, x, y, z FROM {POINTS})"], ", ".join(f"min({a}) AS lo_{a}, max({a}) AS hi_{a}" for a in AXES)
    for k in range(levels):
        out += [
            f"b{k} AS MATERIALIZED (SELECT node, count(*) AS n, {limits} FROM n{k} GROUP BY node)",
            f"""a{k} AS MATERIALIZED (SELECT node, n, axis, {_SPAN("lo")} AS lo, {_SPAN("hi")} AS hi FROM (SELECT *, CASE WHEN hi_x - lo_x >= hi_y - lo_y AND hi_x - lo_x >= hi_z - lo_z THEN 0
                WHEN hi_y - lo_y >= hi_z - lo_z THEN 1 ELSE 2 END AS axis FROM b{k} WHERE n > {CAPACITY}))""",
            f"""h{k} AS MATERIALIZED (SELECT *, CASE WHEN hi > lo THEN CAST(ceil((v - lo) / (hi - lo) * {BINS}) AS INTEGER) ELSE 0 END AS bin FROM
                (SELECT p.*, a.n, a.lo, a.hi, CASE a.axis WHEN 0 THEN p.x WHEN 1 THEN p.y ELSE p.z END AS v FROM n{k} p JOIN a{k} a ON p.node = a.node))""",
            f"c{k} AS (SELECT node, n, bin, sum(count(*)) OVER (PARTITION BY node ORDER BY bin) AS below FROM h{k} GROUP BY node, n, bin)",
            f"e{k} AS (SELECT node, bin AS edge FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY abs(2 * below - n), bin) AS r FROM c{k} WHERE below < n) WHERE r = 1)",
            f"""n{k + 1} AS MATERIALIZED (SELECT node || CASE WHEN CASE WHEN edge IS NULL THEN r <= n // 2 ELSE bin <= edge END THEN 'L' ELSE 'R' END AS node, id, x, y, z FROM
                (SELECT h.*, e.edge, row_number() OVER (PARTITION BY h.node ORDER BY v, id) AS r FROM h{k} h LEFT JOIN e{k} e ON h.node = e.node))""",
        ]
    done = " UNION ALL ".join(f"SELECT p.* FROM n{k} p JOIN b{k} b ON p.node = b.node WHERE b.n <= {CAPACITY}" for k in range(levels))
    out.append(f"leaves AS (SELECT CAST(dense_rank() OVER (ORDER BY node) - 1 AS INTEGER) AS box_id, id, x, y, z FROM ({done}))")
    return "WITH " + ",\n".join(out)


def beam(degree: int = 32, width: int = 4, rounds: int = 100) -> str:
    """The search from random entries, a query's whole state in one row: its beam and what it has seen."""
    entry = lambda d: f"{{'dist': {l2('embedding', f'xs[{d} + 1]')}, 'id': {d}, 'done': false}}"
    marked = "list_transform(beam, lambda t: {'dist': t.dist, 'id': t.id, 'done': t.done OR list_contains(picks, t.id)})"
    return f"""WITH RECURSIVE b AS MATERIALIZED (SELECT list(embedding ORDER BY vec_id) AS xs FROM embeddings),
        g AS MATERIALIZED (SELECT list(near ORDER BY id) AS gs FROM (SELECT id, list(neighbor ORDER BY rank) AS near FROM {edges(degree)} GROUP BY id)),
        t AS (SELECT vec_id AS qid, 0 AS i, vec_id * 64 % {bits.WORD} AS s FROM embeddings UNION ALL SELECT qid, i + 1, {LCG} FROM t WHERE i < {WIDTH}),
        e AS MATERIALIZED (SELECT qid, list(DISTINCT s % (SELECT count(*) FROM embeddings)) AS ids FROM t WHERE i > 0 GROUP BY qid),
        w AS (SELECT qid, embedding, 0 AS i, ids AS seen, list_slice(list_sort(list_transform(ids, lambda d: {entry("d")})), 1, {WIDTH}) AS beam FROM e JOIN embeddings ON qid = vec_id, b
          UNION ALL
          SELECT qid, embedding, i + 1, list_concat(seen, fresh), list_slice(list_sort(list_concat({marked}, list_transform(fresh, lambda d: {entry("d")}))), 1, {WIDTH}) FROM
            (SELECT *, list_filter(list_distinct(flatten(list_transform(picks, lambda p: gs[p + 1]))), lambda d: NOT list_contains(seen, d)) AS fresh FROM
              (SELECT *, list_slice(list_transform(list_filter(beam, lambda t: NOT t.done), lambda t: t.id), 1, {width}) AS picks FROM w) , g WHERE len(picks) > 0 AND i < {rounds}), b)
        SELECT qid, CAST(r AS INTEGER) AS rank, beam[r].id AS id, round(beam[r].dist, 6) AS dist FROM
          (SELECT qid, beam, unnest(range(1, {K} + 1)) AS r FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i DESC) AS last FROM w) WHERE last = 1)"""


BEAM = f"(SELECT qid, id, round(dist, 6) AS dist, rank % 2 = 0 AS expanded FROM {knn(K, 16)})"
BATCH = f"(SELECT qid, id, round(dist, 6) AS dist, false AS expanded FROM {knn(K, 32)})"


def slot(h: int) -> str:
    a, b = bits.MULTIPLIERS[2 * h : 2 * h + 2]
    x = "vec_id"
    for shift, factor in ((16, a), (13, b)):
        x = f"((xor({x}, {x} >> {shift})::HUGEINT * {factor}) % {bits.WORD})::BIGINT"
    return f"xor({x}, {x} >> 16) % {bits.FILTER_WORDS * 32}"


_WIDEST = "CASE WHEN wx >= wy AND wx >= wz THEN 0 WHEN wy >= wz THEN 1 ELSE 2 END"

ORACLE_SQL: dict[str, str] = {
    "knn_exact": f"SELECT qid, rank, id, round(dist, 6) AS dist FROM {knn()}",
    "knn_truncated": f"SELECT qid, rank, id, round(dist, 6) AS dist FROM {knn(K, 32)}",
    "centroid_distances": f"""WITH e AS (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings),
        c AS (SELECT label, list(x ORDER BY p) AS c FROM (SELECT label, p, avg(embedding[p]::DOUBLE) AS x FROM e GROUP BY label, p) GROUP BY label)
        SELECT e.vec_id AS id, c.label, round({l2("e.embedding", "c.c")}, 6) AS dist FROM embeddings e, c""",
    "knn_graph": f"SELECT * FROM {edges(DEGREE)}",
    "graph_without_sentinels": f"SELECT * FROM {edges(4)}",
    "in_degree": f"SELECT neighbor AS id, count(*) AS in_degree FROM {edges(DEGREE)} GROUP BY neighbor",
    "graph_two_hop": f"""WITH g AS (SELECT * FROM {edges(8)}), v AS (SELECT id AS qid, neighbor AS id FROM g UNION SELECT vec_id, vec_id FROM embeddings),
        r AS (SELECT DISTINCT a.id AS qid, b.neighbor AS id FROM g a JOIN g b ON a.neighbor = b.id)
        SELECT r.qid, r.id FROM r LEFT JOIN v ON r.qid = v.qid AND r.id = v.id WHERE v.id IS NULL""",
    "column_mean": "SELECT CAST(p - 1 AS INTEGER) AS dim, round(avg(embedding[p]::DOUBLE), 6) AS mean FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) GROUP BY p",
    "center_vectors": """WITH e AS (SELECT vec_id, p, embedding[p]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)),
        m AS (SELECT p, avg(x) AS m FROM e GROUP BY p)
        SELECT e.vec_id AS id, CAST(e.p - 1 AS INTEGER) AS dim, round(e.x - m.m, 6) AS x FROM e JOIN m ON e.p = m.p""",
    "covariance": """WITH e AS (SELECT vec_id, p, embedding[p]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings))
        SELECT CAST(a.p - 1 AS INTEGER) AS i, CAST(b.p - 1 AS INTEGER) AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.p <= b.p GROUP BY a.p, b.p""",
    "project_fixed_matrix": f"SELECT vec_id AS id, {times()} FROM embeddings",
    "gemm_rows": f"SELECT vec_id AS id, {times('2.0::DOUBLE * ', ' + embedding[{}]::DOUBLE')} FROM embeddings",
    "subspace_points": "SELECT vec_id AS id, round(embedding[4]::DOUBLE, 6) AS x, round(embedding[5]::DOUBLE, 6) AS y, round(embedding[6]::DOUBLE, 6) AS z FROM embeddings",
    "quantised": "SELECT vec_id AS id, CAST(p - 1 AS INTEGER) AS dim, CAST(greatest(least(CAST(trunc(embedding[p]::DOUBLE * 400.0::DOUBLE) AS BIGINT), 127), -127) AS INTEGER) AS q FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)",
    "beam_length": "SELECT vec_id AS id, CAST(pow(2.0::DOUBLE, ceil(log2((vec_id + 1)::DOUBLE))) AS BIGINT) AS length FROM embeddings",
    "id_remap": "SELECT e.vec_id AS id, CAST(n.n - 1 AS INTEGER) AS number FROM embeddings e JOIN (SELECT label, row_number() OVER (ORDER BY label) AS n FROM (SELECT DISTINCT label FROM embeddings)) n ON e.label = n.label",
    "bounds": "SELECT " + ", ".join(f"round(min({a}) - 0.01::DOUBLE, 6) AS lo_{a}, round(max({a}) + 0.01::DOUBLE, 6) AS hi_{a}" for a in AXES) + f" FROM {POINTS}",
    "tight_boxes_by_label": f"SELECT box_id, {SIDES} FROM {TIGHT}",
    "expand_boxes": f"SELECT box_id, {SIDES} FROM {wider(0.2)}",
    "box_histogram": f"SELECT box_id, n FROM {COUNTS}",
    "point_in_box": f"SELECT qid, box_id FROM {HITS}",
    "box_entry_with_fallback": f"SELECT qid, box_id FROM {BOX_OF}",
    "box_candidates": f"SELECT qid, id FROM {CANDIDATES}",
    "hit_offsets": f"""SELECT h.qid, h.box_id, c.n, CAST(coalesce(sum(c.n) OVER (PARTITION BY h.qid ORDER BY h.box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM {HITS} h JOIN {COUNTS} c ON h.box_id = c.box_id""",
    "candidate_topk": f"""SELECT qid, CAST(n AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM
        (SELECT c.qid, c.id, {l2("q.embedding", "b.embedding")} AS dist FROM {CANDIDATES} c JOIN embeddings q ON c.qid = q.vec_id JOIN embeddings b ON c.id = b.vec_id)) WHERE n <= {K}""",
    "kd_split_level1": f"""WITH b AS (SELECT max(x) - min(x) AS wx, max(y) - min(y) AS wy, max(z) - min(z) AS wz, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM {POINTS}),
        s AS (SELECT {_WIDEST} AS axis, CASE {_WIDEST} WHEN 0 THEN mx WHEN 1 THEN my ELSE mz END AS mid FROM b)
        SELECT s.axis, round(s.mid, 6) AS mid, CAST(sum(CASE WHEN CASE s.axis WHEN 0 THEN p.x WHEN 1 THEN p.y ELSE p.z END <= s.mid THEN 1 ELSE 0 END) AS BIGINT) AS n_at_or_below, count(*) AS n FROM {POINTS} p, s GROUP BY s.axis, s.mid""",
    "recall_at_k": f"SELECT round({RECALL}, 6) AS recall, count(*) AS n_queries FROM {found(knn(K, 32), knn())}",
    "recall_by_label": f"SELECT e.label, round({RECALL}, 6) AS recall, count(*) AS n_queries FROM {found(knn(K, 32), knn())} f JOIN embeddings e ON f.qid = e.vec_id GROUP BY e.label",
    "mean_candidates": f"SELECT (SELECT round({RECALL}, 6) FROM {found(CANDIDATES, knn())}) AS recall, (SELECT round(avg(n), 6) FROM (SELECT count(*) AS n FROM {CANDIDATES} GROUP BY qid)) AS mean_candidates",
    "rerank_truncated_candidates": f"""SELECT qid, CAST(n AS INTEGER) AS rank, id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM
        (SELECT c.qid, c.id, {l2("q.embedding", "b.embedding")} AS dist FROM {knn(32, 16)} c JOIN embeddings q ON c.qid = q.vec_id JOIN embeddings b ON c.id = b.vec_id)) WHERE n <= {K}""",
    "merge_beams": f"""SELECT qid, CAST(n AS INTEGER) AS rank, id, dist, expanded FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM
        (SELECT qid, id, min(dist) AS dist, bool_or(expanded) AS expanded FROM (SELECT * FROM {BEAM} UNION ALL SELECT * FROM {BATCH}) GROUP BY qid, id)) WHERE n <= 12""",
    "frontier_selection": f"SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS n FROM {BEAM} WHERE NOT expanded) WHERE n <= 3",
    "dimension_recalls": f"SELECT dim, round(recall, 6) AS recall FROM {_RECALLS}",
    "min_dimension": f"SELECT CAST(min(dim) AS INTEGER) AS dim FROM {_RECALLS} WHERE recall >= 0.99",
    "training_truth": f"SELECT qid, rank, id, round(dist, 6) AS dist FROM {sampled(100)}",
    "pca_variance": """WITH e AS (SELECT vec_id, p, embedding[p]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)),
        c AS (SELECT a.p = b.p AS own, covar_samp(a.x, b.x) AS c FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.p, b.p)
        SELECT round(sum(CASE WHEN own THEN c ELSE 0 END), 6) AS total, round(sum(c * c), 6) AS squares, 1.0::DOUBLE AS ratio FROM c""",
    "pca_lengths": """WITH e AS (SELECT vec_id, p, embedding[p]::DOUBLE AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)),
        m AS (SELECT p, avg(x) AS m FROM e GROUP BY p) SELECT vec_id AS id, round(sum((x - m) * (x - m)), 6) AS length, true AS same FROM e JOIN m ON e.p = m.p GROUP BY vec_id""",
    "vector_files": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding, lambda x: {'floor(abs((x * 100::FLOAT)::FLOAT))::DOUBLE' if kind in ('ivecs', 'bvecs', 'nsw') else 'x::DOUBLE'})), 4) AS total FROM embeddings"
        for kind in KINDS
    ),
    "global_offsets": f"SELECT box_id, n, CAST(coalesce(sum(n) OVER (ORDER BY box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {COUNTS}",
    "kd_boxes": f"{kd_leaves()} SELECT box_id, CAST(count(*) AS INTEGER) AS n, " + ", ".join(f"round({f}({a}), 6) AS {p}_{a}" for p, f in (("lo", "min"), ("hi", "max")) for a in AXES) + " FROM leaves GROUP BY box_id",
    "kd_members": f"{kd_leaves()} SELECT box_id, id FROM leaves",
    "beam_search_raw": beam(),
    "beam_whole_box": f"SELECT qid, rank, id, round(dist, 6) AS dist FROM {knn()}",
    "beam_whole_random": f"SELECT qid, rank, id, round(dist, 6) AS dist FROM {knn()}",
    "random_entry_lcg": f"""WITH RECURSIVE t AS (SELECT vec_id AS qid, 0 AS i, vec_id * 64 % {bits.WORD} AS s FROM embeddings UNION ALL SELECT qid, i + 1, {LCG} FROM t WHERE i < 16)
        SELECT DISTINCT qid, s % (SELECT count(*) FROM embeddings) AS id FROM t WHERE i > 0""",
    "lcg_states": f"SELECT id, s AS state, 10 + s % 990 AS random_id FROM (SELECT s AS id, {LCG} AS s FROM (SELECT vec_id AS s FROM embeddings))",
    "bloom_hash": " UNION ALL ".join(f"SELECT id, {h} AS h, slot, slot % {bits.FILTER_WORDS} AS word, slot // {bits.FILTER_WORDS} AS bit FROM (SELECT vec_id AS id, {slot(h)} AS slot FROM embeddings)" for h in range(bits.FILTER_HASHES)),
    "bloom_params": """WITH c AS (SELECT count(*)::DOUBLE AS n FROM embeddings), a AS (SELECT CAST(i AS INTEGER) AS i, 32.0::DOUBLE * pow(2.0::DOUBLE, i) AS m FROM (SELECT unnest(range(1, 12)) AS i)),
        b AS (SELECT i, m, n, m / n AS r, greatest(round(ln(2.0::DOUBLE) * (m / n)), 1.0::DOUBLE) AS k FROM a, c)
        SELECT i, m, round(r, 6) AS r, k, round(pow(1 - exp(-k / r), k), 6) AS rate, round(-k / ln(1 - exp(ln(0.01::DOUBLE) / k)), 6) AS bits_an_entry,
        CAST(ceil(-n * ln(0.01::DOUBLE) / (ln(2.0::DOUBLE) * ln(2.0::DOUBLE))) AS BIGINT) AS bits_for, CAST(ceil(m / (-k / ln(1 - exp(ln(0.01::DOUBLE) / k)))) AS BIGINT) AS entries_for FROM b""",
    "log_averages": "SELECT 'stage' || CAST(label % 3 AS VARCHAR) AS stage, round(avg(vec_id::DOUBLE), 6) AS ms FROM embeddings GROUP BY label % 3",
}
