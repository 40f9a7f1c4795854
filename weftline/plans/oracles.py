"""The queries of the catalogue in SQL for DuckDB, put together from common table expressions."""

from __future__ import annotations

import math

from ..operators.affinity import EXAGGERATION, FLOOR, TOLERANCE, TRIES
from ..operators.descent import GAIN_DOWN, GAIN_UP, RATE
from ..operators.graphlets import PARTED, TYPES
from .catalog import FACTOR, GAMMA, K, LEVELS, MOVED, PERPLEXITY, SHIFT, SHIFTED


def _u(*parts: str) -> str:
    """The uniform number that a seed and parts decide."""
    text = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


def _normal(seed: str, *parts: str) -> str:
    u, v = _u(f"'{seed}:u'", *parts), _u(f"'{seed}:v'", *parts)
    return f"(sqrt(-2.0 * ln(1.0 - {u})) * cos(6.283185307179586::DOUBLE * {v}))"


def _in(labels: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def _each(x: str) -> str:
    """The cells (item_id, pos, x) of the array expression ``x`` of rows a."""
    return f"SELECT item_id, pos - 1 AS pos, {r(x + '[pos]')} AS x FROM a, generate_series(1, len(a.x)) AS g(pos)"


F0 = """f0 AS MATERIALIZED (SELECT 0 AS frame_id, vec_id AS item_id, embedding::DOUBLE[] AS x, label::VARCHAR AS label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"""
C0 = F0 + """,
cent AS MATERIALIZED (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x[pos]) AS m FROM f0, generate_series(1, len(x)) AS g(pos) GROUP BY label, pos) GROUP BY label)"""
F01 = C0 + f""",
f1 AS MATERIALIZED (SELECT 1 AS frame_id, item_id, CASE WHEN label IN {_in(MOVED)} THEN list_transform(x, lambda v, i: c[i] + (v - c[i]) * {FACTOR}::DOUBLE) WHEN label IN {_in(SHIFTED)} THEN list_transform(x, lambda v: v + {SHIFT}::DOUBLE) ELSE x END AS x, label FROM f0 LEFT JOIN cent USING (label)),
fs AS (SELECT frame_id, item_id, x, label FROM f0 UNION ALL SELECT * FROM f1)"""
KNN = F01 + f""",
span AS (SELECT frame_id, min(list_min(x)) AS lo, max(list_max(x)) AS hi FROM fs GROUP BY frame_id),
sc AS MATERIALIZED (SELECT frame_id, item_id, list_transform(x, lambda v: (v - lo) / (hi - lo)) AS x FROM fs JOIN span USING (frame_id)),
knn AS MATERIALIZED (SELECT frame_id, src, dst, rank, dist FROM (SELECT *, row_number() OVER (PARTITION BY frame_id, src ORDER BY dist, dst) AS rank FROM
    (SELECT a.frame_id, a.item_id AS src, b.item_id AS dst, list_distance(a.x, b.x) AS dist FROM sc a JOIN sc b ON a.frame_id = b.frame_id AND a.item_id <> b.item_id)) WHERE rank <= {K})"""
EDGES = KNN + """,
ed AS MATERIALIZED (SELECT DISTINCT frame_id, least(src, dst) AS u, greatest(src, dst) AS v FROM knn),
sym AS MATERIALIZED (SELECT frame_id, u, v FROM ed UNION ALL SELECT frame_id, v, u FROM ed)"""
_types = "CASE " + " ".join(f"WHEN sig = '{s}' AND prod = {n} THEN {t}" for s, n, t in PARTED) + " " + " ".join(f"WHEN sig = '{s}' THEN {t}" for s, t in TYPES.items()) + " END"
GRAPHLETS = (
    EDGES
    + """,
s2 AS (SELECT frame_id, [u, v] AS nodes FROM ed)"""
    + "".join(
        f""",
s{k} AS MATERIALIZED (SELECT DISTINCT s.frame_id, list_sort(list_append(nodes, sym.v)) AS nodes FROM (SELECT frame_id, nodes, unnest(nodes) AS n FROM s{k - 1}) s JOIN sym ON sym.frame_id = s.frame_id AND sym.u = n WHERE NOT list_contains(nodes, sym.v))"""
        for k in (3, 4, 5)
    )
    + f""",
sets AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5)),
deg AS MATERIALIZED (SELECT id, s.frame_id, n, count(*) AS d FROM (SELECT id, frame_id, nodes, unnest(nodes) AS n FROM sets) s JOIN sym ON sym.frame_id = s.frame_id AND sym.u = n AND list_contains(nodes, sym.v) GROUP BY id, s.frame_id, n),
prods AS (SELECT a.id, sum(a.d * b.d) // 2 AS prod FROM deg a JOIN deg b ON a.id = b.id JOIN sym ON sym.frame_id = a.frame_id AND sym.u = a.n AND sym.v = b.n GROUP BY a.id),
sigs AS (SELECT id, string_agg(d::VARCHAR, '' ORDER BY d) AS sig FROM deg GROUP BY id),
typed AS MATERIALIZED (SELECT sets.id, sets.frame_id, nodes, {_types} AS gtype FROM sets JOIN sigs USING (id) JOIN prods USING (id)),
gfd AS MATERIALIZED (SELECT frame_id, item_id, gtype, count(*) AS cnt FROM (SELECT frame_id, gtype, unnest(nodes) AS item_id FROM typed) GROUP BY ALL)"""
)


def _layers(levels: int) -> str:
    out = """,
l0 AS (SELECT frame_id, item_id AS seed, item_id FROM fs)"""
    for k in range(1, levels):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{j} z WHERE z.frame_id = a.frame_id AND z.seed = a.seed AND z.item_id = sym.v)" for j in range(k))
        out += f""",
l{k} AS MATERIALIZED (SELECT DISTINCT a.frame_id, a.seed, sym.v AS item_id FROM l{k - 1} a JOIN sym ON sym.frame_id = a.frame_id AND sym.u = a.item_id WHERE {seen})"""
    return out + ", layers AS (" + " UNION ALL ".join(f"SELECT *, {k} AS layer FROM l{k}" for k in range(levels)) + ")"


FEATURES = (
    GRAPHLETS
    + _layers(LEVELS)
    + """,
sums AS (SELECT layers.frame_id, seed AS item_id, layer, gtype, sum(cnt) AS cnt FROM layers JOIN gfd ON gfd.frame_id = layers.frame_id AND gfd.item_id = layers.item_id GROUP BY ALL),
feat AS MATERIALIZED (SELECT frame_id, item_id, layer, gtype, cnt / sum(cnt) OVER (PARTITION BY frame_id, item_id, layer) AS x FROM sums)"""
)
SIMS = (
    FEATURES
    + """,
cmp AS (SELECT item_id, coalesce(a.x, 0) AS p, coalesce(b.x, 0) AS q FROM (SELECT * FROM feat WHERE frame_id = 0) a FULL JOIN (SELECT * FROM feat WHERE frame_id = 1) b USING (item_id, layer, gtype)),
tot AS (SELECT item_id, sum(p * q) AS ab, sum(p * p) AS aa, sum(q * q) AS bb, sum((p - q) * (p - q)) AS sq, sum(abs(p - q)) AS l1 FROM cmp GROUP BY item_id),
sim AS (SELECT item_id, CASE WHEN aa > 0 AND bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0 END AS cosine, exp(-coalesce(sq, 0) / 2) AS rbf, exp(-coalesce(l1, 0)) AS laplacian FROM f0 LEFT JOIN tot USING (item_id))"""
)
COMMON = """,
common AS MATERIALIZED (SELECT a.src, a.dst FROM knn a JOIN knn b ON a.frame_id = 0 AND b.frame_id = 1 AND a.src = b.src AND a.dst = b.dst),
ratio AS (SELECT item_id, coalesce(n, 0) / %s.0 AS ratio FROM f0 LEFT JOIN (SELECT src AS item_id, count(*) AS n FROM common GROUP BY src) USING (item_id))""" % K
WEIGHTS = (
    SIMS
    + COMMON
    + """,
disc AS MATERIALIZED (SELECT item_id, cosine * ratio AS sim FROM sim JOIN ratio USING (item_id)),
w AS MATERIALIZED (SELECT src, dst, a.sim * b.sim AS weight FROM common JOIN disc a ON a.item_id = src JOIN disc b ON b.item_id = dst)"""
)
DIST = F0 + """,
dd AS MATERIALIZED (SELECT a.item_id AS i, b.item_id AS j, list_sum(list_transform(a.x, lambda v, k: (v - b.x[k]) * (v - b.x[k]))) AS d2 FROM f0 a JOIN f0 b ON a.item_id <> b.item_id)"""
BETA = (
    DIST
    + f""",
ds AS MATERIALIZED (SELECT i, list(d2 - low) AS d FROM (SELECT *, min(d2) OVER (PARTITION BY i) AS low FROM dd) GROUP BY i),
bis(i, k, b, lo, hi, diff) AS (
    SELECT i, 0, 1.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, ln(list_sum(list_transform(d, lambda v: exp(-v)))) + list_sum(list_transform(d, lambda v: v * exp(-v))) / list_sum(list_transform(d, lambda v: exp(-v))) - {math.log(PERPLEXITY)!r}::DOUBLE FROM ds
    UNION ALL
    SELECT n.i, k, nb, nlo, nhi, ln(list_sum(list_transform(d, lambda v: exp(-v * nb)))) + nb * list_sum(list_transform(d, lambda v: v * exp(-v * nb))) / list_sum(list_transform(d, lambda v: exp(-v * nb))) - {math.log(PERPLEXITY)!r}::DOUBLE
    FROM (SELECT i, k + 1 AS k, CASE WHEN diff > 0 THEN CASE WHEN hi IS NULL THEN b * 2 ELSE (b + hi) / 2 END ELSE CASE WHEN lo IS NULL THEN b / 2 ELSE (b + lo) / 2 END END AS nb, CASE WHEN diff > 0 THEN b ELSE lo END AS nlo, CASE WHEN diff > 0 THEN hi ELSE b END AS nhi FROM bis WHERE abs(diff) > {TOLERANCE} AND k < {TRIES}) n JOIN ds USING (i)),
beta AS MATERIALIZED (SELECT i, arg_max(b, k) AS beta FROM bis GROUP BY i)"""
)
P = BETA + f""",
ex AS (SELECT i, j, exp(-(d2 - min(d2) OVER (PARTITION BY i)) * beta) AS e FROM dd JOIN beta USING (i)),
cp AS MATERIALIZED (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS p FROM ex),
sy AS (SELECT i, j, sum(p) AS p FROM (SELECT i, j, p FROM cp UNION ALL SELECT j, i, p FROM cp) GROUP BY i, j),
jp AS MATERIALIZED (SELECT i, j, p / (SELECT sum(p) FROM sy) AS p FROM sy)"""


def _layout(name: str, seed: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT item_id, {_normal(f'{seed}:0', 'item_id')} AS y0, {_normal(f'{seed}:1', 'item_id')} AS y1 FROM f0)"


STUDENT = f""",
nums AS MATERIALIZED (SELECT a.item_id AS i, b.item_id AS j, 1 / (1 + (a.y0 - b.y0) * (a.y0 - b.y0) + (a.y1 - b.y1) * (a.y1 - b.y1)) AS num, a.y0 - b.y0 AS d0, a.y1 - b.y1 AS d1 FROM y a JOIN y b ON a.item_id <> b.item_id),
q AS MATERIALIZED (SELECT *, greatest(num / (SELECT sum(num) FROM nums), {FLOOR}) AS q FROM nums)"""
FORCE = P + ", " + _layout("y", "layout") + STUDENT + f""",
force AS (SELECT i AS item_id, sum((greatest(jp.p * {EXAGGERATION}, {FLOOR}) - q) * num * d0) AS f0, sum((greatest(jp.p * {EXAGGERATION}, {FLOOR}) - q) * num * d1) AS f1 FROM jp JOIN q USING (i, j) GROUP BY i)"""
HELD = KNN + COMMON + ", " + _layout("y", "layout") + ", " + _layout("z", "before") + """,
e AS (SELECT src, dst, (src % 5 + dst % 3) / 6.0::DOUBLE AS weight, (za.y0 - zb.y0) - (ya.y0 - yb.y0) AS o0, (za.y1 - zb.y1) - (ya.y1 - yb.y1) AS o1
    FROM common JOIN y ya ON ya.item_id = src JOIN y yb ON yb.item_id = dst JOIN z za ON za.item_id = src JOIN z zb ON zb.item_id = dst)"""
SETS = EDGES + """,
sets AS (SELECT src * 2 + frame_id AS set_id, frame_id, list_concat(list_concat([src], list_sort(list(dst))), [src + 1]) AS nodes FROM knn WHERE rank <= 2 GROUP BY frame_id, src),
member AS (SELECT DISTINCT set_id, frame_id, unnest(nodes) AS n FROM sets),
ind AS MATERIALIZED (SELECT a.set_id, ed.frame_id, u, v FROM ed JOIN member a ON a.frame_id = ed.frame_id AND a.n = u JOIN member b ON b.set_id = a.set_id AND b.frame_id = ed.frame_id AND b.n = v)"""
PARTS = KNN + """,
e1 AS (SELECT frame_id, src AS u, dst AS v FROM knn WHERE rank = 1 UNION SELECT frame_id, dst, src FROM knn WHERE rank = 1),
reach(frame_id, a, b) AS (SELECT frame_id, u, v FROM e1 UNION SELECT reach.frame_id, a, e1.v FROM reach JOIN e1 ON e1.frame_id = reach.frame_id AND e1.u = b),
comp AS (SELECT frame_id, a AS item_id, least(a, min(b)) AS component FROM reach GROUP BY frame_id, a)"""


def _moved(when: str, by: str, source: str = "f0") -> str:
    return f"a AS (SELECT item_id, CASE WHEN {when} THEN list_transform(x, lambda v, i: v + {by}) ELSE x END AS x FROM {source})"


def _q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


_jitter = lambda seed, most, *parts: f"({_u(repr(seed), *parts, '(i - 1)')} * 2 - 1) * {most}::DOUBLE"
_knn = f"SELECT frame_id, src, dst, rank::INTEGER AS rank, {r('dist')} AS dist FROM knn"
ORACLES = {
    "frame_minmax": _q(F0 + ", span AS (SELECT min(list_min(x)) AS lo, max(list_max(x)) AS hi FROM f0), a AS (SELECT item_id, list_transform(x, lambda v: (v - lo) / (hi - lo)) AS x FROM f0, span)", _each("x")),
    "cluster_centroids": _q(C0, f"SELECT label, pos - 1 AS pos, {r('c[pos]')} AS x FROM cent, generate_series(1, len(c)) AS g(pos)"),
    "label_complement": _q(F0, "SELECT item_id, label FROM f0 WHERE item_id NOT IN (SELECT item_id FROM f0 WHERE label IN ('1', '4'))"),
    "gaussian_clusters": f"SELECT id AS item_id, (id // 60)::VARCHAR AS label, i - 1 AS pos, {r('(' + _u(repr('g:mean'), '(id // 60)', '(i - 1)') + ' * 2 - 1) * 10.0::DOUBLE + ' + _normal('g', 'id', '(i - 1)') + ' * sqrt(0.5::DOUBLE)')} AS x FROM generate_series(0, 299) AS g(id), generate_series(1, 6) AS h(i)",
    "keep_split": _q(F0, f"SELECT item_id, row_number() OVER (ORDER BY {_u(repr('keep'), 'item_id')}, item_id) <= floor((SELECT count(*) FROM f0) * 0.7::DOUBLE) AS kept FROM f0"),
    "disturb_points": _q(F0 + ", " + _moved("true", _jitter("jitter", 0.3, "item_id")), _each("x")),
    "disturb_cluster": _q(F0 + ", " + _moved("label = '2'", _jitter("jitter", 0.3, "item_id")), _each("x")),
    "translate_clusters": _q(F0 + ", " + _moved("label IN ('0', '5')", _jitter("move", 0.4)), _each("x")),
    "disturb_label_subsets": _q(
        F0
        + f", pick AS (SELECT *, label IN ('1', '2') AND row_number() OVER (PARTITION BY label ORDER BY {_u(repr('subset'), 'item_id')}, item_id) <= floor((SELECT count(*) FROM f0) * (1 - 0.9::DOUBLE) / 2) AS hit FROM f0), "
        + _moved("hit", _jitter("subset:offset", 0.5, "label"), "pick"),
        _each("x"),
    ),
    "shift_all": _q(F0 + ", " + _moved("true", f"CASE WHEN {_u(repr('shift:sign'))} < 0.5 THEN -0.25::DOUBLE ELSE 0.25::DOUBLE END"), _each("x")),
    "add_noise": _q(F0 + ", " + _moved("item_id % 3 = 0", _jitter("noise", 0.2, "item_id")), _each("x")),
    "overlap_clusters": _q(
        C0
        + ", mid AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(c[pos]) AS m FROM cent, generate_series(1, len(c)) AS g(pos) WHERE label IN ('0', '1', '2') GROUP BY pos)), a AS (SELECT item_id, CASE WHEN label IN ('0', '1', '2') THEN list_transform(x, lambda v, i: v + (m[i] - c[i])) ELSE x END AS x FROM f0 LEFT JOIN cent USING (label), mid)",
        _each("x"),
    ),
    "scale_cluster": _q(C0 + ", a AS (SELECT item_id, CASE WHEN label = '4' THEN list_transform(x, lambda v, i: 0.5::DOUBLE + (v - c[i]) * 0.25::DOUBLE) ELSE x END AS x FROM f0 LEFT JOIN cent USING (label))", _each("x")),
    "split_cluster": _q(F0 + f", half AS (SELECT item_id, (CASE WHEN row_number() OVER (ORDER BY {_u(repr('split'), 'item_id')}, item_id) <= count(*) OVER () // 2 THEN 1 ELSE 2 END) AS h FROM f0 WHERE label = '6'), a AS (SELECT item_id, CASE h WHEN 1 THEN list_transform(x, lambda v: v - 0.3::DOUBLE) WHEN 2 THEN list_transform(x, lambda v: v + 0.3::DOUBLE) ELSE x END AS x FROM f0 LEFT JOIN half USING (item_id))", _each("x")),
    "kernels": _q(
        F0,
        f"SELECT a.item_id, {r('list_cosine_similarity(a.x, b.x)')} AS cosine, {r('exp(-list_sum(list_transform(a.x, lambda v, i: (v - b.x[i]) * (v - b.x[i]))) / 2)')} AS rbf, {r('exp(-list_sum(list_transform(a.x, lambda v, i: abs(v - b.x[i]))))')} AS laplacian, {r('list_sum(list_transform(a.x, lambda v, i: abs(v - b.x[i])))')} AS l1, {r('list_sum(list_transform(a.x, lambda v, i: (v - b.x[i]) * (v - b.x[i])))')} AS l2 FROM f0 a JOIN f0 b ON b.item_id = a.item_id + 1",
    ),
    "argsort": _q(F0, "SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY x[pos], pos) - 1)::INTEGER AS rank, (pos - 1)::INTEGER AS pos FROM f0, generate_series(1, len(x)) AS g(pos)"),
    "l1_normalised": _q(F0 + ", a AS (SELECT item_id, list_transform(x, lambda v: abs(v) / list_sum(list_transform(x, lambda u: abs(u)))) AS x FROM f0)", _each("x")),
    "knn_graph": _q(KNN, _knn),
    "graph_text_roundtrip": _q(KNN, _knn),
    "frames_text_roundtrip": _q(F01, f"SELECT frame_id, item_id - first AS item_id, label, pos - 1 AS pos, {r('x[pos]')} AS x FROM (SELECT *, min(item_id) OVER () AS first FROM fs), generate_series(1, len(x)) AS g(pos)"),
    "similarities_text_roundtrip": _q(SIMS, f"SELECT 0 AS frame_a, 1 AS frame_b, item_id, {r('cosine')} AS sim FROM sim"),
    "layouts_text_roundtrip": _q(F0 + ", " + _layout("y", "layout"), f"SELECT 0 AS frame_id, item_id - min(item_id) OVER () AS item_id, label, {r('y0')} AS y0, {r('y1')} AS y1 FROM y JOIN f0 USING (item_id)"),
    "first_dimensions": _q(F0 + ", a AS (SELECT item_id, x[1:10] AS x FROM f0)", _each("x")),
    "pca_spectrum": _q(
        F0 + ", c AS (SELECT pos, avg(x[pos]) AS m FROM f0, generate_series(1, len(x)) AS g(pos) GROUP BY pos)",
        f"SELECT {r('sum(v)')} AS variance FROM (SELECT pos, var_samp(x[pos]) AS v FROM f0, generate_series(1, len(x)) AS g(pos) GROUP BY pos)",
    ),
    "graphlet_types_within_size": _q(GRAPHLETS, "SELECT frame_id, len(nodes) AS size, CASE len(nodes) WHEN 3 THEN gtype WHEN 4 THEN gtype - 2 ELSE gtype - 8 END AS gtype, count(*) AS n FROM typed GROUP BY ALL"),
    "undirected_edges": _q(EDGES, "SELECT frame_id, u, v FROM ed"),
    "degrees": _q(EDGES, "SELECT frame_id, u AS item_id, count(*) AS degree FROM sym GROUP BY ALL"),
    "edge_num_1": _q(EDGES, "SELECT frame_id, count(*) AS n FROM ed GROUP BY frame_id"),
    "edge_num_2": _q(EDGES, "SELECT ed.frame_id, sum(a.d + b.d - 2)::BIGINT AS n FROM ed JOIN (SELECT frame_id, u, count(*) AS d FROM sym GROUP BY ALL) a ON a.frame_id = ed.frame_id AND a.u = ed.u JOIN (SELECT frame_id, u, count(*) AS d FROM sym GROUP BY ALL) b ON b.frame_id = ed.frame_id AND b.u = ed.v GROUP BY ed.frame_id"),
    "has_edge": _q(EDGES, "SELECT a, b, EXISTS (SELECT 1 FROM sym WHERE frame_id = 1 AND u = a AND v = b) AS linked FROM (SELECT DISTINCT dst AS a, src AS b FROM knn WHERE frame_id = 0)"),
    "induced_edges": _q(SETS, "SELECT * FROM ind"),
    "connected_sets": _q(
        SETS + ", r(set_id, a, b) AS (SELECT set_id, n, n FROM member UNION SELECT r.set_id, a, CASE WHEN b = u THEN v ELSE u END FROM r JOIN ind ON ind.set_id = r.set_id AND (b = u OR b = v))",
        "SELECT set_id, max(n) = any_value(m) AS is_connected FROM (SELECT set_id, a, count(*) AS n FROM r GROUP BY ALL) JOIN (SELECT set_id, count(*) AS m FROM member GROUP BY set_id) USING (set_id) GROUP BY set_id",
    ),
    "connected_components": _q(PARTS, "SELECT * FROM comp"),
    "component_sizes": _q(PARTS, "SELECT frame_id, component, count(*) AS size FROM comp GROUP BY ALL"),
    "bfs_layers": _q(EDGES + _layers(3), "SELECT frame_id, seed, item_id, layer FROM layers"),
    "graphlet_type_counts": _q(GRAPHLETS, "SELECT frame_id, gtype, count(*) AS n FROM typed GROUP BY ALL"),
    "node_gfd": _q(GRAPHLETS, "SELECT * FROM gfd"),
    "node_gfd_normalised": _q(FEATURES, f"SELECT frame_id, item_id, layer * 29 + gtype AS pos, {r('x')} AS x FROM feat"),
    "point_similarity_cos": _q(SIMS, f"SELECT item_id, {r('cosine')} AS sim FROM sim"),
    "point_similarity_rbf": _q(SIMS, f"SELECT item_id, {r('rbf')} AS sim FROM sim"),
    "point_similarity_laplacian": _q(SIMS, f"SELECT item_id, {r('laplacian')} AS sim FROM sim"),
    "aligned_items": _q(F0, "SELECT item_id, true AS in_a, true AS in_b FROM f0"),
    "common_edges": _q(KNN + COMMON, "SELECT src, dst FROM common"),
    "neighbor_ratio": _q(KNN + COMMON, f"SELECT item_id, {r('ratio::DOUBLE')} AS ratio FROM ratio"),
    "discounted_similarity": _q(WEIGHTS, f"SELECT item_id, {r('sim')} AS sim FROM disc"),
    "match_edges": _q(WEIGHTS, f"SELECT src, dst, {r('weight')} AS weight FROM w"),
    "match_edges_norm": _q(WEIGHTS, f"SELECT src, dst, {r('CASE WHEN lo = hi THEN weight ELSE (weight - lo) / (hi - lo) END')} AS weight FROM w, (SELECT min(weight) AS lo, max(weight) AS hi FROM w)"),
    "pairwise_sqdist": _q(DIST, f"SELECT i, j, {r('d2')} AS d2 FROM dd"),
    "perplexity_beta": _q(BETA, f"SELECT i, {r('beta')} AS beta FROM beta"),
    "perplexity_beta_matrix": _q(BETA, f"SELECT i, {r('beta')} AS beta FROM beta"),
    "perplexity_beta_folds": _q(BETA, f"SELECT i, {r('beta')} AS beta FROM beta"),
    "mean_sigma": _q(BETA, f"SELECT 0 AS frame_id, {r('avg(sqrt(1 / beta))')} AS sigma FROM beta"),
    "conditional_p": _q(P, f"SELECT i, j, {r('p', 9)} AS p FROM cp"),
    "joint_p": _q(P, f"SELECT i, j, {r(f'greatest(p, {FLOOR})', 11)} AS p FROM jp"),
    "init_layout": _q(F0 + ", " + _layout("y", "layout"), f"SELECT item_id, {r('y0')} AS y0, {r('y1')} AS y1 FROM y"),
    "centred_layout": _q(F0 + ", " + _layout("y", "layout"), f"SELECT item_id, {r('y0 - avg(y0) OVER ()')} AS y0, {r('y1 - avg(y1) OVER ()')} AS y1 FROM y"),
    "student_q": _q(F0 + ", " + _layout("y", "layout") + STUDENT, f"SELECT i, j, {r('num')} AS num, {r('q', 11)} AS q FROM q"),
    "kl_force": _q(FORCE, f"SELECT item_id, {r('f0', 9)} AS f0, {r('f1', 9)} AS f1 FROM force"),
    "edge_force": _q(
        HELD + f", t AS (SELECT src, dst, {GAMMA}::DOUBLE * weight * o0 / (SELECT count(*) FROM e) AS t0, {GAMMA}::DOUBLE * weight * o1 / (SELECT count(*) FROM e) AS t1 FROM e)",
        f"SELECT item_id, {r('sum(f0)', 9)} AS f0, {r('sum(f1)', 9)} AS f1 FROM (SELECT src AS item_id, -t0 AS f0, -t1 AS f1 FROM t UNION ALL SELECT dst, t0, t1 FROM t) GROUP BY item_id",
    ),
    "one_step_layout": _q(
        FORCE + ", moved AS (SELECT item_id, " + ", ".join(f"y{x} - {RATE}::DOUBLE * CASE WHEN f{x} > 0 THEN 1 + {GAIN_UP}::DOUBLE ELSE {GAIN_DOWN}::DOUBLE END * f{x} AS y{x}" for x in (0, 1)) + " FROM y JOIN force USING (item_id))",
        f"SELECT item_id, {r('y0 - avg(y0) OVER ()')} AS y0, {r('y1 - avg(y1) OVER ()')} AS y1 FROM moved",
    ),
    "kl_cost": _q(P + ", " + _layout("y", "layout") + STUDENT, f"SELECT 0 AS frame_id, {r(f'sum(greatest(p, {FLOOR}) * ln(greatest(p, {FLOOR}) / q))')} AS kl FROM jp JOIN q USING (i, j)"),
    "edge_cost": _q(HELD, f"SELECT 0 AS frame_id, {r('sum(weight * (o0 * o0 + o1 * o1)) / count(*)')} AS c1 FROM e"),
    "neighborhood_preservation": _q(
        KNN + ", " + _layout("y", "layout") + f", near AS (SELECT src, dst FROM (SELECT a.item_id AS src, b.item_id AS dst, row_number() OVER (PARTITION BY a.item_id ORDER BY list_distance([a.y0, a.y1], [b.y0, b.y1]), b.item_id) AS k FROM y a JOIN y b ON a.item_id <> b.item_id) WHERE k <= {K})",
        f"SELECT 0 AS frame_id, {r(f'(SELECT count(*) FROM near JOIN knn USING (src, dst) WHERE frame_id = 0) / (SELECT count(*) * {K} FROM y)')} AS preserved",
    ),
}
