"""Queries of the tensor and vector operators over ``embeddings``; arrays come out as (vec_id, idx, v) rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tensor as T
from ..operators import stats as A
from ..operators import vectors as V
from ..queries import query
from ..session import table

R6 = lambda c: F.round(c, 6)
E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)"


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", T.double(F.col("embedding")).alias("a"))


def _long(d, *columns):
    """(vec_id, idx, one column per array)."""
    x = d.select("vec_id", F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in columns])).alias("idx", "x"))
    return x.select("vec_id", "idx", *[R6(F.col(f"x.{n}")).alias(n) for n, _ in columns])


def _sql(select: str) -> str:
    return f"WITH {E}, u AS (SELECT vec_id, label, a, CAST(i - 1 AS INTEGER) AS idx, a[i] AS x FROM e, unnest(range(1, len(a) + 1)) AS t(i)) SELECT {select} FROM u"


@query("tensor_unary", _sql("""vec_id, idx, round(abs(x), 6) AS "abs", sign(x)::DOUBLE AS sgn, round(-x, 6) AS neg, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0 END AS step, round(tanh(x), 6) AS "tanh", round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS elu, round(greatest(x, 0), 6) AS relu,
round(1 / (1 + exp(-x)), 6) AS sigmoid, round(0.5 * x * (1 + tanh(0.79788456080286535587989211986876::DOUBLE * x * (1 + 0.044715 * x * x))), 6) AS gelu, round(x / (1 + exp(-1.702 * x)), 6) AS gelu_quick, round(x / (1 + exp(-x)), 6) AS silu,
round(x * least(1, greatest(0, (x + 3) / 6)), 6) AS hardswish, round(least(1, greatest(0, (x + 3) / 6)), 6) AS hardsigmoid, round(exp(x), 6) AS "exp", round(x * x, 6) AS sqr, round(sin(x), 6) AS "sin", round(cos(x), 6) AS "cos", round(CASE WHEN x > 0 THEN x ELSE 0.1 * x END, 6) AS leaky"""))
def tensor_unary(spark, d):
    names = ["abs", "sgn", "neg", "step", "tanh", "elu", "relu", "sigmoid", "gelu", "gelu_quick", "silu", "hardswish", "hardsigmoid", "exp", "sqr", "sin", "cos"]
    return _long(emb(spark, d), *[(n, T.unary(F.col("a"), n)) for n in names], ("leaky", T.leaky_relu(F.col("a"), 0.1)))


@query("tensor_binary", _sql("vec_id, idx, round(x + a[idx % 16 + 1], 6) AS \"add\", round(x - a[idx % 16 + 1], 6) AS sub, round(x * a[idx % 16 + 1], 6) AS mul, round(x / (a[idx % 16 + 1] + 2), 6) AS div, round(x * 2.5, 6) AS scale, round(least(greatest(x, -0.1), 0.1), 6) AS clamp, round(x + a[1], 6) AS add1"))
def tensor_binary(spark, d):
    a, b = F.col("a"), F.slice("a", 1, 16)
    return _long(emb(spark, d), *[(op, T.binary(a, b, op)) for op in ("add", "sub", "mul")], ("div", T.binary(a, F.transform(b, lambda x: x + 2), "div")), ("scale", T.scale(a, 2.5)), ("clamp", T.clamp(a, -0.1, 0.1)), ("add1", T.add1(a, F.get(a, F.lit(0)))))


@query("tensor_reductions", f"WITH {E} SELECT vec_id, round(list_sum(a), 6) AS total, round(list_avg(a), 6) AS mean, CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS argmax, CAST(len(list_filter(list_zip(a, list_reverse(a)), lambda p: (p[1] > 0) = (p[2] > 0))) AS BIGINT) AS equal FROM e")
def tensor_reductions(spark, d):
    a = F.col("a")
    sign = lambda c: F.transform(c, lambda x: x > 0)
    return emb(spark, d).select("vec_id", R6(T.sum_rows(a)).alias("total"), R6(T.mean_rows(a)).alias("mean"), T.argmax(a).alias("argmax"), T.count_equal(sign(a), sign(F.reverse(a))).alias("equal"))


@query("tensor_total_sum", "SELECT label, round(sum(x), 6) AS total, count(*) AS n FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY label")
def tensor_total_sum(spark, d):
    return emb(spark, d).groupBy("label").agg(R6(F.sum(T.sum_rows(F.col("a")))).alias("total"), F.sum(F.size("a")).alias("n"))


@query("tensor_norms", f"""WITH {E}, s AS (SELECT *, list_avg(a) AS m, list_avg(list_transform(a, lambda x: x * x)) AS m2 FROM e), u AS (SELECT *, CAST(i - 1 AS INTEGER) AS idx, a[i] AS x FROM s, unnest(range(1, len(a) + 1)) AS t(i)),
g AS (SELECT *, avg(x) OVER w AS gm, avg(x * x) OVER w AS gm2 FROM u WINDOW w AS (PARTITION BY vec_id, idx // 16))
SELECT vec_id, idx, round((x - m) / sqrt(m2 - m * m + 1e-5), 6) AS norm, round(x / sqrt(m2 + 1e-5), 6) AS rms_norm, round(x / greatest(sqrt(m2 * len(a)), 1e-12), 6) AS l2_norm, round((x - gm) / sqrt(gm2 - gm * gm + 1e-5), 6) AS group_norm FROM g""")
def tensor_norms(spark, d):
    a = F.col("a")
    x = _long(emb(spark, d), ("norm", T.norm(a)), ("rms_norm", T.rms_norm(a)), ("l2_norm", T.l2_norm(a)), ("group_norm", T.group_norm(a, 4)))
    return x


@query("tensor_softmax", f"WITH {E}, u AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, a[i] AS x FROM e, unnest(range(1, len(a) + 1)) AS t(i)), z AS (SELECT *, exp(3 * x) AS e1, CASE WHEN idx <= vec_id % 64 THEN exp(3 * x) ELSE 0 END AS e2 FROM u) SELECT vec_id, idx, round(e1 / sum(e1) OVER w, 6) AS soft_max, round(e2 / sum(e2) OVER w, 6) AS causal, round(3 * x - ln(sum(e1) OVER w), 6) AS log_soft_max FROM z WINDOW w AS (PARTITION BY vec_id)")
def tensor_softmax(spark, d):
    a = F.col("a")
    masked = T.diag_mask(a, (F.col("vec_id") % 64).cast("int"), 0, F.lit(None).cast("double"))
    return _long(emb(spark, d), ("soft_max", T.soft_max(a, 3.0)), ("causal", T.soft_max(masked, 3.0)), ("log_soft_max", T.log_soft_max(T.scale(a, 3.0))))


@query("tensor_rope", _sql("""vec_id, idx, round(CASE WHEN idx % 2 = 0 THEN a[idx + 1] * cos((vec_id % 100) * pow(10000.0, -2.0 * (idx // 2) / 64)) - a[idx + 2] * sin((vec_id % 100) * pow(10000.0, -2.0 * (idx // 2) / 64))
ELSE a[idx] * sin((vec_id % 100) * pow(10000.0, -2.0 * (idx // 2) / 64)) + a[idx + 1] * cos((vec_id % 100) * pow(10000.0, -2.0 * (idx // 2) / 64)) END, 6) AS rope, round(x, 6) AS back"""))
def tensor_rope(spark, d):
    pos = F.col("vec_id") % 100
    e = emb(spark, d).withColumn("r", T.rope(F.col("a"), pos, 64))
    return _long(e, ("rope", F.col("r")), ("back", T.rope(F.col("r"), pos, 64, back=True)))


@query("argsort_rows", f"WITH {E}, u AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, a[i] AS x FROM e, unnest(range(1, len(a) + 1)) AS t(i)) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x, i) - 1 AS INTEGER) AS idx, i AS \"at\" FROM u")
def argsort_rows(spark, d):
    return emb(spark, d).select("vec_id", F.posexplode(T.argsort(F.col("a"))).alias("idx", "at"))


@query("topk_rows", f"WITH {E}, u AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, a[i] AS x FROM e, unnest(range(1, len(a) + 1)) AS t(i)) SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS INTEGER) AS idx, i AS \"at\" FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 5")
def topk_rows(spark, d):
    return emb(spark, d).select("vec_id", F.posexplode(T.top_k(F.col("a"), 5)).alias("idx", "at"))


@query("tensor_layout", f"""WITH {E} SELECT vec_id, array_to_string(list_transform(list_concat(a[1:3], a[1:3]), lambda x: CAST(round(x * 10000) AS BIGINT)::VARCHAR), ',') AS repeated, len(list_concat(a, [0.0, 0.0])) AS padded, round(list_sum(list_concat(a, a[62:64])), 6) AS reflected, round(a[1] + a[3] + a[5], 6) AS tiles, round(list_sum(list_transform(a[11:20], lambda x: x)), 6) AS viewed FROM e""")
def tensor_layout(spark, d):
    a = F.col("a")
    text = F.array_join(F.transform(T.repeat(F.slice(a, 1, 3), 2), lambda x: F.round(x * 10000).cast("long").cast("string")), ",")
    reflected = T.sum_rows(T.pad_reflect(a, 0, 3)) - T.sum_rows(F.slice(a, 61, 3)) + T.sum_rows(F.slice(a, 62, 3))
    tiles = F.get(T.repeat_back(F.slice(a, 1, 6), 2), F.lit(0))
    return emb(spark, d).select("vec_id", text.alias("repeated"), F.size(T.pad(a, 2)).cast("long").alias("padded"), R6(reflected).alias("reflected"), R6(tiles).alias("tiles"), R6(T.sum_rows(T.view(a, 10, 10))).alias("viewed"))


@query("pool_1d", f"WITH {E} SELECT vec_id, CAST(i AS INTEGER) AS idx, round(list_avg(a[i * 2 + 1:i * 2 + 4]), 6) AS \"avg\", round(list_max(a[i * 2 + 1:i * 2 + 4]), 6) AS \"max\" FROM e, unnest(range(0, 31)) AS t(i)")
def pool_1d(spark, d):
    return _long(emb(spark, d), ("avg", T.pool_1d(F.col("a"), 4, 2)), ("max", T.pool_1d(F.col("a"), 4, 2, "max")))


@query("upscale_nearest", f"WITH {E} SELECT vec_id, CAST(i AS INTEGER) AS idx, round(a[i // 3 + 1], 6) AS v FROM e, unnest(range(0, 192)) AS t(i)")
def upscale_nearest(spark, d):
    return _long(emb(spark, d), ("v", T.upscale(F.col("a"), 3)))


@query("conv_1d", f"WITH {E} SELECT vec_id, CAST(i AS INTEGER) AS idx, round(0.25 * a[i + 1] - 0.5 * a[i + 2] + a[i + 3], 6) AS v FROM e, unnest(range(0, 62)) AS t(i)")
def conv_1d(spark, d):
    kernel = F.array(F.lit(0.25), F.lit(-0.5), F.lit(1.0))
    return _long(emb(spark, d), ("v", T.conv_1d(F.col("a"), kernel, 3)))


@query("conv_transpose_1d", f"WITH {E}, t AS (SELECT vec_id, CAST(2 * (i - 1) + j AS INTEGER) AS idx, a[i] * [0.25, -0.5, 1.0][j + 1] AS v FROM e, unnest(range(1, 65)) AS t(i), unnest(range(0, 3)) AS k(j)) SELECT vec_id, idx, round(sum(v), 6) AS v FROM t GROUP BY vec_id, idx")
def conv_transpose_1d(spark, d):
    kernel = F.array(F.lit(0.25), F.lit(-0.5), F.lit(1.0))
    return _long(emb(spark, d), ("v", T.conv_transpose_1d(F.col("a"), kernel, 3, 2)))


@query("matmul_coo", f"WITH {E}, m AS (SELECT vec_id AS i, CAST(k - 1 AS INTEGER) AS j, a[k] AS v FROM e, unnest(range(1, 65)) AS t(k)), c AS (SELECT label AS k, j, avg(v) AS v FROM m JOIN e ON vec_id = i GROUP BY 1, 2) SELECT m.i, c.k, round(sum(m.v * c.v), 6) AS v FROM m JOIN c USING (j) GROUP BY 1, 2")
def matmul_coo(spark, d):
    """All vectors times the matrix of the labels' mean vectors."""
    e = emb(spark, d)
    m = T.to_coo(e, "vec_id", "a")
    c = V.mean_vector(e, ["label"], "a").select(F.col("label").alias("i"), F.col("idx").alias("j"), "v")
    return T.mul_mat(m, c).select("i", "k", R6("v").alias("v"))


@query("gram_matrix", "WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS a FROM embeddings) SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(sum(a[i] * a[j]), 6) AS v FROM e, unnest(range(1, 65)) AS t(i), unnest(range(1, 65)) AS s(j) GROUP BY 1, 2")
def gram_matrix(spark, d):
    return T.gram(emb(spark, d), "a", 64).select("i", "j", R6("v").alias("v"))


@query("pca_first_component")
def pca_first_component(spark, d):
    v = A.power_iteration(T.gram(emb(spark, d), "a", 64), 64)
    s = 1.0 if v[max(range(64), key=lambda i: abs(v[i]))] > 0 else -1.0
    return spark.createDataFrame([(i, round(s * x, 4)) for i, x in enumerate(v)], "idx int, v double")


@query("gather_rows", "WITH ids AS (SELECT doc_id, doc_id % 500 AS vid FROM labels) SELECT doc_id, vec_id, label FROM ids JOIN embeddings ON vec_id = vid")
def gather_rows(spark, d):
    ids = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 500).alias("vid"))
    return T.get_rows(emb(spark, d), ids, "vec_id", "vid").select("doc_id", "vec_id", "label")


@query("scatter_add_rows", f"WITH {E} SELECT vec_id % 7 AS id, CAST(i - 1 AS INTEGER) AS idx, round(sum(a[i]), 6) AS v FROM e, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2")
def scatter_add_rows(spark, d):
    return T.get_rows_back(emb(spark, d).withColumn("id", F.col("vec_id") % 7), "id", "a").select("id", "idx", R6("v").alias("v"))


@query("routed_matmul", f"""WITH {E}, x AS (SELECT label AS e, vec_id % 4 AS i, CAST(k - 1 AS INTEGER) AS j, avg(a[k]) AS v FROM e, unnest(range(1, 65)) AS t(k) GROUP BY 1, 2, 3),
ids AS (SELECT DISTINCT vec_id AS row, (vec_id + s * 3) % 10 AS e FROM e, unnest([0, 1]) AS t(s)) SELECT row, x.e, x.i, round(sum(x.v * a[j + 1]), 6) AS v FROM ids JOIN e ON vec_id = row JOIN x ON x.e = ids.e GROUP BY 1, 2, 3""")
def routed_matmul(spark, d):
    """Every vector times the matrices of two of the ten experts, whose rows are mean vectors."""
    c = emb(spark, d).select("vec_id", "label", F.posexplode("a").alias("j", "y"))
    x = c.groupBy(F.col("label").alias("e"), (F.col("vec_id") % 4).alias("i"), "j").agg(F.avg("y").alias("v"))
    b = c.select(F.col("vec_id").alias("row"), "j", F.col("y").alias("v"))
    chosen = F.array(*[((F.col("vec_id") + s) % 10).cast("int") for s in (0, 3)])
    ids = emb(spark, d).select(F.col("vec_id").alias("row"), F.explode(chosen).alias("e"))
    return T.mul_mat_id(x, b, ids).select("row", "e", "i", R6("v").alias("v"))


@query("pool_2d", f"WITH {E} SELECT vec_id // 2 AS i, CAST(j // 2 AS INTEGER) AS j, round(avg(a[j + 1]), 6) AS v FROM e, unnest(range(0, 64)) AS t(j) GROUP BY 1, 2 HAVING count(*) = 4")
def pool_2d(spark, d):
    m = T.to_coo(emb(spark, d), "vec_id", "a")
    return T.pool_2d(m, 2, 2, 2, 2).select(F.col("i").cast("long").alias("i"), "j", R6("v").alias("v"))


@query("sliding_window_attention", f"""WITH {E}, r AS (SELECT label AS seq, vec_id AS pos, a FROM e), s AS (SELECT x.seq, x.pos, y.a AS v, exp(list_dot_product(x.a, y.a) * 2) AS w FROM r x JOIN r y ON x.seq = y.seq AND y.pos BETWEEN x.pos - 39 AND x.pos)
SELECT seq, pos, CAST(c - 1 AS INTEGER) AS idx, round(sum(w * v[c]) / sum(w), 6) AS v FROM s, unnest(range(1, 65)) AS t(c) GROUP BY 1, 2, 3""")
def sliding_window_attention(spark, d):
    r = emb(spark, d).select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), *[F.col("a").alias(c) for c in "qkv"])
    return T.sliding_attention(r, 40, 2.0).select("seq", "pos", F.posexplode("out").alias("idx", "v")).withColumn("v", R6("v"))


@query("causal_conv", f"WITH {E} SELECT vec_id, round(a[1] + 0.5 * coalesce(lag(a[1]) OVER w, 0) + 0.25 * coalesce(lag(a[1], 2) OVER w, 0), 6) AS v FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def causal_conv(spark, d):
    r = emb(spark, d).select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), F.get("a", F.lit(0)).alias("x"))
    return T.ssm_conv(r, "x", [0.25, 0.5, 1.0]).select(F.col("pos").alias("vec_id"), R6("out").alias("v"))


@query("cross_entropy_loss", f"WITH {E}, u AS (SELECT vec_id, label, unnest(a) AS x, unnest(range(0, 64)) AS i FROM e), s AS (SELECT vec_id, ln(sum(exp(x))) - max(CASE WHEN i = label THEN x END) AS loss FROM u GROUP BY vec_id) SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM s")
def cross_entropy_loss(spark, d):
    hot = F.transform("a", lambda x, i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return emb(spark, d).agg(R6(F.avg(T.cross_entropy(F.col("a"), hot))).alias("loss"), F.count("*").alias("n"))


@query("adamw_step", _sql("vec_id, idx, round(x * (1 - 0.01 * 0.1) - 0.01 * (0.1 * x * 2) / (1 - 0.9) / (sqrt(0.001 * (x * 2) * (x * 2) / (1 - 0.999)) + 1e-8), 6) AS x, round(0.1 * x * 2, 6) AS m, round(0.001 * (x * 2) * (x * 2), 6) AS v"))
def adamw_step(spark, d):
    z = F.transform("a", lambda x: F.lit(0.0))
    e = emb(spark, d).withColumn("s", T.adamw(F.col("a"), T.scale(F.col("a"), 2.0), z, z, 1, lr=0.01, wd=0.1))
    return _long(e, ("x", F.transform("s", lambda e: e["x"])), ("m", F.transform("s", lambda e: e["m"])), ("v", F.transform("s", lambda e: e["v"])))


def _recurrence_sql(name: str, state: str, before: bool, out: str) -> str:
    """A recursion over the rows of each label: 64 numbers of state, row by row. S is the old state, x a place of the new one from 0."""
    start = "list_transform(range(0, 64), lambda x: 0.0::DOUBLE)"
    row = lambda s: state.replace("$S", s)
    read = lambda s, old: out.replace("$S", old if before else s).replace("$O", old)
    return f"""{name} AS (SELECT e.seq, e.rn, e.pos, {start} AS old, {row(start)} AS st FROM r e WHERE rn = 1
UNION ALL SELECT e.seq, e.rn, e.pos, {name}.st, {row(name + '.st')} FROM {name} JOIN r e ON e.seq = {name}.seq AND e.rn = {name}.rn + 1),
{name}_out AS (SELECT '{name}' AS op, t.seq, t.pos, CAST(j AS INTEGER) AS idx, round({read('t.st', 't.old')}, 6) AS v FROM {name} t JOIN r e ON e.seq = t.seq AND e.rn = t.rn, unnest(range(0, 8)) AS u(j))"""


_SOFT = "(CASE WHEN {0} <= 20 THEN ln(1 + exp({0})) ELSE {0} END)"
_RECURRENCES = ",\n".join([
    _recurrence_sql("wkv6", "list_transform(range(0, 64), lambda x: $S[x + 1] * e.w[x // 8 + 1] + e.k[x // 8 + 1] * e.v[x % 8 + 1])", True, "list_sum(list_transform(range(1, 9), lambda i: e.r[i] * (0.5 * e.k[i] * e.v[j + 1] + $S[(i - 1) * 8 + j + 1])))"),
    _recurrence_sql("gla", "list_transform(range(0, 64), lambda x: $S[x + 1] * e.g[x // 8 + 1] + e.k[x // 8 + 1] * e.v[x % 8 + 1])", False, "0.5 * list_sum(list_transform(range(1, 9), lambda i: e.q[i] * $S[(i - 1) * 8 + j + 1]))"),
    _recurrence_sql("wkv7", "list_transform(range(0, 64), lambda x: $S[x + 1] * e.w[x % 8 + 1] + e.v[x // 8 + 1] * e.k[x % 8 + 1] + list_dot_product($S[(x // 8) * 8 + 1:(x // 8) * 8 + 8], e.a) * e.b[x % 8 + 1])", False, "list_dot_product($S[j * 8 + 1:j * 8 + 8], e.r)"),
    _recurrence_sql("ssm", f"list_transform(range(0, 64), lambda x: $S[x + 1] * exp(-{_SOFT.format('e.k[x // 8 + 1]')}) + e.v[x % 8 + 1] * e.r[x // 8 + 1] * {_SOFT.format('e.k[x // 8 + 1]')})", False, "list_dot_product($S[j * 8 + 1:j * 8 + 8], e.w)"),
])


@query("recurrences", f"""WITH RECURSIVE {E}, r AS (SELECT label AS seq, vec_id AS pos, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, {', '.join(f"a[{1 + 8 * i}:{8 + 8 * i}] AS {n}" for i, n in enumerate("rkvwqgab"))} FROM e),
{_RECURRENCES}
{' UNION ALL '.join(f"SELECT * FROM {n}_out" for n in ("wkv6", "gla", "wkv7", "ssm"))}""")
def recurrences(spark, d):
    """The sequential operators along each label's vectors, all components: an eighth of them is one of the operators' inputs."""
    r = emb(spark, d).select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), *[F.slice("a", 1 + 8 * i, 8).alias(n) for i, n in enumerate("rkvwqgab")])
    outs = [
        ("wkv6", T.wkv6(r, [0.5] * 8)), ("gla", T.gated_linear_attention(r, 0.5)), ("wkv7", T.wkv7(r)),
        ("ssm", T.ssm_scan(r.select("seq", "pos", F.col("r").alias("x"), F.col("k").alias("dt"), F.col("v").alias("b"), F.col("w").alias("c")), [-1.0] * 8)),
    ]
    out = None
    for n, o in outs:
        o = o.select(F.lit(n).alias("op"), "seq", "pos", F.posexplode("out").alias("idx", "v")).withColumn("v", F.round("v", 6))
        out = o if out is None else out.unionByName(o)
    return out


@query("cosine_pairs", f"WITH {E}, q AS (SELECT * FROM e WHERE vec_id % 100 = 0) SELECT x.vec_id AS a_id, y.vec_id AS b_id, round(list_cosine_similarity(x.a, y.a), 6) AS cos FROM q x, e y")
def cosine_pairs(spark, d):
    """The stated queries (ids divisible by 100) against all rows."""
    e = emb(spark, d)
    return V.cosine_pairs(e, "vec_id", "a", e.filter("vec_id % 100 = 0")).select("a_id", "b_id", R6("cos").alias("cos"))


@query("cosine_topk", f"WITH {E} SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, r.vec_id, round(list_cosine_similarity(q.a, r.a), 6) AS cos FROM e q, e r WHERE q.vec_id % 100 = 0 WINDOW w AS (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.a, r.a), 9) DESC, r.vec_id) QUALIFY row_number() OVER w <= 10")
def cosine_topk(spark, d):
    e = emb(spark, d)
    return V.top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "a", 10).select("query_id", "rank", "vec_id", R6("cos").alias("cos"))


@query("normalize_vectors", f"WITH {E}, u AS (SELECT vec_id, a, CAST(i - 1 AS INTEGER) AS idx, a[i] AS x FROM e, unnest(range(1, 65)) AS t(i)) SELECT vec_id, idx, round(x / sqrt(list_dot_product(a, a)), 6) AS l2, round(x / (list_max(list_transform(a, lambda v: abs(v))) / 32760.0::DOUBLE) / 32760, 6) AS maxabs, round(x / pow(list_sum(list_transform(a, lambda v: pow(abs(v), 3))), 1.0 / 3), 6) AS p3 FROM u")
def normalize_vectors(spark, d):
    a = F.col("a")
    return _long(emb(spark, d), ("l2", V.normalize(a)), ("maxabs", T.scale(V.normalize(a, 0), 1 / 32760)), ("p3", V.normalize(a, 3)))


@query("mean_vector_per_label", f"WITH {E} SELECT label, CAST(i - 1 AS INTEGER) AS idx, round(avg(a[i]), 6) AS v FROM e, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2")
def mean_vector_per_label(spark, d):
    return V.mean_vector(emb(spark, d), ["label"], "a").select("label", "idx", R6("v").alias("v"))


@query("pooling_first_last", f"WITH {E}, p AS (SELECT conv_id, turn, a FROM conversations JOIN e ON vec_id = (conv_id * 8 + turn) % 500) SELECT conv_id, round(list_sum(arg_min(a, turn)), 6) AS first_sum, round(list_sum(arg_max(a, turn)), 6) AS last_sum FROM p GROUP BY conv_id")
def pooling_first_last(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 8 + F.col("turn")) % 500).alias("vec_id"))
    p = c.join(emb(spark, d), "vec_id")
    f, s = V.pool(p, "conv_id", "turn", "a", "first"), V.pool(p, "conv_id", "turn", "a", "last").withColumnRenamed("pooled", "last")
    return f.join(s, "conv_id").select("conv_id", R6(T.sum_rows(F.col("pooled"))).alias("first_sum"), R6(T.sum_rows(F.col("last"))).alias("last_sum"))


@query("rerank_ordering", f"WITH {E} SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY a[1] DESC, vec_id) AS INTEGER) AS rank FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY a[1] DESC, vec_id) <= 5")
def rerank_ordering(spark, d):
    e = emb(spark, d).withColumn("score", F.get("a", F.lit(0)))
    return V.rerank(e, "label", "score", "vec_id", 5).select("label", "vec_id", "rank")
