"""Queries of the layout and 2-D tensor operators: every vector of ``embeddings`` is an 8 x 8 image."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import tensor as T
from ..queries import query
from ..session import table

R6 = lambda c: F.round(c, 6)
E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)"
PIXELS = f"WITH {E}, p AS (SELECT vec_id, CAST(n // 8 AS INTEGER) AS i, CAST(n % 8 AS INTEGER) AS j, a[n + 1] AS v FROM e, unnest(range(0, 64)) AS t(n))"
KERNEL = "k AS (SELECT * FROM (VALUES (0, 0, 1.0::DOUBLE), (0, 1, -2.0), (1, 0, 0.5), (1, 1, 3.0)) AS t(ki, kj, w))"


def emb(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", T.double(F.col("embedding")).alias("a"))


def pixels(spark, d):
    return L.grid(emb(spark, d), "a", 8, ["vec_id"])


def kernel(spark):
    return spark.createDataFrame([(0, 0, 1.0), (0, 1, -2.0), (1, 0, 0.5), (1, 1, 3.0)], "ki int, kj int, w double")


@query("concat_rows", f"{PIXELS} SELECT vec_id, i, CAST(j AS INTEGER) AS j, round(v, 6) AS v FROM p UNION ALL SELECT vec_id, i, CAST(j + 8 AS INTEGER), round(v * v, 6) FROM p")
def concat_rows(spark, d):
    m = pixels(spark, d)
    return L.concat_dim(m, m.withColumn("v", F.col("v") * F.col("v")), "j", 8).withColumn("v", R6("v"))


@query("reshape_permute", f"{PIXELS} SELECT vec_id, CAST((i * 8 + j) % 16 AS BIGINT) AS i, CAST((i * 8 + j) // 16 AS BIGINT) AS j, round(v, 6) AS v FROM p")
def reshape_permute(spark, d):
    m = L.permute(L.reshape(pixels(spark, d), 8, 16), {"i": "j", "j": "i"})
    return m.select("vec_id", "i", "j", R6("v").alias("v"))


@query("diag_matrix", f"WITH {E} SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN round(a[i + 1], 6) ELSE 0 END AS v FROM e, unnest(range(0, 4)) AS t(i), unnest(range(0, 4)) AS s(j)")
def diag_matrix(spark, d):
    m = emb(spark, d).select("vec_id", F.posexplode(L.diag(F.slice("a", 1, 4))).alias("i", "row"))
    return m.select("vec_id", "i", F.posexplode("row").alias("j", "v")).withColumn("v", R6("v"))


@query("out_prod", f"{PIXELS} SELECT x.vec_id, x.j AS i, y.j AS k, round(sum(x.v * y.v), 6) AS v FROM p x JOIN p y ON x.vec_id = y.vec_id AND x.i = y.i GROUP BY 1, 2, 3")
def out_prod(spark, d):
    m = pixels(spark, d)
    a = m.select("vec_id", F.col("i").alias("r"), F.col("j").alias("i"), "v")
    b = m.select("vec_id", F.col("i").alias("r"), F.col("j").alias("k"), "v")
    return L.out_prod(a, b, ["vec_id"]).withColumn("v", R6("v"))


@query("im2col_2d", f"""{PIXELS}, o AS (SELECT oi, oj, ki, kj FROM unnest(range(0, 4)) AS a(oi), unnest(range(0, 4)) AS b(oj), unnest(range(0, 3)) AS c(ki), unnest(range(0, 3)) AS g(kj))
SELECT vec_id, CAST(oi AS INTEGER) AS oi, CAST(oj AS INTEGER) AS oj, CAST(ki AS INTEGER) AS ki, CAST(kj AS INTEGER) AS kj, round(v, 6) AS v FROM o JOIN p ON p.i = oi * 2 + ki - 1 AND p.j = oj * 2 + kj - 1""")
def im2col_2d(spark, d):
    return L.im2col_2d(pixels(spark, d), 3, 3, 2, 1, 1, 8, 8, ["vec_id"]).withColumn("v", R6("v"))


@query("im2col_2d_back", f"""{PIXELS}, o AS (SELECT oi, oj, ki, kj FROM unnest(range(0, 4)) AS a(oi), unnest(range(0, 4)) AS b(oj), unnest(range(0, 3)) AS c(ki), unnest(range(0, 3)) AS g(kj))
SELECT vec_id, i, j, round(sum(v), 6) AS v FROM o JOIN p ON p.i = oi * 2 + ki - 1 AND p.j = oj * 2 + kj - 1 GROUP BY 1, 2, 3""")
def im2col_2d_back(spark, d):
    p = L.im2col_2d(pixels(spark, d), 3, 3, 2, 1, 1, 8, 8, ["vec_id"])
    return L.im2col_2d_back(p, 2, 1, 1, ["vec_id"]).withColumn("v", R6("v"))


@query("conv_2d", f"{PIXELS}, {KERNEL} SELECT vec_id, CAST(i - ki AS INTEGER) AS oi, CAST(j - kj AS INTEGER) AS oj, round(sum(v * w), 6) AS v FROM p, k WHERE i - ki BETWEEN 0 AND 6 AND j - kj BETWEEN 0 AND 6 GROUP BY 1, 2, 3")
def conv_2d(spark, d):
    return L.conv_2d(pixels(spark, d), kernel(spark), 2, 2, 1, 0, 1, 8, 8, ["vec_id"]).withColumn("v", R6("v"))


@query("conv_2d_depthwise", f"{PIXELS}, {KERNEL} SELECT vec_id AS c, CAST(i - ki AS INTEGER) AS i, CAST(j - kj AS INTEGER) AS j, round(sum(v * w * (1 + vec_id % 3)), 6) AS v FROM p, k WHERE i - ki BETWEEN 0 AND 6 AND j - kj BETWEEN 0 AND 6 GROUP BY 1, 2, 3")
def conv_2d_depthwise(spark, d):
    m = pixels(spark, d).withColumnRenamed("vec_id", "c")
    cells = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(w).alias("w")) for i, j, w in ((0, 0, 1.0), (0, 1, -2.0), (1, 0, 0.5), (1, 1, 3.0))])
    k = emb(spark, d).select(F.col("vec_id").alias("c"), F.explode(cells).alias("x")).select("c", "x.di", "x.dj", (F.col("x.w") * (1 + F.col("c") % 3)).alias("w"))
    return T.conv_2d_dw(m, k).withColumn("v", R6("v"))


@query("conv_transpose_2d", f"{PIXELS}, {KERNEL} SELECT vec_id, CAST(i * 2 + ki AS INTEGER) AS i, CAST(j * 2 + kj AS INTEGER) AS j, round(sum(v * w), 6) AS v FROM p, k GROUP BY 1, 2, 3")
def conv_transpose_2d(spark, d):
    return L.conv_transpose_2d(pixels(spark, d), kernel(spark), 2, ["vec_id"]).withColumn("v", R6("v"))


@query("pool_2d_back_avg", f"""{PIXELS}, g AS (SELECT vec_id, CAST(oi AS INTEGER) AS oi, CAST(oj AS INTEGER) AS oj, 1.0 + oi + 2 * oj AS g FROM e, unnest(range(0, 3)) AS t(oi), unnest(range(0, 3)) AS s(oj))
SELECT p.vec_id, i, j, round(sum(g) / 16, 6) AS v FROM p JOIN g ON p.vec_id = g.vec_id AND i BETWEEN oi * 2 AND oi * 2 + 3 AND j BETWEEN oj * 2 AND oj * 2 + 3 GROUP BY 1, 2, 3""")
def pool_2d_back_avg(spark, d):
    return L.pool_2d_back(pixels(spark, d), _window_grads(spark, d), 4, 2, ["vec_id"]).withColumn("v", R6("v"))


@query("pool_2d_back_max", f"""{PIXELS}, g AS (SELECT vec_id, CAST(oi AS INTEGER) AS oi, CAST(oj AS INTEGER) AS oj, 1.0 + oi + 2 * oj AS g FROM e, unnest(range(0, 3)) AS t(oi), unnest(range(0, 3)) AS s(oj)),
w AS (SELECT p.vec_id, oi, oj, g, i, j, row_number() OVER (PARTITION BY p.vec_id, oi, oj ORDER BY v DESC, i, j) AS r FROM p JOIN g ON p.vec_id = g.vec_id AND i BETWEEN oi * 2 AND oi * 2 + 3 AND j BETWEEN oj * 2 AND oj * 2 + 3)
SELECT vec_id, i, j, round(sum(g), 6)::DOUBLE AS v FROM w WHERE r = 1 GROUP BY 1, 2, 3""")
def pool_2d_back_max(spark, d):
    return L.pool_2d_back(pixels(spark, d), _window_grads(spark, d), 4, 2, ["vec_id"], "max").withColumn("v", R6("v"))


def _window_grads(spark, d):
    """A gradient for each of the 3 x 3 windows of 4 x 4 pixels."""
    places = F.sequence(F.lit(0), F.lit(2))
    g = emb(spark, d).select("vec_id", F.explode(places).alias("oi")).withColumn("oj", F.explode(places))
    return g.withColumn("g", 1.0 + F.col("oi") + 2 * F.col("oj"))


@query("relative_positions", f"""WITH {E}, t AS (SELECT CAST(n AS INTEGER) AS row, vec_id AS c, a[n + 1] AS v FROM e, unnest(range(0, 64)) AS t(n))
SELECT CAST(q AS INTEGER) AS qi, CAST(k AS INTEGER) AS ki, c, round(v, 6) AS v FROM unnest(range(0, 32)) AS a(q), unnest(range(0, 32)) AS b(k) JOIN t ON t.row = 32 - k - 1 + q""")
def relative_positions(spark, d):
    """Tables of 63 offsets, one for each vector, for 32 query and 32 key places."""
    t = emb(spark, d).select(F.col("vec_id").alias("c"), F.posexplode("a").alias("row", "v"))
    return L.get_rel_pos(t, 32, 32).withColumn("v", R6("v"))


@query("add_relative_positions", f"""WITH {E} SELECT vec_id AS q, CAST(h AS INTEGER) AS kh, CAST(w AS INTEGER) AS kw, round(a[h * 8 + w + 1] + a[h + 1] * 2 + a[w + 1] * 3, 6) AS v FROM e, unnest(range(0, 8)) AS t(h), unnest(range(0, 8)) AS s(w)""")
def add_relative_positions(spark, d):
    m = pixels(spark, d).select(F.col("vec_id").alias("q"), F.col("i").alias("kh"), F.col("j").alias("kw"), "v")
    one = emb(spark, d).select(F.col("vec_id").alias("q"), F.posexplode(F.slice("a", 1, 8)).alias("k", "v"))
    h = one.select("q", F.col("k").alias("kh"), (F.col("v") * 2).alias("v"))
    w = one.select("q", F.col("k").alias("kw"), (F.col("v") * 3).alias("v"))
    return L.add_rel_pos(m, h, w).withColumn("v", R6("v"))


@query("masked_attention", f"""WITH {E}, r AS (SELECT label AS seq, vec_id AS pos, a, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE (vec_id % 3)::DOUBLE END AS m FROM e),
s AS (SELECT x.seq, x.pos, y.a AS v, exp(5 * tanh(list_dot_product(x.a, y.a) / 5) + 0.5 * y.m) AS w FROM r x JOIN r y ON x.seq = y.seq AND y.pos BETWEEN x.pos - 49 AND x.pos),
t AS (SELECT seq, pos, CAST(c - 1 AS INTEGER) AS idx, sum(w * v[c]) AS n, sum(w) AS z FROM s, unnest(range(1, 65)) AS t(c) GROUP BY 1, 2, 3) SELECT seq, pos, idx, round(n / z, 6) AS v FROM t WHERE z IS NOT NULL""")
def masked_attention(spark, d):
    mask = F.when(F.col("vec_id") % 5 != 0, (F.col("vec_id") % 3).cast("double"))
    r = emb(spark, d).select(F.col("label").alias("seq"), F.col("vec_id").alias("pos"), F.col("a").alias("q"), F.col("a").alias("k"), F.col("a").alias("v"), mask.alias("m"))
    out = L.attention(r, 50, 1.0, softcap=5.0, slope=0.5, mask="m").select("seq", "pos", F.posexplode("out").alias("idx", "v"))
    return out.filter("v is not null").withColumn("v", R6("v"))


@query("rope_yarn", f"""WITH {E}, c AS (SELECT greatest(0, floor(64 * ln(4096 / (32 * 2 * pi())) / (2 * ln(10000)))) AS lo, least(63, ceil(64 * ln(4096 / (2 * pi())) / (2 * ln(10000)))) AS hi),
u AS (SELECT vec_id, CAST(i AS INTEGER) AS idx, a[i + 1] AS x, a[(i // 2) * 2 + 1] AS x0, a[(i // 2) * 2 + 2] AS x1, i // 2 AS p, (vec_id % 100) * pow(10000.0, -2.0 * (i // 2) / 64) AS f FROM e, unnest(range(0, 64)) AS t(i)),
g AS (SELECT *, 1 - least(1, greatest(0, (p - lo) / greatest(0.001, hi - lo))) AS r FROM u, c), h AS (SELECT *, f * 0.25 * (1 - r) + f * r AS th FROM g)
SELECT vec_id, idx, round((1 + 0.1 * ln(4)) * CASE WHEN idx % 2 = 0 THEN x0 * cos(th) - x1 * sin(th) ELSE x0 * sin(th) + x1 * cos(th) END, 6) AS v FROM h""")
def rope_yarn(spark, d):
    r = L.rope_yarn(F.col("a"), F.col("vec_id") % 100, 64, freq_scale=0.25)
    return emb(spark, d).select("vec_id", F.posexplode(r).alias("idx", "v")).withColumn("v", R6("v"))


@query("rope_sections", f"""WITH {E}, u AS (SELECT vec_id, CAST(i AS INTEGER) AS idx, i % 32 AS p, a[i % 32 + 1] AS x0, a[i % 32 + 33] AS x1, CASE WHEN (i % 32) % 16 < 8 THEN vec_id % 50 WHEN (i % 32) % 16 < 12 THEN vec_id % 7 ELSE vec_id % 11 END * pow(10000.0, -2.0 * (i % 32) / 64) AS th FROM e, unnest(range(0, 64)) AS t(i))
SELECT vec_id, idx, round(CASE WHEN idx < 32 THEN x0 * cos(th) - x1 * sin(th) ELSE x0 * sin(th) + x1 * cos(th) END, 6) AS v FROM u""")
def rope_sections(spark, d):
    at = F.array(*[F.col("vec_id") % n for n in (50, 7, 11)])
    r = L.rope_sections(F.col("a"), at, 64, [8, 4, 4])
    return emb(spark, d).select("vec_id", F.posexplode(r).alias("idx", "v")).withColumn("v", R6("v"))


@query("cross_entropy_grad", f"""WITH {E}, u AS (SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS idx, exp(a[i]) AS x FROM e, unnest(range(1, 65)) AS t(i))
SELECT vec_id, idx, round((x / sum(x) OVER (PARTITION BY vec_id) - CASE WHEN idx = label THEN 1 ELSE 0 END) / 8, 6) AS v FROM u""")
def cross_entropy_grad(spark, d):
    hot = F.transform("a", lambda x, i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return emb(spark, d).select("vec_id", F.posexplode(L.cross_entropy_grad(F.col("a"), hot, F.lit(8))).alias("idx", "v")).withColumn("v", R6("v"))


@query("upscale_linear", f"""WITH {E}, u AS (SELECT vec_id, a, CAST(i AS INTEGER) AS idx, greatest((i + 0.5) / 2 - 0.5, 0) AS z FROM e, unnest(range(0, 128)) AS t(i))
SELECT vec_id, idx, round(a[floor(z)::INTEGER + 1] * (1 - (z - floor(z))) + a[least(floor(z)::INTEGER + 1, 63) + 1] * (z - floor(z)), 6) AS v FROM u""")
def upscale_linear(spark, d):
    return emb(spark, d).select("vec_id", F.posexplode(T.upscale_linear(F.col("a"), 2)).alias("idx", "v")).withColumn("v", R6("v"))


@query("window_partition", f"{PIXELS} SELECT vec_id, CAST(i // 4 AS INTEGER) AS wi, CAST(j // 4 AS INTEGER) AS wj, round(sum(v * (1 + i % 4) * (1 + j % 4)), 6) AS v FROM p GROUP BY 1, 2, 3")
def window_partition(spark, d):
    """Tiles keep their image's key; what is weighed by its place in the tile has gone there and back."""
    tiles = T.win_part(pixels(spark, d), 4, ["vec_id"])
    back = T.win_part(T.win_unpart(tiles, 4, ["vec_id"]), 4, ["vec_id"])
    w = F.col("v") * (1 + F.col("i")) * (1 + F.col("j"))
    return back.groupBy("vec_id", "wi", "wj").agg(R6(F.sum(w)).alias("v"))


@query("timestep_embedding", "SELECT event_id, CAST(i AS INTEGER) AS idx, round(CASE WHEN i < 4 THEN cos((event_id % 1000) * exp(-ln(10000.0) * i / 4)) ELSE sin((event_id % 1000) * exp(-ln(10000.0) * (i - 4) / 4)) END, 6) AS v FROM events, unnest(range(0, 8)) AS t(i)")
def timestep_embedding(spark, d):
    t = T.timestep_embedding((F.col("event_id") % 1000).cast("double"), 8)
    return table(spark, d, "events").select("event_id", F.posexplode(t).alias("idx", "v")).withColumn("v", R6("v"))


@query("type_copies", f"WITH {E} SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, CAST(trunc(a[i] * 1000) AS INTEGER) AS q, round(CAST(a[i] AS FLOAT)::DOUBLE, 6) AS f FROM e, unnest(range(1, 65)) AS t(i)")
def type_copies(spark, d):
    q = L.dup(T.scale(F.col("a"), 1000.0), "int")
    x = emb(spark, d).select("vec_id", F.posexplode(F.arrays_zip(q.alias("q"), L.dup(F.col("a"), "float").alias("f"))).alias("idx", "x"))
    return x.select("vec_id", "idx", "x.q", F.round(F.col("x.f").cast("double"), 6).alias("f"))


@query("set_and_add_views", f"WITH {E} SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, round(CASE WHEN i BETWEEN 11 AND 20 THEN a[i - 10] ELSE a[i] END, 6) AS placed, round(CASE WHEN i BETWEEN 11 AND 20 THEN a[i] + a[i - 10] ELSE a[i] END, 6) AS added FROM e, unnest(range(1, 65)) AS t(i)")
def set_and_add_views(spark, d):
    a, b = F.col("a"), F.slice("a", 1, 10)
    x = F.arrays_zip(T.set_view(a, b, 10).alias("placed"), T.acc_view(a, b, 10).alias("added"))
    x = emb(spark, d).select("vec_id", F.posexplode(x).alias("idx", "x"))
    return x.select("vec_id", "idx", R6("x.placed").alias("placed"), R6("x.added").alias("added"))


@query("activation_grads", f"""WITH {E}, u AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS idx, a[i] AS x, a[65 - i] AS g, list_sum(list_transform(a, lambda v: v * v)) AS ss, list_dot_product(a, list_reverse(a)) AS xg FROM e, unnest(range(1, 65)) AS t(i)),
s AS (SELECT *, exp(x) / sum(exp(x)) OVER w AS y FROM u WINDOW w AS (PARTITION BY vec_id)), z AS (SELECT *, sum(g * y) OVER (PARTITION BY vec_id) AS gy FROM s)
SELECT vec_id, idx, round(g / (1 + exp(-x)) * (1 + x * (1 - 1 / (1 + exp(-x)))), 6) AS silu, round((g - x * xg / (ss + 64e-5)) / sqrt(ss / 64 + 1e-5), 6) AS rms, round(y * (g - gy), 6) AS soft FROM z""")
def activation_grads(spark, d):
    a, g = F.col("a"), F.reverse("a")
    x = F.arrays_zip(T.silu_back(g, a).alias("silu"), T.rms_norm_back(g, a).alias("rms"), T.soft_max_back(g, T.soft_max(a)).alias("soft"))
    x = emb(spark, d).select("vec_id", F.posexplode(x).alias("idx", "x"))
    return x.select("vec_id", "idx", *[R6(f"x.{c}").alias(c) for c in ("silu", "rms", "soft")])
