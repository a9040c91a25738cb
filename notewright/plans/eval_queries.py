"""Queries of the evaluation statistics, the build comparison and the candidate samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators import rowwise, selection
from ..operators import stats as A
from ..queries import query
from ..session import table

R6 = lambda c: F.round(c, 6)


@query("bench_compare_selfjoin", """SELECT tb.l_suppkey, tb.l_linenumber, tb.y, round(avg(tb.l_extendedprice), 6) AS base, round(avg(tc.l_extendedprice), 6) AS other, round(avg(tc.l_extendedprice) / avg(tb.l_extendedprice), 6) AS speedup
FROM (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem) tb JOIN (SELECT *, CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem) tc
ON tb.l_suppkey = tc.l_suppkey AND tb.l_linenumber = tc.l_linenumber AND tb.y = tc.y AND tb.l_returnflag = 'A' AND tc.l_returnflag = 'R' GROUP BY 1, 2, 3""")
def bench_compare_selfjoin(spark, d):
    t = table(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    c = A.compare_builds(t, ["l_suppkey", "l_linenumber", "y"], "l_returnflag", "A", "R", "l_extendedprice")
    return c.select("l_suppkey", "l_linenumber", "y", R6("base").alias("base"), R6("other").alias("other"), R6("speedup").alias("speedup"))


@query("bench_distinct_builds", "SELECT DISTINCT substring(o_orderpriority, 1, CAST((SELECT min(length(o_orderpriority)) FROM orders) AS BIGINT)) AS build FROM orders")
def bench_distinct_builds(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority")
    n = o.agg(F.min(F.length("o_orderpriority")).alias("n"))
    return o.distinct().crossJoin(F.broadcast(n)).select(F.expr("substring(o_orderpriority, 1, n)").alias("build")).distinct()


@query("bench_build_lengths", "SELECT min(length(o_orderpriority)) AS shortest, max(length(o_orderpriority)) AS longest, count(DISTINCT o_orderpriority) AS builds FROM orders")
def bench_build_lengths(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.min(F.length("o_orderpriority")).cast("long").alias("shortest"), F.max(F.length("o_orderpriority")).cast("long").alias("longest"), F.countDistinct("o_orderpriority").alias("builds"))


@query("param_grid", "SELECT r_name, n_name, p_brand FROM region, nation, (SELECT DISTINCT p_brand FROM part)")
def param_grid(spark, d):
    return A.parameter_grid(table(spark, d, "region").select("r_name"), table(spark, d, "nation").select("n_name"), table(spark, d, "part").select("p_brand").distinct())


@query("mean_stdev_throughput", "SELECT event_type, round(avg(1e9 * 512 / (value * 1e6)), 6) AS mean, round(coalesce(stddev_samp(1e9 * 512 / (value * 1e6)), 0), 6) AS stdev, count(*) AS n FROM events GROUP BY event_type")
def mean_stdev_throughput(spark, d):
    e = table(spark, d, "events").withColumn("tps", A.throughput(F.lit(512), F.col("value") * 1e6))
    return A.mean_stdev(e, ["event_type"], "tps").select("event_type", R6("mean").alias("mean"), R6("stdev").alias("stdev"), "n")


@query("ppl_with_error", "SELECT event_type, count(*) AS n, round(exp(avg(ln(1 + value))), 6) AS ppl, round(sqrt(greatest(avg(ln(1 + value) ** 2) - avg(ln(1 + value)) ** 2, 0) / (count(*) - 1)) * exp(avg(ln(1 + value))), 6) AS ppl_err FROM events GROUP BY event_type")
def ppl_with_error(spark, d):
    e = table(spark, d, "events").withColumn("nll", F.log(1 + F.col("value")))
    return A.perplexity(e, ["event_type"], "nll").select("event_type", "n", R6("ppl").alias("ppl"), R6("ppl_err").alias("ppl_err"))


@query("strided_perplexity", """WITH r AS (SELECT user_id, ln(1 + value) AS nll, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT user_id, count(*) AS n, round(exp(avg(nll)), 6) AS ppl FROM r WHERE i >= 4 GROUP BY user_id""")
def strided_perplexity(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.log(1 + F.col("value")).alias("nll"))
    return A.perplexity(A.strided_positions(e, ["user_id"], "event_id", 8, 4), ["user_id"], "nll").select("user_id", "n", R6("ppl").alias("ppl"))


_ERR = "round(sqrt(greatest(avg(({0}) ** 2) - avg({0}) ** 2, 0) / (count(*) - 1)), 6)"


@query("kld_suite", f"""WITH e AS (SELECT event_type, ln(1 + value) AS b, ln(1 + value) * 1.1 + 0.01 * (event_id % 7) AS q, value / (100 + event_id % 13) AS k, event_id % 5 <> 0 AS same FROM events)
SELECT event_type, count(*) AS n, round(avg(q - b), 6) AS ln_ratio, {_ERR.format('q - b')} AS ln_ratio_err, round(corr(b, q), 6) AS correlation, round(avg(k), 6) AS kld_mean, {_ERR.format('k')} AS kld_err,
CASE WHEN count(*) >= 100 THEN round(max(k), 6) END AS kld_max, CASE WHEN count(*) >= 100 THEN round(min(k), 6) END AS kld_min,
{', '.join(f"CASE WHEN count(*) >= 100 THEN round(quantile_cont(k, {x}), 6) END AS kld_{n}" for n, x in A.KLD_POINTS.items())},
round(avg(exp(-q) - exp(-b)), 6) AS dp_mean, {_ERR.format('exp(-q) - exp(-b)')} AS dp_err, round(sqrt(avg((exp(-q) - exp(-b)) ** 2)), 6) AS dp_rms,
round(avg(CAST(same AS DOUBLE)), 6) AS same_top, {_ERR.format('CAST(same AS DOUBLE)')} AS same_top_err FROM e GROUP BY event_type""")
def kld_suite(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_type", F.log(1 + F.col("value")).alias("b"), (F.log(1 + F.col("value")) * 1.1 + 0.01 * (i % 7)).alias("q"), (F.col("value") / (100 + i % 13)).alias("k"), (i % 5 != 0).alias("same"))
    s = A.divergence_suite(e, ["event_type"], "b", "q", "k", "same").drop("base_mean", "mean")
    return s.select("event_type", "n", *[R6(c).alias(c) for c in s.columns if c not in ("event_type", "n")])


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type")
def percentiles(spark, d):
    p = selection.percentiles(table(spark, d, "events"), ["event_type"], "value", [0.05, 0.5, 0.999])
    return p.select("event_type", *[R6(F.get("points", F.lit(i))).alias(n) for i, n in enumerate(("p05", "p50", "p999"))])


@query("mean_and_uncertainty", """SELECT user_id, round(CASE WHEN count(*) >= 1 THEN sum(value) / count(*) ELSE 0 END, 6) AS mean,
round(CASE WHEN count(*) > 10 THEN sqrt(greatest(sum(value * value) / count(*) - (sum(value) / count(*)) ** 2, 0) / (count(*) - 1)) ELSE 0 END, 6) AS err FROM events GROUP BY user_id""")
def mean_and_uncertainty(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2"))
    m, e = A.mean_and_error(F.col("n"), F.col("s"), F.col("s2"))
    return s.select("user_id", R6(m).alias("mean"), R6(e).alias("err"))


@query("running_accuracy_wilson", f"""WITH r AS (SELECT doc_id, quality, doc_id % 4 AS part FROM labels), w AS (SELECT doc_id, part, count(*) OVER w AS n, avg(CAST(quality AS DOUBLE)) OVER w AS p FROM r WINDOW w AS (PARTITION BY part ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT doc_id, n, round(p, 6) AS accuracy, round((p + {A.Z} * {A.Z} / (2 * n) - {A.Z} * sqrt(p * (1 - p) / n + {A.Z} * {A.Z} / (4 * n * n))) / (1 + {A.Z} * {A.Z} / n), 6) AS low,
round((p + {A.Z} * {A.Z} / (2 * n) + {A.Z} * sqrt(p * (1 - p) / n + {A.Z} * {A.Z} / (4 * n * n))) / (1 + {A.Z} * {A.Z} / n), 6) AS high FROM w""")
def running_accuracy_wilson(spark, d):
    r = A.running_accuracy(table(spark, d, "labels").withColumn("part", F.col("doc_id") % 4), ["part"], "doc_id", "quality")
    return r.select("doc_id", "n", *[R6(c).alias(c) for c in ("accuracy", "low", "high")])


@query("argmax_task_accuracy", """WITH c AS (SELECT event_id // 4 AS task, event_id % 4 AS choice, value FROM events), b AS (SELECT task, arg_max(choice, (value, -choice)) AS choice FROM c GROUP BY task)
SELECT count(*) AS n, round(100 * avg(CAST(choice = task % 4 AS DOUBLE)), 6) AS acc, round(100 * sqrt(avg(CAST(choice = task % 4 AS DOUBLE)) * (1 - avg(CAST(choice = task % 4 AS DOUBLE))) / (count(*) - 1)), 6) AS err FROM b""")
def argmax_task_accuracy(spark, d):
    c = table(spark, d, "events").select(F.expr("event_id div 4").alias("task"), (F.col("event_id") % 4).alias("choice"), "value")
    b = A.best_choice(c, ["task"], "choice", "value").withColumn("correct", F.col("choice") == F.col("task") % 4)
    return A.accuracy(b, [], "correct").select("n", R6("acc").alias("acc"), R6("err").alias("err"))


@query("imatrix_col_stats", "SELECT label, CAST(i - 1 AS INTEGER) AS idx, round(sum(CAST(embedding[i] AS DOUBLE) ** 2), 6) AS sum_sq, count(*) AS n FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY label, i")
def imatrix_col_stats(spark, d):
    e = table(spark, d, "embeddings")
    halves = [A.column_activity(e.filter(F.col("vec_id") % 2 == i), ["label"], "embedding") for i in range(2)]
    return A.merge_activity(*halves).select("label", "idx", R6("sum_sq").alias("sum_sq"), "n")


@query("pass_ratio_pivot", "SELECT user_id % 20 AS grp, " + ", ".join(f"round(avg(CASE WHEN event_type = '{t}' THEN CAST(value > 50 AS DOUBLE) END), 6) AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def pass_ratio_pivot(spark, d):
    e = table(spark, d, "events").withColumn("grp", F.col("user_id") % 20)
    return A.pass_ratio_pivot(e, "grp", "event_type", ["click", "error", "purchase", "signup", "view"], F.col("value") > 50)


@query("tool_run_stats", "SELECT event_type, round(avg(CAST(value > 50 AS DOUBLE)), 6) AS success_ratio, round(avg(value), 6) AS avg_time, round(quantile_cont(value, 0.5), 6) AS median_time, CAST(count_if(value > 50) AS BIGINT) AS successes, count(DISTINCT CASE WHEN value <= 50 THEN user_id END) AS failing_users FROM events GROUP BY event_type")
def tool_run_stats(spark, d):
    ok = F.col("value") > 50
    e = table(spark, d, "events")
    median = selection.percentiles(e, ["event_type"], "value", [0.5]).select(F.col("event_type").alias("m_type"), R6(F.get("points", F.lit(0))).alias("median_time"))
    rates = e.groupBy("event_type").agg(R6(F.avg(ok.cast("double"))).alias("success_ratio"), R6(F.avg("value")).alias("avg_time"), F.count_if(ok).alias("successes"), F.countDistinct(F.when(~ok, F.col("user_id"))).alias("failing_users"))
    return rates.join(median, F.col("event_type").eqNullSafe(F.col("m_type")), "left").drop("m_type")


@query("newest_other_build", "SELECT o_orderpriority AS build FROM orders WHERE o_orderpriority NOT IN ('1-URGENT') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def newest_other_build(spark, d):
    o = table(spark, d, "orders")
    base = o.sparkSession.range(1).select(F.lit("1-URGENT").alias("o_orderpriority"))
    return o.join(F.broadcast(base), "o_orderpriority", "left_anti").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select(F.col("o_orderpriority").alias("build"))


# Samplers: a user's events are the candidates, value / 100 the logit.
_C = "c AS (SELECT user_id AS ctx, event_id AS id, value / 100 AS logit FROM events)"
_P = f"{_C}, sm AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY ctx)) AS e FROM c), p AS (SELECT ctx, id, logit, e / sum(e) OVER (PARTITION BY ctx) AS p, row_number() OVER (PARTITION BY ctx ORDER BY logit DESC, id) AS r FROM sm), q AS (SELECT *, sum(p) OVER (PARTITION BY ctx ORDER BY r ROWS UNBOUNDED PRECEDING) - p AS cum FROM p)"
_AFTER = "SELECT ctx, id, round(exp(logit - max(logit) OVER (PARTITION BY ctx)) / sum(exp(logit)) OVER (PARTITION BY ctx) * exp(max(logit) OVER (PARTITION BY ctx)), 6) AS p FROM "


def candidates(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("ctx"), F.col("event_id").alias("id"), (F.col("value") / 100).alias("logit"))


def _out(x):
    return S.softmax(x.select("ctx", "id", "logit")).select("ctx", "id", R6("p").alias("p"))


def _sampler(name: str, sql: str, f):
    query(name, sql)(lambda spark, d: _out(f(candidates(spark, d))))


_sampler("softmax_over_candidates", f"WITH {_C} {_AFTER} c", lambda c: c)
_sampler("sampler_top_k", f"WITH {_P} {_AFTER} q WHERE r <= 5", lambda c: S.top_k(c, 5))
_sampler("sampler_greedy", f"WITH {_P} {_AFTER} q WHERE r = 1", S.greedy)
_sampler("sampler_top_p", f"WITH {_P} {_AFTER} q WHERE cum < 0.6 - 1e-9 OR r <= 1", lambda c: S.top_p(c, 0.6))
_sampler("sampler_min_p", f"WITH {_P}, t AS (SELECT *, max(logit) OVER (PARTITION BY ctx) + ln(0.2) AS t FROM q) {_AFTER} t WHERE logit >= t OR r <= 1", lambda c: S.min_p(c, 0.2))
_sampler("sampler_typical", f"""WITH {_P}, h AS (SELECT *, sum(-p * ln(p)) OVER (PARTITION BY ctx) AS h FROM p), s AS (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(abs(-ln(p) - h), 12), logit DESC, id) AS tr FROM h),
t AS (SELECT *, sum(p) OVER (PARTITION BY ctx ORDER BY tr ROWS UNBOUNDED PRECEDING) - p AS tc FROM s) {_AFTER} t WHERE tc <= 0.5 + 1e-9 OR tr <= 1""", lambda c: S.typical(c, 0.5))
_sampler("sampler_temp", f"WITH {_C}, t AS (SELECT ctx, id, logit / 0.7 AS logit FROM c) {_AFTER} t", lambda c: S.temperature(c, 0.7))
_sampler("sampler_temp_dynamic", f"""WITH {_P}, h AS (SELECT *, count(*) OVER (PARTITION BY ctx) AS n, sum(-p * ln(p)) OVER (PARTITION BY ctx) AS h FROM p),
t AS (SELECT ctx, id, CASE WHEN n > 1 THEN logit / (0.5 + 1.0 * greatest(h / ln(n), 0)) ELSE logit END AS logit FROM h) {_AFTER} t""", lambda c: S.temperature_dynamic(c, 1.0, 0.5, 1.0))
_sampler("sampler_top_n_sigma", f"WITH {_C}, t AS (SELECT *, max(logit) OVER (PARTITION BY ctx) - 1.5 * stddev_pop(logit) OVER (PARTITION BY ctx) AS t FROM c) {_AFTER} t WHERE logit >= t", lambda c: S.top_n_sigma(c, 1.5))
_U = "CAST(CAST('0x' || substr(md5('{seed}|' || CAST(ctx AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
_sampler("sampler_xtc", f"""WITH {_P}, a AS (SELECT *, sum(CAST(p >= 0.02 AS INTEGER)) OVER (PARTITION BY ctx) AS a FROM q) {_AFTER} a
WHERE NOT ({_U.format(seed='xtc')} <= 0.5 AND a > 1) OR r >= a""", lambda c: S.xtc(c, 0.5, 0.02))
_sampler("sampler_dist", f"""WITH {_P}, u AS (SELECT *, {_U.format(seed='dist')} AS u, max(cum + p) OVER (PARTITION BY ctx) AS l FROM q), f AS (SELECT * FROM u WHERE cum + p > least(u, l - 1e-9) QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY r) = 1) {_AFTER} f""", lambda c: S.dist(c, "dist"))
_sampler("sampler_chain", f"WITH {_P}, k AS (SELECT ctx, id, logit / 0.8 AS logit FROM q WHERE r <= 20 AND logit >= (SELECT max(logit) FROM c c2 WHERE c2.ctx = q.ctx) + ln(0.3)) {_AFTER} k", lambda c: S.chain(c, lambda x: S.top_k(x, 20), lambda x: S.min_p(x, 0.3), lambda x: S.temperature(x, 0.8)))
_sampler("sampler_chain_rows", f"WITH {_P}, k AS (SELECT ctx, id, logit / 0.8 AS logit FROM q WHERE r <= 20 AND logit >= (SELECT max(logit) FROM c c2 WHERE c2.ctx = q.ctx) + ln(0.3)) {_AFTER} k", lambda c: rowwise.sample(c, ("top_k", 20), ("min_p", 0.3), ("temperature", 0.8)))


@query("sampler_penalties", f"""WITH {_C}, h AS (SELECT user_id AS ctx, event_id % 50 AS tok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
n AS (SELECT ctx, tok, count(*) AS n FROM h WHERE r <= 16 GROUP BY ctx, tok), k AS (SELECT ctx, id % 50 AS id, max(logit) - 2 AS logit FROM c GROUP BY ctx, id % 50)
SELECT k.ctx, k.id, round(CASE WHEN n > 0 THEN (CASE WHEN logit <= 0 THEN logit * 1.3 ELSE logit / 1.3 END) - n * 0.1 - 0.2 ELSE logit END, 6) AS logit FROM k LEFT JOIN n ON n.ctx = k.ctx AND n.tok = k.id""")
def sampler_penalties(spark, d):
    c = candidates(spark, d).withColumn("id", F.col("id") % 50).groupBy("ctx", "id").agg((F.max("logit") - 2).alias("logit"))
    h = table(spark, d, "events").select(F.col("user_id").alias("ctx"), F.col("event_id").alias("pos"), (F.col("event_id") % 50).alias("id"))
    return S.penalties(c, h, 16, 1.3, 0.1, 0.2).select("ctx", "id", R6("logit").alias("logit"))


@query("sampler_logit_bias", f"WITH {_C} SELECT ctx, id, round(logit + CASE WHEN id % 10 = 3 THEN 1.5 ELSE 0 END, 6) AS logit FROM c")
def sampler_logit_bias(spark, d):
    c = candidates(spark, d)
    bias = c.filter("id % 10 = 3").select("id", F.lit(1.5).alias("bias")).distinct()
    return S.logit_bias(c, bias).select("ctx", "id", R6("logit").alias("logit"))


@query("ranked_probabilities", f"WITH {_P} SELECT ctx, id, CAST(r AS INTEGER) AS rank, round(p, 6) AS p FROM q WHERE r <= 3")
def ranked_probabilities(spark, d):
    return S.ranked_report(candidates(spark, d), 3).select("ctx", "id", "rank", R6("p").alias("p"))


@query("sampler_dry")
def sampler_dry(spark, d):
    e = table(spark, d, "events")
    h = e.select(F.col("user_id").alias("ctx"), F.col("event_id").alias("pos"), (F.crc32("event_type") % 97).alias("id"))
    c = h.select("ctx", "id").distinct().withColumn("logit", F.lit(0.0))
    return S.dry(c, h, 1.0, 1.1, 2).select("ctx", "id", R6("logit").alias("logit"))


@query("sampler_mirostat_v2")
def sampler_mirostat_v2(spark, d):
    steps = candidates(spark, d).withColumn("step", F.expr("id % 5"))
    return S.mirostat_v2(steps, 3.0, 0.1).select("ctx", "step", "id", R6("mu").alias("mu"))


@query("sampler_mirostat")
def sampler_mirostat(spark, d):
    steps = candidates(spark, d).withColumn("step", F.expr("id % 5"))
    return S.mirostat(steps, 3.0, 0.1).select("ctx", "step", "id", R6("mu").alias("mu"))
