"""Queries over binary files that they write themselves (``sources.files``), over streams, of epochs and of chat templates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import templates
from ..functions import tensor as T
from ..operators import ngrams, training
from ..queries import query
from ..session import delete_on_exit, shared_dir, table
from ..sources import files, tasks
from ..streaming import answers, count_tables
from . import extraction

R = lambda c, n=6: F.round(c, n)


def _kept(d: DataFrame, form: str, **options) -> str:
    """Writes ``d`` in a format to a folder of its own and returns the folder."""
    files.register(d.sparkSession)
    path = f"{shared_dir(d.sparkSession)}/notewright/{form}-{uuid.uuid4().hex}"
    delete_on_exit(d.sparkSession, path)
    d.write.format(form).options(**{k: str(v) for k, v in options.items()}).mode("overwrite").save(path)
    return path


@query("tensor_file_rows", "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS FLOAT)::DOUBLE) AS a FROM embeddings) SELECT 'label.' || label AS tensor, vec_id AS row, CAST(i - 1 AS INTEGER) AS idx, round(a[i], 6) AS v FROM e, unnest(range(1, len(a) + 1)) AS t(i)")
def tensor_file_rows(spark, d):
    """The vectors as a tensor for each label, written by many tasks, and read again by byte ranges."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("label."), F.col("label")).alias("tensor"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("values"))
    path = _kept(e.repartition("tensor"), "gguf", type="F32")
    back = spark.read.format("gguf").option("path", path).option("range_bytes", 16_384).load()
    return back.select("tensor", "row", F.posexplode("values").alias("idx", "v")).withColumn("v", R("v"))


@query("tensor_file_filter", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE label IN (2, 5)) SELECT vec_id AS row, round(list_max(list_transform(a, lambda x: abs(x))), 3) AS top, len(a) AS n FROM e")
def tensor_file_filter(spark, d):
    """A filter on tensors' names leaves the ranges of all others unread."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("label."), F.col("label")).alias("tensor"), F.col("vec_id").alias("row"), F.col("embedding").cast("array<double>").alias("values"))
    path = _kept(e, "gguf", type="F64")
    back = spark.read.format("gguf").option("path", path).load().filter(F.col("tensor").isin("label.2", "label.5"))
    return back.select("row", R(F.array_max(F.transform("values", F.abs)), 3).alias("top"), F.size("values").cast("long").alias("n"))


@query("log_prob_file", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), s AS (SELECT vec_id, a, list_max(a) * 40 AS hi, list_sum(list_transform(a, lambda x: exp(x * 40 - list_max(a) * 40))) AS z FROM e), t AS (SELECT *, greatest(list_min(a) * 40, hi - 16) AS lo FROM s)
SELECT vec_id, round(CAST((hi - lo) / 65535 AS FLOAT)::DOUBLE * 65535, 3) AS width, round(CAST(lo - hi - ln(z) AS FLOAT)::DOUBLE, 3) AS low, CAST(floor(list_sum(list_transform(a, lambda x: CASE WHEN x * 40 > lo THEN round_even((x * 40 - lo) / ((hi - lo) / 65535), 0) ELSE 0 END)) / 1000) AS BIGINT) AS q_sum FROM t""")
def log_prob_file(spark, d):
    """Quantised log-probabilities as files of fixed records, a chunk for each vector."""
    e = table(spark, d, "embeddings").select("vec_id", tasks.quantise_log_probs(T.scale(F.col("embedding").cast("array<double>"), 40.0)).alias("x"))
    rows = e.select(F.col("vec_id").alias("chunk"), F.lit(0).alias("place"), F.col("x.scale").alias("scale"), F.col("x.low").alias("low"), F.col("x.q").alias("q"))
    path = _kept(rows.repartitionByRange(4, "chunk").sortWithinPartitions("chunk"), "logprobs", n_ctx=4)
    back = spark.read.format("logprobs").option("path", path).option("range_bytes", 32_768).load()
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
    return back.select(F.col("chunk").alias("vec_id"), R(F.col("scale") * 65535, 3).alias("width"), R("low", 3).alias("low"), F.floor(total / 1000).alias("q_sum"))


@query("ngram_cache_file", """WITH l AS (SELECT l_suppkey % 50 AS a, lead(l_suppkey % 50) OVER w AS b, lead(l_suppkey % 50, 2) OVER w AS c FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 50))
SELECT CAST(a AS VARCHAR) AS ngram, CAST(b AS INTEGER) AS next_token, count(*) AS cnt FROM l WHERE b IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT a || ' ' || b, CAST(c AS INTEGER), count(*) FROM l WHERE c IS NOT NULL GROUP BY 1, 2""")
def ngram_cache_file(spark, d):
    """Counts of tokens behind one and two others, written as cache files and read again by their index."""
    token = (F.col("l_suppkey") % 50).cast("int")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", token.alias("t")))), lambda x: x["t"]).alias("t"))
    at = rows.select("t", F.explode(F.sequence(F.lit(0), F.size("t") - 2)).alias("i")).filter("size(t) > 1")
    of = lambda n: F.when(F.col("i") + n < F.size("t"), F.struct(F.slice("t", F.col("i") + 1, n).alias("ngram"), F.get("t", F.col("i") + n).alias("next_token")))
    counts = at.select(F.explode(F.array(of(1), of(2))).alias("g")).filter("g is not null").groupBy("g.ngram", "g.next_token").agg(F.count("*").alias("cnt"))
    path = _kept(counts.repartition(4, "ngram").sortWithinPartitions("ngram", "next_token"), "ngram_cache", range_bytes=2_048)
    back = spark.read.format("ngram_cache").option("path", path).load()
    return back.select(F.array_join(F.transform("ngram", lambda x: x.cast("string")), " ").alias("ngram"), "next_token", "cnt")


# Streams


def _stream(spark, d: str, name: str) -> DataFrame:
    """A pattern, as a stream's path must not be a file."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _folder(spark, name: str) -> str:
    path = f"{shared_dir(spark)}/notewright/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


@query("ngram_stream", """WITH w AS (SELECT regexp_extract_all(text, '[0-9A-Za-z_]+') AS w FROM conversations), g AS (SELECT 1 AS n, w[i] AS ngram, w[i + 1] AS next_token FROM w, unnest(range(1, len(w))) AS t(i)
UNION ALL SELECT 2, w[i] || ' ' || w[i + 1], w[i + 2] FROM w, unnest(range(1, len(w) - 1)) AS t(i)) SELECT n, ngram, next_token, count(*) AS cnt FROM g GROUP BY 1, 2, 3""")
def ngram_stream(spark, d):
    """Counts behind one and two words, kept by a stream of conversations; the table is read when the stream has caught up."""
    path = _folder(spark, "ngram-stream")
    rows = _stream(spark, d, "conversations").select(ngrams.words(F.col("text")).alias("t"))
    count_tables.follow(rows, "t", f"{path}/table", f"{path}/checkpoint", 2).awaitTermination()
    return count_tables.read(spark, f"{path}/table")


@query("stop_string_stream", """WITH t AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN contains(t, '. ') THEN 'stop' END AS finished, md5(CASE WHEN contains(t, '. ') THEN split_part(t, '. ', 1) WHEN t LIKE '%.' THEN t[1:length(t) - 1] ELSE t END) AS said FROM t WHERE CASE WHEN contains(t, '. ') THEN TRUE ELSE rtrim(t, '.') <> '' END""")
def stop_string_stream(spark, d):
    """Conversations as streams of pieces up to the first end of a sentence; an ending that may begin the stop string is held back."""
    path = _folder(spark, "stop-strings")
    rows = _stream(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("no"), F.col("text").alias("piece"))
    out = answers.answers(rows, [". "])
    keep = lambda b, n: b.write.mode("overwrite").parquet(f"{path}/said/batch={n}")
    out.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    said = spark.read.schema("key bigint, part string, finished string, batch int").parquet(f"{path}/said")
    g = said.groupBy(F.col("key").alias("conv_id")).agg(F.max("finished").alias("finished"), F.array_sort(F.collect_list(F.struct("batch", "part"))).alias("s"))
    return g.select("conv_id", "finished", F.md5(F.array_join(F.transform("s", lambda x: x["part"]), "")).alias("said"))


# Extraction


@query("extraction_ledger", "SELECT conv_id AS entity, turn AS chunk_no, CASE WHEN text IS NOT NULL THEN length(text) || ':' || split_part(text, ' ', 1) END AS answer FROM conversations")
def extraction_ledger(spark, d):
    """A short answer to every message: a first run asks every other one, the second finds them in the ledger."""
    path = _folder(spark, "extraction")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("entity"), F.col("turn").alias("chunk_no"), F.col("text").alias("prompt"))

    def make():
        return lambda t: f"{len(t)}:{t.split(' ')[0]}"

    extraction.extract_resumed(c.filter("turn % 2 = 0"), make, path)
    return extraction.extract_resumed(c, make, path).select("entity", "chunk_no", "answer")


# Epochs

_Z = "(1 / (1 + exp(-(w0 + w1 * x1 + w2 * x2 + w3 * x3))) - y)"
_EPOCH = "e{1} AS (SELECT any_value(w0) - 0.5 * avg(" + _Z + ") AS w0, " + ", ".join(f"any_value(w{i}) - 0.5 * avg({_Z} * x{i}) AS w{i}" for i in (1, 2, 3)) + " FROM x, e{0})"


@query("fit_labels", rf"""WITH x AS (SELECT ln(1 + length(text)) / 10 AS x1, length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1) AS x2, length(regexp_replace(text, '[^#$%&*|]', '', 'g')) / greatest(length(text), 1) AS x3, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
e0 AS (SELECT 0::DOUBLE AS w0, 0::DOUBLE AS w1, 0::DOUBLE AS w2, 0::DOUBLE AS w3), {', '.join(_EPOCH.format(i, i + 1) for i in range(5))} SELECT unnest(range(0, 4))::INTEGER AS at, round(unnest([w0, w1, w2, w3]), 6) AS w FROM e5""")
def fit_labels(spark, d):
    """Five epochs of a logistic fit of quality on three rates of whole texts."""
    t = F.col("text")
    rate = lambda p: F.length(F.regexp_replace(t, p, "")) / F.greatest(F.length(t), F.lit(1))
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", (F.log1p(F.length(t)) / 10).alias("x1"), rate("[^A-Z]+").alias("x2"), rate("[^#$%&*|]+").alias("x3"))
    f = training.fit(x.join(table(spark, d, "labels"), "doc_id"), "doc_id", ["x1", "x2", "x3"], "quality", 5, step="sgd", rate=0.5, valid_percent=0)
    return spark.createDataFrame([(i, round(float(w), 6)) for i, w in enumerate(f.w)], "at int, w double")


# Chat templates of answers with tool calls

_M = "SELECT conv_id, turn, text, CASE WHEN role = 'user' AND turn % 5 = 4 THEN 'tool' ELSE role END AS role, role = 'assistant' AND turn % 4 = 3 AS calls, '{\"name\": \"find\", \"' AS before, '\": {\"turn\": ' || turn || '}}' AS after FROM conversations"
_SPELLED = {
    "hermes": ("''", "CASE WHEN role = 'tool' THEN '<|im_start|>tool\n<tool_response>\n' || text || '\n</tool_response><|im_end|>\n' ELSE '<|im_start|>' || role || '\n' || text || CASE WHEN calls THEN '\n<tool_call>\n' || before || 'arguments' || after || '\n</tool_call>' ELSE '' END || '<|im_end|>\n' END", "'<|im_start|>assistant\n'"),
    "llama3": ("'<s>'", r"'<|start_header_id|>' || CASE WHEN role = 'tool' THEN 'ipython' ELSE role END || '<|end_header_id|>" + "\n\n" + r"' || CASE WHEN calls THEN before || 'parameters' || after ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END || '<|eot_id|>'", "'<|start_header_id|>assistant<|end_header_id|>\n\n'"),
    "mistral": ("'<s>'", "CASE WHEN role IN ('user', 'system') THEN '[INST] ' || text || '[/INST]' WHEN role = 'tool' THEN '[TOOL_RESULTS] {\"content\": ' || to_json(text)::VARCHAR || '}[/TOOL_RESULTS]' WHEN calls THEN '[TOOL_CALLS] [' || before || 'arguments' || after || ']</s>' ELSE ' ' || text || '</s>' END", "''"),
}


def _family(name: str) -> None:
    bos, message, prompt = _SPELLED[name]

    @query(f"tool_template_{name}", f"WITH m AS ({_M}) SELECT conv_id, md5({bos} || string_agg({message}, '' ORDER BY turn) || {prompt}) AS digest FROM m GROUP BY conv_id")
    def render(spark, d):
        role = F.when((F.col("role") == "user") & (F.col("turn") % 5 == 4), "tool").otherwise(F.col("role"))
        call = F.struct(F.lit("find").alias("name"), F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")).alias("arguments"))
        calls = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), F.array(call)).otherwise(F.array().cast("array<struct<name:string,arguments:string>>"))
        m = table(spark, d, "conversations").withColumn("m", F.struct(role.alias("role"), F.col("text").alias("content"), calls.alias("calls")))
        m = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("x")).select("conv_id", F.transform("x", lambda x: x["m"]).alias("messages"))
        prompt = templates.compile_template(templates.FAMILIES[name], m.schema, add_generation_prompt=True, bos_token="<s>", eos_token="</s>")
        return m.select("conv_id", F.md5(prompt).alias("digest"))


for _name in _SPELLED:
    _family(_name)
