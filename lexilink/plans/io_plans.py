"""Formats, sharding, run bookkeeping and the encoder seam."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexilink.functions import text as T
from lexilink.operators import runs as R
from lexilink.operators import sharding as H
from lexilink.plans.catalog import register
from lexilink.sources import fixtures as S
from lexilink.sources import pubtator as P

PA, AN, KB = S.PASSAGES_SQL, S.ANNOTATIONS_SQL, S.KB_SQL
EV = "ev AS (SELECT user_id AS doc, event_type AS type, event_id AS id FROM events)"

@register("pubtator_parse", """SELECT c_custkey AS pmid, 10 AS start, 15 AS "end", c_name AS text, 'Gene' AS type, c_nationkey || '/' || c_mktsegment || '/7' AS ids, 'Effect of ' || c_name || ' (n|5).' AS title FROM customer""")
def pubtator_parse(spark, d):
    """What a file can hold besides annotations: relations, empty lines, bars in texts, prefixes, placeholders."""
    key = F.col("c_custkey").cast("string")
    lines = F.array(
        F.concat(key, F.lit("|t|Effect of "), "c_name", F.lit(" (n|5).")), F.concat(key, F.lit("|a|")), F.concat_ws("\t", key, F.lit("10"), F.lit("15"), "c_name", F.lit("Gene"), F.concat(F.lit("Tax:"), F.col("c_nationkey").cast("string"), F.lit(",MESH:"), "c_mktsegment", F.lit("|*7;-"))),
        F.concat_ws("\t", key, F.lit("Association"), F.lit("672"), F.lit("D001241"), F.lit("Novel")), F.lit(""),
    )
    each = S.table(spark, d, "customer").select(F.explode(lines).alias("value"))
    found = P.parse_annotations(each).join(P.parse_texts(each).where("kind = 't'").select("pmid", F.col("text").alias("title")), "pmid")
    return found.withColumn("ids", F.array_join("ids", "/"))


@register("pubtator_format", f"WITH {PA}, r AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY passage_id) AS k FROM pa) SELECT eid, eid || '|t|' || max(text) FILTER (WHERE k = 1) AS title, eid || '|a|' || coalesce(string_agg(text, ' ' ORDER BY k) FILTER (WHERE k > 1), '') AS abstract FROM r GROUP BY eid")
def pubtator_format(spark, d):
    return P.format_documents(S.passages(spark, d))


@register("pubtator_append", f"WITH {EV}, b AS (SELECT CAST(id % 2 AS INT) AS source, * FROM ev) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY source, id) AS INT) AS place, type, id FROM b")
def pubtator_append(spark, d):
    t = S.typed_annotations(spark, d)
    return P.append_annotations(t.where("id % 2 = 1"), t.where("id % 2 = 0"), "id")


@register("xml_sanitize", "SELECT doc_id, md5(replace(text, 'e', '?')) AS text FROM documents")
def xml_sanitize(spark, d):
    """Every `e` is first made a control character, which the sanitiser turns into `?`."""
    return S.table(spark, d, "documents").select("doc_id", F.md5(T.sanitize_xml(F.translate("text", "e", "\x01"))).alias("text"))


@register("concept_lines", f'WITH {AN} SELECT doc || \'||\' || start || \'|\' || "end" || \'||\' || status || \'||\' || flag || \'||\' || identifier || \'|\' || supplier AS line FROM an')
def concept_lines(spark, d):
    ids = F.array(F.col("identifier").cast("string"), F.col("supplier").cast("string"))
    return S.annotations(spark, d).select(P.concept_line(F.col("doc"), F.col("start"), F.col("end"), F.col("status"), F.col("flag"), ids).alias("line"))


@register("zip_align", "WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_name FROM customer), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_totalprice FROM orders) SELECT a.k, c_name, o_totalprice FROM a JOIN b USING (k)")
def zip_align(spark, d):
    a = H.global_row_number(S.table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], "k", 1)
    b = H.global_row_number(S.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "k", 1)
    return a.join(b, "k").select("k", "c_name", "o_totalprice")


@register("shard_addressing", "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS shard, (row_number() OVER (ORDER BY c_custkey) - 1) % 100 AS position FROM customer")
def shard_addressing(spark, d):
    rows = H.global_row_number(S.table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    shard, position = H.shard_address(F.col("row"), 100)
    return rows.select("c_custkey", shard.alias("shard"), position.alias("position"))


@register("fixed_chunks", "SELECT s, count(*) AS n, min(k) AS first FROM (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 64 AS s, c_custkey AS k FROM customer) GROUP BY s")
def fixed_chunks(spark, d):
    rows = H.global_row_number(S.table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return rows.groupBy(F.floor(F.col("row") / 64).cast("long").alias("s")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@register("ntile_shards", "SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) AS INT) AS shard FROM customer")
def ntile_shards(spark, d):
    customers = S.table(spark, d, "customer").select("c_custkey")
    rows = H.global_row_number(customers, ["c_custkey"]).join(F.broadcast(customers.agg(F.count("*").alias("total"))))
    return rows.select("c_custkey", H.near_equal_chunk(F.col("row"), F.col("total"), 7).alias("shard"))


@register("shard_sizes", "WITH s AS (SELECT (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS s FROM customer), n AS (SELECT s, count(*) AS n FROM s GROUP BY s) SELECT count(DISTINCT n) <= 2 AS valid, max(n) AS largest, count(*) AS shards FROM n")
def shard_sizes(spark, d):
    rows = H.global_row_number(S.table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    sizes = rows.groupBy(F.floor(F.col("row") / 100).alias("s")).agg(F.count("*").alias("n"))
    return sizes.agg((F.count_distinct("n") <= 2).alias("valid"), F.max("n").alias("largest"), F.count("*").alias("shards"))


@register("block_ranges", "WITH b AS (SELECT unnest(range(0, (SELECT count(*) FROM customer), 1000)) AS lo) SELECT lo, coalesce(lead(lo) OVER (ORDER BY lo), (SELECT count(*) FROM customer)) AS hi FROM b")
def block_ranges(spark, d):
    total = S.table(spark, d, "customer").agg(F.count("*").alias("n"))
    return total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long"))).alias("lo"), "n").select("lo", F.least(F.col("lo") + 1000, "n").alias("hi"))


@register("sink_roundtrip", "SELECT vec_id AS uid, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings")
def sink_roundtrip(spark, d):
    """Embeddings written in shards of fixed row counts and read back."""
    path = f"{R.scratch(spark)}/roundtrip-{uuid.uuid4().hex}"
    S.table(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), "embedding").write.option("maxRecordsPerFile", 200).option("compression", "gzip").parquet(path)
    return spark.read.parquet(path).select("uid", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@register("blink_mentions", f"WITH {AN} SELECT to_json({{'mention_id': doc * 100 + start, 'start_index': start, 'label_document_id': id}}) AS line FROM (SELECT *, unnest([identifier, supplier]) AS id FROM an WHERE NOT is_foreign)")
def blink_mentions(spark, d):
    each = S.annotations(spark, d).where("NOT is_foreign").withColumn("id", F.explode(F.array("identifier", "supplier")))
    return each.select(F.to_json(F.struct((F.col("doc") * 100 + F.col("start")).alias("mention_id"), F.col("start").alias("start_index"), F.col("id").alias("label_document_id"))).alias("line"))


@register("blink_contexts", f"WITH {AN} SELECT hexdigest, o_orderpriority AS context, p_name AS label FROM an JOIN orders ON doc = o_orderkey JOIN part ON identifier = p_partkey")
def blink_contexts(spark, d):
    contexts = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("context"))
    labels = S.table(spark, d, "part").select(F.col("p_partkey").alias("identifier"), F.col("p_name").alias("label"))
    return S.annotations(spark, d).join(contexts, "doc").join(labels, "identifier").select("hexdigest", "context", "label")


@register("type_filter", f"WITH {EV} SELECT doc, id FROM ev WHERE type <> 'view'")
def type_filter(spark, d):
    return S.typed_annotations(spark, d).where("type <> 'view'").select("doc", "id")


#: How types of several annotation schemes are named here.
TYPES = {"click": "gene", "purchase": "disease", "view": "chemical", "scroll": "species"}


@register("type_map", f"WITH {EV} SELECT id, CASE type WHEN 'click' THEN 'gene' WHEN 'purchase' THEN 'disease' WHEN 'view' THEN 'chemical' WHEN 'scroll' THEN 'species' ELSE 'other' END AS entity FROM ev")
def type_map(spark, d):
    lookup = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])
    return S.typed_annotations(spark, d).select("id", F.coalesce(lookup[F.col("type")], F.lit("other")).alias("entity"))


@register("gold_ids_normalise", f"WITH {AN} SELECT hexdigest, identifier || '/' || supplier AS ids FROM an")
def gold_ids_normalise(spark, d):
    raw = F.concat(F.lit("Tax:"), F.col("identifier").cast("string"), F.lit("|-,*"), F.col("supplier").cast("string"))
    return S.annotations(spark, d).select("hexdigest", F.array_join(P.normalise_ids(raw), "/").alias("ids"))


@register("json_roundtrip", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_roundtrip(spark, d):
    props = F.from_json("props", "k long")
    return S.table(spark, d, "events").select("event_id", F.from_json(F.to_json(F.create_map(F.lit("k"), props["k"].cast("string"))), "map<string,string>")["k"].cast("long").alias("k"))


@register("spec_parse", "SELECT p_partkey, p_type AS corpus, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'dev' END AS split, p_brand AS type FROM part")
def spec_parse(spark, d):
    split = F.when(F.col("p_size") % 2 == 0, F.lit("test")).otherwise(F.lit("dev"))
    specs = S.table(spark, d, "part").select("p_partkey", F.concat_ws(".", "p_type", split, "p_brand").alias("spec"))
    return R.parse_specs(specs, "spec").select("p_partkey", "corpus", "split", "type")


@register("config_digest", "SELECT c_custkey, sha256('{\"name\":\"' || c_name || '\",\"nation\":\"' || c_nationkey || '\",\"segment\":\"' || c_mktsegment || '\"}') AS digest FROM customer")
def config_digest(spark, d):
    c = S.table(spark, d, "customer")
    return c.select("c_custkey", R.config_digest({"segment": F.col("c_mktsegment"), "name": F.col("c_name"), "nation": F.col("c_nationkey")}).alias("digest"))


@register("run_registry", "WITH c AS (SELECT DISTINCT sha256(c_mktsegment) AS digest, c_mktsegment AS s FROM customer), k AS (SELECT digest, row_number() OVER (ORDER BY digest) - 1 AS run FROM c WHERE s < 'G'), f AS (SELECT digest, row_number() OVER (ORDER BY digest) + coalesce((SELECT max(run) FROM k), -1) AS run FROM c WHERE s >= 'G') SELECT * FROM k UNION ALL SELECT * FROM f")
def run_registry(spark, d):
    segments = S.table(spark, d, "customer").select("c_mktsegment").distinct().withColumn("digest", F.sha2("c_mktsegment", 256))
    known = R.register_runs(segments.where("c_mktsegment < 'G'").select("digest"), None)
    return R.register_runs(segments.select("digest"), known)


@register("run_naming", "SELECT c_custkey, 'run' || CASE WHEN c_custkey % 2 = 0 THEN '_ar' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN '_noph' ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '_nocs' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '_noctx' ELSE '' END AS name FROM customer")
def run_naming(spark, d):
    k = F.col("c_custkey")
    return S.table(spark, d, "customer").select("c_custkey", R.run_name(F.lit("run"), ar=k % 2 == 0, noph=k % 3 == 0, nocs=k % 5 == 0, noctx=k % 7 == 0).alias("name"))


@register("enum_domain", "SELECT c_mktsegment AS value, c_mktsegment IN ('BUILDING', 'MACHINERY') AS valid FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def enum_domain(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct().withColumn("valid", F.col("value").isin("BUILDING", "MACHINERY"))


@register("warmup_steps", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 100 AS BIGINT) ELSE CAST(floor(o_totalprice * 0.1) AS BIGINT) END AS steps FROM orders")
def warmup_steps(spark, d):
    warm = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 100).otherwise(F.lit(0.1)).cast("double")
    return S.table(spark, d, "orders").select("o_orderkey", R.warmup_steps(warm, F.col("o_totalprice"), F.col("o_orderkey") % 2 == 0).alias("steps"))


ML = "ml AS (SELECT user_id AS run, ts, event_id, value AS metric, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"


@register("running_loss", f"WITH {ML} SELECT run, CAST(step AS INT) AS step, CASE WHEN step > 1 THEN round(sum(metric) OVER (PARTITION BY run ORDER BY step) / (step - 1), 9) END AS by_index, round(sum(metric) OVER (PARTITION BY run ORDER BY step) / step, 9) AS mean FROM ml")
def running_loss(spark, d):
    return R.running_loss(S.metric_log(spark, d)).select("run", "step", F.round("by_index", 9).alias("by_index"), F.round("mean", 9).alias("mean"))


@register("best_checkpoint", f"WITH {ML}, b AS (SELECT run, step, metric, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ml) SELECT run, CAST(step AS INT) AS step, metric FROM b WHERE before IS NULL OR metric > before")
def best_checkpoint(spark, d):
    return R.best_so_far(S.metric_log(spark, d))


@register("best_run", f"WITH {ML} SELECT run, CAST(arg_max(step, {{'m': round(metric), 's': step}}) AS INT) AS step FROM ml GROUP BY run")
def best_run(spark, d):
    """The best rounded metric; of equals the last."""
    steps = R.with_steps(S.metric_log(spark, d)).withColumn("m", F.round("metric"))
    return steps.groupBy("run").agg(F.max_by("step", F.struct("m", "step")).alias("step"))


@register(
    "encode_seam",
    f"WITH {KB}, c AS (SELECT uid, list_transform(string_split(lower(name), ''), lambda c: ascii(c) % 32) AS codes FROM kb), n AS (SELECT uid, list_transform(generate_series(0, 31), lambda k: len(list_filter(codes, lambda x: x = k))) AS n FROM c), m AS (SELECT uid, n, sqrt(list_sum(list_transform(n, lambda x: x * x))) AS l FROM n) SELECT uid, k, round(CAST(CAST(n[k + 1] / l AS FLOAT) AS DOUBLE), 6) AS value FROM (SELECT *, unnest(generate_series(0, 31)) AS k FROM m)",
)
def encode_seam(spark, d):
    """Names through an encoder given as a function on texts."""
    from lexilink.functions.encoder import encode, letter_encoder

    vectors = encode(S.kb(spark, d).select("uid", "name"), "uid", "name", letter_encoder(32))
    return vectors.select("uid", F.posexplode("embedding").alias("k", "x")).select("uid", F.col("k").cast("long").alias("k"), F.round(F.col("x").cast("double"), 6).alias("value"))


_NORMAL = "list_transform({x}, lambda v: (v - list_avg({x})) / sqrt(list_var_pop({x}) + 1e-5))"


@register(
    "project_vectors",
    f"WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), b AS (SELECT vec_id, {_NORMAL.format(x='x')} AS x FROM a), c AS (SELECT vec_id, list_transform(generate_series(0, 15), lambda j: list_sum(list_transform(generate_series(0, 63), lambda i: x[i + 1] * ((i * 7 + j * 13) % 11 - 5) / 10))) AS y FROM b), e AS (SELECT vec_id, {_NORMAL.format(x='y')} AS y FROM c) SELECT vec_id, k, round(y[k + 1], 5) AS value FROM (SELECT *, unnest(generate_series(0, 15)) AS k FROM e)",
)
def project_vectors(spark, d):
    from lexilink.functions.encoder import Projection, project

    out = project(S.table(spark, d, "embeddings"), "vec_id", "embedding", Projection.stepped(64, 16))
    return out.select("vec_id", F.posexplode("embedding").alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("x", 5).alias("value"))
