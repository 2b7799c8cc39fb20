"""Retrieval, candidates, loss and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexilink.operators import candidates as C
from lexilink.operators import dictionary as DI
from lexilink.operators import evaluation as E
from lexilink.operators import retrieval as R
from lexilink.operators.indexstore import knn_ivf as knn_ivf_search
from lexilink.plans.catalog import register
from lexilink.sources import fixtures as S

V, KB, AN = S.VECTORS_SQL, S.KB_SQL, S.ANNOTATIONS_SQL
_IP = "round(list_inner_product(qv.e, kv.e), 9)"
_L2 = "round(-list_sum(list_transform(list_zip(qv.e, kv.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9)"


def _top(k: int, score: str = _IP, name: str = "t") -> str:
    return f"{name} AS (SELECT * FROM (SELECT mention, gold, uid, identifier, {score} AS score, row_number() OVER (PARTITION BY mention ORDER BY {score} DESC, uid) AS rank FROM qv, kv) WHERE rank <= {k})"


def _ranked(spark, d, k):
    return R.knn(S.query_vectors(spark, d), S.kb_vectors(spark, d), k)


@register("knn_flat", f"WITH {V}, {_top(10)} SELECT mention, CAST(rank AS INT) AS rank, uid, round(score, 6) AS score FROM t")
def knn_flat(spark, d):
    return _ranked(spark, d, 10).withColumn("score", F.round("score", 6))


@register("knn_flat_l2", f"WITH {V}, {_top(10, _L2)} SELECT mention, CAST(rank AS INT) AS rank, uid, round(-score, 6) AS distance FROM t")
def knn_flat_l2(spark, d):
    found = R.knn(S.query_vectors(spark, d), S.kb_vectors(spark, d), 10, "l2")
    return found.select("mention", "rank", "uid", F.round(-F.col("score"), 6).alias("distance"))


@register("knn_sharded_merge", f"WITH {V}, {_top(5)} SELECT mention, CAST(rank AS INT) AS rank, uid FROM t")
def knn_sharded_merge(spark, d):
    """Each of four shards is searched alone; their top-k lists merge to the global one."""
    index = S.kb_vectors(spark, d)
    parts = [R.partial_top_k(index.where(F.col("uid") % 4 == s), ids, q, 5, "ip") for ids, q in R.query_blocks(S.query_vectors(spark, d)) for s in range(4)]
    return R.merge_top_k(reduce(DataFrame.unionByName, parts), 5).select("mention", "rank", "uid")


@register("knn_ivf", f"WITH {V} SELECT count(*) AS queries, true AS recall_reached, true AS scores_exact FROM qv")
def knn_ivf(spark, d):
    """Inverted cells against exact search: at least 0.9 of the true ten nearest are found, and what is found has its exact score."""
    found = knn_ivf_search(S.query_vectors(spark, d), S.kb_vectors(spark, d), 10, factor=3.5, recall=0.95)
    true = _ranked(spark, d, 10).select("mention", "uid", F.col("score").alias("exact"))
    both = true.join(found.select("mention", "uid", "score"), ["mention", "uid"], "left").groupBy("mention").agg(F.count("score").alias("hits"), F.count("*").alias("n"), F.max(F.abs(F.col("score") - F.col("exact"))).alias("off"))
    return both.agg(F.count("*").alias("queries"), (F.sum("hits") >= 0.9 * F.sum("n")).alias("recall_reached"), (F.coalesce(F.max("off"), F.lit(0.0)) < 1e-6).alias("scores_exact"))


@register("ivf_params", "SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS nlist, CAST(greatest(1, floor(sqrt(floor(sqrt(count(*)))) * 1.5)) AS BIGINT) AS nprobe FROM embeddings")
def ivf_params(spark, d):
    n = S.kb_vectors(spark, d).agg(F.count("*").alias("n"))
    cells = F.floor(F.sqrt("n"))
    return n.select(cells.cast("long").alias("nlist"), F.greatest(F.lit(1), F.floor(F.sqrt(cells) * 1.5)).cast("long").alias("nprobe"))


_KNOWN = "known AS (SELECT * FROM kv WHERE uid % 9 <> 0)"


@register("candidates_resolve", f"WITH {V}, {_KNOWN}, {_top(8)} SELECT t.mention, CAST(t.rank AS INT) AS rank, t.uid, coalesce(known.identifier, -100) AS identifier FROM t LEFT JOIN known ON t.uid = known.uid")
def candidates_resolve(spark, d):
    return C.resolve(_ranked(spark, d, 8), S.kb_vectors(spark, d).where("uid % 9 <> 0")).select("mention", "rank", "uid", "identifier")


@register("index_orphans", f"WITH {V}, {_KNOWN}, {_top(8)} SELECT DISTINCT uid FROM t WHERE uid NOT IN (SELECT uid FROM known)")
def index_orphans(spark, d):
    return C.orphans(_ranked(spark, d, 8), S.kb_vectors(spark, d).where("uid % 9 <> 0"))


@register("recall_at_k", f"WITH {V}, {_top(10)}, f AS (SELECT qv.mention, min(rank) AS first FROM qv LEFT JOIN t ON t.mention = qv.mention AND list_contains(t.gold, t.identifier) GROUP BY qv.mention) SELECT count(*) AS n, count(*) FILTER (WHERE first <= 1) AS hits_1, count(*) FILTER (WHERE first <= 5) AS hits_5, count(*) FILTER (WHERE first <= 10) AS hits_10 FROM f")
def recall_at_k(spark, d):
    resolved = C.resolve(_ranked(spark, d, 10), S.kb_vectors(spark, d))
    return E.recall_at(resolved, S.query_vectors(spark, d), [1, 5, 10])


@register("link_mentions", f"WITH {V}, {_top(3)} SELECT mention, string_agg(identifier, ',' ORDER BY rank) AS y_pred FROM t GROUP BY mention")
def link_mentions(spark, d):
    resolved = C.resolve(_ranked(spark, d, 3), S.kb_vectors(spark, d))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "identifier"))), lambda s: s["identifier"].cast("string"))
    return resolved.groupBy("mention").agg(F.array_join(ordered, ",").alias("y_pred"))


@register("candidate_labels", f"WITH {V}, {_top(8)} SELECT mention, CAST(rank AS INT) AS rank, uid, CAST(list_contains(gold, identifier) AS INT) AS label FROM t")
def candidate_labels(spark, d):
    return C.labelled(C.resolve(_ranked(spark, d, 8), S.kb_vectors(spark, d)), S.query_vectors(spark, d)).select("mention", "rank", "uid", "label")


@register("accuracy_at_index", f"WITH {V}, {_top(8)}, p AS (SELECT mention, list(CAST(list_contains(gold, identifier) AS INT) ORDER BY rank) AS y FROM t GROUP BY mention) SELECT round(avg(y[1 + (mention // 50) % 8]), 6) AS accuracy FROM p")
def accuracy_at_index(spark, d):
    rows = C.labelled(C.resolve(_ranked(spark, d, 8), S.kb_vectors(spark, d)), S.query_vectors(spark, d))
    y = rows.groupBy("mention").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("y"))
    return y.agg(F.round(F.avg(F.get("y", (F.col("mention") / 50 % 8).cast("int"))), 6).alias("accuracy"))


@register("marginal_nll", f"WITH {V}, {_top(16)}, e AS (SELECT mention, exp(score - max(score) OVER (PARTITION BY mention)) AS w, CAST(list_contains(gold, identifier) AS INT) AS y FROM t), m AS (SELECT mention, sum(w * y) / sum(w) AS s FROM e GROUP BY mention) SELECT mention, round(-ln(least(greatest(s, 1e-9), 1.0)), 6) AS nll FROM m WHERE s > 0")
def marginal_nll(spark, d):
    rows = C.labelled(C.resolve(_ranked(spark, d, 16), S.kb_vectors(spark, d)), S.query_vectors(spark, d))
    return C.marginal_nll(rows.select("mention", "score", "label")).withColumn("nll", F.round("nll", 6))


@register(
    "global_candidates",
    f"""WITH {V}, {_top(4)}, l AS (SELECT mention // 250 AS doc, mention, rank, uid FROM t), pool AS (SELECT DISTINCT doc, l.uid, e FROM l JOIN kv ON l.uid = kv.uid),
    near AS (SELECT a.doc, a.uid AS of_uid, b.uid, round(list_inner_product(a.e, b.e), 9) AS score FROM pool a JOIN pool b ON a.doc = b.doc),
    fo AS (SELECT l.doc, l.mention, l.rank, near.uid, row_number() OVER (PARTITION BY l.doc, l.mention, l.rank ORDER BY score DESC, near.uid) AS i FROM l JOIN near ON l.doc = near.doc AND l.uid = near.of_uid
      WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc = l.doc AND o.mention = l.mention AND o.uid = near.uid)),
    f AS (SELECT doc, mention, uid, min({{'i': i, 'rank': rank}}) AS k FROM fo GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc, mention ORDER BY k) AS place FROM f),
    c AS (SELECT doc, min(n) AS shortest FROM (SELECT l.doc, l.mention, count(DISTINCT r.uid) FILTER (WHERE place <= 16) AS n FROM l LEFT JOIN r ON l.doc = r.doc AND l.mention = r.mention GROUP BY ALL) GROUP BY doc)
    SELECT r.doc, mention, CAST(place AS INT) AS rank, uid FROM r JOIN c ON r.doc = c.doc WHERE place <= least(16, shortest)""",
)
def global_candidates(spark, d):
    local = _ranked(spark, d, 4).select(F.floor(F.col("mention") / 250).cast("long").alias("doc"), "mention", "rank", "uid")
    return C.global_candidates(local, S.kb_vectors(spark, d))


@register("l2_norms", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def l2_norms(spark, d):
    return S.table(spark, d, "embeddings").select("vec_id", F.round(C.l2_norm(F.col("embedding")), 6).alias("norm"))


@register("mention_pooling", "SELECT a.vec_id AS mention, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] + p[2]) / 2)), 6) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def mention_pooling(spark, d):
    e = S.table(spark, d, "embeddings")
    marks = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("mention"), F.col("embedding").alias("start")).join(e.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("mention"), F.col("embedding").alias("end")), "mention")
    pooled = F.zip_with("start", "end", lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    return marks.select("mention", F.round(F.aggregate(pooled, F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


# Predictions of spans and documents.
_GP = f"{AN}, gold AS (SELECT * FROM an WHERE status = 'O'), pred AS (SELECT doc, start, \"end\", supplier FROM an WHERE flag <> 'A')"


def _gold(spark, d):
    return S.annotations(spark, d).where("status = 'O'")


def _pred(spark, d):
    return S.annotations(spark, d).where("flag <> 'A'").select("doc", "start", "end", "supplier")


@register("gold_pred_join", f"WITH {_GP} SELECT pred.doc, pred.start, pred.supplier, coalesce(hexdigest, '-') AS hexdigest FROM pred LEFT JOIN gold ON pred.doc = gold.doc AND pred.start = gold.start AND pred.\"end\" = gold.\"end\"")
def gold_pred_join(spark, d):
    return E.reconcile(_pred(spark, d), _gold(spark, d)).select("doc", "start", "supplier", "hexdigest")


@register("ner_semi", f"WITH {_GP} SELECT doc, start FROM pred WHERE (doc, start, \"end\") IN (SELECT doc, start, \"end\" FROM gold)")
def ner_semi(spark, d):
    return _pred(spark, d).join(_gold(spark, d), ["doc", "start", "end"], "left_semi").select("doc", "start")


@register("ner_recall", f"WITH {_GP}, c AS (SELECT count(*) FILTER (WHERE (doc, start, \"end\") IN (SELECT doc, start, \"end\" FROM pred)) AS tp, count(*) AS n FROM gold) SELECT tp, n, round(100 * tp / n, 2) AS recall FROM c")
def ner_recall(spark, d):
    return E.ner_recall(_pred(spark, d), _gold(spark, d))


@register("doc_prf", """WITH g AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS id FROM lineitem WHERE l_linestatus = 'O'), p AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R'),
per AS (SELECT g.doc, count(*) AS ng, (SELECT count(*) FROM p WHERE p.doc = g.doc) AS np, count(p.id) AS tp FROM g LEFT JOIN p ON g.doc = p.doc AND g.id = p.id GROUP BY g.doc),
m AS (SELECT avg(CASE WHEN np > 0 THEN tp / np ELSE 0 END) AS p, avg(tp / ng) AS r FROM per) SELECT round(100 * p, 6) AS precision, round(100 * r, 6) AS recall, round(100 * 2 * p * r / (p + r), 6) AS f1 FROM m""")
def doc_prf(spark, d):
    rows = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("id"), "l_linestatus", "l_returnflag")
    return E.document_prf(rows.where("l_linestatus = 'O'").select("doc", "id"), rows.where("l_returnflag = 'R'").select("doc", "id"))


_MODELS = f"{AN}, mp AS (SELECT m AS model, hexdigest, identifier, supplier FROM an, (VALUES (2), (3), (5)) v(m) WHERE (doc + start // 10) % m <> 1)"


def _models(spark, d):
    """Three models, each with predictions for other mentions."""
    each = S.annotations(spark, d).withColumn("model", F.explode(F.array(*map(F.lit, (2, 3, 5)))))
    return each.where((F.col("doc") + F.floor(F.col("start") / 10)) % F.col("model") != 1)


@register("common_mentions", f"WITH {_MODELS} SELECT hexdigest FROM mp GROUP BY hexdigest HAVING count(DISTINCT model) = 3")
def common_mentions(spark, d):
    return E.common_mentions(_models(spark, d), 3)


@register("results_pivot", f"WITH {_MODELS} SELECT p_brand AS corpus, coalesce(CAST(max(CASE WHEN model = 2 THEN n END) AS VARCHAR), '-') AS \"2\", coalesce(CAST(max(CASE WHEN model = 3 THEN n END) AS VARCHAR), '-') AS \"3\", coalesce(CAST(max(CASE WHEN model = 7 THEN n END) AS VARCHAR), '-') AS \"7\" FROM (SELECT p_brand, model, count(*) AS n FROM mp JOIN part ON identifier = p_partkey GROUP BY ALL) GROUP BY p_brand")
def results_pivot(spark, d):
    brands = S.table(spark, d, "part").select(F.col("p_partkey").alias("identifier"), F.col("p_brand").alias("corpus"))
    counts = _models(spark, d).join(brands, "identifier").groupBy("corpus", "model").agg(F.count("*").alias("n"))
    return E.pivot_results(counts, "corpus", "model", "n", ["2", "3", "7"])


_RP = f"{AN}, r AS (SELECT doc AS mention, CAST(row_number() OVER (PARTITION BY doc ORDER BY start) AS INT) AS rank, CASE WHEN supplier % 3 = 0 THEN [supplier, supplier + 1] ELSE [supplier] END AS ids FROM an), g AS (SELECT doc AS mention, list_distinct(list(supplier + identifier % 2)) AS gold FROM an GROUP BY doc)"
_STD = "[list_transform(list_sort(list_transform(ids, lambda i: {'h': (i * 2654435761) % 1000003, 'id': i})), lambda s: s.id)[1]]"


def _ranks(spark, d):
    a = S.annotations(spark, d)
    ids = F.when(F.col("supplier") % 3 == 0, F.array("supplier", F.col("supplier") + 1)).otherwise(F.array("supplier"))
    ranks = a.select(F.col("doc").alias("mention"), F.row_number().over(Window.partitionBy("doc").orderBy("start")).alias("rank"), ids.alias("ids"))
    return ranks, a.groupBy(F.col("doc").alias("mention")).agg(F.collect_set(F.col("supplier") + F.col("identifier") % 2).alias("gold"))


for _mode, _member in (("strict", "CASE WHEN len(list_distinct(ids)) > 1 THEN [-1] ELSE ids END"), ("std", _STD), ("lenient", "ids")):
    for _k in (1, 3):

        def _recall(spark, d, mode=_mode, k=_k):
            return E.multi_label_recall(*_ranks(spark, d), k, mode)

        register(
            f"recall_{_mode}" if _k == 1 else f"recall_{_mode}_{_k}",
            f"WITH {_RP}, h AS (SELECT g.mention, bool_or(list_has_any({_member}, gold)) AS hit FROM g JOIN r ON g.mention = r.mention AND rank <= {_k} GROUP BY g.mention) SELECT count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(100 * count(*) FILTER (WHERE hit) / count(*), 2) AS recall FROM h",
        )(_recall)


@register(
    "species_filter",
    f"WITH {_RP}, e AS (SELECT mention, rank, unnest(ids) AS id FROM r), s AS (SELECT mention, rank, id, id % 5 = mention % 5 AS own FROM e) SELECT mention, rank, CASE WHEN bool_or(own) THEN string_agg(DISTINCT id, ',' ORDER BY id) FILTER (WHERE own) ELSE string_agg(DISTINCT id, ',' ORDER BY id) END AS ids FROM s GROUP BY mention, rank",
)
def species_filter(spark, d):
    ranks, gold = _ranks(spark, d)
    species = ranks.select(F.explode("ids").alias("identifier")).distinct().withColumn("species", F.col("identifier") % 5)
    assigned = gold.select("mention", (F.col("mention") % 5).cast("string").alias("assigned"))
    found = E.species_filtered(ranks, species, assigned)
    return found.select("mention", "rank", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@register("species_positions", f"WITH {_GP} SELECT hexdigest, nation.n_nationkey AS species FROM gold JOIN pred ON gold.doc = pred.doc AND gold.start = pred.start AND gold.\"end\" = pred.\"end\" JOIN supplier ON pred.supplier = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def species_positions(spark, d):
    species = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("species"))
    assigned = _pred(spark, d).join(species, "supplier").select("doc", "start", "end", "species")
    return _gold(spark, d).select("doc", "start", "end", "hexdigest").join(assigned, ["doc", "start", "end"]).select("hexdigest", "species")


@register("mention_hash_join", f"WITH {AN}, n AS (SELECT hexdigest, row_number() OVER (ORDER BY doc, start) - 1 AS mention_id, supplier FROM an) SELECT mention_id, hexdigest, supplier FROM n")
def mention_hash_join(spark, d):
    """Predictions by mention number get their digests through the inverse of the map digest -> number."""
    from lexilink.operators.sharding import global_row_number

    numbered = global_row_number(S.annotations(spark, d).select("doc", "start", "hexdigest", "supplier"), ["doc", "start"], "mention_id")
    inverse = DI.inverted(numbered.select("hexdigest", "mention_id"), "hexdigest", "mention_id")
    return numbered.select("mention_id", "supplier").join(inverse, "mention_id").select("mention_id", "hexdigest", "supplier")


@register("doc_top1_set", f"WITH {_RP} SELECT mention // 10 AS doc, string_agg(DISTINCT ids[1], ',' ORDER BY ids[1]) AS ids FROM r WHERE rank = 1 GROUP BY mention // 10")
def doc_top1_set(spark, d):
    first = _ranks(spark, d)[0].where("rank = 1").select(F.floor(F.col("mention") / 10).cast("long").alias("doc"), F.get("ids", F.lit(0)).alias("id"))
    return first.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_set("id")), lambda i: i.cast("string")), ",").alias("ids"))


@register("gold_extract", "SELECT sha256(l_orderkey || '-' || l_linenumber) AS hexdigest, arg_max(l_partkey, {'d': l_shipdate, 'p': l_partkey}) AS identifier FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 7 <> 0 GROUP BY l_orderkey, l_linenumber")
def gold_extract(spark, d):
    """Of the rows that repeat a mention the last one's identifier counts."""
    rows = S.table(spark, d, "lineitem").where("l_linestatus = 'O' AND l_partkey % 7 <> 0")
    keyed = rows.select(F.sha2(F.concat_ws("-", "l_orderkey", "l_linenumber"), 256).alias("hexdigest"), F.col("l_partkey").alias("identifier"), "l_shipdate")
    return DI.last_wins(keyed, "hexdigest", "identifier", ["l_shipdate", "identifier"]).select(F.col("key").alias("hexdigest"), F.col("value").alias("identifier"))


@register("mentions_extract", f"WITH {AN} SELECT hexdigest, p_name AS text, p_brand AS identifiers FROM an JOIN part ON identifier = p_partkey WHERE NOT is_foreign")
def mentions_extract(spark, d):
    part = S.table(spark, d, "part").select(F.col("p_partkey").alias("identifier"), F.col("p_name").alias("text"), F.col("p_brand").alias("identifiers"))
    return S.annotations(spark, d).where("NOT is_foreign").join(part, "identifier").select("hexdigest", "text", "identifiers")
