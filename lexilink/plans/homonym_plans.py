"""Homonyms, dictionaries and identifiers of the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexilink.functions import text as T
from lexilink.operators import dictionary as D
from lexilink.operators import homonyms as H
from lexilink.operators import identifiers as I
from lexilink.plans.catalog import register
from lexilink.sources import fixtures as S

KB, FI = S.KB_SQL, S.FOREIGN_SQL
_FH = "fh AS (SELECT uid, foreign_identifier FROM kb WHERE name IN (SELECT name FROM kb GROUP BY name HAVING count(DISTINCT foreign_identifier) > 1))"
_NH = """nh AS (SELECT k.uid, k.identifier, k.name, k.foreign_identifier FROM kb k JOIN (SELECT name, foreign_identifier FROM kb GROUP BY ALL HAVING count(DISTINCT identifier) > 1) s
  ON k.name = s.name AND k.foreign_identifier = s.foreign_identifier)"""
_DN = """free AS (SELECT * FROM kb WHERE name NOT IN (SELECT name FROM nh)),
dn AS (SELECT identifier, coalesce(min(CASE WHEN description = 0 THEN {'n': length(name), 'name': name} END).name, min(CASE WHEN description <> 0 THEN {'n': length(name), 'name': name} END).name) AS d FROM free GROUP BY identifier)"""
_HD = f"""WITH {KB}, {FI}, {_FH}, {_NH}, {_DN},
hd AS (SELECT kb.uid, kb.identifier, kb.name, CASE WHEN fh.uid IS NULL THEN '' ELSE 'F:' || coalesce(foreign_name, '') || chr(31) END || CASE WHEN dn.d IS NULL THEN '' ELSE 'D:' || dn.d || chr(31) END AS disambiguation,
  dn.d, CASE WHEN fh.uid IS NULL THEN NULL ELSE coalesce(foreign_name, '') END AS f
  FROM kb LEFT JOIN fh ON kb.uid = fh.uid LEFT JOIN fi ON fh.foreign_identifier = fi.foreign_identifier LEFT JOIN nh ON kb.uid = nh.uid LEFT JOIN dn ON nh.identifier = dn.identifier)"""


@register("src_kb_scan", f"WITH {KB} SELECT uid, identifier, name, description FROM kb WHERE foreign_identifier = 2")
def src_kb_scan(spark, d):
    return S.kb(spark, d).where("foreign_identifier = 2").select("uid", "identifier", "name", "description")


@register("hd_foreign_homonyms", f"WITH {KB}, {_FH} SELECT * FROM fh")
def hd_foreign_homonyms(spark, d):
    return H.foreign_homonyms(S.kb(spark, d))


@register("hd_foreign", f"WITH {KB}, {FI}, {_FH} SELECT uid, foreign_identifier, foreign_name FROM fh JOIN fi USING (foreign_identifier)")
def hd_foreign(spark, d):
    return H.foreign_homonyms(S.kb(spark, d)).join(F.broadcast(S.foreign(spark, d)), "foreign_identifier").select("uid", "foreign_identifier", "foreign_name")


@register("hd_name_homonyms", f"WITH {KB}, {_NH}, {_DN} SELECT nh.uid, nh.foreign_identifier, dn.d AS disambiguation_name FROM nh LEFT JOIN dn USING (identifier)")
def hd_name_homonyms(spark, d):
    kb = S.kb(spark, d)
    found = H.name_homonyms(kb)
    return found.join(H.choose_names(kb, found), "identifier", "left").select("uid", "foreign_identifier", "disambiguation_name")


@register("hd_unique_name", f"{_HD} SELECT uid, identifier, disambiguation, name || CASE WHEN d IS NULL AND f IS NULL THEN '' ELSE ' (' || concat_ws(',', d, f) || ')' END AS unique_name FROM hd")
def hd_unique_name(spark, d):
    done = H.disambiguate(S.kb(spark, d), S.foreign(spark, d))
    return done.select("uid", "identifier", "disambiguation", H.unique_name(F.col("name"), F.col("disambiguation")).alias("unique_name"))


@register("hd_unique_violations", f"{_HD} SELECT name, disambiguation, count(*) AS n_rows FROM hd GROUP BY ALL HAVING count(*) > 1")
def hd_unique_violations(spark, d):
    return H.unique_violations(H.disambiguate(S.kb(spark, d), S.foreign(spark, d)))


@register("homonym_uids", f"WITH {KB}, {_FH}, {_NH} SELECT uid FROM fh UNION SELECT uid FROM nh")
def homonym_uids(spark, d):
    kb = S.kb(spark, d)
    return H.foreign_homonyms(kb).select("uid").union(H.name_homonyms(kb).select("uid")).distinct()


@register("kb_dictionary_nohd", f"WITH {KB} SELECT name, min(uid) AS uid, array_to_string(list_sort(list(identifier)), '|') AS identifiers FROM kb WHERE foreign_identifier IN (0, 1, 2) GROUP BY name")
def kb_dictionary_nohd(spark, d):
    found = D.name_dictionary(S.kb(spark, d), subset=[0, 1, 2])
    return found.select("name", "uid", F.concat_ws("|", F.transform("identifiers", lambda i: i.cast("string"))).alias("identifiers"))


@register("id_to_names", f"WITH {KB} SELECT identifier, count(DISTINCT name) AS n_names, string_agg(DISTINCT name, '|' ORDER BY name) AS names FROM kb GROUP BY identifier")
def id_to_names(spark, d):
    return D.id_to_names(S.kb(spark, d)).select("identifier", F.size("names").cast("long").alias("n_names"), F.array_join("names", "|").alias("names"))


@register("kb_subset", f"WITH {KB} SELECT uid, name, foreign_identifier FROM kb WHERE foreign_identifier IN (1, 3)")
def kb_subset(spark, d):
    return D.subset(S.kb(spark, d), [1, 3]).select("uid", "name", "foreign_identifier")


@register("kb_lookup_in", f"WITH {KB} SELECT uid, identifier, name FROM kb WHERE uid IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def kb_lookup_in(spark, d):
    keys = S.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("uid"))
    return S.kb(spark, d).join(keys, "uid", "left_semi").select("uid", "identifier", "name")


@register(
    "kb_synsets",
    f"""WITH {KB}, {FI}, g AS (SELECT identifier, min(uid) AS k, arg_min(name, uid) FILTER (WHERE description = 0) AS symbol, list_sort(list(DISTINCT name) FILTER (WHERE description = 1)) AS others, arg_min(foreign_name, uid) AS species
      FROM kb JOIN fi USING (foreign_identifier) GROUP BY identifier)
    SELECT identifier, coalesce(symbol, others[1]) AS title, CASE WHEN others IS NULL THEN '' ELSE coalesce(symbol, others[1]) || ' ( [' || species || '] ' || array_to_string(others, ' ; ') || ' )' END AS text FROM g""",
)
def kb_synsets(spark, d):
    return D.synsets(S.kb(spark, d).join(F.broadcast(S.foreign(spark, d)), "foreign_identifier"))


@register("kb_pipe_dictionary", f"WITH {KB} SELECT string_identifier || '||' || string_agg(DISTINCT name, '|' ORDER BY name) AS line FROM kb WHERE name <> '' GROUP BY string_identifier")
def kb_pipe_dictionary(spark, d):
    return D.pipe_dictionary(S.kb(spark, d))


_AN = S.ANNOTATIONS_SQL


@register("identifier_mapping", f"WITH {_AN}, {KB} SELECT hexdigest, kb.identifier FROM an JOIN part ON an.identifier = p_partkey JOIN (SELECT DISTINCT string_identifier, identifier FROM kb) kb ON kb.string_identifier = p_brand")
def identifier_mapping(spark, d):
    strings = S.table(spark, d, "part").select(F.col("p_partkey").alias("identifier"), F.array("p_brand").alias("ids"))
    rows = S.annotations(spark, d).join(strings, "identifier").select("hexdigest", "ids")
    mapping = S.kb(spark, d).select(F.col("string_identifier").alias("id"), F.col("identifier").alias("int_id")).distinct()
    return I.map_mandatory(rows, "hexdigest", "ids", mapping).select("hexdigest", F.col("int_id").alias("identifier"))


_HIST = "hist AS (SELECT p_partkey AS id, p_partkey + 100000 AS new_id FROM part WHERE p_partkey % 3 = 0)"


def _history(spark, d):
    return S.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 100000).alias("new_id"))


@register("identifier_canonical", f"WITH {_AN}, {_HIST} SELECT hexdigest, coalesce(new_id, identifier) AS identifier FROM an LEFT JOIN hist ON identifier = id")
def identifier_canonical(spark, d):
    return I.canonical(S.annotations(spark, d).select("hexdigest", "identifier"), "identifier", _history(spark, d))


@register("identifier_nil", f"WITH {_AN}, {_HIST} SELECT hexdigest, coalesce(CAST(new_id AS VARCHAR), 'NIL') AS identifier FROM an LEFT JOIN hist ON identifier = id")
def identifier_nil(spark, d):
    return I.or_nil(S.annotations(spark, d).select("hexdigest", "identifier"), "identifier", _history(spark, d))


@register("identifier_reverse", f"WITH {KB} SELECT s_suppkey AS doc, string_agg(DISTINCT string_identifier || '-' || uid, ',' ORDER BY string_identifier || '-' || uid) AS ids FROM supplier JOIN kb ON kb.identifier = 11 + s_suppkey % 20 GROUP BY s_suppkey")
def identifier_reverse(spark, d):
    ints = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"), (11 + F.col("s_suppkey") % 20).alias("int_id"))
    mapping = S.kb(spark, d).select(F.col("identifier").alias("int_id"), F.concat_ws("-", "string_identifier", "uid").alias("id"))
    return I.reverse(ints, "doc", mapping, lambda ids: F.array_join(ids, ","))


@register("identifier_normalise", f"WITH {_AN}, {_HIST} SELECT hexdigest, CASE WHEN is_foreign THEN -1 ELSE coalesce(new_id, identifier) END AS identifier FROM an LEFT JOIN hist ON identifier = id")
def identifier_normalise(spark, d):
    return I.normalise(S.annotations(spark, d), _history(spark, d)).select("hexdigest", "identifier")


@register("corpus_identifiers", f"WITH {_AN} SELECT DISTINCT identifier FROM an WHERE NOT is_foreign")
def corpus_identifiers(spark, d):
    return S.annotations(spark, d).where("NOT is_foreign").select("identifier").distinct()


@register("prefix_filter", "SELECT p_partkey AS uid, p_brand AS id FROM part WHERE starts_with(p_brand, 'Brand#2')")
def prefix_filter(spark, d):
    return S.table(spark, d, "part").where(F.startswith("p_brand", F.lit("Brand#2"))).select(F.col("p_partkey").alias("uid"), F.col("p_brand").alias("id"))


@register(
    "obsolete_filter",
    f"WITH {_AN}, {_HIST} SELECT count(*) AS n_mentions, count(*) FILTER (WHERE id IS NULL AND identifier % 2 = 1) AS n_obsolete FROM an LEFT JOIN hist ON identifier = id",
)
def obsolete_filter(spark, d):
    every = S.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") + 100000).when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("new_id"))
    rows = S.annotations(spark, d).select("hexdigest", F.array("identifier").alias("ids"))
    return I.obsolete_counts(I.with_history(rows, "hexdigest", "ids", every))


@register("last_wins_map", f"WITH {_AN} SELECT supplier AS key, arg_max(identifier, {{'d': doc, 's': start}}) AS value FROM an GROUP BY supplier")
def last_wins_map(spark, d):
    return D.last_wins(S.annotations(spark, d), "supplier", "identifier", ["doc", "start"])


@register("id_to_species", f"WITH {KB} SELECT k.identifier, arg_max(foreign_identifier, uid) AS species FROM kb k WHERE identifier IN (SELECT identifier FROM kb WHERE uid % 4 = 0) GROUP BY k.identifier")
def id_to_species(spark, d):
    kb = S.kb(spark, d)
    wanted = kb.where("uid % 4 = 0").select("identifier")
    return D.last_wins(kb.join(wanted, "identifier", "left_semi"), "identifier", "foreign_identifier", ["uid"]).withColumnsRenamed({"key": "identifier", "value": "species"})


@register("surrogate_keys", f"WITH {KB}, n AS (SELECT DISTINCT name FROM kb), known AS (SELECT name, row_number() OVER (ORDER BY name) AS code FROM n WHERE length(name) % 2 = 0), fresh AS (SELECT name, row_number() OVER (ORDER BY name) + (SELECT max(code) FROM known) AS code FROM n WHERE length(name) % 2 = 1) SELECT * FROM known UNION ALL SELECT * FROM fresh")
def surrogate_keys(spark, d):
    names = S.kb(spark, d).select("name").distinct()
    known = D.ordinal(names.where("length(name) % 2 = 0"), "name", "code", first=1)
    return D.assign_codes(names, known, "name", "code")


@register("name_normalise", f"WITH {KB} SELECT uid, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM kb")
def name_normalise(spark, d):
    return S.kb(spark, d).select("uid", T.normalise_name(F.col("name")).alias("name"))


@register("natural_sort", r"""SELECT name, row_number() OVER (ORDER BY regexp_replace(name, '\d+', '#', 'g'), CAST(regexp_extract(name, '(\d+)', 1) AS BIGINT), name) AS position FROM (SELECT 'shard_' || c_custkey || '.zarr' AS name FROM customer)""")
def natural_sort(spark, d):
    names = S.table(spark, d, "customer").select(F.concat(F.lit("shard_"), F.col("c_custkey").cast("string"), F.lit(".zarr")).alias("name"))
    return D.ordinal(names.withColumn("key", T.natural_key(F.col("name"))), "key", "position", first=1).select("name", "position")
