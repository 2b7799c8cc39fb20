"""Corpus preparation and text similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexilink.functions import text as T
from lexilink.operators import abbreviations as A
from lexilink.operators import corpus as C
from lexilink.operators import textsim as X
from lexilink.plans.catalog import register
from lexilink.sources import fixtures as S

PA, SE, KB, AN = S.PASSAGES_SQL, S.SENTENCES_SQL, S.KB_SQL, S.ANNOTATIONS_SQL
CLS, SEP, MS, ME = 101, 102, 1, 2


@register(
    "sentence_islands",
    f"WITH {SE}, a AS (SELECT *, CASE WHEN passage_id = 1 THEN 0 ELSE passage_id END AS p FROM se), b AS (SELECT *, CASE WHEN lag(p) OVER w IS DISTINCT FROM p THEN 1 ELSE 0 END AS s FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY sentence_id)), c AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY sentence_id) - 1 AS island FROM b) SELECT doc_id, CAST(island AS BIGINT) AS island, min(p) AS passage_id, count(*) AS n_sentences, md5(string_agg(text, ' ' ORDER BY sentence_id)) AS text_md5 FROM c GROUP BY doc_id, island",
)
def sentence_islands(spark, d):
    return C.sentence_islands(S.sentences(spark, d)).withColumn("text_md5", F.md5("text")).drop("text")


@register("passage_offsets", f'WITH {PA} SELECT eid, passage_id, CAST(coalesce(sum(length(text)) OVER (PARTITION BY eid ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM pa')
def passage_offsets(spark, d):
    return C.passage_offsets(S.passages(spark, d), "eid", "passage_id").select("eid", "passage_id", "offset")


@register("passages_nonempty", f"WITH {PA} SELECT eid, passage_id FROM pa WHERE contains(text, 'th')")
def passages_nonempty(spark, d):
    found = S.passages(spark, d).withColumn("annotations", F.regexp_extract_all("text", F.lit("th"), F.lit(0)))
    return found.where(F.size("annotations") > 0).select("eid", "passage_id")


@register("annotations_native", f"WITH {AN} SELECT doc, count(*) FILTER (WHERE NOT is_foreign) AS n FROM an GROUP BY doc")
def annotations_native(spark, d):
    docs = S.annotations(spark, d).groupBy("doc").agg(F.collect_list(F.struct("start", "is_foreign")).alias("annotations"))
    return docs.select("doc", F.size(F.filter("annotations", lambda a: ~a["is_foreign"])).cast("long").alias("n"))


@register("relative_offsets", f'WITH {AN} SELECT doc, start, start - (start // 30) * 30 AS rel_start, "end" - (start // 30) * 30 AS rel_end FROM an')
def relative_offsets(spark, d):
    offset = (F.floor(F.col("start") / 30) * 30).cast("long")
    return S.annotations(spark, d).select("doc", "start", (F.col("start") - offset).alias("rel_start"), (F.col("end") - offset).alias("rel_end"))


@register("merge_title_abstract", f"WITH {PA}, r AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY passage_id) AS k FROM pa) SELECT eid, -1 AS passage_id, string_agg(text, ' ' ORDER BY k) FILTER (WHERE k <= 2) AS text, count(*) AS n_passages FROM r GROUP BY eid")
def merge_title_abstract(spark, d):
    return C.merge_title_abstract(S.passages(spark, d))


@register("examples_regroup", f"WITH {PA} SELECT eid, count(*) AS n, md5(string_agg(text, '|' ORDER BY passage_id)) AS joined FROM pa GROUP BY eid")
def examples_regroup(spark, d):
    return C.regroup(S.passages(spark, d)).select("eid", F.size("passages").cast("long").alias("n"), F.md5(F.array_join("passages", "|")).alias("joined"))


@register("split_passages", f"WITH {PA} SELECT eid, passage_id, role, length(text) AS n FROM pa")
def split_passages(spark, d):
    packed = S.passages(spark, d).groupBy("eid").agg(F.array_sort(F.collect_list(F.struct("passage_id", "role", "text"))).alias("s"))
    arrays = packed.select("eid", F.col("s.passage_id").alias("passage_id"), F.col("s.role").alias("role"), F.col("s.text").alias("text"))
    return C.split_arrays(arrays, "eid", ["passage_id", "role", "text"]).select("eid", "passage_id", "role", F.length("text").cast("long").alias("n"))


@register("corpus_union", f"WITH {PA} SELECT 'train' AS split, count(*) AS n FROM pa WHERE eid % 3 = 0 UNION ALL SELECT 'dev', count(*) FROM pa WHERE eid % 3 = 1 UNION ALL SELECT 'test', count(*) FROM pa WHERE eid % 3 = 2")
def corpus_union(spark, d):
    p = S.passages(spark, d)
    return C.concat_splits({name: p.where(F.col("eid") % 3 == k) for k, name in enumerate(("train", "dev", "test"))}).groupBy("split").agg(F.count("*").alias("n"))


# Token arrays: word lengths of a passage, so that SQL can say them too.
_TOK = f"{PA}, tk AS (SELECT eid, passage_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INT)) AS tokens FROM pa)"
_PADL = "list_concat(list_transform(generate_series(1, greatest(0, {w} - len({a}))), lambda x: {v}), {a})"
_PADR = "list_concat({a}, list_transform(generate_series(1, greatest(0, {w} - len({a}))), lambda x: {v}))"


def _text(array: str) -> str:
    return f"array_to_string({array}, ' ')"


def _tokens(spark, d):
    return S.passages(spark, d).select("eid", "passage_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w)).alias("tokens"))


def _joined(array):
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


@register("tokenize_names", f"WITH {KB} SELECT uid, array_to_string(regexp_extract_all(lower(name), '[a-z]+|[0-9]'), ' ') AS tokens FROM kb")
def tokenize_names(spark, d):
    return S.kb(spark, d).select("uid", F.array_join(F.regexp_extract_all(F.lower("name"), F.lit("[a-z]+|[0-9]"), F.lit(0)), " ").alias("tokens"))


@register("pad_batch", f"WITH {_TOK}, s AS (SELECT eid, passage_id, tokens AS t FROM tk), w AS (SELECT eid, max(len(t)) AS w FROM s GROUP BY eid) SELECT s.eid, passage_id, {_text(_PADR.format(w='w', a='t', v='-1'))} AS padded, {_text(_PADL.format(w='w', a='t', v='-1'))} AS padded_left FROM s JOIN w USING (eid)")
def pad_batch(spark, d):
    rows = _tokens(spark, d).withColumn("left", F.col("tokens"))
    both = C.pad_batch(C.pad_batch(rows, "eid", "tokens").drop("width"), "eid", "left", "left")
    return both.select("eid", "passage_id", _joined("tokens").alias("padded"), _joined("left").alias("padded_left"))


@register("encode_names", f"WITH {_TOK} SELECT eid, passage_id, {_text(_PADR.format(w=16, a='list_concat([101], tokens[1:14], [102])', v='0'))} AS encoded FROM tk")
def encode_names(spark, d):
    return _tokens(spark, d).select("eid", "passage_id", _joined(C.encode_name(F.col("tokens"), 16, CLS, SEP)).alias("encoded"))


@register("add_special_tokens", f"WITH {_TOK}, p AS (SELECT eid, passage_id, list_transform(tokens, lambda x: x + 1) AS t, max(len(tokens)) OVER (PARTITION BY eid) + 2 AS w FROM tk) SELECT eid, passage_id, {_text(_PADR.format(w='w', a='list_concat([101], t, [102])', v='0'))} AS encoded FROM p")
def add_special_tokens(spark, d):
    rows = _tokens(spark, d).withColumn("tokens", F.transform("tokens", lambda x: x + 1))
    padded = C.pad_batch(rows, "eid", "tokens", value=0)
    return padded.select("eid", "passage_id", _joined(C.add_special_tokens(F.col("tokens"), CLS, SEP)).alias("encoded"))


@register("attention_mask", f"WITH {_TOK} SELECT eid, passage_id, {_text('list_transform(tokens, lambda x: CAST(x <> 2 AS INT))')} AS mask, {_text('list_transform(tokens, lambda x: CAST(x = 3 OR x = 4 AS INT))')} AS global_mask FROM tk")
def attention_mask(spark, d):
    t = F.col("tokens")
    return _tokens(spark, d).select("eid", "passage_id", _joined(C.attention_mask(t, 2)).alias("mask"), _joined(C.global_attention_mask(t, [3, 4])).alias("global_mask"))


@register("squeeze_mentions", f"WITH {_TOK} SELECT eid, passage_id, array_to_string(list_transform(list_filter(tokens, lambda x: x % 3 <> 0), lambda x: x || ',-1'), ' ') AS mentions FROM tk")
def squeeze_mentions(spark, d):
    """Tokens as mentions of two places, in sentences of three; those that are all padding go."""
    cell = lambda x: F.array(F.when(x % 3 == 0, -1).otherwise(x), F.lit(-1))
    sentences = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / 3).cast("int")), lambda i: F.transform(F.slice("tokens", 3 * i + 1, F.lit(3)), cell))
    done = F.transform(C.squeeze_mentions(sentences), lambda m: F.array_join(F.transform(m, lambda x: x.cast("string")), ","))
    return _tokens(spark, d).select("eid", "passage_id", F.array_join(done, " ").alias("mentions"))


@register("pad_empty", f"WITH {_TOK}, f AS (SELECT eid, passage_id, list_filter(tokens, lambda x: x > 12) AS t FROM tk) SELECT eid, passage_id, CASE WHEN len(t) = 0 THEN '-1' ELSE {_text('t')} END AS ids FROM f")
def pad_empty(spark, d):
    return _tokens(spark, d).select("eid", "passage_id", _joined(C.pad_empty(F.filter("tokens", lambda x: x > 12))).alias("ids"))


@register("reshape_rows", f"WITH {_TOK} SELECT eid, passage_id, i AS row, {_text('tokens[1 + 4 * i:4 + 4 * i]')} AS part FROM (SELECT *, unnest(generate_series(0, (len(tokens) - 1) // 4)) AS i FROM tk)")
def reshape_rows(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / 4).cast("int")), lambda i: F.slice("tokens", 1 + 4 * i, F.lit(4)))
    return _tokens(spark, d).select("eid", "passage_id", F.posexplode(rows).alias("row", "part")).select("eid", "passage_id", F.col("row").cast("long").alias("row"), _joined("part").alias("part"))


@register("extract_mentions", f"WITH {_TOK} SELECT eid, passage_id, array_to_string(list_transform(list_filter(list_zip(tokens, list_concat(tokens[2:], [0])), lambda p: p[1] > 7), lambda p: p[1] || ' ' || p[2]), '|') AS mentions FROM tk")
def extract_mentions(spark, d):
    """Every long word, with the length of the one after it, between marks; marks are no lengths."""
    after = F.concat(F.slice("tokens", F.lit(2), F.size("tokens")), F.array(F.lit(0)))
    marked = F.flatten(F.zip_with("tokens", after, lambda t, n: F.when(t > 7, F.array(F.lit(-1), t, n, F.lit(-2))).otherwise(F.array(t))))
    runs = F.transform(C.extract_mentions(marked, -1, -2), lambda m: F.array_join(F.transform(m, lambda x: x.cast("string")), " "))
    return _tokens(spark, d).select("eid", "passage_id", F.array_join(runs, "|").alias("mentions"))


@register("context_window", f"WITH {_TOK}, p AS (SELECT eid, passage_id, tokens[1:5] AS l, tokens[6:8] AS m, tokens[9:] AS r FROM tk), s AS (SELECT *, CAST(ceil((14 - len(m) - 2) / 2) AS INT) AS k FROM p) SELECT eid, passage_id, {_text('list_concat(l[greatest(1, len(l) - k + 1):], m, r[1:k])')} AS context FROM s")
def context_window(spark, d):
    t = F.col("tokens")
    return _tokens(spark, d).select("eid", "passage_id", _joined(C.context_window(F.slice(t, 1, 5), F.slice(t, 6, 3), F.slice(t, F.lit(9), F.size(t)), 14)).alias("context"))


@register("text_annotations", f"WITH {PA}, r AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY passage_id) - 1 AS k, sum(length(text)) OVER (PARTITION BY eid ORDER BY passage_id) - length(text) AS o FROM pa) SELECT eid, passage_id, CAST(CASE WHEN k < 2 THEN o + 3 ELSE 3 END AS BIGINT) AS start FROM r")
def text_annotations(spark, d):
    """Later passages get passage-relative offsets; title and abstract keep those of the document."""
    rows = C.passage_offsets(S.passages(spark, d), "eid", "passage_id")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("eid").orderBy("passage_id")) - 1
    return rows.select("eid", "passage_id", F.when(k < 2, F.col("offset") + 3).otherwise(3).cast("long").alias("start"))


_CUT = "least(4, length(text))"


@register("mention_context", f"WITH {PA} SELECT eid, passage_id, substr(text, 1, 4) AS l, substr(text, 10) AS r, substr(text, 11) AS r_skipped FROM pa")
def mention_context(spark, d):
    left, right = T.context(F.col("text"), F.lit(4), F.lit(9))
    return S.passages(spark, d).select("eid", "passage_id", left.alias("l"), right.alias("r"), T.context(F.col("text"), F.lit(4), F.lit(9), skip=1)[1].alias("r_skipped"))


@register("mention_markup", f"WITH {PA} SELECT eid, passage_id, substr(text, 1, 4) || 'START ' || substr(text, 5, 5) || ' END' || substr(text, 10) AS source, substr(text, 5, 5) || ' is' AS target FROM pa")
def mention_markup(spark, d):
    left, right = T.context(F.col("text"), F.lit(4), F.lit(9))
    mention = F.substring("text", 5, 5)
    return S.passages(spark, d).select("eid", "passage_id", F.concat(left, F.lit("START "), mention, F.lit(" END"), right).alias("source"), F.concat(mention, F.lit(" is")).alias("target"))


@register("mention_markers", f"WITH {PA} SELECT eid, passage_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) > 7 THEN '[MS] ' || w || ' [ME]' ELSE w END), ' ') AS marked FROM pa")
def mention_markers(spark, d):
    """Every word of more than seven letters is a mention."""
    p, keys = S.passages(spark, d), ["eid", "passage_id"]
    long = C.tokens_with_offsets(p, keys, "text").where(F.length("word") > 7)
    spans = long.groupBy(*keys).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return p.join(spans, keys, "left").select(*keys, C.mark_mentions(F.col("text"), F.coalesce("spans", none)).alias("marked"))


@register("char_to_token_spans", f"WITH {PA}, w AS (SELECT eid, passage_id, ws, unnest(generate_series(1, len(ws))) AS i FROM (SELECT *, string_split(text, ' ') AS ws FROM pa)), t AS (SELECT eid, passage_id, CAST(i - 1 AS INT) AS token, CAST(list_sum(list_concat([0], list_transform(ws[1:i - 1], lambda x: length(x) + 1))) AS BIGINT) AS s, length(ws[i]) AS n FROM w) SELECT a.eid, a.passage_id, a.s AS start, a.token AS first_token, b.token AS last_token FROM t a JOIN t b ON a.eid = b.eid AND a.passage_id = b.passage_id AND b.token = a.token + 1")
def char_to_token_spans(spark, d):
    """Spans over every two neighbouring words, found again among the words of their passage."""
    t = C.token_offsets(S.passages(spark, d), ["eid", "passage_id"], "text")
    pairs = F.greatest(F.size("starts") - 1, F.lit(0))
    spans = F.zip_with(F.slice("starts", F.lit(1), pairs), F.slice("ends", F.lit(2), pairs), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return C.char_to_token_spans(t.withColumn("spans", spans), ["eid", "passage_id"]).select("eid", "passage_id", "start", "first_token", "last_token")


@register("prefix_trie_next", "WITH s AS (SELECT DISTINCT string_split(p_type, ' ') AS t FROM part) SELECT DISTINCT array_to_string(t[1:i], ' ') AS prefix, t[i + 1] AS next FROM (SELECT t, unnest(generate_series(0, len(t) - 1)) AS i FROM s)")
def prefix_trie_next(spark, d):
    sequences = S.table(spark, d, "part").select(F.split("p_type", " ").alias("t")).distinct()
    return X.trie_children(sequences, "t").select(F.array_join("prefix", " ").alias("prefix"), "next")


_GRAM = "list_transform(generate_series(1, greatest(0, length({c}) - 2)), lambda i: substr({c}, i, 3))"


@register(
    "tfidf_best_name",
    f"""WITH {KB}, n AS (SELECT DISTINCT lower(name) AS name FROM kb), idf AS (SELECT g, ln((1.0 + (SELECT count(*) FROM n)) / (1.0 + count(*))) + 1.0 AS w FROM (SELECT DISTINCT name, unnest({_GRAM.format(c='name')}) AS g FROM n) GROUP BY g),
    m AS (SELECT p_partkey AS mention, lower(p_name) AS text, p_brand FROM part), c AS (SELECT m.mention, kb.uid AS ord, kb.name FROM m JOIN kb ON kb.string_identifier = m.p_brand),
    mv AS (SELECT mention, g, count(*) * any_value(w) AS x FROM (SELECT mention, unnest({_GRAM.format(c='text')}) AS g FROM m) JOIN idf USING (g) GROUP BY mention, g), mn AS (SELECT mention, sqrt(sum(x * x)) AS l FROM mv GROUP BY mention),
    cv AS (SELECT uid, g, count(*) * any_value(w) AS x FROM (SELECT uid, unnest({_GRAM.format(c='lower(name)')}) AS g FROM kb) JOIN idf USING (g) GROUP BY uid, g), cn AS (SELECT uid, sqrt(sum(x * x)) AS l FROM cv GROUP BY uid),
    sc AS (SELECT c.mention, c.ord, sum((mv.x / mn.l) * (cv.x / cn.l)) AS s FROM c JOIN mv ON c.mention = mv.mention JOIN cv ON cv.uid = c.ord AND cv.g = mv.g JOIN mn ON mn.mention = c.mention JOIN cn ON cn.uid = c.ord GROUP BY ALL)
    SELECT mention, ord, name, score FROM (SELECT c.mention, c.ord, c.name, round(coalesce(s, 0), 6) AS score, row_number() OVER (PARTITION BY c.mention ORDER BY round(coalesce(s, 0), 6) DESC, c.ord) AS k FROM c LEFT JOIN sc ON c.mention = sc.mention AND c.ord = sc.ord) WHERE k = 1""",
)
def tfidf_best_name(spark, d):
    kb = S.kb(spark, d)
    mentions = S.table(spark, d, "part").select(F.col("p_partkey").alias("mention"), F.col("p_brand").alias("key"), F.col("p_name").alias("text"))
    choices = kb.select(F.col("string_identifier").alias("key"), F.col("uid").alias("ord"), "name")
    return X.best_names(mentions, choices, X.inverse_frequencies(kb))


def _choices(spark, d):
    """(mention, text, identifier) of every name, and (identifier, choice): the distinct homonyms among an identifier's names."""
    kb = S.kb(spark, d)
    mentions = kb.select(F.col("uid").alias("mention"), T.fuzzy_process(F.col("name")).alias("text"), "identifier")
    choices = kb.join(_homonym_uids(kb), "uid", "left_semi").select("identifier", T.fuzzy_process(F.col("name")).alias("choice")).distinct()
    return mentions, choices


def _homonym_uids(kb):
    from lexilink.operators import homonyms as H

    return H.foreign_homonyms(kb).select("uid").union(H.name_homonyms(kb).select("uid")).distinct()


@register("indel_ratio")
def indel_ratio(spark, d):
    pairs = S.kb(spark, d).groupBy("identifier").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    return X.with_indel_ratio(pairs, "a", "b")


@register("ambiguous_mentions")
def ambiguous_mentions(spark, d):
    """How many mentions, names of the knowledge base, have a homonym among the names of their own identifier that is alike to so many percent."""
    mentions, choices = _choices(spark, d)
    return X.ambiguous_counts(mentions, choices, (80, 85, 95, 100))


_FUZZY = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g'))"


@register(
    "ambiguous_exact",
    f"""WITH {KB}, h AS (SELECT uid FROM kb WHERE name IN (SELECT name FROM kb GROUP BY name HAVING count(DISTINCT foreign_identifier) > 1) OR (name, foreign_identifier) IN (SELECT (name, foreign_identifier) FROM kb GROUP BY name, foreign_identifier HAVING count(DISTINCT identifier) > 1))
    SELECT count(DISTINCT m.uid) AS n FROM kb m JOIN kb c ON m.identifier = c.identifier AND {_FUZZY.format(c='m.name')} = {_FUZZY.format(c='c.name')} WHERE c.uid IN (SELECT uid FROM h)""",
)
def ambiguous_exact(spark, d):
    mentions, choices = _choices(spark, d)
    found = mentions.join(choices, "identifier").where(F.col("text") == F.col("choice"))
    return found.agg(F.count_distinct("mention").alias("n"))


# Abbreviations: parts stand for definitions, their initials for short forms.
_INITIALS = "upper(substr(p_name, 1, 1) || substr(string_split(p_name, ' ')[2], 1, 1))"
_PAIRS_SQL = "p AS (SELECT p_partkey AS doc, p_size AS ord, CASE WHEN p_size % 2 = 0 THEN 'a -' || p_brand ELSE p_brand END AS short, p_name || '-' || p_type AS long FROM part)"


def _initials():
    return F.upper(F.concat(F.substring("p_name", 1, 1), F.substring(F.get(F.split("p_name", " "), F.lit(1)), 1, 1)))


def _pairs(spark, d):
    short = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a -"), "p_brand")).otherwise(F.col("p_brand"))
    return S.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), F.col("p_size").alias("ord"), short.alias("short"), F.concat_ws("-", "p_name", "p_type").alias("long"))


@register("ab3p_output_parse", f"SELECT CAST(p_partkey AS INT) AS doc, {_INITIALS} AS short, p_name AS long, p_size / 100.0::DOUBLE AS score FROM part")
def ab3p_output_parse(spark, d):
    """A header, a row and a broken row for each part, as a finder prints them."""
    lines = F.array(F.concat(F.col("p_partkey").cast("string"), F.lit("|text of it")), F.concat(F.lit(" "), F.concat_ws("|", _initials(), "p_name", (F.col("p_size") / 100).cast("string"))), F.lit("broken|row"))
    each = S.table(spark, d, "part").select("p_partkey", F.posexplode(lines).alias("k", "line"))
    return A.parse_extractor_output(each.select((F.col("p_partkey") * 3 + F.col("k")).alias("ord"), "line"))


@register("abbr_clean", f"WITH {_PAIRS_SQL} SELECT * FROM p UNION ALL SELECT doc, ord, trim(replace(short, '-', '')), trim(replace(long, '-', '')) FROM p WHERE contains(short, ' -')")
def abbr_clean(spark, d):
    return C.clean_abbreviations(_pairs(spark, d))


@register("abbr_union", f"WITH {_PAIRS_SQL}, u AS (SELECT 1 AS o, doc, short, long FROM p UNION ALL SELECT 2, doc, short, upper(long) FROM p WHERE ord % 3 = 0) SELECT doc, short, arg_max(long, o) AS long FROM u GROUP BY doc, short")
def abbr_union(spark, d):
    p = _pairs(spark, d)
    later = p.where("ord % 3 = 0").select("doc", "short", F.upper("long").alias("long"))
    both = p.select("doc", "short", "long").withColumn("o", F.lit(1)).unionByName(later.withColumn("o", F.lit(2)))
    return C.last_dictionary(both, "o")


@register("abbr_expand", f"WITH {PA} SELECT eid, passage_id, md5(replace(replace(text, 'th', 'ter'), 'ter', 'long form')) AS expanded FROM pa")
def abbr_expand(spark, d):
    pairs = F.array(F.struct(F.lit("th").alias("short"), F.lit("ter").alias("long")), F.struct(F.lit("ter").alias("short"), F.lit("long form").alias("long")))
    return S.passages(spark, d).select("eid", "passage_id", F.md5(C.replace_in_order(F.col("text"), pairs)).alias("expanded"))


@register("remap_mentions", f"WITH {PA}, o AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY eid ORDER BY passage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o, string_split(text, ' ') AS ws FROM pa), w AS (SELECT eid, passage_id, o, ws, unnest(generate_series(1, len(ws))) AS i FROM o), f AS (SELECT eid, passage_id, ws[i] AS mention, o + CAST(list_sum(list_concat([0], list_transform(ws[1:i - 1], lambda x: length(x) + 1))) AS BIGINT) AS start FROM w WHERE ws[i] <> '') SELECT eid AS doc, CAST(passage_id AS BIGINT) AS passage_id, mention, start, start + length(mention) AS \"end\", CAST(row_number() OVER (PARTITION BY eid, passage_id ORDER BY start) AS INT) AS place FROM f")
def remap_mentions(spark, d):
    """Every word of every passage, found again in document offsets and in order of place."""
    p = C.passage_offsets(S.passages(spark, d), "eid", "passage_id")
    return A.remap_mentions(p.select(F.col("eid").alias("doc"), F.col("passage_id").cast("long").alias("passage_id"), F.col("offset").cast("long").alias("offset"), "text", F.split("text", " ", -1).alias("mentions")))


@register("abbr_extract", f"SELECT p_partkey AS doc, CAST(0 AS BIGINT) AS ord, {_INITIALS} AS short, p_name AS long FROM part")
def abbr_extract(spark, d):
    """A sentence that defines each part's initials, among other parentheses."""
    text = F.concat(F.lit("No (x) here. We saw the "), "p_name", F.lit(" ("), _initials(), F.lit(", old)."))
    return A.extract(S.table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@register("abbr_documents", "SELECT doc_id AS doc, 'XQZ' AS short, 'xeno quartz zone' AS long FROM documents WHERE text IS NOT NULL")
def abbr_documents(spark, d):
    """Every document, with one definition put in front of its text, is read for definitions."""
    docs = S.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("The xeno quartz zone (XQZ) is known.\n"), "text").alias("text"))
    return A.extract(docs, "doc_id", "text").where("short = 'XQZ'").select("doc", "short", "long")


@register("abbr_mentions", f"WITH {PA} SELECT eid, passage_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: replace(replace(w, 'th', 'ter'), 'er', 'long')), ' ')) AS mentions, md5(replace(replace(text, 'th', 'ter'), 'er', 'long')) AS text FROM pa")
def abbr_mentions(spark, d):
    """Short forms go from a text and from the mentions in it alike, here every word, also within a mention."""
    pairs = F.array(F.struct(F.lit("th").alias("short"), F.lit("ter").alias("long")), F.struct(F.lit("er").alias("short"), F.lit("long").alias("long")))
    rows = S.passages(spark, d).withColumns({"mentions": F.split("text", " ", -1), "pairs": pairs})
    done = A.expand(rows, "text", "mentions", "pairs")
    return done.select("eid", "passage_id", F.md5(F.array_join("mentions", " ")).alias("mentions"), F.md5("text").alias("text"))
