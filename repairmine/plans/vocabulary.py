"""Registered queries: vocabularies, encodings, padding and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.operators import tokens as K
from repairmine.operators import vocab as V
from repairmine.plans.registry import register
from repairmine.plans.text import D_PIECE
from repairmine.sources.tables import read_table

D_SPECIALS = "SELECT * FROM (VALUES ('<BEGIN>', 0, 1), ('<END>', 0, 1), ('<UNK>', 0, 1)) v(tok, cnt, sp)"


def d_vocab(tokens_sql: str, min_count: int = 1) -> str:
    return (f"voc AS (SELECT tok, CAST(cnt AS BIGINT) AS cnt, CAST(row_number() OVER (ORDER BY sp, cnt DESC, tok) - 1 "
            f"AS BIGINT) AS id FROM (SELECT tok, count(*) AS cnt, 0 AS sp FROM ({tokens_sql}) GROUP BY tok "
            f"HAVING count(*) >= {min_count} UNION ALL {D_SPECIALS}))")


D_DOC_TOKENS = f"SELECT doc_id, unnest(regexp_extract_all(text, {D_PIECE}, 2)) AS tok FROM documents"
D_DOC_POS = (f"dp AS (SELECT doc_id, unnest(regexp_extract_all(text, {D_PIECE}, 2)) AS tok, "
             f"generate_subscripts(regexp_extract_all(text, {D_PIECE}, 2), 1) AS p FROM documents)")


def _doc_tokens(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", K.tokens_of(F.col("text")).alias("toks"))


def _vocab(spark, sf_dir, min_count=1):
    t = _doc_tokens(spark, sf_dir).select(F.explode("toks").alias("tok"))
    return V.word_vocab(t, "tok", min_count)


@register("word_vocab", oracle=f"WITH {d_vocab(D_DOC_TOKENS)} SELECT tok, cnt, id FROM voc")
def q_word_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: word vocabulary of the documents with ids; labels appended."""
    return _vocab(spark, sf_dir).select("tok", F.col("cnt").cast("bigint").alias("cnt"),
                                        F.col("id").cast("bigint").alias("id"))


@register("vocab_size", oracle=f"WITH {d_vocab(D_DOC_TOKENS)} SELECT CAST(count(*) AS BIGINT) AS vocabulary_size FROM voc")
def q_vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V12."""
    return _vocab(spark, sf_dir).agg(F.count("*").cast("bigint").alias("vocabulary_size"))


D_ENC = f"""{d_vocab(D_DOC_TOKENS)},
cv AS (SELECT conv_id || '-' || turn AS doc_id, regexp_extract_all(text, {D_PIECE}, 2) AS toks FROM conversations),
dp AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM cv),
enc AS (SELECT dp.doc_id, dp.p, coalesce(voc.id, (SELECT id FROM voc WHERE tok = '<UNK>')) AS id
  FROM dp LEFT JOIN voc ON dp.tok = voc.tok)"""


def _turn_tokens(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"),
                    K.tokens_of(F.col("text")).alias("toks"))


@register("encode_words", oracle=f"""WITH {D_ENC}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY p)) AS ids_md5
FROM enc GROUP BY doc_id""")
def q_encode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: words of the conversations -> ids of the documents' vocabulary
    (words it lacks -> unknown id)."""
    e = V.encode_tokens(_turn_tokens(spark, sf_dir), "doc_id", "toks", _vocab(spark, sf_dir))
    return e.select("doc_id", F.size("ids").cast("bigint").alias("n"),
                    F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids_md5"))


@register("decode_words", oracle=f"""WITH {D_ENC}, dec AS (SELECT enc.doc_id, enc.p, voc.tok FROM enc JOIN voc ON enc.id = voc.id)
SELECT doc_id, md5(string_agg(tok, chr(1) ORDER BY p)) AS words_md5 FROM dec GROUP BY doc_id""")
def q_decode_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: ids back to words (unknown words come back as the unknown label)."""
    voc = _vocab(spark, sf_dir)
    e = V.encode_tokens(_turn_tokens(spark, sf_dir), "doc_id", "toks", voc)
    ex = e.select("doc_id", F.posexplode("ids").alias("p", "id"))
    w = ex.join(voc.select("id", "tok"), "id")
    return w.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("p", "tok"))), lambda x: x["tok"]), "\u0001")).alias("words_md5"))


@register("label_ends", oracle=f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {D_PIECE}, 2)) + 2 AS BIGINT) AS n,
  md5(array_to_string(list_concat(['<BEGIN>'], regexp_extract_all(text, {D_PIECE}, 2), ['<END>']), chr(1))) AS labeled_md5
FROM documents""")
def q_label_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: begin and end labels around each text."""
    d = _doc_tokens(spark, sf_dir).withColumn("l", V.label_ends(F.col("toks")))
    return d.select("doc_id", F.size("l").cast("bigint").alias("n"), F.md5(F.array_join("l", "\u0001")).alias("labeled_md5"))


D_PART_TOK = "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok FROM part"


@register("pad_texts", oracle=f"""WITH {d_vocab(D_PART_TOK)},
pw AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok, generate_subscripts(string_split(p_name, ' '), 1) AS p
  FROM part),
ids AS (SELECT p_partkey, list(voc.id ORDER BY p) AS ids FROM pw JOIN voc ON pw.tok = voc.tok GROUP BY p_partkey),
mx AS (SELECT max(len(ids)) AS m FROM ids)
SELECT p_partkey, array_to_string(list_concat(ids, list_transform(range(0, (SELECT m FROM mx) - len(ids)), lambda x: 0)), ',')
  AS padded FROM ids""")
def q_pad_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: word ids of part names padded with 0 to the longest name. The
    width is one scalar aggregate, read as a number."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ", -1).alias("toks"))
    voc = V.word_vocab(p.select(F.explode("toks").alias("tok")), "tok")
    e = V.encode_tokens(p, "p_partkey", "toks", voc)
    width = e.agg(F.max(F.size("ids"))).first()[0] or 0
    return e.select("p_partkey", F.array_join(F.transform(V.pad_to(F.col("ids"), F.lit(width), 0),
                                                          lambda i: i.cast("string")), ",").alias("padded"))


D_NGRAM_ITEMS = ("list_concat(['<BEGIN>'], regexp_extract_all(tok, '(?s).', 0), ['<END>'])")
D_NG = f"""pt AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok,
    generate_subscripts(string_split(p_name, ' '), 1) AS tp FROM part),
ng AS (SELECT p_partkey, tp, tok, unnest(list_transform(range(1, greatest(len({D_NGRAM_ITEMS}) - 2 + 1, 1) + 1),
    lambda i: array_to_string({D_NGRAM_ITEMS}[i:i + 1], chr(1)))) AS g,
    generate_subscripts(list_transform(range(1, greatest(len({D_NGRAM_ITEMS}) - 2 + 1, 1) + 1), lambda i: i), 1) AS gp
  FROM pt),
gv AS (SELECT g, CAST(row_number() OVER (ORDER BY g) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT g FROM ng))"""


def _part_words(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select("p_partkey", F.posexplode(F.split("p_name", " ", -1)).alias("tp", "tok"))


def _word_ngrams(words, n=2):
    """The n-grams ``gp, g`` of each distinct word."""
    g = words.select("tok").distinct().select("tok", F.posexplode(V.ngrams(F.col("tok"), n)).alias("gp", "gram"))
    return g.select("tok", "gp", F.array_join("gram", "\u0001").alias("g"))


def _ngram_vocab(g):
    return V.dense_ids(g.select("g").distinct(), [F.col("g")])


def _encoded_words(words):
    """``p_partkey, tp, ids``: the words of every part with their n-gram ids,
    which are looked up once a distinct word. An exploded table is many times
    what Spark takes it for from its file's size, so the joins are sorted:
    chosen by that size, a broadcast would hold all words in the driver."""
    g = _word_ngrams(words)
    ids = g.join(_ngram_vocab(g).hint("merge"), "g").groupBy("tok").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("gp", "id"))), lambda x: x["id"]).alias("ids"))
    return words.join(ids.hint("merge"), "tok").groupBy("p_partkey", "tp").agg(
        _one_list(F.collect_list("ids")).alias("ids"))


def _one_list(lists):
    """The ids of a place; those of several words there (of a repeated key) by
    their n-grams' places, then by id."""
    placed = F.flatten(F.transform(lists, lambda l: F.transform(l, lambda x, i: F.struct(i.alias("gp"), x.alias("id")))))
    return F.when(F.size(lists) == 1, F.element_at(lists, 1)).otherwise(
        F.transform(F.array_sort(placed), lambda x: x["id"]))


@register("char_ngram_vocab", oracle=f"WITH {D_NG} SELECT g AS gram, id FROM gv")
def q_char_ngram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: character bigrams of part-name words (with edge labels), sorted ids from 0."""
    return _ngram_vocab(_word_ngrams(_part_words(spark, sf_dir))).select(F.col("g").alias("gram"), F.col("id").cast("bigint").alias("id"))


@register("encode_ngrams", oracle=f"""WITH {D_NG},
e AS (SELECT ng.p_partkey, ng.tp, string_agg(CAST(gv.id AS VARCHAR), ',' ORDER BY ng.gp) AS ids FROM ng JOIN gv ON ng.g = gv.g
  GROUP BY ng.p_partkey, ng.tp)
SELECT p_partkey, string_agg(ids, '|' ORDER BY tp) AS encoded FROM e GROUP BY p_partkey""")
def q_encode_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: every word of a part name -> its list of n-gram ids."""
    text = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    per_tok = _encoded_words(_part_words(spark, sf_dir)).select("p_partkey", "tp", text.alias("ids"))
    return per_tok.groupBy("p_partkey").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("tp", "ids"))), lambda x: x["ids"]), "|").alias("encoded"))


@register("pad_ngrams", oracle=f"""WITH {D_NG},
e AS (SELECT ng.p_partkey, ng.tp, list(gv.id ORDER BY ng.gp) AS ids, max(length(ng.tok)) AS tl FROM ng JOIN gv ON ng.g = gv.g
  GROUP BY ng.p_partkey, ng.tp),
w AS (SELECT max(tl) + 2 AS tw FROM e),
t AS (SELECT p_partkey, count(*) AS nt FROM e GROUP BY p_partkey),
m AS (SELECT max(nt) AS mt FROM t),
pe AS (SELECT p_partkey, tp, array_to_string(list_concat(ids, list_transform(range(0, (SELECT tw FROM w) - len(ids)),
  lambda x: 0)), ',') AS s FROM e)
SELECT pe.p_partkey, string_agg(pe.s, '|' ORDER BY pe.tp) || repeat('|' || array_to_string(list_transform(
  range(0, (SELECT tw FROM w)), lambda x: 0), ','), CAST((SELECT mt FROM m) - t.nt AS BIGINT)) AS padded
FROM pe JOIN t ON pe.p_partkey = t.p_partkey GROUP BY pe.p_partkey, t.nt""")
def q_pad_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: n-gram ids padded on both levels: token width = longest word + 2,
    text length = most words in a name (two scalar maxima)."""
    words = F.split("p_name", " ", -1)
    longest, most = read_table(spark, sf_dir, "part").agg(
        F.max(F.array_max(F.transform(words, F.length))), F.max(F.size(words))).first()
    tw, mt = (longest or 0) + 2, max(most or 0, 0)
    per_part = _encoded_words(_part_words(spark, sf_dir)).groupBy("p_partkey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tp", V.pad_to(F.col("ids"), F.lit(tw), 0).alias("x")))),
                    lambda x: x["x"]).alias("rows"))
    empty_row = F.array_repeat(F.lit(0).cast("bigint"), tw)
    padded = F.concat("rows", F.array_repeat(empty_row, (F.lit(mt) - F.size("rows")).cast("int")))
    return per_part.select("p_partkey", F.array_join(F.transform(padded, lambda r: F.array_join(
        F.transform(r, lambda i: i.cast("string")), ",")), "|").alias("padded"))


# --- nested padding on event weeks, batches ---------------------------------------

D_WEEKS_NESTED = """ev AS (SELECT user_id, CAST(floor((dayofmonth(ts) - 1) / 7) AS BIGINT) AS week, ts, event_id,
    CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4
    WHEN 'purchase' THEN 5 ELSE 0 END AS code FROM events WHERE user_id IS NOT NULL),
wk AS (SELECT user_id, week, list(code ORDER BY ts, event_id) AS codes FROM ev GROUP BY user_id, week),
us AS (SELECT user_id, list(codes ORDER BY week) AS rows FROM wk GROUP BY user_id),
dims AS (SELECT (SELECT max(len(rows)) FROM us) AS d0, (SELECT max(len(codes)) FROM wk) AS d1),
ud AS (SELECT us.user_id, us.rows, dims.d0, dims.d1 FROM us, dims),
pd AS (SELECT user_id, list_concat(list_transform(rows, lambda r: list_concat(r, list_transform(
    range(0, d1 - len(r)), lambda x: -1))),
  list_transform(range(0, d0 - len(rows)), lambda x: list_transform(range(0, d1), lambda y: -1))) AS box FROM ud)"""

# Event type codes used by the nested-padding queries.
EVENT_CODES = {"signup": 1, "error": 2, "click": 3, "view": 4, "purchase": 5}
FILL = -1


def nested_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, the list (by week) of event-code lists (by time)."""
    from repairmine.functions.dicts import encode
    ev = read_table(spark, sf_dir, "events").where(F.col("user_id").isNotNull())
    ev = ev.select("user_id", F.floor((F.dayofmonth("ts") - 1) / 7).cast("bigint").alias("week"), "ts", "event_id",
                   F.coalesce(encode(F.col("event_type"), EVENT_CODES), F.lit(0)).alias("code"))
    wk = ev.groupBy("user_id", "week").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "code"))),
                                                       lambda x: x["code"]).alias("codes"))
    return wk.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("week", "codes"))),
                                                 lambda x: x["codes"]).alias("rows"))


def _box_text(c):
    return F.array_join(F.transform(c, lambda r: F.array_join(F.transform(r, lambda i: i.cast("string")), ",")), "|")


@register("pad_nested", oracle=f"""WITH {D_WEEKS_NESTED}
SELECT user_id, array_to_string(list_transform(box, lambda r: array_to_string(r, ',')), '|') AS box FROM pd""")
def q_pad_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9 on event weeks (fill -1)."""
    return V.pad_nested(nested_weeks(spark, sf_dir), "rows", FILL, depth=2).select("user_id", _box_text(F.col("box")).alias("box"))


@register("padded_access", oracle=f"""WITH {D_WEEKS_NESTED}
SELECT user_id, CAST(box[1][2] AS BIGINT) AS v_0_1, CAST(coalesce(box[2][100], -1) AS BIGINT) AS v_1_99,
  CAST(list_position(flatten(box), 5) AS BIGINT) AS first_purchase,
  CAST(list_position(flatten(box)[4:20], 5) + 2 AS BIGINT) AS purchase_in_3_20,
  CAST(len(list_filter(flatten(box), lambda x: x = -1)) AS BIGINT) AS n_fill,
  CAST(list_contains(flatten(box), 2) AS INTEGER) AS has_error FROM pd""")
def q_padded_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, search and count in the padded view; an element past the
    data reads as the fill value."""
    b = V.pad_nested(nested_weeks(spark, sf_dir), "rows", FILL)
    flat = F.flatten("box")
    return b.select("user_id",
                    F.element_at(F.element_at("box", 1), 2).cast("bigint").alias("v_0_1"),
                    F.coalesce(F.try_element_at(F.element_at("box", 2), F.lit(100)), F.lit(FILL)).cast("bigint")
                    .alias("v_1_99"),
                    F.when(F.array_position(flat, 5) > 0, F.array_position(flat, 5)).cast("bigint")
                    .alias("first_purchase"),
                    V.find(flat, 5, 3, 20).cast("bigint").alias("purchase_in_3_20"),
                    F.size(F.filter(flat, lambda x: x == FILL)).cast("bigint").alias("n_fill"),
                    F.array_contains(flat, 2).cast("int").alias("has_error"))


@register("batches", oracle="""
WITH r AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events)
SELECT CAST(floor(rn / 32) AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_event,
  max(event_id) AS last_event, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY event_id) AS user_ids
FROM r GROUP BY floor(rn / 32)""")
def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed batches of 32 rows over parallel columns, by a global
    order computed without a single-task sort (dense ids)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    r = V.dense_ids(ev, [F.col("event_id")], id_col="rn").withColumn("batch", F.floor(F.col("rn") / 32))
    return r.groupBy("batch").agg(
        F.count("*").cast("bigint").alias("n"), F.min("event_id").alias("first_event"),
        F.max("event_id").alias("last_event"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "user_id"))),
                                 lambda x: x["user_id"].cast("string")), ",").alias("user_ids")).select(
        F.col("batch").cast("bigint").alias("batch"), "n", "first_event", "last_event", "user_ids")
