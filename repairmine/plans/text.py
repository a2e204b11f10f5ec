"""Registered queries: cleaning (C*), projections (P*), lines (L*), tokens (K*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repairmine.functions import clean as C
from repairmine.functions.dicts import LANGUAGE, VERDICT, decode, encode
from repairmine.operators import lines as L
from repairmine.operators import tokens as K
from repairmine.plans.registry import register
from repairmine.plans.sqltext import case_map, q
from repairmine.sources.submissions import SUB_CTE, dealt_submissions, problems, submissions, typed_submissions
from repairmine.sources.tables import read_table

# --- DuckDB forms of the cleaning steps (valid for the inputs named) --------
D_C1 = "replace(replace({t}, chr(65279), ''), chr(12288), ' ')"
D_C2 = "array_to_string(regexp_extract_all({t}, " + q("('.*?'|\".*?\"|[^ \\t\\r\\f\\x0B\"']+)") + ", 1), ' ')"
D_C3 = "replace({t}, chr(13), '')"
D_C4 = "regexp_replace({t}, " + q("(?s:/\\*.*?\\*/)|//[^\\r\\n]*") + ", '', 'g')"  # texts without quotes
D_SPACE = q(C.RE2_PY_SPACE + "+")
D_C5 = ("array_to_string(list_filter(string_split({t}, chr(10)), "
        "lambda l: regexp_replace(l, " + D_SPACE + ", '', 'g') <> ''), chr(10))")
D_STRIP = ("regexp_replace({t}, " + q("^" + C.RE2_PY_SPACE + "+|" + C.RE2_PY_SPACE + "+$") + ", '', 'g')")
D_PIECE = q(K.RX_PIECE)


D_TRIM = "CASE WHEN length({t}) < 2 THEN '' ELSE substring({t}, 2, length({t}) - 2) END"
D_SUBT = (SUB_CTE + ", subt AS (SELECT id, problem_name, user_id, problem_user_id, language, status, "
          + case_map("language", LANGUAGE) + " AS language_code, " + case_map("status", VERDICT)
          + " AS status_code, " + D_TRIM.replace("{t}", "code") + " AS code FROM sub)")


def d(form: str, t: str) -> str:
    return form.replace("{t}", t)


def d_clean(t: str) -> str:
    return d(D_C5, d(D_C4, d(D_C3, d(D_C2, d(D_C1, t)))))


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _digest(c):
    return [F.md5(c).alias("md5"), F.length(c).cast("bigint").alias("n_chars")]


# --- C: cleaning -------------------------------------------------------------

@register("clean_odd_chars", oracle=f"""
SELECT doc_id, md5({d(D_C1, 'text')}) AS md5, CAST(length({d(D_C1, 'text')}) AS BIGINT) AS n_chars FROM documents""")
def q_clean_odd_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_digest(C.strip_odd_chars(F.col("text"))))


@register("collapse_blanks", oracle=f"""
SELECT doc_id, md5({d(D_C2, 'text')}) AS md5, CAST(length({d(D_C2, 'text')}) AS BIGINT) AS n_chars FROM documents""")
def q_collapse_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_digest(C.collapse_blanks(F.col("text"))))


@register("drop_cr", oracle=f"""
WITH {SUB_CTE} SELECT id, {d(D_C3, 'code')} AS code FROM sub""")
def q_drop_cr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions(spark, sf_dir).select("id", C.drop_cr(F.col("code")).alias("code"))


@register("strip_comments", oracle=f"""
WITH {SUB_CTE} SELECT id, {d(D_C4, 'code')} AS code FROM sub""")
def q_strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions(spark, sf_dir).select("id", C.strip_comments(F.col("code")).alias("code"))


@register("drop_blank_lines", oracle=f"""
SELECT doc_id, md5({d(D_C5, 'text')}) AS md5, CAST(length({d(D_C5, 'text')}) AS BIGINT) AS n_chars FROM documents""")
def q_drop_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", *_digest(C.drop_blank_lines(F.col("text"))))


@register("clean_code", oracle=f"""
WITH {D_SUBT} SELECT id, {d_clean('code')} AS code FROM subt""")
def q_clean_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 on the submissions as read (ends trimmed)."""
    return typed_submissions(submissions(spark, sf_dir)).select("id", C.clean_code(F.col("code")).alias("code"))


@register("ascii_only", oracle="""
SELECT doc_id, CAST(strlen(text) = length(text) AS INTEGER) AS is_ascii FROM documents""")
def q_ascii_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", C.is_ascii(F.col("text")).cast("int").alias("is_ascii"))


def clean_corpus(sub: DataFrame) -> DataFrame:
    """Key (P7) + C6 + C7 + non-empty (F5); null keys dropped."""
    return (sub.where(F.col("problem_name").isNotNull() & F.col("user_id").isNotNull()
                      & F.col("code").isNotNull())
            .withColumn("problem_user_id", F.concat_ws("_", "problem_name", "user_id"))
            .withColumn("code", C.once(C.clean_code(F.col("code"))))
            .where(C.is_ascii(F.col("code")) & (F.col("code") != "")))


D_CLEAN_CORPUS = f"""
SELECT * REPLACE (problem_name || '_' || user_id AS problem_user_id, {d_clean('code')} AS code) FROM subt
WHERE problem_name IS NOT NULL AND user_id IS NOT NULL AND code IS NOT NULL"""
D_CLEAN_CTE = f"cs0 AS ({D_CLEAN_CORPUS}), cs AS (SELECT * FROM cs0 WHERE strlen(code) = length(code) AND code <> '')"


@register("clean_corpus", oracle=f"""
WITH {D_SUBT}, {D_CLEAN_CTE} SELECT id, problem_user_id, code FROM cs""")
def q_clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_corpus(dealt_submissions(spark, sf_dir)).select("id", "problem_user_id", "code")


@register("clean_corpus_counts", oracle=f"""
WITH {D_SUBT}, {D_CLEAN_CTE}
SELECT (SELECT CAST(count(*) AS BIGINT) FROM sub) AS n_before,
       (SELECT CAST(count(*) AS BIGINT) FROM cs0) AS n_keyed,
       (SELECT CAST(count(*) AS BIGINT) FROM cs) AS n_after""")
def q_clean_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 row counts before and after, in one pass over the view."""
    sub = typed_submissions(submissions(spark, sf_dir))
    keyed = F.col("problem_name").isNotNull() & F.col("user_id").isNotNull() & F.col("code").isNotNull()
    cc = C.clean_code(F.col("code"))
    return sub.agg(
        F.count("*").cast("bigint").alias("n_before"),
        F.count(F.when(keyed, 1)).cast("bigint").alias("n_keyed"),
        F.count(F.when(keyed & C.is_ascii(cc) & (cc != ""), 1)).cast("bigint").alias("n_after"))


@register("drop_directives", oracle=f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {D_PIECE}, 2)) AS BIGINT) AS n_tokens FROM documents
WHERE NOT ({' OR '.join(f"instr(text, {q(w)}) > 0" for w in C.DIRECTIVE_WORDS)})""")
def q_drop_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without preprocessor words, of any length."""
    docs = _docs(spark, sf_dir).where(~C.has_directive(F.col("text")))
    return docs.select("doc_id", F.size(K.tokens_of(F.col("text"))).cast("bigint").alias("n_tokens"))


# --- P: projections ----------------------------------------------------------

@register("strip_units", oracle=f"""
WITH {SUB_CTE} SELECT id, TRY_CAST(trim(replace(time, 'ms', '')) AS INTEGER) AS time_ms,
  TRY_CAST(trim(replace(memory, 'KB', '')) AS INTEGER) AS memory_kb FROM sub""")
def q_strip_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = submissions(spark, sf_dir)
    return s.select("id", C.strip_unit(F.col("time"), "ms").alias("time_ms"),
                    C.strip_unit(F.col("memory"), "KB").alias("memory_kb"))


@register("parse_time", oracle=f"""
WITH {SUB_CTE} SELECT id, CAST(epoch(CAST(CAST(submit_time AS VARCHAR) AS TIMESTAMP)) AS BIGINT) AS epoch_s,
  CAST(year(submit_time) AS BIGINT) AS yr FROM sub""")
def q_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse the timestamp text (UTC)."""
    s = submissions(spark, sf_dir)
    # wall-clock time without a zone: epoch seconds by date arithmetic, so the
    # result does not depend on the session time zone
    ts = F.to_timestamp_ntz(F.col("submit_time").cast("string"))
    epoch = (F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("bigint") * 86400
             + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)))
    return s.select("id", epoch.cast("bigint").alias("epoch_s"), F.year(ts).cast("bigint").alias("yr"))


@register("split_tags", oracle=f"""
WITH {SUB_CTE}, pr AS (SELECT problem_name, array_to_string(list_sort(list_distinct(list(language))), ':') AS tags
  FROM sub GROUP BY problem_name)
SELECT problem_name, tag, CAST(k AS BIGINT) AS k FROM (
  SELECT problem_name, unnest(string_split(tags, ':')) AS tag, generate_subscripts(string_split(tags, ':'), 1) - 1 AS k
  FROM pr)""")
def q_split_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split the problem tag text on ':' (problems derived from sub)."""
    pr = problems(submissions(spark, sf_dir))
    return pr.select("problem_name", F.posexplode(F.split("tags", ":", -1)).alias("k", "tag")).select(
        "problem_name", "tag", F.col("k").cast("bigint").alias("k"))


@register("trim_ends", oracle=f"""
WITH {SUB_CTE} SELECT id, CASE WHEN length(code) < 2 THEN '' ELSE substring(code, 2, length(code) - 2) END AS code FROM sub""")
def q_trim_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return submissions(spark, sf_dir).select("id", C.trim_ends(F.col("code")).alias("code"))


@register("encode_dict", oracle=f"""
WITH {SUB_CTE} SELECT id, {case_map('language', LANGUAGE)} AS language_code, language AS language_raw,
  {case_map('status', VERDICT)} AS status_code, status AS status_raw FROM sub""")
def q_encode_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: codes (null when unmapped) and the raw values."""
    s = submissions(spark, sf_dir)
    return s.select("id", encode(F.col("language"), LANGUAGE).alias("language_code"),
                    F.col("language").alias("language_raw"),
                    encode(F.col("status"), VERDICT).alias("status_code"), F.col("status").alias("status_raw"))


@register("decode_dict", oracle=f"""
WITH {SUB_CTE}, e AS (SELECT id, {case_map('language', LANGUAGE)} AS lc, {case_map('status', VERDICT)} AS sc FROM sub)
SELECT id, {case_map('lc', {v: k for k, v in LANGUAGE.items()})} AS language,
  {case_map('sc', {v: k for k, v in VERDICT.items()})} AS status FROM e""")
def q_decode_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes back to names through the inverted map."""
    s = submissions(spark, sf_dir)
    e = s.select("id", encode(F.col("language"), LANGUAGE).alias("lc"), encode(F.col("status"), VERDICT).alias("sc"))
    return e.select("id", decode(F.col("lc"), LANGUAGE).alias("language"), decode(F.col("sc"), VERDICT).alias("status"))


@register("problem_user_key", oracle=f"""
WITH {SUB_CTE} SELECT id, problem_name || '_' || user_id AS problem_user_id FROM sub
WHERE problem_name IS NOT NULL AND user_id IS NOT NULL""")
def q_problem_user_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = submissions(spark, sf_dir).where(F.col("problem_name").isNotNull() & F.col("user_id").isNotNull())
    return s.select("id", F.concat_ws("_", "problem_name", "user_id").alias("problem_user_id"))


# --- L: lines ----------------------------------------------------------------

D_LINES = "string_split({t}, chr(10))"
D_REF = q(L.RX_REF_LINE.replace("(?s)", ""))


def d_ref_lines(t: str) -> str:
    return (f"list_filter(list_transform({d(D_LINES, t)}, lambda l: {d(D_STRIP, 'l')}), "
            f"lambda l: regexp_matches(l, {D_REF}))")


def d_ref_name(x: str) -> str:
    a, b = q(L.RX_REF_NAME_ANGLE.replace("(?s)", "")), q(L.RX_REF_NAME_QUOTE.replace("(?s)", ""))
    return (f"CASE WHEN regexp_matches({x}, {a}) THEN regexp_extract({x}, {a}, 1) "
            f"WHEN regexp_matches({x}, {b}) THEN regexp_extract({x}, {b}, 1) END")


@register("ref_lines", oracle=f"""
WITH {D_SUBT} SELECT id, array_to_string({d_ref_lines('code')}, chr(10)) AS ref_lines,
  CAST(len({d_ref_lines('code')}) AS BIGINT) AS n_refs FROM subt""")
def q_ref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = typed_submissions(submissions(spark, sf_dir)).withColumn("_r", L.ref_lines(F.col("code")))
    return s.select("id", F.array_join("_r", "\n").alias("ref_lines"), F.size("_r").cast("bigint").alias("n_refs"))


@register("ref_names", oracle=f"""
WITH {D_SUBT} SELECT id, array_to_string(list_transform({d_ref_lines('code')}, lambda x: {d_ref_name('x')}), ',')
  AS names FROM subt""")
def q_ref_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = typed_submissions(submissions(spark, sf_dir))
    return s.select("id", F.array_join(L.ref_names(F.col("code")), ",").alias("names"))


def d_drop_ref_lines(t: str) -> str:
    return f"array_to_string(list_filter({d(D_LINES, t)}, lambda l: NOT regexp_matches(l, {D_REF})), chr(10))"


@register("drop_ref_lines", oracle=f"""
WITH {D_SUBT} SELECT id, array_to_string(list_filter({d(D_LINES, 'code')}, lambda l: NOT regexp_matches(l, {D_REF})),
  chr(10)) AS code FROM subt""")
def q_drop_ref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_submissions(submissions(spark, sf_dir)).select("id", L.drop_ref_lines(F.col("code")).alias("code"))


@register("blank_ref_lines", oracle=f"""
WITH {D_SUBT} SELECT id, array_to_string(list_transform({d(D_LINES, 'code')},
  lambda l: CASE WHEN regexp_matches(l, {D_REF}) THEN '' ELSE l END), chr(10)) AS code FROM subt""")
def q_blank_ref_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_submissions(submissions(spark, sf_dir)).select("id", L.blank_ref_lines(F.col("code")).alias("code"))


def d_ref_line_no(src: str) -> str:
    return f"""
refs AS (SELECT id, unnest({d_ref_lines('code')}) AS line, generate_subscripts({d_ref_lines('code')}, 1) - 1 AS k FROM {src}),
al AS (SELECT id, {d(D_STRIP, 'raw')} AS line, min(n) AS line_no FROM (
  SELECT id, unnest({d(D_LINES, 'code')}) AS raw, generate_subscripts({d(D_LINES, 'code')}, 1) - 1 AS n FROM {src})
  GROUP BY id, {d(D_STRIP, 'raw')}),
rl AS (SELECT refs.id, CAST(refs.k AS BIGINT) AS k, CAST(al.line_no AS BIGINT) AS line_no, refs.line
  FROM refs LEFT JOIN al ON refs.id = al.id AND refs.line = al.line)"""


D_REF_LINE_NO = d_ref_line_no("subt")


@register("ref_line_no", oracle=f"""
WITH {D_SUBT}, {D_REF_LINE_NO} SELECT id, k, line_no FROM rl""")
def q_ref_line_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line number of each reference line."""
    rl = L.ref_line_numbers(typed_submissions(submissions(spark, sf_dir)), "id", "code")
    return rl.select("id", F.col("k").cast("bigint").alias("k"), F.col("line_no").cast("bigint").alias("line_no"))


D_HREF = q('href="([^"]*)"')


@register("same_refs", oracle=f"""
WITH hp AS (SELECT page_id, array_to_string(regexp_extract_all(html, {D_HREF}, 1), chr(1)) AS refs FROM pages)
SELECT page_id, CAST(min(page_id) OVER (PARTITION BY refs) AS BIGINT) AS group_id,
  CAST(count(*) OVER (PARTITION BY refs) AS BIGINT) AS group_size FROM hp""")
def q_same_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with equal ordered reference lists (``href`` values) share a
    group; the list is the equi-join key, so no page pairs are formed."""
    hp = read_table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1).alias("refs"))
    g = hp.groupBy("refs").agg(F.min("page_id").alias("group_id"), F.count("*").alias("group_size"))
    return hp.join(g, "refs").select("page_id", F.col("group_id").cast("bigint").alias("group_id"),
                                     F.col("group_size").cast("bigint").alias("group_size"))


@register("restore_lines", oracle=f"""
WITH {D_SUBT}, {D_REF_LINE_NO},
bl AS (SELECT id, code AS orig, list_transform({d(D_LINES, 'code')},
  lambda l: CASE WHEN regexp_matches(l, {D_REF}) THEN '' ELSE l END) AS ls FROM subt),
tl AS (SELECT id, unnest(ls) AS cur, generate_subscripts(ls, 1) - 1 AS n FROM bl),
j AS (SELECT tl.id, tl.n, tl.cur, rl.line FROM tl LEFT JOIN rl ON tl.id = rl.id AND tl.n = rl.line_no),
rb AS (SELECT id, string_agg(CASE WHEN line IS NOT NULL AND {d(D_STRIP, 'cur')} = '' THEN line ELSE cur END, chr(10) ORDER BY n)
  AS code, count(CASE WHEN line IS NOT NULL AND {d(D_STRIP, 'cur')} = '' THEN 1 END) AS placed FROM j GROUP BY id),
tot AS (SELECT id, count(*) AS saved FROM rl GROUP BY id)
SELECT rb.id, rb.code, CAST(coalesce(tot.saved, 0) - rb.placed AS BIGINT) AS conflicts
FROM rb LEFT JOIN tot ON rb.id = tot.id""")
def q_restore_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank the reference lines (L4), then put the saved (stripped) lines
    back on their line numbers (L5)."""
    sub = typed_submissions(submissions(spark, sf_dir))
    saved = L.ref_line_numbers(sub, "id", "code").select("id", "line_no", "line")
    blanked = sub.select("id", L.blank_ref_lines(F.col("code")).alias("code"))
    r = L.restore_lines(blanked, saved, "id", "code")
    return r.select("id", "code", F.col("conflicts").cast("bigint").alias("conflicts"))


D_MARKER = q(L.RX_MARKER.replace("(?s)", ""))


@register("section_tags", oracle=f"""
WITH ln AS (SELECT doc_id, unnest({d(D_LINES, 'text')}) AS line, generate_subscripts({d(D_LINES, 'text')}, 1) AS line_no
  FROM documents),
st AS (SELECT doc_id, line_no, CASE WHEN NOT regexp_matches(line, {D_MARKER})
    OR trim(regexp_extract(line, {D_MARKER}, 3)) = '' THEN NULL
  WHEN trim(regexp_extract(line, {D_MARKER}, 3)) = '3' THEN false
  WHEN trim(regexp_extract(line, {D_MARKER}, 3)) IN ('1', '2') THEN true END AS s FROM ln),
f AS (SELECT doc_id, line_no, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS tagged FROM st)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN tagged THEN 1 ELSE 0 END) AS BIGINT) AS n_tagged
FROM f GROUP BY doc_id""")
def q_section_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines inside tagged sections, per document."""
    t = L.section_tags(_docs(spark, sf_dir), "doc_id", "text")
    return t.groupBy("doc_id").agg(F.count("*").cast("bigint").alias("n_lines"),
                                   F.sum(F.col("tagged").cast("int")).cast("bigint").alias("n_tagged"))


@register("shift_positions", oracle="""
WITH ops AS (SELECT l_orderkey, l_linenumber AS op_id, l_linenumber * 10 AS pos FROM lineitem),
blk AS (SELECT l_orderkey, l_linenumber * 10 - 5 AS bpos, CAST(l_quantity AS INTEGER) AS blen FROM lineitem)
SELECT ops.l_orderkey, CAST(ops.op_id AS BIGINT) AS op_id,
  CAST(ops.pos + coalesce(sum(CASE WHEN ops.pos >= blk.bpos THEN blk.blen ELSE 0 END), 0) AS BIGINT) AS new_pos
FROM ops LEFT JOIN blk ON ops.l_orderkey = blk.l_orderkey
GROUP BY ops.l_orderkey, ops.op_id, ops.pos""")
def q_shift_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10 on lineitem: operation at ``10 * line`` moves right by the sizes
    (quantities) of the blocks inserted at ``10 * line - 5`` before it."""
    li = read_table(spark, sf_dir, "lineitem")
    ops = li.select("l_orderkey", F.col("l_linenumber").alias("op_id"), (F.col("l_linenumber") * 10).alias("pos"))
    blocks = li.select("l_orderkey", (F.col("l_linenumber") * 10 - 5).alias("pos"),
                       F.col("l_quantity").cast("int").alias("length"))
    r = L.shift_positions(ops, blocks, ["l_orderkey"])
    return r.select("l_orderkey", F.col("op_id").cast("bigint").alias("op_id"),
                    F.col("new_pos").cast("bigint").alias("new_pos"))


def _per_document(spark: SparkSession, sf_dir: str, columns, docs: DataFrame | None = None) -> DataFrame:
    """``doc_id`` and expressions over the token array of every document with
    tokens. The explode of one summary drops the others without a filter, which
    would run the token expressions again below it."""
    t = K.with_tokens(_docs(spark, sf_dir) if docs is None else docs, "text")
    told = F.when(F.size("tokens") > 0, F.array(F.struct(*columns(F.col("tokens")))))
    return t.select("doc_id", F.explode(told).alias("e")).select("doc_id", "e.*")


# --- K: tokens ---------------------------------------------------------------

D_TOKTAB = f"""
pc AS (SELECT doc_id, unnest(regexp_extract_all(text, {D_PIECE}, 1)) AS g,
  unnest(regexp_extract_all(text, {D_PIECE}, 2)) AS tok,
  generate_subscripts(regexp_extract_all(text, {D_PIECE}, 2), 1) - 1 AS pos FROM documents),
pw AS (SELECT *, coalesce(sum(length(g) + length(tok)) OVER w, 0) AS st,
  coalesce(sum(length(g || tok) - length(replace(g || tok, chr(10), ''))) OVER w, 0) AS nlb,
  CASE WHEN instr(tok, chr(10)) > 0 THEN length(g) + length(tok) - instr(reverse(tok), chr(10))
       WHEN instr(g, chr(10)) > 0 THEN length(g) - instr(reverse(g), chr(10)) END AS pl,
  CASE WHEN instr(g, chr(10)) > 0 THEN length(g) - instr(reverse(g), chr(10)) END AS gl
  FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tt AS (SELECT doc_id, pos, tok, st + length(g) AS off,
  nlb + length(g) - length(replace(g, chr(10), '')) + 1 AS line,
  st + length(g) - coalesce(gl + st, max(pl + st) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS col FROM pw)"""


@register("token_table", oracle=f"""
WITH {D_TOKTAB}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, md5(string_agg(tok, chr(1) ORDER BY pos)) AS tokens_md5
FROM tt GROUP BY doc_id""")
def q_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the long token table of the documents, summarised per document."""
    return _per_document(spark, sf_dir, lambda t: [
        F.size(t).cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(F.transform(t, lambda x: x["tok"]), "\u0001")).alias("tokens_md5")])


@register("token_offsets", oracle=f"""
WITH {D_TOKTAB}
SELECT doc_id, CAST(sum(off) AS BIGINT) AS sum_off, CAST(max(line) AS BIGINT) AS max_line,
  CAST(sum(line) AS BIGINT) AS sum_line, CAST(sum(col) AS BIGINT) AS sum_col,
  md5(string_agg(off || ':' || line || ':' || col, ',' ORDER BY pos)) AS coords_md5
FROM tt GROUP BY doc_id""")
def q_token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: offset, line and column of every token (summarised per document)."""
    total = lambda t, c: F.aggregate(t, F.lit(0).cast("bigint"), lambda a, x: a + x[c]).alias(f"sum_{c}")
    coord = lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("off", "line", "col")])
    return _per_document(spark, sf_dir, lambda t: [
        total(t, "off"), F.array_max(F.transform(t, lambda x: x["line"])).cast("bigint").alias("max_line"),
        total(t, "line"), total(t, "col"), F.md5(F.array_join(F.transform(t, coord), ",")).alias("coords_md5")])


@register("rebuild_text", oracle=f"""
WITH {D_TOKTAB},
pz AS (SELECT doc_id, pos, line - coalesce(lag(line) OVER w, 1) AS nl, off - coalesce(lag(off) OVER w, 0) AS doff,
  coalesce(lag(length(tok)) OVER w, 0) AS plen, tok FROM tt WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pp AS (SELECT doc_id, pos, repeat(chr(10), CAST(greatest(nl, 0) AS BIGINT)) ||
  repeat(' ', CAST(greatest(doff - CASE WHEN nl <> 0 THEN nl + 1 ELSE plen END, 0) AS BIGINT)) || tok AS piece FROM pz)
SELECT doc_id, md5(string_agg(piece, '' ORDER BY pos)) AS md5, CAST(length(string_agg(piece, '' ORDER BY pos)) AS BIGINT)
  AS n_chars FROM pp GROUP BY doc_id""")
def q_rebuild_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: text rebuilt from the token table."""
    rb = _per_document(spark, sf_dir, lambda t: [K.text_of(t).alias("text")])
    return rb.select("doc_id", *_digest(F.col("text")))


@register("token_class", oracle=f"""
WITH {D_SUBT}, {D_CLEAN_CTE},
tk AS (SELECT unnest(regexp_extract_all(code, {D_PIECE}, 2)) AS tok FROM cs),
c AS (SELECT CASE WHEN tok IN ({', '.join(q(x) for x in K.C_KEYWORDS)}) THEN 'keyword'
  WHEN tok IN ({', '.join(q(x) for x in K.C_OPERATORS)}) THEN 'operator'
  WHEN starts_with(tok, '#include') THEN 'reference'
  WHEN regexp_matches(tok, {q(K.RX_IDENT)}) THEN 'identifier'
  WHEN regexp_matches(tok, {q(K.RX_LITERAL)}) THEN 'literal' ELSE 'other' END AS cls, tok FROM tk)
SELECT cls, tok, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY cls, tok""")
def q_token_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: class of every distinct token of the cleaned corpus, with counts."""
    cs = clean_corpus(dealt_submissions(spark, sf_dir))
    tk = cs.select(F.explode(K.tokens_of(F.col("code"))).alias("tok"))
    return (tk.groupBy("tok").agg(F.count("*").cast("bigint").alias("n"))
            .select(K.token_class(F.col("tok")).alias("cls"), "tok", "n"))


@register("identifier_set", oracle=f"""
WITH {D_SUBT}, {D_CLEAN_CTE}
SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(code, {D_PIECE}, 2),
  lambda t: t NOT IN ({', '.join(q(x) for x in K.C_KEYWORDS)}) AND t NOT IN ({', '.join(q(x) for x in K.C_OPERATORS)})
  AND NOT starts_with(t, '#include')))), ',') AS idents
FROM cs""")
def q_identifier_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: identifiers of each cleaned text."""
    cs = clean_corpus(dealt_submissions(spark, sf_dir))
    return cs.select("id", F.array_join(K.identifier_set(K.tokens_of(F.col("code"))), ",").alias("idents"))


D_CALLS = ("list_filter(generate_series(0, greatest(len(tk) - 2, 0)), lambda i: i <= len(tk) - 2 "
           f"AND coalesce(regexp_matches(tk[i + 1], {q(K.RX_IDENT)}) AND tk[i + 2] = '(', false))")


@register("token_window_match", oracle=f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {D_PIECE}, 2) AS tk FROM documents)
SELECT doc_id, CAST(len({D_CALLS}) AS BIGINT) AS n_calls, array_to_string({D_CALLS}, ',') AS positions FROM t""")
def q_token_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: call sites (a name then ``(``) in every document."""
    docs = _docs(spark, sf_dir).withColumn("_t", K.tokens_of(F.col("text")))
    hits = K.window_matches(F.col("_t"), [lambda t: t.rlike(K.RX_IDENT), lambda t: t == "("])
    return docs.select("doc_id", F.size(hits).cast("bigint").alias("n_calls"),
                       F.array_join(F.transform(hits, lambda i: i.cast("string")), ",").alias("positions"))


@register("token_span", oracle=f"""
WITH {D_SUBT}, {D_CLEAN_CTE},
t AS (SELECT id, regexp_extract_all(code, {D_PIECE}, 2) AS tk FROM cs),
b AS (SELECT id, tk, unnest(list_filter(generate_series(0, greatest(len(tk) - 1, 0)), lambda i: tk[i + 1] = 'return')) AS b
  FROM t)
SELECT id, CAST(b AS BIGINT) AS b, CAST(coalesce(list_min(list_filter(generate_series(0, greatest(len(tk) - 1, 0)),
  lambda j: j > b AND tk[j + 1] = ';')), len(tk) - 1) AS BIGINT) AS e FROM b""")
def q_token_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: span from ``return`` to the first ``;`` after it (or the last token)."""
    cs = clean_corpus(dealt_submissions(spark, sf_dir))
    # the tokens are a column of their own, or every step of a scan over them
    # would tokenize the text again; outer, or a filter would run below it all
    cs = cs.select("id", K.tokens_of(F.col("code")).alias("_t"))
    s = cs.select("id", F.explode_outer(K.spans(F.col("_t"), "return", ";")).alias("s")).where("s is not null")
    return s.select("id", F.col("s.b").cast("bigint").alias("b"), F.col("s.e").cast("bigint").alias("e"))


@register("token_cap", oracle=f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, {D_PIECE}, 2)) AS BIGINT) AS n_tokens,
  CAST(len(regexp_extract_all(text, {D_PIECE}, 2)) <= 1000 AS INTEGER) AS within_1000,
  CAST(len(regexp_extract_all(text, {D_PIECE}, 2)) <= 2000 AS INTEGER) AS within_2000 FROM documents""")
def q_token_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: token counts against the caps 1000 (corruption) and 2000."""
    docs = _docs(spark, sf_dir).withColumn("_t", K.tokens_of(F.col("text")))
    return docs.select("doc_id", F.size("_t").cast("bigint").alias("n_tokens"),
                       K.within_cap(F.col("_t"), 1000).cast("int").alias("within_1000"),
                       K.within_cap(F.col("_t"), 2000).cast("int").alias("within_2000"))


@register("first_token_after", oracle=f"""
WITH {D_TOKTAB},
fl AS (SELECT doc_id, line, min(pos) AS p FROM tt GROUP BY doc_id, line),
ln AS (SELECT doc_id, generate_subscripts({d(D_LINES, 'text')}, 1) AS line_no FROM documents)
SELECT ln.doc_id, CAST(ln.line_no AS BIGINT) AS line_no, CAST(min(fl.p) AS BIGINT) AS first_pos
FROM ln LEFT JOIN fl ON ln.doc_id = fl.doc_id AND fl.line > ln.line_no GROUP BY ln.doc_id, ln.line_no""")
def q_first_token_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line of a document, the first token on a later line."""
    t = K.with_tokens(_docs(spark, sf_dir), "text").withColumn(
        "_n", F.size(L.lines_of(F.col("text")))).withColumn("_lines", F.transform("tokens", lambda x: x["line"]))
    t = t.select("doc_id", F.posexplode(L.first_after(F.col("_lines"), F.col("_n"))).alias("i", "p"))
    return t.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), F.col("p").cast("bigint").alias("first_pos"))


@register("token_section", oracle=f"""
WITH {D_TOKTAB},
ln AS (SELECT doc_id, unnest({d(D_LINES, 'text')}) AS line, generate_subscripts({d(D_LINES, 'text')}, 1) AS line_no
  FROM documents),
st AS (SELECT doc_id, line_no, CASE WHEN NOT regexp_matches(line, {D_MARKER})
    OR trim(regexp_extract(line, {D_MARKER}, 3)) = '' THEN NULL
  WHEN trim(regexp_extract(line, {D_MARKER}, 3)) = '3' THEN false
  WHEN trim(regexp_extract(line, {D_MARKER}, 3)) IN ('1', '2') THEN true END AS s FROM ln),
f AS (SELECT doc_id, line_no, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS tagged FROM st)
SELECT tt.doc_id, CAST(count(*) AS BIGINT) AS n_tokens,
  CAST(sum(CASE WHEN f.tagged THEN 1 ELSE 0 END) AS BIGINT) AS n_tagged_tokens
FROM tt LEFT JOIN f ON tt.doc_id = f.doc_id AND tt.line = f.line_no GROUP BY tt.doc_id""")
def q_token_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag every token by the section of its line."""
    docs = _docs(spark, sf_dir).withColumn("_tags", L.tags_of(F.col("text")))
    tagged = lambda t: F.filter(t, lambda x: F.get(F.col("_tags"), x["line"] - 1))
    return _per_document(spark, sf_dir, lambda t: [
        F.size(t).cast("bigint").alias("n_tokens"), F.size(tagged(t)).cast("bigint").alias("n_tagged_tokens")], docs)
