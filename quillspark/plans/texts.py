"""Text cleaning, naming and parsing functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens
from .registry import query, table
from .statutes import STRIP, strip_sql


def docs(spark, sf_dir, *cols):
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


def text():
    return F.coalesce(F.col("text"), F.lit(""))


#: Some characters and their compatibility forms.
PLAIN, WIDE = "e1 ", "\uff45\u2460\u3000"
_PLANTED = f"translate(replace(replace(replace(coalesce(text, ''), 'fi', chr(64257)), 'é', 'e' || chr(769)), 'a', 'a' || chr(8203)), '{PLAIN}', '{WIDE}')"


@query("T01_normalize_unicode", f"SELECT doc_id, nfc_normalize(translate(replace(replace(x, chr(8203), ''), chr(64257), 'fi'), '{WIDE}', '{PLAIN}')) AS text FROM (SELECT doc_id, {_PLANTED} AS x FROM documents)")
def normalize_unicode(spark, sf_dir):
    """Texts with wide letters and spaces, circled digits, ligatures, split accents and zero-width spaces."""
    x = F.replace(F.replace(F.replace(text(), F.lit("fi"), F.lit("\ufb01")), F.lit("é"), F.lit("e\u0301")), F.lit("a"), F.lit("a\u200b"))
    return docs(spark, sf_dir, T.normalize_unicode(F.translate(x, PLAIN, WIDE)).alias("text"))


_BLANKS = r"regexp_replace(coalesce({}, ''), '[ \t]+', ' ', 'g')"


@query("T02_clean_line", f"SELECT page_id, {strip_sql(_BLANKS.format('html'))} AS line FROM pages")
def clean_line(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_line(F.coalesce("html", F.lit("")), nfkc=False).alias("line"))


@query("T03_clean_text", "SELECT doc_id, " + strip_sql(rf"regexp_replace(regexp_replace({_BLANKS.format('text')}, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')") + " AS text FROM documents")
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir, T.clean_text(text(), nfkc=False).alias("text"))


@query("T05_drop_noise_words", "SELECT doc_id, " + strip_sql("regexp_replace(regexp_replace(replace(" + STRIP.format("coalesce(text, '')") + r", '국가법령정보센터', ''), '법제처\s*\d+', '', 'g'), '법제처', '', 'g')") + " AS text FROM documents")
def drop_noise_words(spark, sf_dir):
    return docs(spark, sf_dir, T.drop_noise_words(text()).alias("text"))


@query("T06_clean_text_old", "SELECT doc_id, " + strip_sql(rf"regexp_replace({_BLANKS.format('text')}, '\s*\n\s*', chr(10), 'g')") + " AS text FROM documents")
def clean_text_old(spark, sf_dir):
    return docs(spark, sf_dir, T.clean_text_flat(text(), nfkc=False).alias("text"))


_SAFE = r"regexp_replace(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}_\-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("T07_safe_id", f"SELECT page_id, {_SAFE.format('url')} AS id FROM pages")
def safe_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_id(F.col("url")).alias("id"))


@query("T08_X03_fingerprint_dedup", r"SELECT sha1(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', '', 'g')) AS fp, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY fp")
def fingerprint_dedup(spark, sf_dir):
    return docs(spark, sf_dir, T.fingerprint(text()).alias("fp")).groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def forms(k, *branches):
    """The branch of each row's remainder."""
    out = F.lit(None).cast("string")
    for no, b in reversed(list(enumerate(branches))):
        out = F.when(k % len(branches) == no, b).otherwise(out)
    return out


def forms_sql(k: str, *branches: str) -> str:
    return f"CASE {k} % {len(branches)} " + " ".join(f"WHEN {no} THEN {b}" for no, b in enumerate(branches)) + " END"


_T09 = forms_sql("c_custkey", "NULL", "' law' || c_custkey || chr(12288)", "'(act) ' || c_mktsegment", "'law' || c_custkey || '(act)(' || c_mktsegment || ')'", "''", "' law ' || c_custkey || ' (' || c_name")


@query("T09_short_name", f"SELECT c_custkey, name, coalesce(nullif({strip_sql("regexp_extract(name, '^([^(]+)', 1)")}, ''), {strip_sql('name')}, '') AS law FROM (SELECT c_custkey, {_T09} AS name FROM customer)")
def short_name(spark, sf_dir):
    """Names with and without parentheses, that begin with one, with blanks around, empty and null."""
    k, key, seg = F.col("c_custkey"), F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    name = forms(k, F.lit(None), F.concat(F.lit(" law"), key, F.lit("\u3000")), F.concat(F.lit("(act) "), seg), F.concat(F.lit("law"), key, F.lit("(act)("), seg, F.lit(")")), F.lit(""), F.concat(F.lit(" law "), key, F.lit(" ("), F.col("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name")).withColumn("law", T.short_law_name(F.col("name")))


_T10 = forms_sql("doc_id", "'법' || doc_id || '_법률_제' || doc_id || '호_2024' || lpad(((doc_id % 12) + 1)::VARCHAR, 2, '0') || '15'", "'법' || doc_id || '_시행령_20231231'", "source || '법(법률)(제' || doc_id || '호)'", "'_시행규칙_' || doc_id", "' 법 ' || doc_id || '_법률안_제호_19991231'", "'법률_' || doc_id || '_대통령령'")


@query("T10_name_metadata", f"""SELECT doc_id, coalesce(nullif({strip_sql("regexp_extract(name, '^([^_]+)', 1)")}, ''), name) AS law_name, nullif(regexp_extract(name, '(?:^|_)({T.LAW_TYPES})(?:_|$)', 1), '') AS law_type, nullif(regexp_extract(name, '(제\\d+호)', 1), '') AS law_number,
  CASE WHEN regexp_matches(name, '20\\d{{6}}') THEN regexp_replace(regexp_extract(name, '20\\d{{6}}'), '(....)(..)(..)', '\\1-\\2-\\3') END AS effective_date FROM (SELECT doc_id, {_T10} AS name FROM documents)""")
def name_metadata(spark, sf_dir):
    """Names with all parts, and with some missing, misplaced or of an unknown kind."""
    k, ident = F.col("doc_id"), F.col("doc_id").cast("string")
    full = F.concat(F.lit("법"), ident, F.lit("_법률_제"), ident, F.lit("호_2024"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("15"))
    name = forms(k, full, F.concat(F.lit("법"), ident, F.lit("_시행령_20231231")), F.concat("source", F.lit("법(법률)(제"), ident, F.lit("호)")), F.concat(F.lit("_시행규칙_"), ident), F.concat(F.lit(" 법 "), ident, F.lit("_법률안_제호_19991231")), F.concat(F.lit("법률_"), ident, F.lit("_대통령령")))
    rows = docs(spark, sf_dir, name.alias("name"))
    return rows.select("doc_id", *(c.alias(k) for k, c in T.law_metadata(F.col("name")).items()))


_UUID5 = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query("T14_point_id", f"SELECT doc_id, {_UUID5} AS id FROM (SELECT doc_id, sha1(unhex('{T.URL_NAMESPACE}') || encode('doc_' || doc_id)) AS h FROM documents)")
def point_id(spark, sf_dir):
    return docs(spark, sf_dir, T.uuid5(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))).alias("id"))


@query("T15_preview", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents")
def preview(spark, sf_dir):
    return docs(spark, sf_dir, T.preview(F.col("text"), 200).alias("preview"))


_T16 = forms_sql("doc_id", "'법_본문_제' || doc_id || '조'", "'법_부칙_제' || doc_id || '조'", "'법_본문_제1조_본문_제' || doc_id || '조'", "'본문_' || source", "NULL", "'법_본문_'")


@query("T16_after_main_section", f"SELECT doc_id, list_extract(string_split(x, '_본문_'), -1) AS short FROM (SELECT doc_id, {_T16} AS x FROM documents)")
def after_main(spark, sf_dir):
    """Ids of main and supplementary articles, with the mark twice, at the end or not at all."""
    k, ident = F.col("doc_id"), F.col("doc_id").cast("string")
    x = forms(k, F.concat(F.lit("법_본문_제"), ident, F.lit("조")), F.concat(F.lit("법_부칙_제"), ident, F.lit("조")), F.concat(F.lit("법_본문_제1조_본문_제"), ident, F.lit("조")), F.concat(F.lit("본문_"), "source"), F.lit(None), F.lit("법_본문_"))
    return docs(spark, sf_dir, T.after_main_section(x).alias("short"))


_P13 = forms_sql("doc_id", "'제' || doc_id || '조'", "'제 ' || doc_id || ' 조의2'", "'부칙 제' || doc_id || '조, 제3조'", "'제조'", "NULL", "'제' || doc_id || '00000000000조'", "source || doc_id || '조'")


@query("P13_article_number", f"SELECT doc_id, coalesce(try_cast(nullif(regexp_extract(x, '제\\s*(\\d+)\\s*조', 1), '') AS INT), 999999) AS number FROM (SELECT doc_id, {_P13} AS x FROM documents)")
def article_number(spark, sf_dir):
    """Numbers with blanks, sub-numbers, several in one, none, and one beyond an integer."""
    k, ident = F.col("doc_id"), F.col("doc_id").cast("string")
    x = forms(k, F.concat(F.lit("제"), ident, F.lit("조")), F.concat(F.lit("제 "), ident, F.lit(" 조의2")), F.concat(F.lit("부칙 제"), ident, F.lit("조, 제3조")), F.lit("제조"), F.lit(None), F.concat(F.lit("제"), ident, F.lit("00000000000조")), F.concat("source", ident, F.lit("조")))
    return docs(spark, sf_dir, T.article_number(x).alias("number"))


_P14 = forms_sql("doc_id", "'제' || doc_id || '조( ' || source || ' ) x'", "'제' || doc_id || '조의2 (' || source || ') 제1조(목적)'", "'제' || doc_id || '조 본문은 제5조의2(특례)와 같다'", "'제' || doc_id || '(' || source || ')'", "'제' || doc_id || '조 삭제'", "'제 ' || doc_id || ' 조 ()(' || source || ')'", "NULL")
_TITLE = {"fixed": r"제\s*\d+\s*조(?:의\s*\d+)?\s*\(([^)]+)\)", "compat": r"제\s*\d+(?:조의\d+)?\s*\(([^)]+)\)"}


@query("P14_evaluation_title", "SELECT doc_id, " + ", ".join(strip_sql(f"regexp_extract(x, '{p}', 1)") + f" AS {name}" for name, p in _TITLE.items()) + f" FROM (SELECT doc_id, {_P14} AS x FROM documents)")
def evaluation_title(spark, sf_dir):
    """Titles after numbers and sub-numbers, in a later reference only, empty, or missing."""
    k, ident = F.col("doc_id"), F.col("doc_id").cast("string")
    x = forms(k, F.concat(F.lit("제"), ident, F.lit("조( "), "source", F.lit(" ) x")), F.concat(F.lit("제"), ident, F.lit("조의2 ("), "source", F.lit(") 제1조(목적)")), F.concat(F.lit("제"), ident, F.lit("조 본문은 제5조의2(특례)와 같다")), F.concat(F.lit("제"), ident, F.lit("("), "source", F.lit(")")), F.concat(F.lit("제"), ident, F.lit("조 삭제")), F.concat(F.lit("제 "), ident, F.lit(" 조 ()("), "source", F.lit(")")), F.lit(None))
    return docs(spark, sf_dir, T.evaluation_title(x).alias("fixed"), T.evaluation_title(x, fixed=False).alias("compat"))


TOKENS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: length(x) > 1))"


@query("R05_tokens", f"SELECT doc_id, array_to_string(list_sort({TOKENS.format('coalesce(text, chr(32))')}), ' ') AS tokens FROM documents")
def token_sets(spark, sf_dir):
    return docs(spark, sf_dir, F.array_join(F.array_sort(tokens.tokenize(text())), " ").alias("tokens"))


@query("F03_valid_queries", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(" + strip_sql("coalesce(text, '')") + ") >= 10")
def valid_queries(spark, sf_dir):
    from ..operators.evalset import valid_query

    return table(spark, sf_dir, "conversations").where((F.col("role") == "user") & valid_query(F.col("text"))).select("conv_id", "turn")


@query("F04_missing_fields", "SELECT doc_id AS id, f AS field FROM (SELECT doc_id, unnest(['text', 'lang', 'mark']) AS f, unnest([text, CASE WHEN doc_id % 7 <> 3 THEN lang END, CASE WHEN doc_id % 5 = 1 THEN '' ELSE source END]) AS v FROM documents) WHERE v IS NULL OR v = ''")
def missing_fields(spark, sf_dir):
    from ..operators.validate import missing_fields as lacking

    rows = docs(spark, sf_dir, "text", F.when(F.col("doc_id") % 7 != 3, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("source")).alias("mark"))
    return lacking(rows.withColumnRenamed("doc_id", "id"), ("text", "lang", "mark"))
