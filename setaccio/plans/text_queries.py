"""Queries of text functions and rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from setaccio.functions import text as T, udf
from setaccio.operators import dedup, filters
from setaccio.plans.sql import BLANKS, LINES, PARAS, STRIP, WORDS
from setaccio.plans.tables import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its name; without SQL only its rows are checked."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark, sf):
    return table(spark, sf, "documents").where("text is not null")


KNOWN = rf"[\p{{L}}\p{{Nd}}{BLANKS}]"
FEATURES = rf"""
f AS (SELECT doc_id, text, len(words) AS n_words, length(text) AS n_chars, length(regexp_replace(text, '{KNOWN}', '', 'g')) / nullif(length(text), 0) AS symbol_ratio,
  len(lines) AS n_lines, len(list_distinct(lines)) AS distinct_lines, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / nullif(length(text), 0) AS alpha_ratio,
  len(list_filter(words, lambda w: regexp_matches(w, '[a-zA-Z]\d|\d[a-zA-Z]'))) / nullif(len(words), 0) AS mixed_ratio
  FROM (SELECT doc_id, text, {WORDS("text")} AS words, {LINES("text")} AS lines FROM documents WHERE text IS NOT NULL))"""
RULES = {
    "min_words": "n_words >= 50",
    "empty_guard": "n_chars > 0",
    "symbol_ratio": "symbol_ratio <= 0.35",
    "dup_line_ratio": "(n_lines <= 5 OR distinct_lines / n_lines >= 0.5)",
    "alpha_ratio": "alpha_ratio >= 0.30",
    "mixed_alnum": "mixed_ratio <= 0.05",
}
_RULE_OF = {"min_words": "min_words", "empty_guard": "empty", "symbol_ratio": "symbols", "dup_line_ratio": "repeated_lines", "alpha_ratio": "letters", "mixed_alnum": "mixed"}


@query(f"WITH {FEATURES} SELECT doc_id, n_words, n_chars, round(symbol_ratio, 6) AS symbol_ratio, n_lines, distinct_lines, round(alpha_ratio, 6) AS alpha_ratio, round(mixed_ratio, 6) AS mixed_ratio FROM f")
def heuristic_features(spark, sf):
    rows = filters.with_features(_docs(spark, sf), "text").select("doc_id", "f.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("symbol_ratio", "alpha_ratio", "mixed_ratio")})


def _rule(name):
    def run(spark, sf):
        return filters.with_features(_docs(spark, sf), "text").where(filters.rules()[_RULE_OF[name]]).select("doc_id")

    run.__name__ = name
    return run


for _name, _where in RULES.items():
    query(f"WITH {FEATURES} SELECT doc_id FROM f WHERE {_where}")(_rule(_name))

HEURISTIC = " AND ".join(RULES.values())


@query(f"WITH {FEATURES} SELECT doc_id FROM f WHERE {HEURISTIC}")
def heuristic_filter(spark, sf):
    return filters.heuristic(_docs(spark, sf), "text").select("doc_id")


_CASES = " ".join(f"WHEN NOT coalesce({w}, false) THEN '{_RULE_OF[n]}'" for n, w in RULES.items())


@query(f"WITH {FEATURES} SELECT reason, count(*) AS n FROM (SELECT CASE {_CASES} END AS reason FROM f) GROUP BY reason")
def reject_reasons(spark, sf):
    return filters.with_features(_docs(spark, sf), "text").groupBy(filters.reject_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) >= 200")
def min_chars(spark, sf):
    return filters.min_chars(table(spark, sf, "documents"), "text", 200).select("doc_id", F.length("text").alias("n_chars"))


@query("SELECT rec_id, host FROM culturax_it_ppl95 WHERE lang = 'it'")
def lang_meta_filter(spark, sf):
    return filters.metadata_language(table(spark, sf, "culturax_it_ppl95"), "lang", "it").select("rec_id", "host")


_SPACED = "translate({0}, chr(8239) || chr(160) || chr(65279), '  ')"
_TYPO = "replace(translate({0}, chr(169) || chr(65533), ''), chr(8230), '...')"
_NEW = r"regexp_replace({0}, '\r\n?', chr(10), 'g')"


def _collapsed(x: str) -> str:
    per_line = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda l: array_to_string({WORDS('l')}, ' ')), chr(10))"
    return STRIP(rf"regexp_replace({per_line}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT doc_id, {_collapsed(_NEW.format(_TYPO.format(_SPACED.format('text'))))} AS text FROM documents WHERE text IS NOT NULL")
def clean_text_full(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_full(F.col("text")).alias("text"))


@query(f"SELECT rec_id, {_collapsed(_NEW.format(_SPACED.format('coalesce(text, chr(32))')))} AS text FROM culturax_it_ppl95")
def clean_text_basic(spark, sf):
    return table(spark, sf, "culturax_it_ppl95").select("rec_id", T.clean_basic(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_NEW.format(_TYPO.format(_SPACED.format('nfc_normalize(text)')))} AS text FROM documents WHERE text IS NOT NULL")
def clean_epub(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_book(udf.nfc("text")).alias("text"))


_ARTICLE = _NEW.format("translate(nfc_normalize(text), chr(8239) || chr(160), '  ')")


@query(rf"SELECT row_id, {STRIP(rf"regexp_replace(regexp_replace({_ARTICLE}, '{T.HEADING}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM wiki_it WHERE text IS NOT NULL")
def clean_article(spark, sf):
    return table(spark, sf, "wiki_it").where("text is not null").select("row_id", T.clean_article(udf.nfc("text")).alias("text"))


@query("SELECT row_id, nfc_normalize(text) AS text FROM wiki_it")
def nfc(spark, sf):
    return table(spark, sf, "wiki_it").select("row_id", udf.nfc("text").alias("text"))


@query(f"SELECT doc_id, CASE WHEN starts_with({STRIP('text')}, '<') THEN regexp_replace(text, '<[^>]+>', ' ', 'g') ELSE text END AS text FROM documents WHERE text IS NOT NULL")
def strip_html_regex(spark, sf):
    return _docs(spark, sf).select("doc_id", T.strip_markup(F.col("text")).alias("text"))


@query()
def html_to_text(spark, sf):
    return _docs(spark, sf).select("doc_id", udf.html_to_text("text").alias("text"))


@query(f"SELECT doc_id, len(w) AS n_words, w[1] AS first_word, w[-1] AS last_word FROM (SELECT doc_id, {WORDS('text')} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0")
def whitespace_tokens(spark, sf):
    w = _docs(spark, sf).select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").alias("n_words"), F.element_at("w", 1).alias("first_word"), F.element_at("w", -1).alias("last_word"))


@query("SELECT doc_id, substring(text, 1, 500) AS head FROM documents WHERE text IS NOT NULL")
def truncate_head(spark, sf):
    return _docs(spark, sf).select("doc_id", F.substring("text", 1, 500).alias("head"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k.none') AS missing FROM events")
def field_path(spark, sf):
    return table(spark, sf, "events").select("event_id", T.field_path(F.col("props"), "k").alias("k"), T.field_path(F.col("props"), "k.none").alias("missing"))


@query(r"""SELECT count(*) AS n_chars, string_agg(c, '' ORDER BY c) FILTER (WHERE place <= 50) AS sample
FROM (SELECT c, row_number() OVER (ORDER BY c) AS place FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM culturax_it_ppl95) WHERE ascii(c) > 127)""")
def non_ascii_inventory(spark, sf):
    chars = table(spark, sf, "culturax_it_ppl95").select(F.explode(T.non_ascii(F.col("text"))).alias("c")).where("c != ''").distinct()
    every = chars.agg(F.array_sort(F.collect_set("c")).alias("all"))  # at most one entry a character of Unicode
    return every.select(F.size("all").cast("long").alias("n_chars"), F.array_join(F.slice("all", 1, 50), "").alias("sample"))


@query("""WITH c AS (SELECT pair_id, completion, unnest(string_split(completion, '')) AS c, generate_subscripts(string_split(completion, ''), 1) AS p FROM sft_calendar_v2 WHERE completion <> ''),
b AS (SELECT *, sum(CASE c WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY pair_id ORDER BY p) AS balance FROM c WHERE c IN ('{', '}')),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY p) AS k FROM b WHERE c = '{' AND balance = 1), e AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY p) AS k FROM b WHERE c = '}' AND balance = 0),
f AS (SELECT o.pair_id, o.p, substring(o.completion, o.p, e.p - o.p + 1) AS part FROM o JOIN e ON e.pair_id = o.pair_id AND e.k = o.k)
SELECT s.pair_id, (SELECT arg_min(part, p) FROM f WHERE f.pair_id = s.pair_id AND json_valid(part)) AS json FROM sft_calendar_v2 s""")
def first_json(spark, sf):
    return table(spark, sf, "sft_calendar_v2").select("pair_id", udf.first_json("completion").alias("json"))


_WORDS = (("riunione", "f", "c"), ("incontro", "m", "v"), ("corso", "m", "c"), ("assemblea", "f", "v"), ("visita", "f", "c"), ("evento", "m", "v"), ("pranzo", "m", "c"), ("udienza", "f", "v"))
_ART = """CASE WHEN initial = 'v' THEN '{0}' WHEN gender = 'f' THEN '{1}' ELSE '{2}' END || word"""


@query(f"""SELECT word, CASE WHEN gender = 'f' AND initial = 'v' THEN 'un''' WHEN gender = 'f' THEN 'una ' ELSE 'un ' END || word AS indef, {_ART.format("l''", "la ", "il ")} AS def,
{_ART.format("dell''", "della ", "del ")} AS del, {_ART.format("all''", "alla ", "al ")} AS al FROM (VALUES {", ".join(map(str, _WORDS))}) AS w(word, gender, initial)""")
def article_agreement(spark, sf):
    rows = spark.createDataFrame(list(_WORDS), "word string, gender string, initial string")
    return rows.select("word", *(T.article_word(F.col("word"), F.col("gender"), F.col("initial"), k).alias(k) for k in ("indef", "def", "del", "al")))


@query("SELECT c_custkey, 'Cliente ' || c_name || ' (' || c_mktsegment || ')' AS line FROM customer")
def template_format(spark, sf):
    from setaccio.operators.synth import fill

    return table(spark, sf, "customer").select("c_custkey", fill(F.lit("Cliente {name} ({kind})"), {"name": F.col("c_name"), "kind": F.col("c_mktsegment")}).alias("line"))


@query(f"SELECT doc_id, regexp_replace(substring(text, 1, 120), '[{T.UNPRINTED}]', chr(183), 'g') AS shown FROM documents WHERE text IS NOT NULL")
def printable_mask(spark, sf):
    return _docs(spark, sf).select("doc_id", T.printable(F.col("text")).alias("shown"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN ppl < 60 THEN 'low' WHEN ppl < 150 THEN 'medium' WHEN ppl < 400 THEN 'high' WHEN ppl IS NOT NULL THEN 'very high' END AS label FROM culturax_it_ppl95) GROUP BY label")
def ppl_bucket(spark, sf):
    return table(spark, sf, "culturax_it_ppl95").groupBy(T.ppl_label(F.col("ppl")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT rec_id, least(CAST(floor(log10(greatest(ppl, 1.0)) * 8) AS INTEGER), 40) AS bar FROM culturax_it_ppl95 WHERE ppl IS NOT NULL")
def log_bar(spark, sf):
    return table(spark, sf, "culturax_it_ppl95").where("ppl is not null").select("rec_id", T.log_bar(F.col("ppl")).alias("bar"))


@query("SELECT probe_id, text || ' ' AS text FROM wiki_probe WHERE text IS NOT NULL")
def stream_content(spark, sf):
    events = F.transform(F.split("text", " "), lambda w: F.concat(F.lit("data: "), F.to_json(F.struct(F.concat(w, F.lit(" ")).alias("content")))))
    stream = F.concat(F.array_join(events, "\n"), F.lit('\n: note\ndata: {"stop": true}\ndata: {"content": "late"}\ndata: [DONE]'))
    return table(spark, sf, "wiki_probe").where("text is not null").select("probe_id", T.stream_content(stream).alias("text"))


def _dedup_sql(source: str, key: str, sep: str, where: str = "text IS NOT NULL") -> str:
    return f"""p AS (SELECT {key} AS id, unnest(paras) AS para, generate_subscripts(paras, 1) AS pos FROM (SELECT {key}, {PARAS("text", sep)} AS paras FROM {source} WHERE {where})),
r AS (SELECT *, row_number() OVER (PARTITION BY md5(para) ORDER BY id, pos) AS place FROM p), u AS (SELECT id AS {key}, string_agg(para, {sep} ORDER BY pos) AS text FROM r WHERE place = 1 GROUP BY id)"""


LINE, BLANK_LINE = "chr(10)", "chr(10) || chr(10)"


@query(f"WITH {_dedup_sql('documents', 'doc_id', LINE)} SELECT doc_id, text FROM u")
def paragraph_dedup(spark, sf):
    return dedup.paragraph_dedup(table(spark, sf, "documents"), "doc_id", "text", "\n")


@query(f"WITH {_dedup_sql('wiki_it', 'row_id', BLANK_LINE)} SELECT row_id, text FROM u")
def paragraph_dedup_wiki(spark, sf):
    return dedup.paragraph_dedup(table(spark, sf, "wiki_it"), "row_id", "text")


@query(f"WITH {_dedup_sql('wiki_it', 'row_id', BLANK_LINE)} SELECT id AS row_id, CAST(pos - 1 AS INTEGER) AS pos, para AS text FROM r WHERE place = 1")
def block_dedup(spark, sf):
    return dedup.block_dedup(table(spark, sf, "wiki_it"), "row_id", "text").select("row_id", "pos", "text")


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def doc_exact_dedup(spark, sf):
    return dedup.exact_dedup(table(spark, sf, "documents"), "doc_id", "text")


@query(f"""WITH {_dedup_sql('documents', 'doc_id', LINE)} SELECT md5(para) AS digest, count(*) AS n, count(DISTINCT id) AS n_docs, min(id) AS first_id FROM p GROUP BY 1 HAVING count(*) > 1""")
def dup_paragraph_report(spark, sf):
    return dedup.repeated_paragraphs(table(spark, sf, "documents"), "doc_id", "text", "\n")


@query(f"WITH {FEATURES}, h AS (SELECT doc_id, text FROM f WHERE {HEURISTIC}), {_dedup_sql('h', 'doc_id', LINE)} SELECT doc_id, text FROM u")
def curate_heuristic_dedup(spark, sf):
    kept = cut(filters.heuristic(_docs(spark, sf), "text").select("doc_id", "text"))  # both branches of the dedup read it
    return dedup.paragraph_dedup(kept, "doc_id", "text", "\n")


@query("""WITH i AS (SELECT pair_id, prompt, coalesce(CASE WHEN json_valid(completion) THEN json_extract_string(completion, '$.intent') END, '-') AS intent FROM sft_calendar_v2),
f AS (SELECT *, row_number() OVER (PARTITION BY intent, substring(coalesce(prompt, ''), 1, 60) ORDER BY pair_id) AS k FROM i),
q AS (SELECT pair_id, intent, prompt, row_number() OVER (PARTITION BY intent ORDER BY pair_id) AS rank FROM f WHERE k = 1) SELECT pair_id, intent, prompt, rank FROM q WHERE rank <= 20""")
def prefix_quota_sample(spark, sf):
    rows = table(spark, sf, "sft_calendar_v2").select("pair_id", "prompt", F.coalesce(intent(F.col("completion")), F.lit("-")).alias("intent"))
    return dedup.quota(rows, "intent", "prompt", "pair_id", 60, 20).select("pair_id", "intent", "prompt", F.col("rank").cast("long").alias("rank"))


def intent(completion):
    """The intent of a completion that is JSON."""
    return F.when(F.try_parse_json(completion).isNotNull(), F.get_json_object(completion, "$.intent"))

@query(rf"SELECT row_id, {STRIP(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM wiki_it WHERE NOT regexp_matches(text, '[<>{{}}\[\]&|#*:;_]') AND NOT contains(text, chr(39) || chr(39))")
def wiki_plain(spark, sf):
    """Texts without signs of markup of their own, put into wikitext and taken out of it again."""
    before = "{{Box|a={{b|c}}\n|d=[[e]]}}<!-- no -->''"
    after = "''<ref name=\"x\">{{cite|y}}</ref>\n{| class=z\n| [[a]] || b\n|}\n[[File:c.jpg|thumb|of [[d]]]]\n[[Categoria:E]]"
    rows = table(spark, sf, "wiki_it").where(~F.col("text").rlike(r"[<>{}\[\]&|#*:;_]") & ~F.contains("text", F.lit("''")))
    return rows.select("row_id", udf.wikitext(F.concat(F.lit(before), "text", F.lit(after))).alias("text"))
