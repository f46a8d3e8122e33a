"""Queries of budgets, shards, tokens, scoring, pairs, evaluation and numbers, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from setaccio.functions import text as T
from setaccio.operators import budget, evaluation, filters, numeric, scoring, sft, synth, tokens
from setaccio.plans import curation
from setaccio.plans.sql import PARAS, WORDS
from setaccio.plans.tables import cut, new_path, table
from setaccio.plans.text_queries import BLANK_LINE, FEATURES, HEURISTIC, _dedup_sql, intent
from setaccio.sources import corpus, files, sinks

QUERIES, SQL = {}, {}
#: The piece model that the token queries use; a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_SIZES = """s AS (SELECT doc_id AS id, CAST(strlen(text) + {0} AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, row_number() OVER (ORDER BY id) - 1 AS rank FROM s)"""


@query(f"WITH {_SIZES.format(0)} SELECT id, bytes, before FROM b WHERE before < 400000 AND rank < 300")
def budget_until_reached(spark, sf):
    return budget.until_reached(table(spark, sf, "documents"), "doc_id", "text", 400_000, 300)


@query(f"WITH {_SIZES.format(2)} SELECT id, bytes, before FROM b WHERE before + bytes <= 500000")
def budget_never_exceed(spark, sf):
    return budget.never_exceed(table(spark, sf, "documents"), "doc_id", "text", 500_000)


@query(f"WITH {_SIZES.format(2)}, k AS (SELECT id, bytes, before - min(before) OVER () AS before FROM b WHERE before >= 100000) SELECT id, bytes, before FROM k WHERE before + bytes <= 300000")
def skip_prefix(spark, sf):
    return budget.never_exceed(table(spark, sf, "documents"), "doc_id", "text", 300_000, 100_000)


@query(f"""WITH {_SIZES.format(2)}, w AS (SELECT * FROM (VALUES (0, 0), (1, 300000), (2, 600000)) AS v(part, skip)), k AS (SELECT part, id, bytes, before - min(before) OVER (PARTITION BY part) AS before FROM b JOIN w ON before >= skip)
SELECT part, id, bytes FROM k WHERE before + bytes <= 300000""")
def overlapping_shards(spark, sf):
    docs = table(spark, sf, "documents")
    parts = [budget.never_exceed(docs, "doc_id", "text", 300_000, skip).select(F.lit(k).alias("part"), "id", "bytes") for k, skip in enumerate((0, 300_000, 600_000))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH RECURSIVE {_SIZES.format(2)}, g(start, shard) AS (SELECT CAST(0 AS BIGINT), CASE WHEN (SELECT bytes FROM b WHERE rank = 0) > 100000 THEN 1 ELSE 0 END
UNION ALL SELECT (SELECT min(n.rank) FROM b n, b o WHERE o.rank = g.start AND n.before + n.bytes > o.before + greatest(100000, o.bytes)), shard + 1 FROM g
WHERE EXISTS (SELECT 1 FROM b n, b o WHERE o.rank = g.start AND n.before + n.bytes > o.before + greatest(100000, o.bytes)))
SELECT id, bytes, CAST(max(shard) AS INTEGER) AS shard FROM b JOIN g ON g.start <= b.rank GROUP BY id, bytes""")
def next_fit_shards(spark, sf):
    return budget.shards(table(spark, sf, "documents"), "doc_id", "text", 100_000)


@query("""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
n AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no, count(*) OVER () AS total FROM l) SELECT id, line_no, CAST(line_no // CAST(ceil(total / 7) AS BIGINT) AS INTEGER) AS shard FROM n""")
def line_count_split(spark, sf):
    return budget.line_shards(table(spark, sf, "documents"), "doc_id", "text", 7)


@query("""WITH s AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n_chars) OVER () AS total FROM documents WHERE n_chars IS NOT NULL),
t AS (SELECT doc_id, n_chars, least(greatest(total - CAST(floor(total * 0.1) AS BIGINT) - before, 0), n_chars) AS n_train FROM s) SELECT doc_id, n_chars, CAST(n_train AS BIGINT) AS n_train, CAST(n_chars - n_train AS BIGINT) AS n_val FROM t""")
def train_val_split(spark, sf):
    return budget.tail_split(table(spark, sf, "documents").where("n_chars is not null").select("doc_id", "n_chars"), "doc_id", "n_chars")


_VOCAB = "v AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM {0} WHERE text IS NOT NULL) WHERE c <> '')"


@query(f"WITH {_VOCAB.format('documents')} SELECT c AS char, CAST(id AS INTEGER) AS id FROM v")
def char_vocab(spark, sf):
    return tokens.char_vocabulary(table(spark, sf, "documents"), "text")


def _char_ids(spark, sf, known="documents"):
    vocabulary = tokens.vocabulary_map(tokens.char_vocabulary(table(spark, sf, known), "text"))
    return table(spark, sf, "documents").select("doc_id", tokens.encode_chars(F.col("text"), vocabulary).alias("ids"))


_IDS = f"""{_VOCAB.format('documents')}, c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents WHERE text <> ''),
i AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos FROM c JOIN v USING (c))"""


# characters that wiki_probe doesn't have are left out here
@query(f"WITH {_IDS.replace(_VOCAB.format('documents'), _VOCAB.format('wiki_probe'))} SELECT d.doc_id, count(id) AS n_ids, CAST(coalesce(sum(id * (pos % 97 + 1)), 0) AS BIGINT) AS checksum FROM documents d LEFT JOIN i ON i.doc_id = d.doc_id GROUP BY d.doc_id")
def char_encode(spark, sf):
    weighed = F.transform("ids", lambda x, k: x.cast("long") * (k % 97 + 1))
    return _char_ids(spark, sf, "wiki_probe").select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.aggregate(weighed, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def char_roundtrip(spark, sf):
    vocabulary = tokens.vocabulary_map(tokens.char_vocabulary(table(spark, sf, "documents"), "text"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", tokens.decode_chars(tokens.encode_chars(F.col("text"), vocabulary), vocabulary).alias("text"))


@query(f"WITH {_IDS}, n AS (SELECT id AS token, lead(id) OVER (PARTITION BY doc_id ORDER BY pos) AS next_token FROM i) SELECT CAST(token AS INTEGER) AS token, CAST(next_token AS INTEGER) AS next_token, count(*) AS n FROM n WHERE next_token IS NOT NULL GROUP BY 1, 2")
def next_token_pairs(spark, sf):
    return tokens.next_tokens(_char_ids(spark, sf), "doc_id", "ids").groupBy("token", "next_token").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_IDS}, n AS (SELECT id AS a, lead(id) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM i) SELECT CAST(a AS INTEGER) AS \"left\", CAST(b AS INTEGER) AS \"right\", count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY 1, 2")
def pair_counts(spark, sf):
    return tokens.pair_counts(_char_ids(spark, sf), "ids")


@query(f"""WITH {_IDS}, l AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM i GROUP BY doc_id), w AS (SELECT doc_id, ids, unnest(range(0, len(ids) - 65, 64)) AS start FROM l WHERE len(ids) >= 66)
SELECT doc_id AS id, CAST(start AS INTEGER) AS start, array_to_string(ids[start + 1 : start + 64], ' ') AS x, array_to_string(ids[start + 2 : start + 65], ' ') AS y FROM w""")
def window_examples(spark, sf):
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return tokens.windows(_char_ids(spark, sf), "doc_id", "ids", 64, 64).select("id", "start", joined("x").alias("x"), joined("y").alias("y"))


_EVAL = """w AS (SELECT doc_id AS id, n_chars AS n, unnest(range(0, n_chars - 1, 128)) AS beginning FROM documents WHERE n_chars >= 2), e AS (SELECT id, n, CAST(beginning AS INTEGER) AS beginning, CAST(least(beginning + 256, n) AS INTEGER) AS finish FROM w)"""


@query(f"WITH {_EVAL}, s AS (SELECT *, CAST(CASE WHEN beginning = 0 THEN finish - 1 ELSE least(128, finish - beginning - 1) END AS INTEGER) AS n_scored FROM e) SELECT id, beginning AS \"begin\", finish AS \"end\", finish - n_scored AS first_scored, n_scored FROM s WHERE n_scored > 0")
def sliding_windows_eval(spark, sf):
    return tokens.eval_windows(table(spark, sf, "documents"), "doc_id", "n_chars", 256, 128)


@query(f"WITH {_EVAL}, s AS (SELECT *, CAST(finish - CASE WHEN beginning = 0 THEN 1 ELSE least(beginning + 128, n) END AS INTEGER) AS n_scored FROM e) SELECT id, beginning AS \"begin\", finish AS \"end\", finish - n_scored AS first_scored, n_scored FROM s WHERE n_scored > 0")
def sliding_windows_exact(spark, sf):
    return tokens.eval_windows(table(spark, sf, "documents"), "doc_id", "n_chars", 256, 128, "exact")


@query()
def probe_windows(spark, sf):
    return tokens.probe_starts(table(spark, sf, "documents").where("n_chars is not null"), "doc_id", "n_chars", 64, 50)


@query()
def probe_ppl(spark, sf):
    """Each document's characters, their losses by the counts of all documents, and the perplexity over 20 windows of 64."""
    chars = table(spark, sf, "documents").where("text is not null").select("doc_id", F.filter(F.split("text", ""), lambda x: x != "").alias("c"))
    counts = {r.c: r.n for r in chars.select(F.explode("c").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(tokens.MOST_CHARS).collect()}  # a row a character of Unicode
    total = sum(counts.values())
    loss = F.create_map(*(F.lit(x) for c in sorted(counts) for x in (c, -math.log(counts[c] / total))))
    losses = chars.select("doc_id", F.transform("c", lambda x: F.element_at(loss, x)).alias("losses"))
    return tokens.probe_perplexity(losses, "doc_id", "losses", 64, 20)


@query()
def random_batch(spark, sf):
    ids = cut(_char_ids(spark, sf))
    return tokens.random_batch(ids, "doc_id", "ids", 64, 500).select("draw", "id", "start", F.size("x").alias("n_x"), F.size("y").alias("n_y"))


@query()
def spm_encode(spark, sf):
    ids = tokens.tokenizer("sentencepiece", PIECES).encode(table(spark, sf, "wiki_it"), "row_id", "text")
    return ids.select("row_id", F.size("ids").alias("n_ids"), F.hash("ids").alias("digest"))


@query()
def rank_encode(spark, sf):
    ids = tokens.tokenizer("ranks", RANKS, r"\s*\S+|\s+").encode(table(spark, sf, "wiki_it"), "row_id", "text")
    return ids.select("row_id", F.size("ids").alias("n_ids"), F.hash("ids").alias("digest"))


@query(f"WITH {_VOCAB.format('wiki_probe')}, a AS (SELECT id, c AS piece, CAST(-id AS DOUBLE) AS score FROM v) SELECT CAST(id AS INTEGER) AS id, piece, score FROM a UNION ALL SELECT CAST((SELECT max(id) FROM a) + 1 + b AS INTEGER), printf('<0x%02X>', b), -10000.0 FROM range(256) t(b)")
def vocab_extension(spark, sf):
    vocabulary = tokens.char_vocabulary(table(spark, sf, "wiki_probe"), "text").select("id", F.col("char").alias("piece"), (-F.col("id")).cast("double").alias("score"))
    return tokens.byte_pieces(vocabulary)


_DOC_WORDS = f"d AS (SELECT doc_id, {WORDS('lower(substring(text, 1, 10000))')} AS words FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {_DOC_WORDS}, c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY 1, 2), m AS (SELECT word, sum(n) AS total FROM c GROUP BY 1),
s AS (SELECT doc_id, sum(n * -ln((total + 1.0) / ((SELECT sum(total) + count(*) + 1.0 FROM m)))) AS nll FROM c JOIN m USING (word) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, CASE WHEN len(words) < 8 THEN NULL ELSE round(exp(nll / len(words)), 4) END AS ppl FROM d LEFT JOIN s USING (doc_id)""")
def unigram_lm_ppl(spark, sf):
    scored = scoring.unigram_perplexity(table(spark, sf, "documents"), "doc_id", "text")
    return scored.withColumn("ppl", F.when(F.col("ppl") < float("inf"), F.round("ppl", 4)))


@query(f"""WITH {_DOC_WORDS}, l AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS p FROM d), g AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM l),
c AS (SELECT doc_id, a, b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT a, b, sum(n) AS pair, sum(sum(n)) OVER (PARTITION BY a) AS heads FROM c GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n * -ln((pair + 1.0) / (heads + (SELECT count(DISTINCT a) + 1.0 FROM l)))) AS nll FROM c JOIN m USING (a, b) GROUP BY 1)
SELECT doc_id, len(words) AS n_words, CASE WHEN len(words) < 8 THEN NULL ELSE round(exp(nll / (len(words) - 1)), 4) END AS ppl FROM d LEFT JOIN s USING (doc_id)""")
def bigram_lm_ppl(spark, sf):
    scored = scoring.bigram_perplexity(table(spark, sf, "documents"), "doc_id", "text")
    return scored.withColumn("ppl", F.when(F.col("ppl") < float("inf"), F.round("ppl", 4)))


_PLACED = "o AS (SELECT ppl, row_number() OVER (ORDER BY ppl) - 1 AS k, count(*) OVER () AS n FROM culturax_it_ppl95 WHERE ppl IS NOT NULL AND isfinite(ppl))"


@query(f"WITH {_PLACED} SELECT cut, ppl AS value FROM o JOIN (VALUES (0.1), (0.5), (0.95)) AS c(cut) ON k = least(CAST(floor(n * CAST(cut AS DOUBLE)) AS BIGINT), n - 1)")
def ppl_percentiles(spark, sf):
    return scoring.index_percentiles(table(spark, sf, "culturax_it_ppl95"), "ppl", [0.1, 0.5, 0.95])


_RULED = FEATURES.replace("doc_id", "rec_id").replace("FROM documents", "FROM culturax_it_ppl95")
_LIMIT = f"""h AS (SELECT rec_id, text FROM f WHERE {HEURISTIC}), t AS (SELECT ppl FROM culturax_it_ppl95 JOIN h USING (rec_id) WHERE ppl IS NOT NULL AND isfinite(ppl) ORDER BY rec_id LIMIT 5000),
q AS (SELECT ppl AS cut FROM (SELECT ppl, row_number() OVER (ORDER BY ppl) - 1 AS k, count(*) OVER () AS n FROM t) WHERE k = least(CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT), n - 1))"""


@query(f"WITH {_RULED}, {_LIMIT} SELECT rec_id, ppl FROM culturax_it_ppl95 WHERE ppl <= (SELECT cut FROM q)")
def ppl_filter(spark, sf):
    rows = table(spark, sf, "culturax_it_ppl95")
    limit = curation.perplexity_limit(filters.heuristic(rows.where("text is not null"), "text"), "rec_id", "ppl", 0.95)
    return filters.perplexity_cut(rows, "ppl", limit).select("rec_id", "ppl")


@query("SELECT rec_id, '=== PPL ' || printf('%.1f', ppl) || ' ===' || chr(10) || substring(text, 1, 600) AS report FROM culturax_it_ppl95 WHERE ppl > 150 AND text IS NOT NULL ORDER BY rec_id LIMIT 500")
def ppl_reject_sample(spark, sf):
    return sinks.reject_sample(table(spark, sf, "culturax_it_ppl95").where("ppl > 150 and text is not null"), "rec_id", "ppl", "text")


_FUNNEL = f"""{_RULED}, {_LIMIT}, g AS (SELECT h.rec_id, h.text FROM h JOIN culturax_it_ppl95 c ON c.rec_id = h.rec_id WHERE c.lang = 'it'), {_dedup_sql('g', 'rec_id', BLANK_LINE)},
k AS (SELECT u.rec_id, u.text FROM u JOIN culturax_it_ppl95 c ON c.rec_id = u.rec_id WHERE ppl <= (SELECT cut FROM q))"""


@query(f"WITH {_FUNNEL} SELECT (SELECT count(*) FROM f) AS n_in, (SELECT count(*) FROM f) - (SELECT count(*) FROM h) AS heuristic, (SELECT count(*) FROM h) - (SELECT count(*) FROM g) AS lang, (SELECT count(*) FROM g) - (SELECT count(*) FROM u) AS dedup, (SELECT count(*) FROM u) - (SELECT count(*) FROM k) AS ppl, (SELECT count(*) FROM k) AS n_out")
def filter_funnel(spark, sf):
    return curation.curate(table(spark, sf, "culturax_it_ppl95"), "rec_id", "text", ("lang", "it"), ppl=("ppl", 0.95))[1]


@query(f"WITH {_FUNNEL} SELECT rec_id, text FROM k")
def curate_full(spark, sf):
    return curation.curate(table(spark, sf, "culturax_it_ppl95"), "rec_id", "text", ("lang", "it"), ppl=("ppl", 0.95))[0]


@query()
def lang_classifier(spark, sf):
    model = cut(scoring.trigram_classifier(table(spark, sf, "lang_samples"), "lang", "text"))
    return scoring.classify_language(table(spark, sf, "documents"), "doc_id", "text", model).withColumn("score", F.round("score", 6))


@query()
def lang_filter(spark, sf):
    model = cut(scoring.trigram_classifier(table(spark, sf, "lang_samples"), "lang", "text"))
    return scoring.language_filter(table(spark, sf, "documents"), "doc_id", "text", model, "it").select("doc_id")


@query("SELECT CASE WHEN prompt IS NULL OR completion IS NULL THEN 'missing_key' END AS reason, count(*) AS n FROM sft_calendar_v2 GROUP BY 1")
def jsonl_validity(spark, sf):
    lines = table(spark, sf, "sft_calendar_v2").select(F.to_json(F.struct("prompt", "completion")).alias("line"))
    return sft.pairs_from_lines(lines, "line").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(prompt, '') = '' THEN 'missing_prompt' WHEN coalesce(completion, '') = '' THEN 'missing_completion' WHEN NOT json_valid(completion) THEN 'bad_json'
WHEN json_extract_string(completion, '$.intent') IS NULL THEN 'no_intent' END AS reason FROM sft_calendar_v2) GROUP BY reason""")
def sft_row_validity(spark, sf):
    return table(spark, sf, "sft_calendar_v2").groupBy(sft.completion_reason(F.col("prompt"), F.col("completion")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_INTENT = "CASE WHEN json_valid(completion) THEN json_extract_string(completion, '$.intent') END"


@query(f"SELECT intent, count(*) AS n FROM (SELECT {_INTENT} AS intent FROM sft_calendar_v2) GROUP BY intent")
def intent_counts(spark, sf):
    return table(spark, sf, "sft_calendar_v2").groupBy(intent(F.col("completion")).alias("intent")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query(f"SELECT count(*) FILTER (WHERE {_INTENT} = 'create_event') AS n_create, count(*) FILTER (WHERE {_INTENT} = 'unknown') AS n_unknown FROM sft_calendar_v2")
def filtered_count(spark, sf):
    own = intent(F.col("completion"))
    return table(spark, sf, "sft_calendar_v2").agg(F.count_if(own == "create_event").alias("n_create"), F.count_if(own == "unknown").alias("n_unknown"))


@query("""WITH j AS (SELECT pair_id, completion::JSON AS j FROM sft_calendar_v2 WHERE json_valid(completion) AND json_type(completion) = 'OBJECT'), k AS (SELECT pair_id, unnest(json_keys(j)) AS slot, j FROM j),
v AS (SELECT pair_id, slot, json_extract(j, '$.' || slot) AS v FROM k), e AS (SELECT pair_id, slot, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract_string(v, '$[*]') ELSE [v ->> '$'] END) AS value FROM v)
SELECT pair_id, slot, value FROM e WHERE value IS NOT NULL""")
def slot_values(spark, sf):
    rows = table(spark, sf, "sft_calendar_v2").where(F.try_parse_json("completion").isNotNull())
    return sft.slots(rows, "pair_id", "completion")


@query("""WITH j AS (SELECT pair_id, completion::JSON AS j FROM sft_calendar_v2 WHERE json_valid(completion) AND json_type(completion) = 'OBJECT'), k AS (SELECT pair_id, unnest(json_keys(j)) AS slot, j FROM j),
v AS (SELECT pair_id, slot, json_extract(j, '$.' || slot) AS v FROM k), l AS (SELECT pair_id, string_agg('"' || slot || '":' || CAST(v AS VARCHAR), ',' ORDER BY slot) FILTER (WHERE json_type(v) <> 'NULL') AS slots FROM v GROUP BY 1)
SELECT pair_id, '{' || coalesce(slots, '') || '}' AS slots FROM j LEFT JOIN l USING (pair_id)""")
def slot_objects(spark, sf):
    rows = table(spark, sf, "sft_calendar_v2").where(F.schema_of_variant(F.try_parse_json("completion")).startswith("OBJECT"))
    return rows.select("pair_id", sft.encode_slots(F.col("completion")).alias("slots"))


def _encoded(spark, sf, most=128):
    rows = table(spark, sf, "sft_calendar_v2").where("prompt is not null and completion is not null")
    both = rows.select(F.concat("prompt", F.lit("\n"), "completion").alias("text"))
    vocabulary = tokens.vocabulary_map(tokens.char_vocabulary(both, "text"))
    ids = rows.select("pair_id", tokens.encode_chars(F.concat("prompt", F.lit("\n")), vocabulary).alias("p"), tokens.encode_chars(F.col("completion"), vocabulary).alias("c"))
    return sft.encode_pairs(ids, "pair_id", "p", "c", most, end_id=1_000_000)


_CUT = """p AS (SELECT pair_id, length(prompt) + 1 AS np, length(completion) + 1 AS nc FROM sft_calendar_v2 WHERE prompt IS NOT NULL AND completion <> ''),
t AS (SELECT pair_id, np, least(nc, 128 - np) AS nc FROM p WHERE np + nc <= 128 OR 128 - np >= 4)"""


@query(f"WITH {_CUT} SELECT pair_id, np + nc AS n_inputs, np + nc AS n_targets, nc AS n_learnt, np AS first_learnt, np + nc - 1 AS last_learnt FROM t")
def sft_mask_lengths(spark, sf):
    rows = _encoded(spark, sf)
    learnt = F.filter(F.transform("targets", lambda x, k: F.when(x != sft.MASKED, (k + 1).cast("long"))), lambda k: k.isNotNull())
    return rows.select("pair_id", F.size("input_ids").cast("long").alias("n_inputs"), F.size("targets").cast("long").alias("n_targets"), F.size(learnt).cast("long").alias("n_learnt"), F.array_min(learnt).alias("first_learnt"), F.array_max(learnt).alias("last_learnt"))


@query(f"WITH {_CUT}, o AS (SELECT pair_id, nc, np + nc AS n, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch FROM t) SELECT pair_id, batch, max(n) OVER (PARTITION BY batch) AS n_inputs, max(n) OVER (PARTITION BY batch) AS n_targets, max(n) OVER (PARTITION BY batch) - nc AS n_masked FROM o")
def sft_batches_padded(spark, sf):
    rows = sft.batches(_encoded(spark, sf), "pair_id", 16)
    masked = F.size(F.filter("targets", lambda x: x == sft.MASKED)).cast("long")
    return rows.select("pair_id", "batch", F.size("input_ids").cast("long").alias("n_inputs"), F.size("targets").cast("long").alias("n_targets"), masked.alias("n_masked"))


@query()
def seeded_shuffle(spark, sf):
    return sft.shuffled(table(spark, sf, "sft_calendar_v2").select("pair_id"), "pair_id")


@query("SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM eval_output WHERE n_tokens = 512")
def masked_mean_loss(spark, sf):
    rows = table(spark, sf, "eval_output").withColumn("target", F.when(F.col("n_tokens") < 512, sft.MASKED).otherwise(1))
    return sft.masked_mean(rows, "loss", "target").withColumn("loss", F.round("loss", 6))


@query()
def synth_static(spark, sf):
    return synth.static_requests(spark)


@query()
def synth_v1(spark, sf):
    return synth.first_requests(spark)


@query()
def synth_v2(spark, sf):
    return synth.all_requests(spark)


@query()
def synth_shortfall(spark, sf):
    return synth.shortfall(synth.all_requests(spark), dict.fromkeys(synth.TEMPLATES, synth.WANTED))


@query("SELECT c_custkey, ['a', 'b', 'c'][CAST(c_custkey % 3 AS INTEGER) + 1] AS value FROM customer")
def round_robin(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", synth.round_robin(("a", "b", "c"), F.col("c_custkey")).alias("value"))


@query("""WITH b AS (SELECT vec_id, block, list_transform(embedding[block * 32 + 1 : block * 32 + 32], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings, range(0, 2) r(block)),
s AS (SELECT *, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) = 0 THEN 1.0 ELSE list_max(list_transform(v, lambda x: abs(x))) / 127 END AS scale FROM b)
SELECT vec_id, CAST(block AS INTEGER) AS block, round(scale, 9) AS scale, array_to_string(list_transform(v, lambda x: CAST(round_even(x / scale, 0) AS INTEGER)), ' ') AS q FROM s""")
def q8_quantize(spark, sf):
    rows = numeric.quantise(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rows.select("vec_id", "block", F.round("scale", 9).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), " ").alias("q"))


def _logits(spark, sf):
    return numeric.temper(numeric.logits(table(spark, sf, "embeddings"), "vec_id", "embedding"), 0.05)


_LOGITS = "g AS (SELECT vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS token, CAST(unnest(embedding) AS DOUBLE) / 0.05 AS logit FROM embeddings)"


@query(f"WITH {_LOGITS} SELECT id, token FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY logit DESC) AS r FROM g) WHERE r <= 5")
def top_k_filter(spark, sf):
    return numeric.top_k(_logits(spark, sf), 5).select("id", "token")


_SOFT = "p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM g), z AS (SELECT id, token, logit, e / sum(e) OVER (PARTITION BY id) AS p FROM p)"


@query(f"WITH {_LOGITS}, {_SOFT}, c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM z) SELECT id, token, round(p, 6) AS p FROM c WHERE b <= 0.6")
def top_p_filter(spark, sf):
    return numeric.top_p(_logits(spark, sf), 0.6).select("id", "token", F.round("p", 6).alias("p"))


@query(f"WITH {_LOGITS} SELECT g.id, token, round(CASE WHEN token <> label THEN logit WHEN logit > 0 THEN logit / 1.3 ELSE logit * 1.3 END, 6) AS logit FROM g JOIN embeddings ON vec_id = g.id")
def repetition_penalty(spark, sf):
    context = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("token"))
    return numeric.penalise(_logits(spark, sf), context, 1.3).withColumn("logit", F.round("logit", 6))


@query(f"WITH {_LOGITS}, {_SOFT} SELECT id, round(-ln(p), 6) AS loss FROM z JOIN embeddings ON vec_id = id WHERE token = label")
def softmax_xent(spark, sf):
    targets = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("token"))
    return numeric.cross_entropy(_logits(spark, sf), targets).withColumn("loss", F.round("loss", 6))


@query("""WITH w AS (SELECT vec_id AS r, generate_subscripts(embedding, 1) - 1 AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), b AS (SELECT r, c, v FROM w WHERE c < 4), a AS (SELECT r, c, v FROM w WHERE r < 4),
p AS (SELECT b.r, a.c, sum(b.v * a.v) * 2.0 AS v FROM b JOIN a ON b.c = a.r GROUP BY 1, 2) SELECT w.r AS "row", CAST(w.c AS INTEGER) AS col, round(w.v + coalesce(p.v, 0), 6) AS value FROM w LEFT JOIN p ON p.r = w.r AND p.c = w.c""")
def low_rank_merge(spark, sf):
    w = numeric.logits(table(spark, sf, "embeddings"), "vec_id", "embedding").select(F.col("id").alias("row"), F.col("token").alias("col"), F.col("logit").alias("value"))
    return numeric.merge_low_rank(w, w.where("row < 4"), w.where("col < 4"), 8.0, 4).withColumn("value", F.round("value", 6))


@query()
def ppl_judged(spark, sf):
    return scoring.judged(table(spark, sf, "wiki_probe"), "probe_id", "text", "bigram").withColumn("ppl", F.round("ppl", 4))


@query("""SELECT step, round(CASE WHEN step < 200 THEN 0.0003 * step / 200 WHEN step >= 3000 THEN 0.00003 ELSE 0.00003 + 0.5 * (1 + cos(pi() * (step - 200) / 2800)) * 0.00027 END, 10) AS rate FROM range(0, 4000) t(step)""")
def lr_schedule(spark, sf):
    return spark.range(4000).select(F.col("id").alias("step"), F.round(numeric.learning_rate(F.col("id"), 3e-4, 3e-5, 200, 3000), 10).alias("rate"))


_CHUNKS = "c AS (SELECT DISTINCT ON (run_id, start_token, n_tokens, loss) * FROM eval_output WHERE loss IS NOT NULL AND n_tokens > 0 ORDER BY run_id, start_token, n_tokens, loss, checkpoint NULLS LAST, corpus)"


def _chunks(spark, sf):
    return table(spark, sf, "eval_output").where("loss is not null and n_tokens > 0")


@query("SELECT corpus, checkpoint, count(*) AS n_chunks, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, round(exp(sum(loss * n_tokens) / sum(n_tokens)), 6) AS ppl FROM eval_output WHERE loss IS NOT NULL AND n_tokens > 0 GROUP BY 1, 2")
def corpus_ppl(spark, sf):
    return evaluation.corpus_perplexity(_chunks(spark, sf), "corpus", "checkpoint").withColumn("ppl", F.round("ppl", 6))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT run_id, start_token, n_tokens, loss FROM eval_output WHERE loss IS NOT NULL AND n_tokens > 0)")
def distinct_chunks(spark, sf):
    return evaluation.chunks(table(spark, sf, "eval_output")).agg(F.count(F.lit(1)).alias("n"))


_PPL = "m AS (SELECT corpus, checkpoint, exp(sum(loss * n_tokens) / sum(n_tokens)) AS ppl FROM eval_output WHERE loss IS NOT NULL AND n_tokens > 0 GROUP BY 1, 2)"


@query(f"""WITH {_PPL}, s AS (SELECT min(checkpoint) AS a, max(checkpoint) AS b FROM eval_output) SELECT corpus, round(x.ppl, 6) AS ppl_a, round(y.ppl, 6) AS ppl_b, round(y.ppl - x.ppl, 6) AS delta,
CASE WHEN y.ppl < x.ppl THEN 'better' WHEN y.ppl > x.ppl THEN 'worse' ELSE 'equal' END AS verdict FROM m x JOIN m y USING (corpus), s WHERE x.checkpoint = s.a AND y.checkpoint = s.b""")
def compare_ppl(spark, sf):
    first, second = table(spark, sf, "eval_output").agg(F.min("checkpoint"), F.max("checkpoint")).first()
    return evaluation.compare(_chunks(spark, sf), first or "", second or "").withColumns({c: F.round(c, 6) for c in ("ppl_a", "ppl_b", "delta")})


@query(f"WITH {_PPL}, b AS (SELECT corpus, ppl AS base FROM m WHERE checkpoint = (SELECT min(checkpoint) FROM eval_output)) SELECT corpus, checkpoint, round(ppl / base, 6) AS ratio, ppl / base > 1.15 AS forgets FROM m JOIN b USING (corpus) WHERE checkpoint IS NOT NULL")
def forgetting_ratio(spark, sf):
    base = table(spark, sf, "eval_output").agg(F.min("checkpoint")).first()[0]
    return evaluation.forgetting(_chunks(spark, sf), base or "").withColumn("ratio", F.round("ratio", 6))


@query("""WITH e AS (SELECT event_type, event_id, value FROM events), b AS (SELECT *, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM e)
SELECT event_type, event_id, value, best_before FROM b WHERE coalesce(value < best_before, value IS NOT NULL)""")
def running_best(spark, sf):
    rows = evaluation.running_best(table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", "value")
    return rows.where("improved").select("event_type", "event_id", "value", "best_before")


@query("SELECT row_id AS id, text FROM wiki_it WHERE text IS NOT NULL AND length(text) >= 500")
def wiki_articles(spark, sf):
    wrapped = F.concat(F.lit('<doc id="1" url="x">\n'), "text", F.lit("\n</doc>\n<doc>\nkurz\n</doc>"))
    rows = table(spark, sf, "wiki_it").where("text is not null").select(F.col("row_id").alias("id"), wrapped.alias("text"))
    return corpus.explode_articles(rows, "text", 500).select("id", "text")


@query("SELECT probe_id, CASE WHEN text IS NULL THEN NULL ELSE text END AS text FROM wiki_probe WHERE text <> ''")
def marked_section(spark, sf):
    framed = F.concat(F.lit("head\n*** START OF THE BOOK ***\n"), "text", F.lit("\n*** END OF THE BOOK ***\nfoot"))
    return table(spark, sf, "wiki_probe").where("text != ''").select("probe_id", T.between(framed, "*** START", "*** END").alias("text"))


@query(f"""WITH b AS (SELECT unnest({PARAS('text', BLANK_LINE)}) AS text FROM wiki_it WHERE text IS NOT NULL) SELECT text, count(*) AS n FROM b GROUP BY text""")
def text_blocks(spark, sf):
    path = new_path(spark)
    sinks.write_corpus(table(spark, sf, "wiki_it").where("text is not null"), path)
    return corpus.text_blocks(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT pair_id, prompt, completion FROM sft_calendar_v2")
def jsonl_roundtrip(spark, sf):
    path = new_path(spark)
    sinks.write_json_lines(table(spark, sf, "sft_calendar_v2").select("pair_id", "prompt", "completion"), path)
    return corpus.json_lines(spark, path, "pair_id bigint, prompt string, completion string").select("pair_id", "prompt", "completion")


@query("SELECT start_token, n_tokens, round(loss, 6) AS loss, count(*) AS n FROM eval_output GROUP BY 1, 2, 3")
def csv_chunks_roundtrip(spark, sf):
    path = new_path(spark)
    sinks.write_chunks(table(spark, sf, "eval_output"), path)
    rows = spark.read.schema("start_token int, n_tokens int, loss double, ppl double").option("header", True).csv(path)
    return rows.groupBy("start_token", "n_tokens", F.round("loss", 6).alias("loss")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars, 0 AS n_errors FROM wiki_probe WHERE text IS NOT NULL")
def file_scan(spark, sf):
    """Texts written as files of text, each found again under the folder and read as a whole."""
    path = new_path(spark)
    rows = table(spark, sf, "wiki_probe").where("text is not null").select(F.col("probe_id").alias("k"), "text")
    rows.repartition("k").write.partitionBy("k").text(path)
    found = files.read_files(spark, path, only=".TXT")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"), F.count("error").cast("int").alias("n_errors"))


@query(f"WITH {_SIZES.format(2)}, t AS (SELECT CAST(floor(before / 100000) AS INTEGER) AS shard, text FROM b JOIN documents ON doc_id = id), p AS (SELECT shard, unnest({PARAS('text', BLANK_LINE)}) AS text FROM t) SELECT shard, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM p GROUP BY shard")
def shard_files(spark, sf):
    path = new_path(spark)
    docs = table(spark, sf, "documents")
    placed = budget.prefix_sums(budget.sizes(docs, "doc_id", "text", "\n\n"), "id", "bytes").select("id", F.floor(F.col("before") / 100_000).cast("int").alias("shard"))
    sinks.write_shards(docs.join(placed, F.col("doc_id") == F.col("id")), path)
    blocks = spark.read.schema("value string, shard int").option("lineSep", "\n\n").text(path).select("shard", T.strip(F.col("value")).alias("text")).where("text != ''")
    return blocks.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT doc_id, length(text) AS n_ids FROM documents WHERE text IS NOT NULL")
def token_cache(spark, sf):
    """Ids of characters made once for a source and its vocabulary; the second call reads what the first has written."""
    folder, source = new_path(spark), table(spark, sf, "documents").where("text is not null")
    for _ in range(2):
        ids = sinks.cached_tokens(spark, folder, source, "chars", lambda: _char_ids(spark, sf))
    return ids.join(source.select("doc_id"), "doc_id").select("doc_id", F.size("ids").alias("n_ids"))


@query("SELECT CAST(row_number() OVER (ORDER BY lang, word) - 1 AS INTEGER) AS id, word || '_' || lang AS piece, -CAST(length(word) AS DOUBLE) AS score FROM common_words")
def vocabulary_lines(spark, sf):
    path = new_path(spark)
    rows = table(spark, sf, "common_words").orderBy("lang", "word").select(F.concat_ws("\t", F.concat_ws("_", "word", "lang"), (-F.length("word")).cast("string")).alias("value"))
    rows.coalesce(1).write.text(path)
    return corpus.vocabulary_file(spark, path).select(F.col("id").cast("int").alias("id"), "piece", "score")


@query("SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT 0 AS source, trim(text, ' ') AS text FROM wiki_probe WHERE length(text) >= 50 UNION ALL SELECT 1, props FROM events WHERE event_type = 'view') GROUP BY source")
def union_sources(spark, sf):
    configs = [
        {"type": "parquet", "path": f"{sf}/wiki_probe.parquet", "text_field": "text", "min_chars": 50},
        {"type": "parquet", "path": f"{sf}/events.parquet", "text_field": "props", "filter": "event_type = 'view'"},
        {"type": "carrier pigeon"},
    ]
    rows, _ = corpus.union_sources(spark, configs)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT source, count(*) AS n, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY source")
def source_totals(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_documents(spark, sf):
    return table(spark, sf, "documents").where("n_chars is not null").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT md5(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY 1")
def stream_exact_dedup(spark, sf):
    from setaccio.streaming import dedup as streams

    path = f"{sf}/documents.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, path))
    return streams.run_available(spark, streams.distinct_texts(stream.select("text"), "text")).select(F.md5("text").alias("digest"))


def _folder(spark, path):
    """A folder to stream from: the table's own, or one with its rows where the table is a single file."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory():
        return path
    copy = new_path(spark)
    spark.read.parquet(path).write.parquet(copy)
    return copy
