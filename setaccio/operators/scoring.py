"""Perplexity by add-k n-gram models fitted on the corpus, index percentiles, and a trigram language classifier.

They stand in for a neural scorer and a pretrained language model behind the same contracts: a text too short to score has an
infinite perplexity, a long one is scored on its head, and a language is given with a score to compare to a threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setaccio.functions import text as T
from setaccio.plans.tables import cut

#: Characters that are scored, and words a text must have.
HEAD, LEAST_WORDS = 10_000, 8
#: Words or pairs of a model that is sent to every task.
MOST_SENT = 1_000_000
#: Trigrams of a model that is broadcast; a larger one is shuffled.
MOST_GRAMS = 50_000


def _tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    words = T.words(F.lower(F.substring(text_col, 1, HEAD)))
    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("words"))


def _sent(model: DataFrame) -> DataFrame:
    """A written model, marked to be sent to every task if it is small enough for that."""
    return F.broadcast(model) if model.count() <= MOST_SENT else model


def unigram_perplexity(df: DataFrame, id_col: str, text_col: str, k: float = 1.0) -> DataFrame:
    """id_col, n_words, ppl of every text by an add-k model of the words of all texts.

    A model of up to MOST_SENT words goes to every task, and a text's sum is made where the text is read; a larger one is joined by a shuffle.
    """
    docs = _tokens(df, id_col, text_col)
    words = docs.select("id", F.explode("words").alias("word"))
    model = cut(words.groupBy("word").agg(F.count(F.lit(1)).alias("total")))
    sums = model.agg((F.sum("total") + k * (F.count(F.lit(1)) + 1)).alias("all")).scalar()
    nll = -F.log((F.col("total") + k) / F.col("all"))
    scored = words.join(_sent(model), "word").withColumn("all", sums).groupBy("id").agg(F.sum(nll).alias("nll"))
    return _perplexity(docs, scored, id_col, 0)


def bigram_perplexity(df: DataFrame, id_col: str, text_col: str, k: float = 1.0) -> DataFrame:
    """id_col, n_words, ppl of every text by an add-k model of each word given the one before it."""
    docs = _tokens(df, id_col, text_col)
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.element_at("words", i).alias("a"), F.element_at("words", i + 1).alias("b")))
    rows = docs.where(F.size("words") >= 2).select("id", F.explode(pairs).alias("p")).select("id", "p.a", "p.b")
    both = cut(rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("pair")))
    one = both.groupBy("a").agg(F.sum("pair").alias("first"))
    types = docs.select(F.explode("words").alias("w")).agg(F.count_distinct("w").alias("types")).scalar()
    nll = -F.log((F.col("pair") + k) / (F.col("first") + k * (F.col("types") + 1)))
    model = cut(both.join(one, "a").withColumn("types", types).select("a", "b", nll.alias("nll")))
    scored = rows.join(_sent(model), ["a", "b"]).groupBy("id").agg(F.sum("nll").alias("nll"))
    return _perplexity(docs, scored, id_col, 1)


def function_perplexity(df: DataFrame, id_col: str, text_col: str, make) -> DataFrame:
    """id_col, n_words, ppl by any scorer: make() is called once a task and gives a function from the head of a text to its perplexity."""
    import pandas as pd

    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        score = make()
        for b in batches:
            n = b["t"].map(lambda t: len(t.split()))
            ppl = [score(t) if k >= LEAST_WORDS else float("inf") for t, k in zip(b["t"], n)]
            yield pd.DataFrame({id_col: b["k"], "n_words": n, "ppl": pd.Series(ppl, dtype=float)})

    head = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.substring(text_col, 1, HEAD).alias("t"))
    return head.mapInPandas(run, f"`{id_col}` {kind}, n_words int, ppl double")


def perplexity(df: DataFrame, id_col: str, text_col: str, scorer="bigram") -> DataFrame:
    """By a scorer's name, or by a function that makes one (see function_perplexity)."""
    if callable(scorer):
        return function_perplexity(df, id_col, text_col, scorer)
    return {"unigram": unigram_perplexity, "bigram": bigram_perplexity}[scorer](df, id_col, text_col)


def judged(df: DataFrame, id_col: str, text_col: str, scorer="bigram") -> DataFrame:
    """id_col, n_words, ppl, label, bar for a reader: texts of fewer than two words have none of them, short ones no label."""
    rows = perplexity(df, id_col, text_col, scorer)
    known = (F.col("n_words") >= 2) & (F.col("ppl") < float("inf"))
    ppl = F.when(known, F.col("ppl"))
    return rows.select(id_col, "n_words", ppl.alias("ppl"), T.ppl_label(ppl).alias("label"), T.log_bar(ppl).alias("bar"))


def _perplexity(docs: DataFrame, scored: DataFrame, id_col: str, fewer: int) -> DataFrame:
    n = F.size("words")
    ppl = F.when(n < LEAST_WORDS, F.lit(float("inf"))).otherwise(F.exp(F.col("nll") / (n - fewer)))
    return docs.join(scored, "id", "left").select(F.col("id").alias(id_col), n.alias("n_words"), ppl.alias("ppl"))


def index_percentiles(df: DataFrame, value_col: str, cuts: list[float]) -> DataFrame:
    """cut, value: of n finite values in order, the one at index min(int(n * cut), n - 1).

    Values are counted first, so the cumulative counts run over distinct values in ranges, whose totals alone meet in one task.
    """
    from setaccio.operators.budget import prefix_sums

    finite = df.where(F.col(value_col).isNotNull() & ~F.isnan(value_col) & (F.abs(value_col) < float("inf")))
    counts = finite.groupBy(F.col(value_col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = prefix_sums(counts, "value", "n")
    total = counts.agg(F.sum("n").alias("total")).scalar()
    wanted = F.explode(F.array(*(F.lit(float(c)) for c in cuts)))
    rows = placed.withColumn("total", total).withColumn("cut", wanted).withColumn("at", F.least(F.floor(F.col("total") * F.col("cut")), F.col("total") - 1))
    return rows.where("before <= at and at < before + n").select("cut", "value")


def first_sample(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The first n rows in order: a bounded sample."""
    return df.orderBy(order_col).limit(n)


def trigram_classifier(samples: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """gram, and log p a language in a map: an add-one model of the letter trigrams of labelled texts."""
    grams = _grams(samples.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "text").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = grams.groupBy("lang").agg(F.sum("n").alias("all")).agg(F.collect_list(F.struct("lang", "all"))).scalar()  # a row a language
    types = grams.agg(F.count_distinct("gram")).scalar()
    p = F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("all") + F.col("types") + 1))
    full = grams.select("gram").distinct().withColumn("types", types).select("gram", "types", F.inline(sums)).join(grams, ["gram", "lang"], "left")
    return full.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", p))).alias("p"))


def _grams(df: DataFrame, text_col: str) -> DataFrame:
    """df's other columns with gram and n: the letter trigrams of a text's words, ends of words as blanks."""
    clean = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}]+", " "), F.lit(" "))
    grams = F.regexp_extract_all(clean, F.lit("(?=(.{3}))"), F.lit(1))
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.explode(grams).alias("gram")).groupBy(*others, "gram").agg(F.count(F.lit(1)).alias("n"))


def classify_language(df: DataFrame, id_col: str, text_col: str, model: DataFrame, length: int = 500) -> DataFrame:
    """id_col, lang, score of the head of every text that isn't null and has a trigram of the model: the likeliest language and its share of the
    likelihood a trigram, so that long texts aren't all certain."""
    docs = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.substring(text_col, 1, length).alias("text"))
    small = model.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS
    found = _grams(docs, "text").join(F.broadcast(model) if small else model, "gram").select("id", "n", F.explode("p").alias("lang", "p"))
    sums = found.groupBy("id", "lang").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("mean"))
    best = sums.groupBy("id").agg(F.max(F.struct(F.col("mean"), F.col("lang"))).alias("b"), F.collect_list("mean").alias("all"))
    score = 1 / F.aggregate(F.transform("all", lambda m: F.exp((m - F.col("b.mean")) * 10)), F.lit(0.0), lambda a, x: a + x)
    return best.select(F.col("id").alias(id_col), F.col("b.lang").alias("lang"), score.alias("score"))


def language_filter(df: DataFrame, id_col: str, text_col: str, model: DataFrame, lang: str, least: float = 0.85) -> DataFrame:
    """The rows whose text is in the language with at least the given score."""
    return df.join(classify_language(df, id_col, text_col, model).where((F.col("lang") == lang) & (F.col("score") >= least)).select(id_col), id_col, "left_semi")
