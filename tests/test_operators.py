"""Edge cases of budgets, tokens, pairs, numbers, sources, sinks and streams against plain Python."""

from __future__ import annotations

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from setaccio.operators import budget, evaluation, numeric, scoring, sft, synth, tokens
from setaccio.plans import curation
from setaccio.sources import corpus, files, sinks
from setaccio.streaming import dedup as streams


def next_fit(sizes, cap):
    shard, size, out = 0, 0, []
    for b in sizes:
        if size + b > cap:
            shard, size = shard + 1, 0
        size += b
        out.append(shard)
    return out


@pytest.mark.parametrize("sizes", [[], [5], [50, 1, 1], [3, 4, 5, 20, 1, 1, 9, 2], [10, 10, 10], [7] * 40, [1, 30, 30, 1, 1], [9, 1, 9, 1, 10, 2]])
def test_next_fit(spark, sizes):
    df = spark.createDataFrame([(k, "x" * n) for k, n in enumerate(sizes)], "id long, text string")
    got = [r.shard for r in budget.shards(df, "id", "text", 10, separator="").orderBy("id").collect()]
    assert got == next_fit(sizes, 10)


def test_shards_stop_after_n(spark):
    df = spark.createDataFrame([(k, "x" * 7) for k in range(9)], "id long, text string")
    assert [r.shard for r in budget.shards(df, "id", "text", 15, 3, "").orderBy("id").collect()] == [0, 0, 1, 1, 2, 2]


def test_prefix_sums_of_many_ranges(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 100_003).alias("id"), (F.col("id") % 13).alias("v"))
    got = budget.prefix_sums(df, "id", "v").orderBy("id").collect()
    total = 0
    for k, r in enumerate(got):
        assert (r.before, r.rank) == (total, k)
        total += r.v


def test_budgets(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "éé"), (3, None), (4, ""), (5, "bbbbb")], "id long, text string")
    assert [r.id for r in budget.until_reached(df, "id", "text", 5).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in budget.until_reached(df, "id", "text", 0).collect()] == []
    assert [r.id for r in budget.never_exceed(df, "id", "text", 14).orderBy("id").collect()] == [1, 2, 4]
    assert [r.id for r in budget.never_exceed(df, "id", "text", 9, skip_bytes=1).orderBy("id").collect()] == [2, 4]


def test_tail_split_guards_the_empty_validation(spark):
    df = spark.createDataFrame([(1, 4), (2, 5)], "id long, n long")
    assert [(r.n_train, r.n_val) for r in budget.tail_split(df, "id", "n").orderBy("id").collect()] == [(4, 0), (5, 0)]
    assert [(r.n_train, r.n_val) for r in budget.tail_split(df, "id", "n", 0.7).orderBy("id").collect()] == [(3, 1), (0, 5)]


def test_characters(spark):
    df = spark.createDataFrame([(1, "abà"), (2, None), (3, ""), (4, "b" + chr(0x1F600))], "id long, text string")
    vocabulary = tokens.char_vocabulary(df, "text")
    assert [(r.char, r.id) for r in vocabulary.orderBy("id").collect()] == [("a", 0), ("b", 1), ("à", 2), (chr(0x1F600), 3)]
    ids = spark.createDataFrame([("zab",), (None,)], "t string").select(tokens.encode_chars(F.col("t"), tokens.vocabulary_map(vocabulary)).alias("i")).collect()
    assert [r.i for r in ids] == [[0, 1], []]
    empty = tokens.vocabulary_map(tokens.char_vocabulary(df.limit(0), "text"))
    back = spark.createDataFrame([([0, 2, 9],), (None,)], "i array<int>").select(tokens.decode_chars(F.col("i"), tokens.vocabulary_map(vocabulary)).alias("t")).collect()
    assert [r.t for r in back] == ["aà?", None]
    assert df.select(tokens.encode_chars(F.col("text"), empty).alias("i")).first().i == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 11, 25])
def test_eval_windows(spark, n):
    df = spark.createDataFrame([(1, n)], "id long, n long")
    want = []
    for begin in range(0, n - 1, 5):
        end = min(begin + 10, n)
        want.append((begin, end, end - begin - 1 if begin == 0 else min(5, end - begin - 1)))
    got = [(r.begin, r.end, r.n_scored) for r in tokens.eval_windows(df, "id", "n", 10, 5).orderBy("begin").collect()]
    assert got == want
    exact = tokens.eval_windows(df, "id", "n", 10, 5, "exact").collect()
    assert sorted(p for r in exact for p in range(r.first_scored, r.end)) == list(range(1, n))


def test_windows(spark):
    df = spark.createDataFrame([(1, list(range(7))), (2, [1, 2]), (3, []), (4, None)], "id long, t array<int>")
    got = [(r.start, r.x, r.y) for r in tokens.windows(df, "id", "t", 3).orderBy("start").collect()]
    assert got == [(k, list(range(k, k + 3)), list(range(k + 1, k + 4))) for k in range(3)]


@pytest.mark.parametrize(("n_prompt", "n_completion", "want"), [(3, 3, 6), (3, 9, 8), (4, 9, 8), (5, 9, None), (5, 3, 8), (3, 0, None)])
def test_pairs_are_cut_and_masked(spark, n_prompt, n_completion, want):
    df = spark.createDataFrame([(1, list(range(n_prompt)), list(range(100, 100 + n_completion)))], "id long, p array<int>, c array<int>")
    got = sft.encode_pairs(df, "id", "p", "c", 8).collect()
    if want is None:
        assert got == []
    else:
        (r,) = got
        assert len(r.input_ids) == len(r.targets) == want
        learnt = r.input_ids[n_prompt:]
        assert r.targets == [-100] * (n_prompt - 1) + learnt + [-100]


def test_lines_of_pairs(spark):
    lines = ["", "  ", "{bad", '{"prompt": "a"}', '{"prompt": "a", "completion": "b"}', "[1]", None]
    got = sft.pairs_from_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    assert [r.reason for r in got.collect()] == ["blank", "blank", "bad_json", "missing_key", None, "missing_key", "blank"]


def test_slots(spark):
    df = spark.createDataFrame([(1, '{"intent": "a", "contact": ["x", "y"], "date": null}'), (2, "no"), (3, None), (4, "{}")], "id long, c string")
    assert sorted((r.id, r.slot, r.value) for r in sft.slots(df, "id", "c").collect()) == [(1, "contact", "x"), (1, "contact", "y"), (1, "intent", "a")]


@pytest.mark.parametrize("n", [31, 32, 33])
def test_quantised_blocks(spark, n):
    v = [math.sin(k) for k in range(n)]
    got = numeric.quantise(spark.createDataFrame([(1, v), (2, [0.0] * n), (3, []), (4, None)], "id long, v array<double>"), "id", "v").orderBy("id", "block").collect()
    assert len(got) == 2 * math.ceil(n / 32)
    for r in got:
        own = (v if r.id == 1 else [0.0] * n)[r.block * 32 : r.block * 32 + 32]
        own += [0.0] * (32 - len(own))
        scale = max(map(abs, own)) / 127 or 1.0
        assert r.scale == pytest.approx(scale) and r.q == [round(x / scale) for x in own]


def test_ties_at_the_kth_stay(spark):
    df = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate((3, 2, 2, 1))], "id long, token int, logit double")
    assert sorted(r.token for r in numeric.top_k(df, 2).collect()) == [0, 1, 2]
    assert sorted(r.token for r in numeric.top_p(df, 0.0).collect()) == [0]


def test_percentile_by_index(spark):
    for n in (1, 2, 10, 11):
        values = [float(k * k) for k in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("inf"),), (float("nan"),)], "ppl double")
        got = {r.cut: r.value for r in scoring.index_percentiles(df, "ppl", [0.1, 0.8, 1.0]).collect()}
        assert got == {c: values[min(int(n * c), n - 1)] for c in (0.1, 0.8, 1.0)}


def test_short_texts_have_infinite_perplexity(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c d e f g h"), (3, None), (4, "")], "id long, text string")
    for f in (scoring.unigram_perplexity, scoring.bigram_perplexity):
        got = {r.id: r.ppl for r in f(df, "id", "text").collect()}
        assert got[1] == got[4] == float("inf") and 1 < got[2] < 100 and 3 not in got


def test_classifier(spark):
    samples = spark.createDataFrame([("it", "il gatto mangia la zuppa e poi dorme sul tetto della casa"), ("en", "the cat eats the soup and then sleeps on the roof of the house")], "lang string, text string")
    model = scoring.trigram_classifier(samples, "lang", "text")
    docs = spark.createDataFrame([(1, "la casa del gatto"), (2, "the house of the cat"), (3, "123"), (4, None)], "id long, text string")
    assert {r.id: r.lang for r in scoring.classify_language(docs, "id", "text", model).collect()} == {1: "it", 2: "en"}


def test_classifier_with_many_trigrams(spark):
    grams = [chr(0x4E00 + i // 300) + chr(0x5000 + i % 300) + "a" for i in range(60_000)]
    model = spark.createDataFrame([(g, {"x": -1.0}) for g in grams], "gram string, p map<string,double>")
    docs = spark.createDataFrame(list(enumerate(grams[::600])), "id long, text string")
    assert scoring.classify_language(docs, "id", "text", model).count() == 100


def test_funnel_adds_up(spark):
    long = "parola diversa " * 30
    data = [(1, long + "a", "it", 10.0), (2, long + "a", "it", 12.0), (3, "corta", "it", 1.0), (4, long + "b", "en", 5.0), (5, long + "c", "it", 900.0), (6, None, "it", 1.0), (7, long + "d", None, 2.0), (8, long + "e", "it", None)]
    out, funnel = curation.curate(spark.createDataFrame(data, "id long, text string, lang string, ppl double"), "id", "text", ("lang", "it"), ppl=("ppl", 0.5))
    f = funnel.first()
    assert f.n_in == 7 == f.heuristic + f.lang + f.dedup + f.ppl + f.n_out
    assert [r.id for r in out.orderBy("id").collect()] == [1]


def test_running_best(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate((3.0, 3.0, 2.0, None, 5.0, 1.0))], "run long, step int, loss double")
    assert [r.step for r in evaluation.running_best(df, "run", "step", "loss").where("improved").orderBy("step").collect()] == [0, 2, 5]


def test_synthetic_requests(spark):
    rows = synth.all_requests(spark).collect()
    assert rows == synth.all_requests(spark).collect()
    by = {}
    for r in rows:
        by.setdefault(r.intent, []).append(r)
        assert "{" not in r.prompt and f'"intent":"{r.intent}"' in r.completion
    assert set(by) == set(synth.TEMPLATES) and max(map(len, by.values())) <= synth.WANTED
    for own in by.values():
        assert len({r.prompt[:60] for r in own}) == len(own)


def archive(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def test_formats(spark, tmp_path):
    w = 'xmlns:w="http://w"'
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"ciao \xff mondo")
    (tmp_path / "sub" / "b.html").write_text("<nav>x</nav><p>testo</p>")
    (tmp_path / "c.docx").write_bytes(archive(word__document_DOT_xml=f"<w:document {w}><w:p><w:r><w:t>Uno</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Due</w:t></w:r></w:p></w:document>"))
    (tmp_path / "d.pptx").write_bytes(archive(ppt__slides__slide2_DOT_xml="<s><txBody><p><t>B</t></p></txBody></s>", ppt__slides__slide1_DOT_xml="<s><txBody><p><t>A</t></p></txBody></s>"))
    (tmp_path / "e.odt").write_bytes(archive(content_DOT_xml='<c xmlns:t="u"><t:p>Riga<t:span>no</t:span> fine</t:p><t:p> </t:p></c>'))
    (tmp_path / "f.epub").write_bytes(archive(ch1_DOT_xhtml="<p>Cap 1</p><sup>9</sup>", ch2_DOT_xhtml="<p>Cap 2</p>"))
    (tmp_path / "g.docx").write_bytes(b"broken")
    (tmp_path / "h.xyz").write_bytes(b"?")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.TXT"] == ("ciao " + chr(0xFFFD) + " mondo", None)
    assert got["b.html"][0] == "testo" and got["c.docx"][0] == "Uno\nDue" and got["d.pptx"][0] == "A\nB" and got["e.odt"][0] == "Riga fine"
    assert got["f.epub"][0] == "Cap 1\n9\n\nCap 2"
    assert got["g.docx"][0] is None and "BadZipFile" in got["g.docx"][1] and got["h.xyz"] == (None, "unknown format")
    assert files.clean_book((tmp_path / "f.epub").read_bytes()) == "Cap 1\n\nCap 2"
    assert {r.path.rsplit("/", 1)[1] for r in files.read_files(spark, str(tmp_path), only="txt,.HTML").collect()} == {"a.TXT", "b.html"}


def test_text_round_trip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("uno\ndue\n\n\n\ntre\n\n  \n\nquattro")
    assert sorted(r.text for r in corpus.text_blocks(spark, str(tmp_path / "in.txt")).collect()) == ["quattro", "tre", "uno\ndue"]
    sinks.write_corpus(spark.createDataFrame([("a\nb",), ("c",)], "text string").coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == "a\nb\n\nc\n\n"


def test_articles_and_vocabulary(spark, tmp_path):
    (tmp_path / "wiki_00").write_text('<doc id="1">\n' + "x" * 600 + '\n</doc>\n<doc id="2">\ncorto\n</doc>\n')
    assert [len(r.text) for r in corpus.article_files(spark, str(tmp_path)).collect()] == [600]
    (tmp_path / "v.tsv").write_text("<pad>\t0\n\"\t-1.5\nà\t-2\n")
    assert [tuple(r) for r in corpus.vocabulary_file(spark, str(tmp_path / "v.tsv")).orderBy("id").collect()] == [(0, "<pad>", 0.0), (1, '"', -1.5), (2, "à", -2.0)]


def test_slots_by_type(spark):
    df = spark.createDataFrame([(1, '{"note": "[urgente] chiamare Ada", "n": 3, "who": ["A", null, "B"], "no": null, "deep": {"x": [1]}}'), (2, "{}"), (3, "bad"), (4, None)], "id long, c string")
    got = sorted((r.id, r.slot, r.value) for r in sft.slots(df, "id", "c").collect())
    assert got == [(1, "deep", '{"x":[1]}'), (1, "n", "3"), (1, "note", "[urgente] chiamare Ada"), (1, "who", "A"), (1, "who", "B")]
    encoded = {r.id: r.e for r in df.select("id", sft.encode_slots(F.col("c")).alias("e")).collect()}
    assert json.loads(encoded[1]) == {"deep": {"x": [1]}, "n": 3, "note": "[urgente] chiamare Ada", "who": ["A", None, "B"]} and list(json.loads(encoded[1])) == sorted(json.loads(encoded[1]))
    assert encoded[2] == "{}" and encoded[4] is None


def test_probe_perplexity(spark):
    losses = [float(k % 7) for k in range(40)]
    df = spark.createDataFrame([(1, losses), (2, losses[:9]), (3, []), (4, [2.0] * 30)], "id long, l array<double>")
    got = {r.id: (r.n_probes, r.ppl) for r in tokens.probe_perplexity(df, "id", "l", 8, 5).collect()}
    assert got[2] == got[3] == (0, None) and got[4] == (5, pytest.approx(math.exp(2)))
    starts = df.where("id = 1").select(*(F.pmod(F.xxhash64("id", F.lit(k), F.lit(42)), F.lit(31)).alias(f"s{k}") for k in range(5))).first()
    assert got[1][1] == pytest.approx(math.exp(sum(sum(losses[s + 1 : s + 9]) / 8 for s in starts) / 5))


def test_random_batch(spark):
    df = spark.createDataFrame([(1, list(range(100))), (2, list(range(500, 504))), (3, []), (4, None), (None, [1] * 50)], "id long, t array<int>")
    rows = tokens.random_batch(df, "id", "t", 4, 60).collect()
    assert len(rows) == 60 and {r.id for r in rows} == {1} and len({r.start for r in rows}) > 20
    assert all(r.x == list(range(r.start, r.start + 4)) and r.y == [v + 1 for v in r.x] and r.start < 95 for r in rows)
    for wrong in ({"n": 10**6, "length": 4}, {"n": 3, "length": 400}):
        with pytest.raises(ValueError):
            tokens.random_batch(df, "id", "t", **wrong)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(budget, "ROWS", 5)
    df = spark.range(3000).select(((F.col("id") * 7919) % 100_003).alias("id"), F.lit(1).alias("v"))
    rows = df.withColumn("r", budget.range_of(df, "id")).orderBy("id").collect()
    assert [r.r for r in rows] == sorted(r.r for r in rows) and len({r.r for r in rows}) > 300
    assert [r.before for r in budget.prefix_sums(df, "id", "v").orderBy("id").collect()] == list(range(3000))


def test_running_best_of_groups(spark):
    rows = [(g, k, float((k * 7 + 3) % 11) if k % 5 else None) for g in ("a", None) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    got = {(r.g, r.k): r.best_before for r in evaluation.running_best(df, "g", "k", "v").collect()}
    for g, k, _ in rows:
        assert got[g, k] == min((v for h, j, v in rows if h == g and j < k and v is not None), default=None)


def test_dry_run(spark):
    assert sinks.dry_run(spark.range(7).where("id > 2")) == 4 and sinks.dry_run(spark.range(0)) == 0


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from setaccio.plans import tables

    class Cluster:
        conf, sparkContext = type("C", (), {"get": staticmethod(lambda k, d: None)}), type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        tables.shared_dir(Cluster)


def test_sources_fail_alone(spark, tmp_path):
    spark.createDataFrame([("abc",), (None,), ("",)], "t string").write.parquet(str(tmp_path / "p"))
    rows, errors = corpus.union_sources(spark, [{"type": "parquet", "path": str(tmp_path / "p"), "text_field": "t"}, {"type": "parquet", "path": str(tmp_path / "none"), "text_field": "t"}, {"type": "?"}])
    assert [(r.source, r.text) for r in rows.collect()] == [(0, "abc")] and [k for k, _ in errors] == [1, 2]


def test_token_cache(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "src"))
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached_tokens(spark, str(tmp_path), spark.read.parquet(str(tmp_path / "src")), "k", make).count() == 3
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "src"))
    sinks.cached_tokens(spark, str(tmp_path), spark.read.parquet(str(tmp_path / "src")), "k", make)
    assert len(made) == 2


def test_stream_of_batches(spark, tmp_path):
    schema = "id long, text string"
    for k, own in enumerate(([(1, "a"), (2, "a")], [(3, "b"), (4, None), (5, "a")])):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = streams.merge_new(spark, stream, "id", "text", str(tmp_path / "seen")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "seen"))
        assert sorted(r.text for r in got.collect()) == ["a", "b"][: k + 1]


def test_curated_stream(spark, tmp_path):
    long = "parola diversa " * 30
    spark.createDataFrame([(1, long), (2, long), (3, "corta")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    assert [r.text for r in streams.run_available(spark, streams.curate(stream, "text")).collect()] == [long]


def test_dump(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><id>1</id><revision><id>9</id><text>'''uno''' {{no}}[x]</text></revision></page><page><title>B</title><ns>0</ns><id>2</id><redirect title='A'>x</redirect><revision><text>due</text></revision></page></mediawiki>")
    assert [tuple(r) for r in corpus.wiki_dump(spark, str(tmp_path / "d.xml")).collect()] == [(1, "A", "uno [x]")]
    assert [r.text for r in corpus.wiki_dump(spark, str(tmp_path / "d.xml"), plain=False).collect()] == ["'''uno''' {{no}}[x]"]


def test_any_scorer(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a"), (3, None)], "id long, text string")
    got = {r.id: r.ppl for r in scoring.perplexity(df, "id", "text", lambda: len).collect()}
    assert got == {1: 15.0, 2: float("inf")}
    labels = {r.id: (r.ppl, r.label, r.bar) for r in scoring.judged(df, "id", "text", lambda: len).collect()}
    assert labels == {1: (15.0, "low", 9), 2: (None, None, None)}


def test_written_tables_can_be_cleared(spark):
    from pathlib import Path

    from setaccio.plans import tables

    before = len(list(Path(tables.shared_dir(spark)).iterdir()))
    tables.cut(spark.range(3))
    assert len(list(Path(tables.shared_dir(spark)).iterdir())) >= before
    assert tables.clear(spark) >= 1 and tables.clear(spark) == 0
