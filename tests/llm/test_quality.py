from __future__ import annotations

import random

import pytest

from setaccio.llm import quality

COMMON = ["il", "la", "di", "che", "e", "un", "una", "per", "ha", "non", "con", "a", "in", "si", "da"]
PROSE = "Il gatto di casa non ha mangiato la zuppa, perché la sera prima una vicina gli ha portato un pesce. Poi si è messo a dormire con la coda sul muso e non si è mosso fino a mattina."


@pytest.fixture(scope="module")
def language():
    return quality.Language(COMMON, [PROSE, "La bottega di ferramenta vende chiodi, martelli, viti e corde; il padrone serve tutti con pazienza e conosce ogni cliente per nome. Torre Modello Prezzo Stato Quantità usato nuovo vendita mela pera uva noce fico"])


def kinds(texts, language):
    return [s["kind"] for s in quality.describe(texts, language)]


ITEMS = ["mela rossa", "pera", "uva nera e fico", "noce", "corda", "chiodi", "martello", "viti"]
LISTS = [
    "\n".join(f"{k + 1}. {x}" for k, x in enumerate(ITEMS)), "\n".join(f"- {x}" for x in ITEMS), "\n".join(f"• {x.title()}" for x in ITEMS), "Spesa:\n" + "\n".join(ITEMS), " » ".join(ITEMS), " · ".join(ITEMS),
    PROSE.split(".")[0] + ".\n" + "\n".join(f"* {x}." for x in ITEMS), "\n".join(f"{chr(97 + k)}) {x};" for k, x in enumerate(ITEMS)),
]
ROWS = [("Torre", "usato", "12"), ("Modello", "nuovo", "7,50"), ("Mela", "nuovo", "3"), ("Pera", "usato", "41"), ("Uva", "", "9")]
TABLES = ["\n".join(sep.join(r) for r in ROWS) for sep in (" | ", "\t", ";", " - ")] + ["\n".join('"' + '","'.join(r) + '"' for r in ROWS), "\n".join("  ".join(x.ljust(10) for x in r).strip() for r in ROWS[:4])]
JUNK = [
    "5475>-5/|f  e?*_]&#!%;\n|fee%<6.b~*e@{44|b!06.87?a{cc}\n0!.-;@|af;}}8#<+~;,&|~:3f~?b_<;d\n|8]]~f^ |9{b0^*}|,+,=8b[ &[a4\n",
    "zxqv wkrt pplz qqwx vbnm zzzk wqxr " * 4, "a1b2 c3d4e5 f6_g7 h8k9 k1l2m3 n4 " * 5, "-----------\n***********\n===========\n+++++++++++", "var xq=12;\n.kq-zz{margin:3px}\nif(zqw===3){kkx(qzv,'wqz')}\n" * 3, "clicca qui ora\n" * 9]
INTRO = "Il gatto, secondo il testo (cfr. n. 24, pp. 583), non ha mangiato la zuppa con la mela, perché una vicina gli ha portato un pesce e si è messo a dormire"
LISTS += [INTRO + ".\n" + "\n".join(f"{chr(97 + k)}) {x};" for k, x in enumerate(ITEMS[:4]))]
PROSES = [PROSE, PROSE.replace(". ", ".\n"), PROSE.upper(), PROSE.replace(".", ""), "\n".join(f"– {s.strip()}." for s in PROSE.split(".") if s.strip()), PROSE + "\n- mela\n- pera\n- uva\n" + PROSE, "\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)), "Ciao"]


def test_kinds(language):
    assert kinds(LISTS, language) == ["list"] * len(LISTS)
    assert kinds(TABLES, language) == ["table"] * len(TABLES)
    assert kinds(JUNK, language) == ["junk"] * len(JUNK)
    assert kinds(PROSES, language) == ["prose"] * len(PROSES)
    assert kinds(["", "  \n", " "], language) == ["blank"] * 3


def test_kind_doesnt_depend_on_the_block(language):
    texts = [*LISTS, *TABLES, *JUNK, *PROSES, "", "x"]
    assert kinds(texts, language) == [kinds([t], language)[0] for t in texts]


def covered(text, n):
    """Greatest share of a text's letters in the occurrences of one repeated n-gram, letters of two occurrences counted once."""
    words = text.split()
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    share = {g: sum(len(words[k]) for k in {i + j for i, x in enumerate(grams) if x == g for j in range(n)}) for g in grams if grams.count(g) > 1}
    return max(share.values(), default=0) / max(1, sum(map(len, words)))


@pytest.mark.parametrize("n", quality.NGRAMS)
def test_coverage_by_the_commonest_ngram(language, n):
    r = random.Random(n)
    texts = [" ".join(r.choice(["a", "bb", "ccc"]) for _ in range(r.randint(0, 30))) for _ in range(60)]
    assert [s[f"top_{n}gram"] for s in quality.describe(texts, language)] == pytest.approx([covered(t, n) for t in texts])


def test_a_repeated_word_in_prose(language):
    assert kinds([PROSE + " lalala" * 8, PROSE + " ah" * 16, "ah " * 40], language) == ["prose", "prose", "junk"]


def test_repeated_paragraphs_and_boilerplate():
    paragraph = PROSE.replace(". ", ".\n")
    footer = "Torna alla pagina iniziale oppure cerca nell'archivio.\nQuesto sito usa i cookie. Leggi le notizie della redazione."
    language = quality.Language(COMMON, [PROSE, INTRO, footer, " ".join(ITEMS)])
    assert kinds(["\n\n".join([paragraph] * 5), "\n\n".join([paragraph, PROSE]), PROSE + "\n" + footer], language) == ["junk", "prose", "prose"]
    short = INTRO + ".\n" + "\n".join(f"- {x};" for x in ITEMS[:4]) + "\n" + footer
    assert kinds([short], language) == ["list"]
    assert 0.2 < quality.describe([PROSE + "\n" + footer], language)[0]["boilerplate"] < 0.5


def test_statistics(language):
    (s,) = quality.describe(["Il gatto.\nIl gatto.\n\nuna b2 corda!!"], language)
    assert (s["n_words"], s["n_lines"], s["n_chars"]) == (7, 3, 28)
    assert s["mean_word_length"] == pytest.approx(24 / 7) and s["symbol_ratio"] == pytest.approx(4 / 28) and s["digit_ratio"] == pytest.approx(1 / 28)
    assert s["punctuated_lines"] == 1 and s["common_words"] == pytest.approx(3 / 7) and s["mixed_words"] == pytest.approx(1 / 7)
    assert s["duplicate_lines"] == pytest.approx(1 / 3) and s["duplicate_paragraphs"] == 0
    assert s["top_2gram"] == pytest.approx(14 / 24) and s["top_3gram"] == 0


def test_table(clashing, language):
    rows = [(1, PROSE), (2, None), (3, ""), (1, PROSE), (None, PROSE), (4, PROSE * 3000), (5, LISTS[0])]
    got = quality.text_quality(clashing(rows, "rec long, text string"), "rec", "text", language).collect()
    assert sorted((r.id, r.kind) for r in got) == [(1, "prose"), (1, "prose"), (2, "blank"), (3, "blank"), (4, "prose"), (5, "list")]
    assert quality.text_quality(clashing([], "rec long, text string"), "rec", "text", language).count() == 0


def test_queries(spark, sf):
    found = {r.rec_id: r.kind for r in quality.p1_found(spark, sf).collect()}
    stats = {r.rec_id: r.kind for r in quality.p1_stats(spark, sf).collect()}
    assert len(stats) == spark.read.parquet(f"{sf}/culturax_it_ppl95.parquet").count()
    assert found == {k: v for k, v in stats.items() if v in ("list", "table", "junk")} and set(found.values()) == {"list", "table", "junk"}
    assert sum(r.n_records for r in quality.p1_kinds(spark, sf).collect()) == len(stats)
