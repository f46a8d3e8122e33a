"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, crosssplit, langid, leakage, neardup, packing, quality, reading

QUERIES = {
    "p1_found": quality.p1_found,
    "p1_stats": quality.p1_stats,
    "p1_kinds": quality.p1_kinds,
    "p1_sizes": quality.p1_sizes,
    "p2_found": crosssplit.p2_found,
    "p2_counts": crosssplit.p2_counts,
    "p3_found": langid.p3_found,
    "p3_records": langid.p3_records,
    "p3_segments": langid.p3_segments,
    "p4_found": leakage.p4_found,
    "p4_overlaps": leakage.p4_overlaps,
    "p4_items": leakage.p4_items,
    "p5_found": neardup.p5_found,
    "p5_groups": neardup.p5_groups,
    "p6_ids": bpe.p6_ids,
    "p7_bins": packing.p7_bins,
    "p7_fill": packing.p7_fill,
    "p8_found": reading.p8_found,
    "p8_profile": reading.p8_profile,
    "p8_validation": reading.p8_validation,
    "p8_sources": reading.p8_sources,
}


def _words(text: str) -> str:
    """A list of the words of a text: runs of letters or digits, without case and accents."""
    return rf"regexp_extract_all(lower(strip_accents({text})), '[\p{{L}}\p{{N}}]+')"


def _plain(text: str) -> str:
    """A text without invisible characters, markup and breaks of words at line ends."""
    unseen = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in leakage.UNSEEN if a)
    entities = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " "}
    t = rf"regexp_replace(regexp_replace({text}, '[\x{{1}}-\x{{8}}{unseen}]+', '', 'g'), '</?[a-zA-Z][^<>]*>|<!--.*?-->', '', 'gs')"
    for name, sign in entities.items():
        t = f"replace({t}, '{name}', '{sign}')"
    t = rf"regexp_replace({t}, '\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]', '\1', 'g')"
    return rf"regexp_replace({t}, '([\p{{L}}\p{{N}}])[-\x{{2010}}\x{{2011}}][^\S\r\n]*\r?\n[^\S\r\n]*(\p{{L}})', '\1\2', 'g')"


_RUNS = f"""w AS (SELECT row_id, {_words(_plain('text'))} AS w FROM wiki_it WHERE text IS NOT NULL AND row_id IS NOT NULL), v AS (SELECT probe_id, {_words(_plain('text'))} AS w FROM wiki_probe WHERE text IS NOT NULL AND probe_id IS NOT NULL),
a AS (SELECT row_id, k, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM w)), b AS (SELECT probe_id, k, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM v)),
h AS (SELECT DISTINCT row_id, probe_id, a.k AS place, a.k - b.k AS diagonal FROM a JOIN b USING (g))"""
_SETS = f"""w AS (SELECT rec_id, {_words('text')} AS w FROM culturax_it_ppl95 WHERE text IS NOT NULL AND rec_id IS NOT NULL),
s AS (SELECT DISTINCT rec_id, array_to_string(w[k : k + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS k FROM w)), n AS (SELECT rec_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.rec_id AS a, y.rec_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.rec_id < y.rec_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rec_id = a JOIN n y ON y.rec_id = b WHERE 10 * k >= 6 * (x.n + y.n - k))"""

SQL: dict[str, str] = {
    "p4_found": f"WITH {_RUNS} SELECT DISTINCT row_id, probe_id FROM h",
    # consecutive hits on a diagonal are one run, of 11 words more than hits
    "p4_items": f"""WITH {_RUNS}, i AS (SELECT *, place - row_number() OVER (PARTITION BY row_id, probe_id, diagonal ORDER BY place) AS island FROM h),
r AS (SELECT row_id, probe_id, count(*) + 11 AS run FROM i GROUP BY row_id, probe_id, diagonal, island) SELECT probe_id, count(DISTINCT row_id) AS n_articles, CAST(max(run) AS INTEGER) AS longest_run FROM r GROUP BY probe_id""",
    "p5_found": f"WITH {_SETS} SELECT a AS rec_id_a, b AS rec_id_b FROM l",
    "p5_groups": f"""WITH RECURSIVE {_SETS}, e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), c(rec_id, reached) AS (SELECT rec_id, rec_id FROM n UNION SELECT c.rec_id, e.b FROM c JOIN e ON c.reached = e.a),
k AS (SELECT rec_id, md5(string_agg(g, '|' ORDER BY g)) AS k FROM s GROUP BY rec_id) SELECT rec_id, min(rec_id) OVER (PARTITION BY k) AS class_id, group_id FROM k JOIN (SELECT rec_id, min(reached) AS group_id FROM c GROUP BY rec_id) USING (rec_id)""",
    # the statistics that are counts of characters, words and lines
    "p1_sizes": rf"""SELECT rec_id, CAST(length(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')) AS INTEGER) AS n_chars,
CAST(len({_words("replace(coalesce(text, ''), chr(8482), 'TM')")}) AS INTEGER) AS n_words FROM culturax_it_ppl95 WHERE rec_id IS NOT NULL""",
}
