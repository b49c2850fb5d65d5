"""Full-text search over the nodes' texts and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import english as en
from ..operators import fulltext as ft
from ..sinks import shared_folder
from ..sources import views as v
from . import query


def _cases(step: int) -> str:
    """A step's suffixes, longest first, as CASE branches over m."""
    rules = sorted({2: en.STEP2, 3: (*en.STEP3, ("ative", "", None)), 4: en.STEP4}[step], key=lambda r: -len(r[0]))
    out = []
    for suffix, to, before in rules:
        n = len(suffix)
        start = "p2" if step == 4 or suffix == "ative" else "p1"
        also = f" AND regexp_matches(m, '[{before}]{suffix}$')" if before else ""
        out.append(f"WHEN m LIKE '%{suffix}' THEN CASE WHEN length(m) - {n} >= {start}{also} THEN left(m, -{n}) || '{to}' ELSE m END")
    return "CASE " + " ".join(out) + " ELSE m END"


_SHORT = "(regexp_matches(m, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_matches(m, '^[aeiouy][^aeiouy]$'))"
#: SQL of stems: the rules as regular expressions over a table of distinct words (w), step by step.
STEMS = rf"""
st0 AS (SELECT w, CASE {" ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in en.WHOLE.items())} WHEN length(w) < 3 OR regexp_matches(w, '\p{{N}}') THEN w END AS done, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\1Y', 'g') AS m FROM vocabulary),
st1 AS (SELECT *, CASE {" ".join(f"WHEN m LIKE '{p}%' THEN {len(p)}" for p in en.PREFIXES)} WHEN regexp_matches(m, '^[^aeiouy]*[aeiouy]+[^aeiouy]') THEN length(regexp_extract(m, '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length(m) END AS p1 FROM st0),
st2 AS (SELECT w, done, p1, CASE WHEN regexp_matches(substring(m, p1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]') THEN p1 + length(regexp_extract(substring(m, p1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length(m) END AS p2,
  CASE WHEN m LIKE '%sses' THEN left(m, -2) WHEN m LIKE '%ied' OR m LIKE '%ies' THEN CASE WHEN length(m) > 4 THEN left(m, -2) ELSE left(m, -1) END
       WHEN m LIKE '%us' OR m LIKE '%ss' THEN m WHEN regexp_matches(m, '[aeiouy].+s$') THEN left(m, -1) ELSE m END AS m FROM st1),
st3 AS (SELECT w, COALESCE(done, CASE WHEN m IN {en.ALONE} THEN m END) AS done, p1, p2, m, regexp_matches(m, '(eed|eedly)$') AS eed, regexp_matches(m, '[aeiouy].*(ed|edly|ing|ingly)$') AS cut FROM st2),
st4 AS (SELECT w, done, p1, p2, eed, cut, CASE WHEN eed THEN CASE WHEN length(regexp_extract(m, '^(.*)(eed|eedly)$', 1)) >= p1 THEN regexp_replace(m, '(eed|eedly)$', 'ee') ELSE m END
  WHEN cut THEN regexp_replace(m, '(ingly|edly|ing|ed)$', '') ELSE m END AS m FROM st3),
st5 AS (SELECT w, done, p1, p2, CASE WHEN eed OR NOT cut THEN m WHEN regexp_matches(m, '(at|bl|iz)$') THEN m || 'e' WHEN regexp_matches(m, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(m, -1)
  WHEN p1 >= length(m) AND {_SHORT} THEN m || 'e' ELSE m END AS m FROM st4),
st6 AS (SELECT w, done, p1, p2, CASE WHEN regexp_matches(m, '^.+[^aeiouy][yY]$') THEN left(m, -1) || 'i' ELSE m END AS m FROM st5),
st7 AS (SELECT w, done, p1, p2, {_cases(2)} AS m FROM st6),
st8 AS (SELECT w, done, p1, p2, {_cases(3)} AS m FROM st7),
st9 AS (SELECT w, done, p1, p2, {_cases(4)} AS m FROM st8),
stems AS (SELECT w, COALESCE(done, lower(CASE WHEN m LIKE '%e' AND (length(m) - 1 >= p2 OR (length(m) - 1 >= p1 AND NOT (regexp_matches(m, '[^aeiouy][aeiouy][^aeiouywxY]e$') OR regexp_matches(m, '^[aeiouy][^aeiouy]e$')))) THEN left(m, -1)
  WHEN m LIKE '%ll' AND length(m) - 1 >= p2 THEN left(m, -1) ELSE m END)) AS stem FROM st9)"""

#: SQL of the postings of a table @nodes(node_id, content_text, title).
POSTINGS = rf"""
fields AS (SELECT node_id, 'content_text' AS field, content_text AS x FROM @nodes UNION ALL SELECT node_id, 'title', title FROM @nodes),
words AS (SELECT node_id, field, UNNEST(ws) AS w, UNNEST(range(1, len(ws) + 1)) AS pos FROM (SELECT node_id, field, regexp_extract_all(lower(x), '{en.TOKEN}') AS ws FROM fields)),
vocabulary AS (SELECT DISTINCT w FROM words WHERE w NOT IN {en.STOP_WORDS}),{STEMS},
postings AS (SELECT s.stem AS term, node_id, field, pos FROM words JOIN stems s ON words.w = s.w)"""


def ranks(groups: list[tuple[list[list[tuple[str, int]]], list[list[tuple[str, int]]]]]) -> str:
    """SQL of ranked(node_id, rank) for alternatives of (wanted, forbidden) operands over postings."""
    operands = []
    for wanted, forbidden in groups:
        operands += [o for o in (*wanted, *forbidden) if o not in operands]
    place = lambda o: "CASE term " + " ".join(f"WHEN '{t}' THEN {at}" for t, at in o) + " END"
    some = lambda o: ", ".join(f"'{t}'" for t, _ in o)
    occ = " UNION ALL ".join(f"SELECT node_id, field, {k} AS k, pos - {place(o)} AS s, {o[-1][1] + 1} AS wide, {len(o)} AS parts, term FROM postings WHERE term IN ({some(o)})" for k, o in enumerate(operands))
    parts = []
    for g, (wanted, forbidden) in enumerate(groups):
        ks = [operands.index(o) for o in wanted]
        bad = [operands.index(o) for o in forbidden]
        without = f" AND (node_id, field) NOT IN (SELECT (node_id, field) FROM occ WHERE k IN ({', '.join(map(str, bad))}))" if bad else ""
        least = f"LEAST({', '.join(f'l{k}' for k in ks)})"
        before = f"LEAST({', '.join(f'CASE WHEN l{k} = {least} THEN b{k} END' for k in ks)})"
        latest = ", ".join(f"MAX(CASE WHEN k = {k} THEN s END) OVER o AS l{k}, MAX(CASE WHEN k = {k} THEN filled - (e - s + 1) END) OVER o AS b{k}" for k in ks)
        sweep = "WINDOW o AS (PARTITION BY node_id, field ORDER BY e, s, k ROWS UNBOUNDED PRECEDING)"
        parts.append(f"""
g{g}a AS (SELECT *, SUM(e - s + 1) OVER o AS filled FROM occ WHERE k IN ({', '.join(map(str, ks))}){without} {sweep}),
g{g}b AS (SELECT *, {latest} FROM g{g}a {sweep}),
g{g}c AS (SELECT node_id, field, {least} AS p, MIN(e) AS q, ARG_MIN(filled - {before}, (e, s, k)) AS inside FROM g{g}b WHERE {' AND '.join(f'l{k} IS NOT NULL' for k in ks)} GROUP BY ALL)""")
    union = " UNION ALL ".join(f"SELECT node_id, field, p, q, inside FROM g{g}c" for g in range(len(groups)))
    return f"""
occ AS (SELECT node_id, field, k, s, s + wide - 1 AS e FROM ({occ}) GROUP BY node_id, field, k, s, wide, parts HAVING COUNT(DISTINCT term) = parts),{','.join(parts)},
ranked AS (SELECT node_id, ROUND(MAX(rank), 9) AS rank FROM (SELECT node_id, field, SUM(0.1::DOUBLE / (1 + GREATEST(0, q - p + 1 - inside))) AS rank FROM ({union}) GROUP BY node_id, field) GROUP BY node_id)"""


@query(rf"""WITH vocabulary AS (SELECT DISTINCT w FROM (SELECT UNNEST(regexp_extract_all(lower(text), '{en.TOKEN}')) AS w FROM documents) WHERE w NOT IN {en.STOP_WORDS}),{STEMS} SELECT w AS word, stem FROM stems""")
def word_stems(spark, sf_dir):
    """the term of every distinct word of all texts that is no stop word."""
    words = v.read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(en.words_of(F.col("text")))).alias("word"))
    # stop words go by their name: a condition on the stem would be moved before the words are made distinct
    words = words.where(~F.col("word").isin(*en.STOP_WORDS)).distinct()
    return words.select("word", F.get(en.lexemes(F.array("word")), F.lit(0)).alias("stem"))


@query(f"WITH {v.NODES},{POSTINGS.replace('@nodes', 'nodes')},{ranks([([[('ther', 0)], [('erth', 0)]], [])])} SELECT node_id, ROUND(rank, 6) AS rank FROM ranked")
def fts_and_match(spark, sf_dir):
    """every node with both terms, whatever their endings, and its cover density."""
    question = "the thers of erthing"
    return ft.search(ft.postings(v.nodes(spark, sf_dir), only=ft.asked_terms(question)), question).select("node_id", F.round("rank", 6).alias("rank"))


_WEB = 'thatins -erly or "of the orans" anings or "ther" -"as erth" -onings'
_WEB_SQL = [([[("thatin", 0)]], [[("er", 0)]]), ([[("oran", 0)], [("ane", 0)]], []), ([[("ther", 0)]], [[("erth", 0)], [("one", 0)]])]


@query(f"WITH {v.NODES},{POSTINGS.replace('@nodes', 'nodes')},{ranks(_WEB_SQL)} SELECT node_id, ROUND(rank, 6) AS rank FROM ranked")
def fts_alternatives(spark, sf_dir):
    """alternatives, phrases and words that must not be there."""
    return ft.search(ft.postings(v.nodes(spark, sf_dir), only=ft.asked_terms(_WEB)), _WEB).select("node_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {v.NODE_ROWS},{POSTINGS.replace('@nodes', 'node_rows')},{ranks([([[('thatin', 0), ('ononst', 3)]], []), ([[('ere', 0)], [('one', 0)], [('oran', 0)]], [[('hehe', 0)]])])} SELECT node_id, ROUND(rank, 6) AS rank FROM ranked")
def fts_stored(spark, sf_dir):
    """The same from a stored index of all rows, of which the asked terms alone are read."""
    path = shared_folder(spark, "postings")
    ft.write_postings(ft.listed(v.node_rows(spark, sf_dir)), path)
    question = '"thatins of the ononst" or ering onings orans -hehely'
    return ft.search(ft.read_postings(spark, path, ft.asked_terms(question)), question).select("node_id", F.round("rank", 6).alias("rank"))
