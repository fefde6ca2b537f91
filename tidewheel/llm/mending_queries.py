"""Queries of spelling variants, secret scans and conversation repair, with SQL twins."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from tidewheel.llm import conversations, secret_scan, spelling
from tidewheel.llm.tables import table

LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

# The 256 steps of CRC-32, as a list in a column t.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || [k FOR k IN range(8)],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 of ``text``; needs the column t of ``CRC_TABLE``."""
    data = f"hex(encode({text}))"
    codes = f"list_transform(range(len({data}) // 2), lambda k: ('0x' || substr({data}, 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


# --- op11 ----------------------------------------------------------------------------


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), change=spelling.mistyped))


# Near words by deletion: a replaced letter leaves both words equal without it, an inserted
# or deleted one leaves the longer word equal to the shorter.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {LOWER}), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM u, crc),
w AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % {spelling.TYPO_EVERY} = 0
                       THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                       ELSE run END AS word FROM h)
  WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON x.rest = w.word
  UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON x.rest = w.word),
b AS (
  SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, (-near_n, near)) AS best FROM p GROUP BY word),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {spelling.RATIO} * n THEN best END AS form,
         CASE WHEN best_n >= {spelling.RATIO} * n THEN best_n END AS form_n
  FROM w LEFT JOIN b USING (word)),
c AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM f
  UNION ALL
  SELECT c.word, coalesce(f.form, c.root), f.form IS NULL FROM c JOIN f ON f.word = c.root WHERE NOT c.ended)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN c ON c.word = f.word AND c.ended
"""


# --- op12 ----------------------------------------------------------------------------


def op12_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


# --- op13 ----------------------------------------------------------------------------


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damage_report(table(spark, folder, "conversations"))


def _more(way: str, cost: int | str, letter: str) -> str:
    """A way is its cost in 12 digits and its audit, so the least string is the best way."""
    return f"(lpad((substr({way}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({way}, 13) || '{letter}')"


def _insertions(rows: str) -> str:
    """Ways w0..w3 to each state, after at most two insertions."""
    for _ in range(2):
        after = [f"least(w{s}, {', '.join(_more(f'w{p}', conversations.INSERT, 'I') for p in sources)}) AS w{s}"
                 for s, sources in ((2, (0, 1, 3)), (3, (2,)))]
        rows = f"(SELECT * EXCLUDE (w2, w3), {', '.join(after)} FROM {rows})"
    return rows


def _one_row(rows: str) -> str:
    """Ways after the next row: deleted, kept or given another role."""

    def when(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} END"

    cut = "(fault = 'truncated')::INT"
    keep, rerole = f"{conversations.KEEP} + {cut}", f"{conversations.REROLE} + {cut}"
    to = {0: [], 1: [when("NOT goes AND letter = 's'", _more("w0", keep, "K"))], 2: [], 3: []}
    for state, sources, letter in ((2, (0, 1, 3), "u"), (3, (2,), "a")):
        for p in sources:
            to[state].append(when(f"NOT goes AND letter = '{letter}'", _more(f"w{p}", keep, "K")))
            to[state].append(when("NOT goes", _more(f"w{p}", rerole, "R")))
    ways = [f"least({', '.join([_more(f'w{s}', conversations.DELETE, 'D'), *found, 'NULL'])}) AS w{s}" for s, found in to.items()]
    return f"(SELECT c, pos, {', '.join(ways)} FROM {rows})"


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
a AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
e AS (SELECT *, {crc32_sql("c || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw FROM a, crc),
d AS (
  SELECT c, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM e WHERE draw <> 0),
n AS (
  SELECT c, turn, role, text, substr(role, 1, 1) AS letter, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(role || chr(10) || text), copy) AS pos
  FROM d),
m AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN pos > min(pos) OVER (PARTITION BY c, role, text) THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM n),
g AS (SELECT *, fault IN ('blank', 'duplicate') AS goes, lead(letter) OVER (PARTITION BY c ORDER BY pos) AS follows FROM m),
s AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (follows IS NOT NULL AND letter || follows NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last
  FROM g GROUP BY c),
o AS (
  SELECT c, 0::BIGINT AS pos, w0, w1, w2, w3
  FROM {_insertions("(SELECT c, '000000000000' AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM s)")}
  UNION ALL
  SELECT c, pos, w0, w1, w2, w3
  FROM {_insertions(_one_row("(SELECT g.*, w0, w1, w2, w3 FROM o JOIN g ON g.c = o.c AND g.pos = o.pos + 1)"))}),
b AS (SELECT o.c, least(w0, w3) AS way FROM o JOIN s ON s.c = o.c AND s.last = o.pos),
l AS (
  SELECT c, j, substr(way, 12 + j, 1) AS edit FROM (SELECT c, way, unnest(range(1, length(way) - 11)) AS j FROM b)),
k AS (
  SELECT c, j, edit, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w AS made
  FROM l WINDOW w AS (PARTITION BY c ORDER BY j)),
z AS (
  SELECT k.c, k.j, k.edit, k.made, CASE WHEN k.edit <> 'I' THEN g.role END AS role, CASE WHEN k.edit <> 'I' THEN g.text ELSE '' END AS text,
         max(CASE WHEN k.made = 1 AND k.edit = 'K' AND g.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k.c) AS opened
  FROM k LEFT JOIN g ON g.c = k.c AND g.pos = k.pos WHERE k.edit <> 'D'),
t AS (
  SELECT c, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (made - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text,
                              chr(10) ORDER BY j)) AS digest
  FROM z GROUP BY c)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(substr(way, 1, 12)::BIGINT, 0) AS cost,
       coalesce(substr(way, 13), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM a) i LEFT JOIN s ON s.c = i.c LEFT JOIN b ON b.c = i.c LEFT JOIN t ON t.c = i.c
"""

QUERIES = {
    "op11_spelling_variants": (op11_spelling_variants, OP11_SQL),
    "op12_secret_scan": (op12_secret_scan, None),
    "op13_conversation_repair": (op13_conversation_repair, OP13_SQL),
}
