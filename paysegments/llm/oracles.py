"""The same results as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from paysegments.llm.mixing import BUCKET_BITS, LEVELS
from paysegments.llm.queries import ESCAPED

OP1 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{ESCAPED}'
  UNION ALL SELECT -7, 1, 'assistant', '{ESCAPED}'
), escaped AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS body,
         replace(replace(role, '\\', '\\\\'), '<|', '<\\|') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || head || '<|text|>' || body || '<|end|>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

# The level of the mix, and the documents under each source's budget, by running sums over
# the hash; the levels of the histogram end at the same document.
OP7 = f"""
WITH docs AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BUCKET_BITS * LEVELS // 4}) AS BIGINT) AS hash
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, 3 * source_size AS most,
    row_number() OVER w AS n,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source IS NULL, source)
), first AS (
  SELECT min(n) AS n FROM ranked WHERE most * shares > weight * rest
), goals AS (
  SELECT r.source, r.source_size,
    CASE WHEN l.n IS NULL OR r.n < l.n THEN CAST(r.most AS DOUBLE)
         ELSE CAST(r.weight * l.rest AS DOUBLE) / l.shares END AS target
  FROM ranked r LEFT JOIN (SELECT f.n, k.rest, k.shares FROM first f JOIN ranked k ON k.n = f.n) l ON true
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM goals
), cells AS (
  SELECT source, hash, CAST(sum(size) AS BIGINT) AS size FROM docs GROUP BY source, hash
), running AS (
  SELECT c.*, b.target - b.rounds * b.source_size AS budget,
    sum(c.size) OVER (PARTITION BY c.source ORDER BY c.hash) AS upto
  FROM cells c JOIN budgets b ON c.source IS NOT DISTINCT FROM b.source
), ends AS (
  SELECT source, min(hash) AS hash FROM running WHERE upto > budget GROUP BY source
), thresholds AS (
  SELECT e.source,
    r.hash + CASE WHEN r.size - (r.budget - (r.upto - r.size)) < r.budget - (r.upto - r.size) THEN 1 ELSE 0 END AS threshold
  FROM ends e JOIN running r ON r.source IS NOT DISTINCT FROM e.source AND r.hash = e.hash
)
SELECT d.doc_id, d.size, b.source_size, b.target,
  d.size * (b.rounds + CASE WHEN d.hash < coalesce(t.threshold, 0) THEN 1 ELSE 0 END) AS taken
FROM docs d
JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN thresholds t ON d.source IS NOT DISTINCT FROM t.source
"""




def crc32(text: str) -> str:
    """The checksum of an ASCII text, which DuckDB lacks: bit by bit."""
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8), lambda c, _: {bit}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    texts = [f"CAST({f} AS VARCHAR)" for f in fields]
    named = [f"coalesce(octet_length(encode({t})) || ':' || {t}, '-')" for t in texts]
    return f"sha256({' || '.join(named)})"


# Trees as levels of (tree, rank, digest, size); tree 0 is over the roots of the others.
OP11 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS found
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS n
  FROM docs
), nodes AS (
  SELECT 0 AS level, lang, i, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT level + 1, lang, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY level, lang, i // 2, n
), tops AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), above AS (
  SELECT 0 AS level, i, digest, n FROM tops
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) // 2
  FROM above WHERE n > 1 GROUP BY level, i // 2, n
), walk AS (
  SELECT row_number() OVER () AS row, l.doc_id, l.lang, l.leaf, l.i, 0 AS level, l.n, false AS over,
    coalesce(l.found, l.leaf) AS folded, '' AS proof
  FROM leaves l
  UNION ALL
  SELECT w.row, w.doc_id, w.lang, w.leaf,
    CASE WHEN w.n > 1 THEN w.i // 2 ELSE t.i END,
    CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE t.n END,
    w.over OR w.n = 1,
    CASE WHEN w.n = 1 THEN w.folded
         WHEN w.i % 2 = 0 THEN sha256(w.folded || coalesce(s.digest, a.digest, ''))
         ELSE sha256(coalesce(s.digest, a.digest) || w.folded) END,
    w.proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(s.digest, a.digest, '') END
  FROM walk w
  LEFT JOIN nodes s ON NOT w.over AND w.n > 1 AND s.lang = w.lang AND s.level = w.level AND s.i = xor(w.i, 1)
  LEFT JOIN above a ON w.over AND w.n > 1 AND a.level = w.level AND a.i = xor(w.i, 1)
  LEFT JOIN tops t ON NOT w.over AND w.n = 1 AND t.lang = w.lang
  WHERE NOT (w.over AND w.n = 1)
)
SELECT w.doc_id, w.leaf, t.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
  w.folded AS folded_root, w.folded = r.digest AS verified
FROM walk w JOIN tops t ON t.lang = w.lang JOIN above r ON r.n = 1
WHERE w.over AND w.n = 1
"""

# Costs to the end by state (start, system, user, assistant), last turn to first, then the
# ASCII-least tight edits, first to last. ``must`` and ``more`` are a turn's faults as costs.
OP12 = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fault
  FROM conversations
), damaged AS (
  SELECT coalesce('=' || conv_id, '') AS c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) FROM marked WHERE fault <> 0)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 32), sha256(text)) AS i,
    count(*) OVER (PARTITION BY c) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, said = '' AS blank,
    said <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS duplicate
  FROM ordered
), rows AS (
  SELECT *, NOT blank AND NOT duplicate AND right(said, 1) NOT IN ('.', '!', '?') AS truncated,
    CASE WHEN blank OR duplicate THEN 1000000000 ELSE 0 END AS must,
    CASE WHEN NOT blank AND NOT duplicate AND right(said, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
  FROM judged
), back AS (
  SELECT DISTINCT c, n AS i, [0, 10, 5, 0] AS v FROM rows
  UNION ALL
  SELECT c, i, [least(r[1], 5 + r[3], 10 + r[4]), least(r[2], 5 + r[3], 10 + r[4]), least(r[3], 5 + r[4]), least(r[4], 5 + r[3])]
  FROM (
    SELECT b.c, b.i - 1 AS i, [
      least(2 + v[1], 1 + must + more + v[3], CASE initial WHEN 's' THEN must + more + v[2] WHEN 'u' THEN must + more + v[3] END),
      least(2 + v[2], 1 + must + more + v[3], CASE initial WHEN 'u' THEN must + more + v[3] END),
      least(2 + v[3], 1 + must + more + v[4], CASE initial WHEN 'a' THEN must + more + v[4] END),
      least(2 + v[4], 1 + must + more + v[3], CASE initial WHEN 'u' THEN must + more + v[3] END)] AS r
    FROM back b JOIN rows USING (c, i)
  )
), walk AS (
  SELECT c, CAST(0 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM rows WHERE i = 1
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN i ELSE i + 1 END,
    CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE forced END,
    audit || edit,
    CASE edit WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE WHEN forced = 3 THEN 'user:' ELSE 'assistant:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT *, CASE WHEN role IS NULL THEN CASE WHEN q IN (2, 3) THEN 'I' END
      WHEN here[q] = 2 + after[q] THEN 'D' WHEN here[q] = 5 + here[forced] THEN 'I'
      WHEN kept IS NOT NULL AND here[q] = must + more + after[kept] THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT w.*, r.role, r.text, r.must, r.more, h.v AS here, a.v AS after, [3, 3, 4, 3][q] AS forced,
        CASE WHEN r.initial = 's' AND q = 1 THEN 2 WHEN r.initial = 'u' AND q <> 3 THEN 3 WHEN r.initial = 'a' AND q = 3 THEN 4 END AS kept
      FROM walk w JOIN back h ON h.c = w.c AND h.i = w.i
      LEFT JOIN rows r ON r.c = w.c AND r.i = w.i + 1
      LEFT JOIN back a ON a.c = w.c AND a.i = w.i + 1
    )
  ) WHERE edit IS NOT NULL
), last AS (
  SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM walk GROUP BY c
), counts AS (
  SELECT c, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY c
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.v[1], 0) AS BIGINT) AS cost,
  coalesce(l.audit, '') AS audit, sha256(coalesce(array_to_string(l.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts k ON k.c = coalesce('=' || o.conv_id, '')
LEFT JOIN last l ON l.c = k.c
LEFT JOIN back b ON b.c = k.c AND b.i = 0
"""


# All windows of 35 words by their digest, with nothing settled beforehand.
OP2 = """
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id,
    coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words
  FROM documents
), words AS (
  SELECT d, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs
), windows AS (
  SELECT d, i, sha256(string_agg(word, ' ') OVER w) AS digest, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY d ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), repeated AS (
  SELECT d, i, i AS start FROM (SELECT d, i, count(*) OVER (PARTITION BY digest) AS times FROM windows WHERE n = 35)
  WHERE times > 1
), marked AS (
  SELECT d, i, word, coalesce(max(start) OVER (PARTITION BY d ORDER BY i) > i - 35, false) AS gone
  FROM words LEFT JOIN repeated USING (d, i)
), kept AS (
  SELECT d, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text
  FROM marked GROUP BY d
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (d)
"""

# Every pair of a label by its cosine, and the least id that can be reached.
OP9 = """
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), finite AS (
  SELECT *, [x for x in v if x IS NOT NULL AND isfinite(x)] AS found FROM vectors
), usable AS (
  SELECT n, vec_id, label, [x / sqrt(list_sum([y * y for y in found])) for x in found] AS unit FROM finite
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(found) = len(v) AND list_sum([y * y for y in found]) > 0
), links AS (
  SELECT a.n, b.n AS other, b.vec_id FROM usable a JOIN usable b
  ON a.label = b.label AND a.n <> b.n AND len(a.unit) = len(b.unit) AND list_dot_product(a.unit, b.unit) >= 0.98
), reached(n, other, vec_id) AS (
  SELECT n, n, vec_id FROM usable
  UNION SELECT r.n, l.other, l.vec_id FROM reached r JOIN links l ON l.n = r.other
), least AS (
  SELECT n, min(vec_id) AS component_id FROM reached GROUP BY n
), counts AS (
  SELECT n, count(*) AS n_links FROM links GROUP BY n
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(vec_id = coalesce(component_id, vec_id), true) AS kept
FROM vectors LEFT JOIN counts USING (n) LEFT JOIN least USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1,
        "op2_substring_dedup": OP2,
        "op7_mixing": OP7,
        "op9_pq_dedup": OP9,
        "op11_merkle_manifest": OP11,
        "op12_conversation_repair": OP12,
    }
