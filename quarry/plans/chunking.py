"""Queries that split documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.models import hashed_words
from quarry.operators import chunking as C
from quarry.operators import cleaning as K
from quarry.operators import maintenance as M
from quarry.plans.common import CHUNKS, DOCS, documents, registering

QUERIES, ORACLE_SQL, query = registering()
LINES = DOCS + ", lines AS (SELECT source_file, p - 1 AS line, string_split(text, chr(10))[p] AS text FROM docs, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(p))"


def overlap_chunks(s, d):
    return C.chunk_overlap(documents(s, d), 1000, 200, 300)


@query(f"WITH {CHUNKS} SELECT source_file, chunk_index, content FROM chunks")
def chunk_overlap(s, d):
    return overlap_chunks(s, d)


@query(f"WITH {CHUNKS} SELECT source, count(*)::BIGINT AS chunks, sum(length(content))::BIGINT AS chars, count(DISTINCT source_file)::BIGINT AS files FROM chunks GROUP BY source")
def chunk_counts(s, d):
    by = F.substring_index("source_file", "/", 1).alias("source")
    return overlap_chunks(s, d).groupBy(by).agg(F.count("*").alias("chunks"), F.sum(F.char_length("content")).alias("chars"), F.count_distinct("source_file").alias("files"))


FIXED = rf"""{DOCS}, slices AS (SELECT source_file, i, trim(substring(text, i * 1000 + 1, 1000), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM docs, unnest(range(ceil(length(text) / 1000.0)::INT)) t(i)),
fixed AS (SELECT source_file, (row_number() OVER (PARTITION BY source_file ORDER BY i) - 1)::INT AS chunk_index, content FROM slices WHERE content <> '')"""


@query(f"WITH {FIXED} SELECT * FROM fixed")
def chunk_fixed(s, d):
    return C.chunk_fixed(documents(s, d))


@query(f"""WITH RECURSIVE {FIXED}, n AS (SELECT source_file, max(chunk_index) AS last FROM fixed GROUP BY 1),
step(source_file, i, o, content) AS (
  SELECT source_file, 0, 0, content FROM fixed WHERE chunk_index = 0
  UNION ALL
  SELECT s.source_file, s.i + 1, CASE WHEN length(f.content) < 700 AND length(s.content) + 1 + length(f.content) <= 6000 THEN s.o ELSE s.o + 1 END,
    CASE WHEN length(f.content) < 700 AND length(s.content) + 1 + length(f.content) <= 6000 THEN s.content || ' ' || f.content ELSE f.content END
  FROM step s JOIN fixed f ON f.source_file = s.source_file AND f.chunk_index = s.i + 1)
SELECT source_file, o AS chunk_index, arg_max(content, i) AS content FROM step GROUP BY source_file, o""")
def merge_small(s, d):
    return C.merge_small(C.chunk_fixed(documents(s, d)), 700)


@query(rf"""WITH {LINES}, marked AS (SELECT *, trim(text, ' ' || chr(9) || chr(13)) = '' AS blank, sum((trim(text, ' ' || chr(9) || chr(13)) = '')::INT) OVER (PARTITION BY source_file ORDER BY line) AS island FROM lines)
SELECT source_file, (row_number() OVER (PARTITION BY source_file ORDER BY island) - 1)::INT AS pos, text FROM (SELECT source_file, island, string_agg(text, chr(10) ORDER BY line) AS text FROM marked WHERE NOT blank GROUP BY 1, 2)""")
def paragraph_units(s, d):
    return C.paragraph_units(documents(s, d))


@query(f"""WITH RECURSIVE {LINES}, u AS (SELECT source_file, (row_number() OVER (PARTITION BY source_file ORDER BY line))::INT AS pos, text, length(text) AS n FROM lines WHERE trim(text) <> ''),
step(source_file, pos, part, used) AS (
  SELECT source_file, pos, 0, n FROM u WHERE pos = 1
  UNION ALL
  SELECT u.source_file, u.pos, CASE WHEN s.used + 1 + u.n > 1000 THEN s.part + 1 ELSE s.part END, CASE WHEN s.used + 1 + u.n > 1000 THEN u.n ELSE s.used + 1 + u.n END
  FROM step s JOIN u ON u.source_file = s.source_file AND u.pos = s.pos + 1)
SELECT u.source_file, s.part AS chunk_index, string_agg(u.text, ' ' ORDER BY u.pos) AS content FROM u JOIN step s USING (source_file, pos) GROUP BY 1, 2""")
def chunk_context_aware(s, d):
    return C.packed_texts(documents(s, d), lambda t: [x for x in t.split("\n") if x.strip(" ")], 1000)


@query(f"""WITH RECURSIVE {LINES}, u AS (SELECT source_file, line::INT AS line, length(text) + 1 AS n FROM lines),
step(source_file, line, w, used) AS (
  SELECT source_file, line, 0, n FROM u WHERE line = 0
  UNION ALL
  SELECT u.source_file, u.line, CASE WHEN s.used + u.n > 3000 THEN s.w + 1 ELSE s.w END, CASE WHEN s.used + u.n > 3000 THEN u.n ELSE s.used + u.n END
  FROM step s JOIN u ON u.source_file = s.source_file AND u.line = s.line + 1)
SELECT source_file, w AS "window", min(line) AS first_line, count(*)::BIGINT AS lines, sum(n)::BIGINT AS chars, sum(n) <= 3000 AS send FROM u JOIN step USING (source_file, line) GROUP BY 1, 2""")
def line_windows(s, d):
    return C.line_windows(documents(s, d), 3000)


@query(f"""WITH {DOCS}, p AS (SELECT source_file, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda x: trim(x)), lambda x: x <> '') AS l FROM docs)
SELECT source_file, (i - 1)::INT AS pos, l[i] AS sentence FROM p, unnest(range(1, len(l) + 1)) t(i)""")
def sentences(s, d):
    return C.sentences(documents(s, d))


@query()
def chunk_semantic(s, d):
    return C.chunk_semantic(documents(s, d), hashed_words(16), 0.3)


@query()
def chunk_language(s, d):
    return C.chunk_language(documents(s, d), 1000, 100)


@query()
def cap_length(s, d):
    return C.cap_length(documents(s, d).select("source_file", F.lit(0).alias("chunk_index"), F.col("text").alias("content")))


@query()
def split_over_limit(s, d):
    return C.split_over_limit(documents(s, d), 5000)


@query()
def chunk_markdown(s, d):
    return C.chunk_context_aware(C.paragraph_units(documents(s, d), markdown=True), 2000)


@query(f"""WITH {CHUNKS}, st AS (SELECT source_file, sum(length(content))::BIGINT AS stored FROM chunks GROUP BY 1)
SELECT d.source_file, length(d.text)::BIGINT AS own, coalesce(st.stored, 0)::BIGINT AS stored, coalesce(st.stored, 0) > 10 * length(d.text) AS refused FROM docs d LEFT JOIN st USING (source_file)""")
def stored_ratio_guard(s, d):
    return C.stored_ratio_guard(documents(s, d), overlap_chunks(s, d))


@query(f"""WITH {DOCS} SELECT source_file, length(text)::BIGINT AS n, (1 + greatest(0, ceil((length(text) - 1000) / 800.0)))::BIGINT AS windows, (1 + greatest(0, ceil((length(text) - 1000) / 800.0)))::BIGINT AS estimate FROM docs WHERE length(text) > 0""")
def overlap_windows(s, d):
    n = F.char_length("text")
    return documents(s, d).where(n > 0).select("source_file", n.cast("long").alias("n"), T.overlap_windows(n, 1000, 200).alias("windows"), T.overlap_estimate(n).alias("estimate"))


@query(rf"""WITH {DOCS} SELECT source_file, length(text)::BIGINT AS chars, len(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x) <> ''))::BIGINT AS paragraphs,
 len(list_filter(string_split(text, '. '), lambda x: trim(x) <> ''))::BIGINT AS sentences, ceil(length(text) / 1000.0)::BIGINT AS fixed, (1 + greatest(0, ceil((length(text) - 1000) / 800.0)))::BIGINT AS overlap, FALSE AS flagged FROM docs""")
def corpus_estimates(s, d):
    out = M.corpus_estimates(documents(s, d), 1000, 200)
    return out.select("source_file", *[F.col(c).cast("long").alias(c) for c in ("chars", "paragraphs", "sentences", "fixed", "overlap")], "flagged")


@query(rf"""WITH {DOCS} SELECT source_file, regexp_replace(nfc_normalize(regexp_replace(text, '\r\n?', chr(10), 'g')), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g') AS text FROM docs""")
def normalise_text(s, d):
    return documents(s, d).select("source_file", T.normalise_text(F.col("text")).alias("text"))


@query(f"""WITH {LINES}, k AS (SELECT source_file, line::INT AS line, trim(text) AS t FROM lines WHERE trim(text) <> ''), often AS (SELECT t FROM k GROUP BY t HAVING count(DISTINCT source_file) >= 3)
SELECT DISTINCT source_file, line FROM k WHERE t IN (SELECT t FROM often) OR regexp_matches(t, '^(?i)(page )?[0-9]+( (of|/) [0-9]+)?$')""")
def boilerplate_decisions(s, d):
    return K.boilerplate_decisions(K.document_lines(documents(s, d)), 3)


REMOVALS = LINES + """, k AS (SELECT source_file, line, trim(text) AS t FROM lines WHERE trim(text) <> ''), often AS (SELECT t FROM k GROUP BY t HAVING count(DISTINCT source_file) >= 3),
gone AS (SELECT DISTINCT source_file, line FROM k WHERE t IN (SELECT t FROM often) OR regexp_matches(t, '^(?i)(page )?[0-9]+( (of|/) [0-9]+)?$')),
per AS (SELECT l.source_file, sum(length(text) + 1) AS chars, sum(CASE WHEN g.line IS NOT NULL THEN length(text) + 1 ELSE 0 END) AS removed, max(CASE WHEN g.line IS NOT NULL THEN length(text) END) AS longest, count(g.line) AS gone_lines, count(*) AS lines FROM lines l LEFT JOIN gone g ON g.source_file = l.source_file AND g.line = l.line GROUP BY 1),
f AS (SELECT *, CASE WHEN longest > 200 THEN 'removed-long-line' WHEN removed > 0.2 * chars THEN 'removed-too-much' END AS fallback FROM per)"""


@query(f"""WITH {REMOVALS} SELECT source_file, (CASE WHEN fallback IS NOT NULL THEN lines ELSE lines - gone_lines END)::BIGINT AS kept_lines, (CASE WHEN fallback IS NOT NULL THEN 0 ELSE removed END)::BIGINT AS removed_chars, fallback FROM f""")
def apply_removals(s, d):
    lines = K.document_lines(documents(s, d))
    return K.apply_removals(lines, K.boilerplate_decisions(lines, 3))


@query(f"""WITH {REMOVALS} SELECT l.source_file, string_agg(text, chr(10) ORDER BY l.line) AS text FROM lines l JOIN f USING (source_file) LEFT JOIN gone g ON g.source_file = l.source_file AND g.line = l.line WHERE f.fallback IS NOT NULL OR g.line IS NULL GROUP BY 1""")
def cleaned_documents(s, d):
    lines = K.document_lines(documents(s, d))
    return K.cleaned_documents(lines, K.boilerplate_decisions(lines, 3))


@query("SELECT source AS key, sum(length(text))::BIGINT AS chars, count(*)::BIGINT AS records, (1 + greatest(0, ceil((sum(length(text)) - 1000) / 800.0)))::BIGINT AS estimate, sum(length(text)) <= 10000000 AND 1 + greatest(0, ceil((sum(length(text)) - 1000) / 800.0)) <= 10000 AS ok FROM documents GROUP BY source")
def check_parts(s, d):
    return K.check_parts(documents(s, d).select(F.col("source").alias("key"), "text"))
