"""One query for each corpus operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Vocabulary of byte-level BPE, among the installed public tokenizers.
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from .lm_score import score_documents

    return score_documents(table(spark, sf_dir, "documents"), tokenizers.path(BYTE_BPE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import detect_toxicity

    return detect_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


#: Bisections run over one row with a list of the sources' tokens: of the entropy, after its upper end was doubled until it
#: meets the target (never for equal largest sources alone), and of the repetition, up to 1.
_ENTROPY = "(SELECT -list_sum(list_transform(w, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) <= 0.95 * ln(len(w)) + 1e-12 FROM (SELECT list_transform(p, lambda x: x / list_sum(p)) AS w FROM (SELECT list_transform(s, lambda x: pow(x / list_max(s), ({k}) / 1048576.0)) AS p)))"
_REPEATS = "(SELECT list_max(list_transform(range(1, len(s) + 1), lambda j: w[j] * list_sum(s) / s[j])) <= 3.0 + 1e-12 FROM (SELECT list_transform(p, lambda x: x / list_sum(p)) AS w FROM (SELECT list_transform(s, lambda x: pow(x / list_max(s), ({k}) / 1048576.0)) AS p)))"
MIX_CTES = r"""
units AS (SELECT doc_id, coalesce(source, '') AS source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))) AS BIGINT) AS n_tokens
          FROM {docs} GROUP BY ALL),
sources AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS t, count(*) AS n FROM units GROUP BY source),
shares AS (SELECT list(t ORDER BY source) AS s, len(list_filter(s, lambda x: x = list_max(s))) AS tops FROM sources WHERE t > 0),
doubled AS (SELECT s, tops, 1048576 AS h FROM shares UNION ALL SELECT s, tops, h * 2 FROM doubled WHERE ln(tops) < 0.95 * ln(len(s)) AND NOT {double_ok}),
by_entropy AS (SELECT s, ln(any_value(tops)) < 0.95 * ln(len(s)) AS reached, 0::BIGINT AS low, max(h)::BIGINT AS high, 0 AS i FROM doubled GROUP BY s UNION ALL
  SELECT s, reached, CASE WHEN {middle_ok} THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN {middle_ok} THEN (low + high) // 2 ELSE high END, i + 1 FROM by_entropy WHERE reached AND low < high),
by_repeats AS (SELECT s, 0::BIGINT AS low, 1048576::BIGINT AS high, 0 AS i FROM shares UNION ALL
  SELECT s, CASE WHEN {repeats_ok} THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN {repeats_ok} THEN (low + high) // 2 ELSE high END, i + 1 FROM by_repeats WHERE low < high),
ends AS (SELECT any_value(s) AS s, arg_max(high, i) AS e, (SELECT arg_max(low, i) FROM by_repeats) AS r FROM by_entropy),
found AS (SELECT CASE WHEN e > r AND {end_ok} THEN e ELSE r END AS k FROM ends),
powers AS (SELECT source, t, n, pow(t / top, k / 1048576.0) AS p, tt FROM sources, found, (SELECT sum(t) AS tt, max(t) AS top FROM sources) WHERE t > 0),
budgets AS (SELECT source, t, n, CAST(round(p / (SELECT sum(p) FROM powers) * 1e9) AS HUGEINT) * CAST(tt AS HUGEINT) // 1000000000 AS b FROM powers),
plan AS (SELECT source, CAST(b // t AS BIGINT) AS passes, CAST(b % t AS BIGINT) AS rest, (n + 4095) // 4096 AS blocks FROM budgets),
dealt AS (SELECT u.*, passes, rest, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % blocks AS block
          FROM units u JOIN plan USING (source)),
rows_ AS (SELECT *, unnest(range(0, passes + 1)) AS pass FROM dealt),
blocks_ AS (SELECT source, pass, block, row_number() OVER o AS block_rank, CAST(sum(t) OVER (o ROWS UNBOUNDED PRECEDING) - t AS BIGINT) AS before
            FROM (SELECT source, pass, block, sum(n_tokens) AS t FROM rows_ GROUP BY ALL)
            WINDOW o AS (PARTITION BY source, pass ORDER BY md5('17|' || pass || '|block|' || block), block)),
placed AS (SELECT *, row_number() OVER o AS place, CAST(sum(n_tokens) OVER (o ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM rows_
           WINDOW o AS (PARTITION BY source, pass, block ORDER BY md5('17|' || pass || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id)),
mixed AS (SELECT doc_id, source, n_tokens, pass, block_rank, place FROM placed JOIN blocks_ USING (source, pass, block)
          WHERE pass < passes OR before + upto <= rest)
"""
_MIDDLE = "(low + high) // 2"
OP5_SQL = "WITH RECURSIVE " + MIX_CTES.format(docs="documents", double_ok=_ENTROPY.format(k="h"), middle_ok=_ENTROPY.format(k=_MIDDLE), repeats_ok=_REPEATS.format(k=_MIDDLE), end_ok=_REPEATS.format(k="e")).strip() + " SELECT * FROM mixed"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import rotate_perspectives

    segments = rotate_perspectives(table(spark, sf_dir, "conversations"))
    return segments.select("conv_id", "perspective", "turn", "place", "start", "mask_start", "mask_end", "is_target", F.sha2(F.col("segment").cast("binary"), 256).alias("segment_sha256"))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'),
seen AS (SELECT conv_id, perspective, turn, speaker, text, speaker = perspective AS is_target,
                '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || regexp_replace(replace(speaker, '<|im_', '<| im_'), '[\r\n]+', ' ', 'g') END || chr(10) AS header
         FROM t JOIN people ON conv_id IS NOT DISTINCT FROM c),
whole AS (SELECT *, header || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS segment FROM seen),
placed AS (SELECT *, row_number() OVER w AS place, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) - length(segment) AS off
           FROM whole WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, turn, place, CAST(off AS BIGINT) AS start,
       CASE WHEN is_target THEN CAST(off + length(header) AS BIGINT) END AS mask_start,
       CASE WHEN is_target THEN CAST(off + length(segment) AS BIGINT) END AS mask_end, is_target, sha256(segment) AS segment_sha256
FROM placed
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: Shared shingles of all pairs of documents, and the closure of the links.
OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS k FROM t UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.k = e.x), m AS (SELECT doc_id, min(k) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t LEFT JOIN n USING (doc_id) JOIN m ON m.doc_id = t.doc_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .line_dedup import dedup_lines

    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: Different lines by their first place, their shared shingles, the closure of the links, and what each document keeps.
OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d), w AS (SELECT *, doc_id * 1000000000 + pos AS here FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
u AS (SELECT line, min(here) AS place FROM w GROUP BY line), h AS (SELECT place, line, string_split(line, '') AS ch FROM u),
s AS (SELECT DISTINCT place, unnest(CASE WHEN len(ch) >= 9 THEN list_transform(range(1, len(ch) - 7), lambda i: ch[i] || ch[i + 1] || ch[i + 2] || ch[i + 3] || ch[i + 4] || ch[i + 5] || ch[i + 6] || ch[i + 7] || ch[i + 8]) ELSE [line] END) AS g FROM h),
n AS (SELECT place, count(*) AS n FROM s GROUP BY place), c AS (SELECT a.place AS x, b.place AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.place < b.place GROUP BY ALL),
k AS (SELECT x, y FROM c JOIN n p ON p.place = x JOIN n q ON q.place = y WHERE 100 * c >= 80 * (p.n + q.n - c)), e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT place, place AS k FROM u UNION SELECT r.place, e.y FROM r JOIN e ON r.k = e.x), m AS (SELECT place FROM r GROUP BY place HAVING min(k) = place),
f AS (SELECT l.doc_id, l.line, l.pos, w.here IS NOT NULL AS worded, w.here IS NULL OR m.place IS NOT NULL AS kept FROM l LEFT JOIN w ON w.doc_id = l.doc_id AND w.pos = l.pos LEFT JOIN m ON m.place = w.here)
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS text_sha256 FROM f GROUP BY doc_id
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


#: crc32 of decimal digits, bit by bit.
CRC_32 = """xor(list_reduce([4294967295] || flatten(list_transform(string_split({0}, ''), lambda d: [ascii(d)::BIGINT] || [-1, -1, -1, -1, -1, -1, -1, -1])),
lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
#: n-grams over lower-case letters and marks, chr(1) for any run of others and before the text; ranks by count, then number.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, lang, text, {crc} % 5 = 0 AS held_out, regexp_matches(coalesce(text, ''), '\p{{L}}') AS lettered,
  regexp_replace(chr(1) || coalesce(lower(text), ''), '[^\p{{L}}\p{{M}}]+', chr(1), 'g') AS f FROM documents),
h AS (SELECT doc_id, string_split(f, '') AS h FROM d), u AS (SELECT doc_id, unnest(h) AS x, unnest(h[2:]) AS y, unnest(h[3:]) AS z FROM h),
g AS (SELECT doc_id, x AS g FROM u UNION ALL SELECT doc_id, x || y FROM u WHERE y IS NOT NULL UNION ALL SELECT doc_id, x || y || z FROM u WHERE z IS NOT NULL),
c AS (SELECT doc_id, g, count(*) AS n FROM g WHERE g <> chr(1) GROUP BY ALL),
q AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM c JOIN d USING (doc_id) WHERE lettered QUALIFY r < 300),
p0 AS (SELECT lang, g, sum(n) AS n FROM c JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS r FROM p0 QUALIFY r < 300),
k AS (SELECT q.doc_id, x.lang, sum(coalesce(abs(p.r - q.r), 300)) AS away, count(*) AS m FROM q CROSS JOIN (SELECT DISTINCT lang FROM p) x LEFT JOIN p ON p.lang = x.lang AND p.g = q.g GROUP BY ALL),
b AS (SELECT doc_id, arg_min(lang, (away, lang)) AS lang_pred, 1 - min(away) / (300 * max(m)) AS score FROM k GROUP BY doc_id)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN b USING (doc_id)
""".format(crc=CRC_32.format("CAST(doc_id AS VARCHAR)"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from .byte_bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizers.path(BYTE_BPE), tokenizers.PATTERN)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True).drop("digest", "parent_digest")


#: A prefix is the list of its turns' digests; ancestors are its beginnings.
OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, CAST(strlen(coalesce(text, '')) AS BIGINT) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, m, b, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) - 1 AS p FROM t),
k AS (SELECT c, {crc} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT k.c, p, m, b FROM k JOIN o ON o.c = k.c - k.c % 5 WHERE p < h UNION ALL SELECT k.c, p, m, b FROM k JOIN o ON o.c = k.c WHERE p >= h),
x AS (SELECT c, row_number() OVER w AS depth, string_agg(m, '') OVER w AS s, b FROM r WINDOW w AS (PARTITION BY c ORDER BY p) UNION ALL SELECT c, 0, '', 0 FROM k),
n AS (SELECT s, depth, min(c) AS conv_id, count(*) AS n_convs, max(b) AS b FROM x GROUP BY s, depth),
e AS (SELECT s, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, arg_max(s, depth) AS s FROM x GROUP BY c) GROUP BY s),
g AS (SELECT left(s, 64 * (depth - 1)) AS s, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN g USING (s)),
z AS (SELECT left(s, 64 * a) AS s, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
      FROM (SELECT s, unnest(range(0, depth + 1)) AS a, CAST(n_children = 0 AS BIGINT) AS leaf, (n_convs - 1) * b AS saved FROM f) GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM f JOIN z USING (s) LEFT JOIN e USING (s) LEFT JOIN n q ON f.depth > 0 AND q.s = left(f.s, 64 * (f.depth - 1))
""".replace("{crc}", CRC_32.format("CAST(c AS VARCHAR)"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocation import collocations

    return collocations(table(spark, sf_dir, "documents"))


LOWER_ASCII = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: All phrases of every piece, without any pass before; scores as HUGEINT.
OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({low}, '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, k, unnest(CASE WHEN len(w) >= k THEN list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) ELSE [] END) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, CAST(CAST(c.a AS HUGEINT) * c.a * 1000000 // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
m AS (SELECT lang, sub, max(a) AS m FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS sub FROM (SELECT lang, a, string_split(phrase, ' ') AS w FROM f WHERE k = 3)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN m ON m.lang = b.lang AND sub = phrase WHERE m IS NULL OR 100 * m < 50 * a QUALIFY rank <= 2000
""".replace("{low}", LOWER_ASCII.format("text"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


#: All runs of as many words as some window has, joined with the windows.
OP13_SQL = r"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
r AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
h AS (SELECT doc_id, s, n, item FROM r JOIN v USING (g, n)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
""".replace("{low}", LOWER_ASCII.format("text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_lm_score, op4_toxicity, op5_mix_sources, op6_chat_format, op7_near_dedup, op8_line_dedup, op9_quality_rules, op10_exact_dedup, op11_prefix_trie, op12_collocations, op13_decontaminate, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_language_id": OP1_SQL, "op7_near_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL, "op5_mix_sources": OP5_SQL, "op6_chat_format": OP6_SQL, "op10_exact_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_collocations": OP12_SQL, "op13_decontaminate": OP13_SQL}
