"""The queries of this subpackage and, where SQL can say it, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontam, langmix, mixing, neardup, periods, quality, repeats, rules, secretscan, suffixes, tokencounts, turns, urlfilter
from eventloom.session import scratch_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if sql is not None:
            CHECKS[name] = sql.strip()
        return build

    return register


#: Words of a text, in DuckDB.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

@query("op1_language_mixture")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langmix.predict(docs, langmix.train(docs.where(~langmix.held_out(F.col("doc_id")))))


OP2_SQL = r"""
WITH rules(kind, kind_no, pattern, grp, least) AS (VALUES
    ('assign', 0, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
    ('access', 1, 'AKIA[A-Z0-9]+', 0, 18),
    ('hex', 2, '[0-9a-f]+', 0, 16),
    ('private_key', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1),
    ('web_token', 4, 'eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}', 0, 1)),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS (SELECT r, kind, kind_no, grp, least, text, pattern FROM texts, rules WHERE regexp_matches(text, pattern)),
parts AS (
    SELECT r, kind, kind_no, least, unnest(regexp_split_to_array(text, pattern)[:-2]) AS gap,
        unnest(regexp_extract_all(text, pattern)) AS found,
        unnest(CASE WHEN grp = 2 THEN regexp_extract_all(text, pattern, 2) ELSE regexp_extract_all(text, pattern) END) AS secret,
        generate_subscripts(regexp_extract_all(text, pattern), 1) AS no
    FROM hits),
placed AS (
    SELECT r, kind, kind_no, secret, least, length(found) AS size,
        sum(length(gap) + length(found)) OVER (PARTITION BY r, kind_no ORDER BY no) AS stop
    FROM parts),
spans AS (SELECT r, kind, kind_no, stop - size AS start, stop FROM placed WHERE length(secret) >= least),
digest AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, count(*) AS n_spans,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans
    FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, sha256(text) AS blob
FROM texts LEFT JOIN digest USING (r)
"""


@query("op2_secret_scans", OP2_SQL)
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = secretscan.StoredLedger(spark, scratch_path(spark, "secret-ledger"))
    # Some sources after the others; a text that comes again in a later increment is known by then.
    for increment in range(3):
        ledger.advance(docs.where(F.pmod(F.xxhash64("source"), F.lit(3)) == increment))
    return secretscan.report(docs, ledger.ledger().findings)


OP3_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
windows AS (
    SELECT r, pos, array_to_string(words[pos : pos + 4], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS pos FROM texts WHERE len(words) >= 5)),
twice AS (SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(pos, pos + 5)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
        len(list_filter(words, lambda w: regexp_matches(w, '^\p{{Lu}}{{2,}}([^\p{{Lu}}\p{{Ll}}]|$)'))) AS n_shouted
    FROM texts LEFT JOIN covered USING (r) LEFT JOIN dup USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 4 * n_words OR word_chars < 2 * n_words
        OR word_chars > 15 * n_words OR (n_dup_lines > 3 AND 2 * n_dup_lines > n_lines) OR (n_words >= 10 AND 2 * n_shouted > n_words)) AS kept
FROM measured
"""


@query("op3_quality_rules", OP3_SQL)
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = rules.evaluate(table(spark, sf_dir, "documents"))
    base, kept = rules.fails(rules.POLICIES["base"]), ~rules.fails(rules.POLICIES["1"])
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return ledger.select(*columns, base.alias("base_failed"), kept.alias("kept"))


@query("op4_source_mixing")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).taken()


@query("op5_quality_classifier")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, quality.train(docs, table(spark, sf_dir, "labels")))


OP6_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
windows AS (
    SELECT r, pos, array_to_string(words[pos : pos + 34], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS pos FROM texts WHERE len(words) >= 35)),
twice AS (SELECT r, pos FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
gone AS (SELECT r, list(DISTINCT p) AS ps FROM (SELECT r, unnest(range(pos, pos + 35)) AS p FROM twice) GROUP BY r),
kept AS (
    SELECT doc_id, words, coalesce(ps, []) AS ps,
        coalesce((SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT unnest(words) AS w, generate_subscripts(words, 1) AS i)
            WHERE ps IS NULL OR NOT list_contains(ps, i)), '') AS text
    FROM texts LEFT JOIN gone USING (r))
SELECT doc_id, len(words) AS n_words, len(ps) AS n_removed, sha256(text) AS kept_sha256 FROM kept
"""


@query("op6_substring_dedup", OP6_SQL)
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(table(spark, sf_dir, "documents"), length=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: Tokens of a text, in DuckDB; characters of scripts without blanks stand alone.
TOKENS = r"""regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])', ' \1 ', 'g'),
    '[\p{L}\p{M}\p{N}]+')"""

# The rule at every alignment of every document and item, without masks.
OP7_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TOKENS} AS words FROM documents),
items AS (SELECT item_id, words, len(words) AS n, least(len(words), 13) AS span FROM (SELECT item_id, {TOKENS} AS words FROM benchmark) WHERE len(words) >= 5),
doc_words AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS pos FROM docs),
item_words AS (SELECT item_id, n, span, unnest(words) AS w, unnest(range(n)) AS k FROM items),
aligned AS (
    SELECT r, item_id, pos - k AS begin_at, n, span, count(*) AS n_equal, list(k ORDER BY k) AS ks FROM doc_words JOIN item_words USING (w)
    GROUP BY r, item_id, pos - k, n, span HAVING count(*) * 100 >= 80 * span)
SELECT doc_id, item_id, max(n) AS n_tokens, max(n_equal) AS n_equal
FROM aligned JOIN docs USING (r)
WHERE list_max([len(list_filter(ks, lambda k: k >= s AND k < s + span)) FOR s IN range(n - span + 1)]) * 100 >= span * 80
GROUP BY doc_id, item_id
"""


@query("op7_benchmark_decontamination", OP7_SQL)
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_token_counts")
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the whole table for every tokenizer version, reached over inserts, revisions, deletes and replays.

    Each text and draft is encoded once a version; the batches are made of the stored counts.
    """
    docs = table(spark, sf_dir, "documents").withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)))
    drafts = docs.where("part = 0").withColumn("text", F.expr("substring(text, 1, length(text) div 2)"))
    texts = docs.withColumn("draft", F.lit(False)).unionByName(drafts.withColumn("draft", F.lit(True)))
    rollup = tokencounts.Rollup(spark, scratch_path(spark, "token-rollup"))
    for version in tokencounts.VERSIONS:
        stored = scratch_path(spark, "token-counts")
        tokencounts.counted(texts, version, more=("part", "draft")).write.parquet(stored)
        counts = spark.read.parquet(stored)
        early = counts.where("draft OR part = 1")
        rollup.commit(f"insert-{version}", tokencounts.changes(inserted=counts.where("NOT draft AND part <> 0")))
        rollup.commit(f"drafts-{version}", tokencounts.changes(inserted=early))
        for _ in range(2):  # the second time is a replay
            rollup.commit(f"revised-{version}", tokencounts.changes(inserted=counts.where("NOT draft AND part = 0"), deleted=early))
    return rollup.totals()


OP9_SQL = r"""
WITH parts AS (
    SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS at_ FROM pages),
urls AS (
    SELECT page_id, CASE WHEN at_ > 0 THEN substr(url, at_ + 3) ELSE '' END AS tail FROM parts),
split AS (
    SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(tail, '^[^/?#]*', '') AS rest FROM urls),
rules(rule, verdict, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
    ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
listed AS (
    SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
others(name, pattern) AS (VALUES ('pills', '(?i)(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)'), ('casino', '(?i)^([^/?#]*[^a-z0-9/?#])?casino([^a-z0-9]|$)'),
    ('adult', '(?i)^([^/?#]*[^a-z0-9/?#])?(xxx|porn)([^a-z0-9]|$)'), ('login', '(?i)^[^/?#]*/([^?#]*/)?login([/?#.]|$)')),
own AS (SELECT page_id, host, rest, min(name) AS name FROM split JOIN others ON regexp_matches(host || rest, pattern) GROUP BY ALL)
SELECT s.page_id, s.host, s.path, l.rule, coalesce(l.verdict, CASE WHEN name IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(l.rule, name) AS decided_by
FROM split s LEFT JOIN (SELECT DISTINCT * FROM listed) l USING (page_id, host, path) LEFT JOIN own o USING (page_id, host, rest)
"""


@query("op9_url_filters", OP9_SQL)
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules_of = urlfilter.rule_table(spark, (*urlfilter.SITE_RULES, *urlfilter.PATTERN_RULES))
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules_of)


OP10_SQL = rf"""
WITH RECURSIVE texts AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents),
shingles AS (
    SELECT DISTINCT r, array_to_string(words[pos : pos + 3], ' ') AS s
    FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 2, 2))) AS pos FROM texts WHERE len(words) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN sizes x ON a = x.r JOIN sizes y ON b = y.r
    WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
reach(r, root) AS (
    SELECT r, r FROM texts
    UNION
    SELECT b, root FROM reach JOIN links ON reach.r = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM texts LEFT JOIN sizes USING (r)
JOIN (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN texts ON root = texts.r GROUP BY reach.r) USING (r)
"""


@query("op10_minhash_neardup", OP10_SQL)
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


OP11_SQL = r"""
WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(text)) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT r, doc_id, h, length(h) // 2 AS n FROM texts),
windows AS (
    SELECT r, i, md5(substr(h, 2 * i + 1, 200)) AS w
    FROM (SELECT r, h, unnest(range(n - 99)) AS i FROM sized WHERE n >= 100)),
later AS (SELECT r, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY r, i) > 1),
edges AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM edges),
spans AS (SELECT r, min(i) AS start, max(i) + 100 AS stop FROM runs GROUP BY r, run),
gaps AS (
    SELECT r, start, stop, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS after, lead(start) OVER (PARTITION BY r ORDER BY start) AS next FROM spans),
kept AS (
    SELECT r, count(*) AS n_spans, sum(stop - start)::BIGINT AS n_removed,
        string_agg(substr(h, 2 * after + 1, 2 * (start - after)), '' ORDER BY start) || substr(any_value(h), 2 * max(stop) + 1) AS h
    FROM gaps JOIN sized USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, s.h))) AS kept_sha256
FROM sized s LEFT JOIN kept k USING (r)
"""


@query("op11_suffix_array_dedup", OP11_SQL)
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.without_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The unsigned CRC-32 of ASCII text {0}, in DuckDB.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP12_SQL = rf"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
        CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
    FROM keyed WHERE hit <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS no FROM damaged),
faulty AS (
    SELECT *, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY no) AS before,
        CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY no) > 1 THEN 'd'
            WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 't' ELSE '' END AS fault
    FROM ordered),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (no > 1 AND (before || initial) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
    FROM faulty GROUP BY conv_id),
inserts(p, q, cost, audit, made) AS (VALUES (0, 0, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []),
    (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:'])),
steps(p, initial, q, role) AS (VALUES (0, 's', 1, NULL), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
edits AS (
    SELECT conv_id, no, p, p AS q, 2 AS cost, 'D' AS audit, [] AS made FROM faulty, (VALUES (0), (1), (2), (3)) s(p)
    UNION ALL
    SELECT conv_id, no, p, q, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', [f.role || ':' || text] FROM faulty f JOIN steps s USING (initial) WHERE fault NOT IN ('b', 'd')
    UNION ALL
    SELECT conv_id, no, p, q, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', [s.role || ':' || text] FROM faulty f, steps s WHERE s.role IS NOT NULL AND fault NOT IN ('b', 'd')),
moves AS (
    SELECT conv_id, no, e.p, i.q, e.cost + i.cost AS cost, e.audit || i.audit AS audit, list_concat(e.made, i.made) AS made
    FROM edits e JOIN inserts i ON e.q = i.p),
parsed(conv_id, no, q, cost, audit, made) AS (
    SELECT conv_id, 0::BIGINT, q, cost, audit, made FROM counted, inserts WHERE p = 0
    UNION ALL
    SELECT conv_id, no, q, cost, audit, made FROM (
        SELECT m.conv_id, m.no, m.q, a.cost + m.cost AS cost, a.audit || m.audit AS audit, list_concat(a.made, m.made) AS made
        FROM parsed a JOIN moves m ON a.conv_id IS NOT DISTINCT FROM m.conv_id AND m.no = a.no + 1 AND m.p = a.q)
    QUALIFY row_number() OVER (PARTITION BY conv_id, no, q ORDER BY cost, audit) = 1),
best AS (
    SELECT parsed.* FROM parsed JOIN counted c ON parsed.conv_id IS NOT DISTINCT FROM c.conv_id AND no = n WHERE q IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY parsed.conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
"""


@query("op12_conversation_repair", OP12_SQL)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    rows = turns.damaged(original)
    found = turns.repairs(rows)
    out = original.select("conv_id").distinct()
    for more in (found, turns.digests(turns.repaired(rows, found))):
        more = more.withColumnRenamed("conv_id", "_conv")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP13_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words, {CRC32.format("doc_id::VARCHAR")} AS h FROM documents),
plan AS (SELECT *, len(words) AS n, h // 10 AS g FROM texts),
shifted AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM plan),
given AS (
    SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE words END AS words
    FROM shifted),
placed AS (SELECT r, n, unnest(words) AS w, unnest(range(n)) AS i FROM given),
equal AS (SELECT x.r, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, i, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
    SELECT * FROM stretches s WHERE NOT EXISTS (
        SELECT 1 FROM stretches t WHERE t.r = s.r AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
listed AS (
    SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines,
        list([start, start + q, start + length]) AS spans FROM runs GROUP BY r),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::HUGEINT * 1000000000000 // q DESC, start, q) = 1),
dropped AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM placed ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM given LEFT JOIN listed USING (r) LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""


@query("op13_periodic_runs", OP13_SQL)
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = periods.periodic_runs(docs)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
