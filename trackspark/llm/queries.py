"""The production queries of this subpackage over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, conversations, decontam, langid, licenses, neardup, packing, quality, resample, secrets, sharding, substring, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> str:
    return f"pmod(crc32(cast(cast(doc_id AS string) AS binary)), {n})"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), f"{_remainder(4)} <> 2")
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(F.expr(f"{_remainder(4)} = 2"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("version")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/archive"
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    back = warc.record_bytes(warc.read_archive(spark, path))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha2("record", 256).alias("record_sha256"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs, f"{_remainder(3)} <> 1")
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", F.coalesce(F.expr(f"{_remainder(3)} = 1"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")), present="present"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_neardup, op3_secrets, op4_decontam, op5_warc, op6_langid, op7_packing, op8_ann, op9_sharding, op10_substring, op11_resample, op12_conversations, op13_licenses)}

WORDS = "[^\\x20\\x09-\\x0D]+"


def _spans_sql() -> str:
    parts = []
    for i, rule in enumerate(secrets.RULES):
        pattern = (rule.scan or rule.pattern).replace("'", "''")
        parts.append(f"""
            SELECT doc_id, list_filter(list_transform(range(1, len(found) + 1), lambda i: {{
                'start': CAST(list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS BIGINT),
                'kind_no': {i}, 'size': length(found[i]), 'tested': length(tested[i]), 'kind': '{rule.kind}'}}), lambda s: s.tested >= {rule.least}) AS spans
            FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS pieces, regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {rule.group}) AS tested FROM d)""")
    return " UNION ALL ".join(parts)


_WORD = 1 << 64


def _finalised(x: int) -> int:
    """The 64-bit finaliser in plain integers."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % _WORD
    x = (x ^ x >> 27) * 0x94D049BB133111EB % _WORD
    return x ^ x >> 31


def _step_sql(source: str, seed: int, rounds: int) -> str:
    """One pass of the Feistel rounds over rows (doc_id, size, text_crc32, n, a, b, x) of source."""
    query = f"SELECT * EXCLUDE (x), x // b AS l, x % b AS r FROM {source}"
    for i in range(rounds):
        key = _finalised(((i + 1) * 0x9E3779B97F4A7C15 + seed) % _WORD)
        fixed, moved, size = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        query = f"SELECT *, xor(CAST({fixed} AS UHUGEINT), CAST({key} AS UHUGEINT)) AS m FROM ({query})"
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            query = f"SELECT * REPLACE ((xor(m, m >> {shift}) * CAST({factor} AS UHUGEINT)) % CAST({_WORD} AS UHUGEINT) AS m) FROM ({query})"
        query = f"SELECT * EXCLUDE (m) REPLACE (({moved} + CAST(xor(m, m >> 31) % CAST({size} AS UHUGEINT) AS BIGINT)) % {size} AS {moved}) FROM ({query})"
    return f"SELECT doc_id, size, text_crc32, row_number, n, a, b, l * b + r AS x FROM ({query})"


def _sharding_sql(shards: int = 40, seed: int = 20240101, rounds: int = 6) -> str:
    """CRC-32 byte by byte, global row numbers, and the permutation with cycle walking."""
    return f"""
        WITH RECURSIVE t AS (
            SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k)) AS tab),
        h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) + 16 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
        bytes AS (SELECT doc_id, size, list_transform(range(1, 2 * (size - 16), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)) AS bytes FROM h),
        d AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM bytes, t),
        s AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number, count(*) OVER () AS n FROM d),
        g AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM s),
        p AS (SELECT doc_id, size, text_crc32, row_number, n, a, (n + a - 1) // a AS b, row_number AS x FROM g),
        w AS (
            {_step_sql("p", seed, rounds)}
            UNION ALL
            {_step_sql("(SELECT * FROM w WHERE x >= n)", seed, rounds)})
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_number
        FROM w WHERE x < n
    """


#: Lower-cased words of ASCII letters and digits and of all characters beyond ASCII.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _resample_sql() -> str:
    """Features by list functions, CRC-32 of the distinct ones byte by byte, and ranks by one sort."""

    def features(table: str) -> str:
        return f"SELECT rn, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM {table}"

    return f"""
        WITH t AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k)) AS tab),
        d AS (SELECT row_number() OVER () AS rn, doc_id, {PLAIN_WORDS} AS w FROM documents),
        b AS (SELECT row_number() OVER () AS rn, {PLAIN_WORDS} AS w FROM benchmark),
        df AS (SELECT rn, f, count(*) AS n FROM ({features("d")}) GROUP BY rn, f),
        bf AS (SELECT f, count(*) AS n FROM ({features("b")}) GROUP BY f),
        h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
        k AS (SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM h, t),
        s AS (SELECT bucket, sum(n) AS n FROM df JOIN k USING (f) GROUP BY bucket),
        u AS (SELECT bucket, sum(n) AS n FROM bf JOIN k USING (f) GROUP BY bucket),
        n AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS all_s, (SELECT coalesce(sum(n), 0) FROM u) AS all_t),
        g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n, s LEFT JOIN u ON u.bucket = s.bucket),
        m AS (SELECT rn, sum(df.n) AS n, sum(df.n * gain) AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY rn),
        x AS (SELECT rn, doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total::DOUBLE / n::DOUBLE), 0) AS BIGINT) AS weight,
                     CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (rn)),
        y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
        r AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, rn) AS place, count(*) OVER () AS able FROM y WHERE n_words >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * able // 100 THEN place END AS rank FROM y LEFT JOIN r USING (rn)
    """


def _licenses_sql() -> str:
    """The phrases as literals; the notices' wordings, which are data, from the operator."""
    phrases = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
    rows = ", ".join(f"({i}, '{label}', {str(i < 3).lower()}, '{text}')" for i, (label, text) in enumerate([*phrases, *licenses.NOTICES]))

    def best(diagonals: str) -> str:
        low, high = (f"list_{m}(list_transform({diagonals}, lambda d: d.diagonal + list_{m}(d.places)))" for m in ("min", "max"))
        covered = f"len(list_distinct(flatten(list_transform(flatten(list_transform({diagonals}, lambda d: d.places)), lambda p: [p, p + 1, p + 2]))))"
        return f"{{'ratio': {covered} / greatest(size, {high} + 3 - {low}), 'covered': {covered}, 'length': {high} + 3 - {low}}}"

    return f"""
        WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {PLAIN_WORDS} AS w FROM documents),
        t AS (SELECT template, label, phrase, w, len(w) AS size FROM (SELECT template, label, phrase, {PLAIN_WORDS} AS w FROM (VALUES {rows}) v(template, label, phrase, text))),
        tg AS (SELECT * EXCLUDE (w), w[spot + 1:spot + 3] AS gram FROM (SELECT *, unnest(range(0, size - 2)) AS spot FROM t)),
        g AS (SELECT rn, place, w[place + 1:place + 3] AS gram FROM (SELECT rn, w, unnest(range(0, len(w) - 2)) AS place FROM d)),
        v AS (SELECT rn, template, label, phrase, size, place - spot AS diagonal, count(*) AS votes, list_sort(list(DISTINCT spot)) AS places FROM g JOIN tg USING (gram) GROUP BY ALL),
        n AS (SELECT *, list({{'diagonal': diagonal, 'places': places}}) OVER (PARTITION BY rn, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND 8 FOLLOWING) AS near FROM v),
        b AS (SELECT *, greatest({best("[{'diagonal': diagonal, 'places': places}]")}, {best("near")}) AS best FROM n),
        s AS (SELECT rn, label, phrase AND votes = size - 2 AS base, diagonal, best.ratio AS ratio, greatest(size, best.length) - best.covered <= size // 12 AS verified FROM b),
        a AS (SELECT rn, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
                     array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (verified)), ',') AS labels, max(ratio) AS score FROM s GROUP BY rn)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
        FROM d LEFT JOIN a USING (rn)
    """


def _conversations_sql() -> str:
    """The plain dynamic programme: whole audit texts and repaired lines in each state, row by row."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
        WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda k: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k)) AS tab),
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
        c AS (SELECT *, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS hit FROM k, t),
        v AS (SELECT row_number() OVER () AS conv, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
        e AS (SELECT conv, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
              FROM c JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id WHERE hit <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS i, rtrim(text, {blanks}) AS ending FROM e),
        f AS (SELECT *, left(role, 1) AS kind, ending = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, right(ending, 1) NOT IN ('.', '!', '?') AS open_end, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM o),
        g AS (SELECT conv, i, role, text, kind, blank, again AND NOT blank AS duplicate, open_end AND NOT blank AND NOT again AS truncated, turn, before FROM f),
        s AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                     count(*) FILTER (before IS NOT NULL AND before || kind NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM g GROUP BY conv),
        ins AS (SELECT * FROM (VALUES (0, 0, '', 0, NULL), (1, 1, '', 0, NULL), (2, 2, '', 0, NULL), (3, 3, '', 0, NULL), (0, 2, 'I', 5, 'user:'), (1, 2, 'I', 5, 'user:'), (2, 3, 'I', 5, 'assistant:'), (3, 2, 'I', 5, 'user:')) x(p, m, code, cost, line)),
        op AS (SELECT * FROM (VALUES (0, 0, 'D', 2, NULL, NULL), (1, 1, 'D', 2, NULL, NULL), (2, 2, 'D', 2, NULL, NULL), (3, 3, 'D', 2, NULL, NULL), (0, 2, 'R', 1, NULL, 'user'), (1, 2, 'R', 1, NULL, 'user'), (3, 2, 'R', 1, NULL, 'user'), (2, 3, 'R', 1, NULL, 'assistant'),
                                     (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (3, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL)) x(m, q, code, cost, kind, role)),
        r AS (
            SELECT conv, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM v
            UNION ALL
            SELECT * FROM (
                SELECT r.conv, g.i, op.q, r.cost + ins.cost + op.cost + CASE WHEN op.code <> 'D' AND truncated THEN 5 ELSE 0 END AS cost, r.audit || ins.code || op.code AS audit,
                       r.lines || CASE WHEN ins.line IS NULL THEN [] ELSE [ins.line] END || CASE op.code WHEN 'D' THEN [] WHEN 'K' THEN [g.role || ':' || g.text] ELSE [op.role || ':' || g.text] END AS lines
                FROM r JOIN g ON g.conv = r.conv AND g.i = r.i + 1 JOIN ins ON ins.p = r.q JOIN op ON op.m = ins.m AND (op.kind IS NULL OR op.kind = g.kind) AND (op.code = 'D' OR NOT (blank OR duplicate)))
            QUALIFY row_number() OVER (PARTITION BY conv, q ORDER BY cost, audit) = 1),
        z AS (SELECT r.conv, r.cost + ins.cost AS cost, r.audit || ins.code AS audit, r.lines || CASE WHEN ins.line IS NULL THEN [] ELSE [ins.line] END AS lines
              FROM r LEFT JOIN s USING (conv) JOIN ins ON ins.p = r.q AND ins.m IN (0, 3) WHERE r.i = coalesce(s.n, 0) QUALIFY row_number() OVER (PARTITION BY r.conv ORDER BY r.cost + ins.cost, r.audit || ins.code) = 1)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
        FROM v JOIN z USING (conv) LEFT JOIN s USING (conv)
    """


ORACLE_SQL: dict[str, str] = {
    "op12_conversations": _conversations_sql(),
    "op13_licenses": _licenses_sql(),
    "op11_resample": _resample_sql(),
    "op9_sharding": _sharding_sql(),
    "op2_neardup": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS.replace(chr(92) * 2, chr(92))}') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS items FROM d),
        e AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
        links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id
                  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
        least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT s.doc_id, CAST(len(items) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least ON least.x = s.doc_id
    """,
    "op3_secrets": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({_spans_sql()}),
        g AS (SELECT doc_id, list_sort(flatten(list(spans))) AS spans FROM m GROUP BY doc_id)
        SELECT doc_id, CAST(len(list_filter(spans, lambda s: s.kind_no = 0)) AS BIGINT) AS n_assign,
               CAST(len(list_filter(spans, lambda s: s.kind_no = 1)) AS BIGINT) AS n_access,
               CAST(len(list_filter(spans, lambda s: s.kind_no = 2)) AS BIGINT) AS n_hex,
               sha256(coalesce(array_to_string(list_transform(list_filter(spans, lambda s: s.kind_no < 3), lambda s: s.kind || ':' || s.start || ':' || (s.start + s.size)), ','), '')) AS base_sha256,
               coalesce(array_to_string(list_transform(spans, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.size)), ','), '') AS spans
        FROM g
    """,
    "op10_substring": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS.replace(chr(92) * 2, chr(92))}') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
        h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
        least AS (SELECT k, min(doc_id) AS first_id FROM h GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM h JOIN least USING (k) WHERE first_id < doc_id),
        g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
        kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS text FROM words w ANTI JOIN gone USING (doc_id, pos) GROUP BY w.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op5_warc": f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p),
             r AS (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again, replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), chr(0), '%00') AS target FROM f)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to,
               sha256(replace('WARC/1.1|WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || '|WARC-Record-ID: <urn:record:' || page_id || '>|WARC-Date: {warc.DATE}|', '|', chr(13) || chr(10))
                   || coalesce('WARC-Target-URI: ' || target || chr(13) || chr(10), '') || 'WARC-Payload-Digest: sha256:' || payload_digest || chr(13) || chr(10)
                   || CASE WHEN again THEN 'WARC-Refers-To: <urn:record:' || first_id || '>' || chr(13) || chr(10) || 'WARC-Profile: {warc.REVISIT_PROFILE}' || chr(13) || chr(10) ELSE '' END
                   || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE payload_bytes END || chr(13) || chr(10) || chr(13) || chr(10)
                   || CASE WHEN again THEN '' ELSE html END || chr(13) || chr(10) || chr(13) || chr(10)) AS record_sha256
        FROM r
    """,
}
