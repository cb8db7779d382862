"""The named queries of this package, thin layers over the operators, and SQL to check them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hooktrace.llm import dialogue, html_text, imatch, jaccard, mixing, pieces, pii, rules, spelling, topk, toxicity, trie, warc
from hooktrace.sinks.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
 CASE WHEN page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id <> best THEN best END AS refers_to
FROM p LEFT JOIN w USING (payload_digest)""",
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    path = shared_folder(spark, "warc")
    warc.archive_pages(table(spark, sf_dir, "pages"), path, compression="gzip")
    records = warc.restore_payloads(warc.reassemble(warc.read_archives(spark, path)))
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


@query(
    "op2_exact_top_k",
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
 FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer inner products of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


_PII_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
 SELECT doc_id, 'email' AS kind, 1 AS rank, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS hits,
  string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS pieces FROM d
 UNION ALL SELECT doc_id, 'ip', 2, regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  string_split_regex(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
 UNION ALL SELECT doc_id, 'card', 3, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'),
  string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') FROM d
 UNION ALL SELECT doc_id, 'phone', 4, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'),
  string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
 UNION ALL SELECT doc_id, 'iban', 5, regexp_extract_all(text, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b'),
  string_split_regex(text, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b') FROM d
 UNION ALL SELECT doc_id, 'dni', 6, regexp_extract_all(text, '\b[0-9]{8}-?[A-Z]\b'),
  string_split_regex(text, '\b[0-9]{8}-?[A-Z]\b') FROM d
 UNION ALL SELECT doc_id, 'ssn', 7, regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b'),
  string_split_regex(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') FROM d
 UNION ALL SELECT doc_id, 'routing', 8, regexp_extract_all(text, '\b[0-9]{9}\b'),
  string_split_regex(text, '\b[0-9]{9}\b') FROM d
 UNION ALL SELECT doc_id, 'secret', 9, regexp_extract_all(text, '(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)["'']?\x20{0,3}[:=]\x20{0,3}["'']?[A-Za-z0-9+/_.~-]{16,}={0,2}'),
  string_split_regex(text, '(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)["'']?\x20{0,3}[:=]\x20{0,3}["'']?[A-Za-z0-9+/_.~-]{16,}={0,2}') FROM d),
h AS (SELECT doc_id, kind, rank, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS piece,
  unnest(pieces[2:len(hits) + 1]) AS after, unnest(range(1, len(hits) + 1)) AS i FROM m),
s AS (SELECT *, sum(length(piece) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop,
  regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS plain,
  lower(right(piece, 40) || ' ' || left(after, 40)) AS near,
  regexp_extract(hit, '[A-Za-z0-9+/_.~-]{16,}={0,2}$') AS value FROM h),
v AS (SELECT *, stop - length(hit) AS start,
  CASE kind WHEN 'email' THEN 80 WHEN 'ip' THEN 50 WHEN 'card' THEN 75 WHEN 'phone' THEN 60 WHEN 'iban' THEN 85
   WHEN 'dni' THEN 60 WHEN 'ssn' THEN 40 WHEN 'routing' THEN 40 ELSE 70 END
  + CASE WHEN regexp_matches(near, CASE kind WHEN 'email' THEN 'mail|contact|write|reach|correo|courriel|kontakt'
   WHEN 'ip' THEN 'address|host|server|client|login|logged|visitor' WHEN 'card' THEN 'card|visa|credit|payment|charge|karte|carte|tarjeta'
   WHEN 'phone' THEN 'phone|call|mobile|tel|fax|contact|ruf|appel|llam' WHEN 'iban' THEN 'iban|bank|account|transfer|konto|compte|cuenta'
   WHEN 'dni' THEN 'dni|nif|identi|documento' WHEN 'ssn' THEN 'ssn|social|security|taxpayer'
   WHEN 'routing' THEN 'routing|aba|bank|transfer|wire' ELSE 'auth|login|header|curl|export|config|env' END) THEN 15 ELSE 0 END AS score
 FROM s WHERE CASE kind
 WHEN 'email' THEN true
 WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0
 WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND (list_sum(list_transform(range(1, length(digits) + 1),
   lambda j: CASE WHEN j % 2 = 1 THEN CAST(digits[-j] AS INTEGER) WHEN CAST(digits[-j] AS INTEGER) > 4
     THEN CAST(digits[-j] AS INTEGER) * 2 - 9 ELSE CAST(digits[-j] AS INTEGER) * 2 END))) % 10 = 0
 WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
 WHEN 'dni' THEN substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(left(hit, 8) AS INTEGER) % 23 + 1, 1) = right(hit, 1)
 WHEN 'ssn' THEN NOT regexp_matches(hit, '^(?:000|666|9)|-00-|-0000$')
 WHEN 'routing' THEN regexp_matches(hit, '^(?:0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)') AND list_sum(list_transform(range(1, 10),
   lambda j: CAST(hit[j] AS INTEGER) * CASE j % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END)) % 10 = 0
 WHEN 'secret' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
   AND len(list_distinct(string_split(value, ''))) >= 8
 ELSE length(plain) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''),
   lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(ascii(c) - 48 AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END),
   lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97, CAST(0 AS BIGINT)) = 1 END),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
  count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY rank, start) FILTER (WHERE rank < 5) AS base,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY rank, start) AS spans,
  string_agg(CAST(score AS VARCHAR), ',' ORDER BY rank, start) AS scores FROM v WHERE score >= 50 GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
 coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)"""


@query("op7_pii", _PII_SQL)
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every text."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), out="spans").select("doc_id", "spans")
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[pii.count_kind(spans, k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.span_digest(spans, pii.BASE_KINDS), 256).alias("base_sha256"),
        pii.span_digest(spans).alias("spans"),
        pii.score_digest(spans).alias("scores"),
    )


@query("op4_imatch")
def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    docs = table(spark, sf_dir, "documents")
    return imatch.compare_edits(docs, imatch.build_lexicon(docs))


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    rows = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op8_ngram_trie")
def op8_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every text."""
    scored = trie.score_texts(table(spark, sf_dir, "documents"), order=3)
    return scored.select(
        "doc_id",
        (~trie.in_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    rows = html_text.extract(pages, html_text.fit(pages))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query(
    "op10_jaccard",
    r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter, any_value(a.n) + any_value(b.n) AS total
 FROM t a JOIN t b ON a.token = b.token AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
e AS (SELECT x, y FROM p WHERE 100 * inter >= 90 * (total - inter)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(node, reach) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.node, u.y FROM r JOIN u ON r.reach = u.x)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.component_id, coalesce(l.n_links, 0) AS n_links
FROM g JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) m ON g.doc_id = m.node
LEFT JOIN (SELECT x, count(*) AS n_links FROM u GROUP BY x) l ON g.doc_id = l.x""",
)
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are similar to 90 per cent."""
    found = jaccard.similar_components(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


@query(
    "op3_poisson_mix",
    """
WITH c AS (SELECT source, count(*) AS n, CAST(count(*) AS DOUBLE) ** 0.5 AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c) / (SELECT sum(w) FROM c) * w / n AS rate FROM c),
p AS (SELECT source, k, sum(exp(k * ln(rate) - rate - CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END)) OVER (PARTITION BY source ORDER BY k) AS cdf
 FROM r, range(0, 90) t(k)),
d AS (SELECT doc_id, source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':0:1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.doc_id, d.source, count(*) AS copies FROM d JOIN p ON d.source = p.source AND p.cdf < d.u GROUP BY ALL)
SELECT doc_id, source, CAST(unnest(range(0, copies)) AS INTEGER) AS copy FROM n""",
)
def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken so that sources weigh as the square roots of their sizes."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, copy_column="copy").select("doc_id", "source", "copy")


@query("op11_rules")
def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = rules.score(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


# crc32 by its table, over a list of bytes: crc_step folds the list, l is the table.
_CRC = """
t(i, k, c) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
 UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8)"""


def _crc_of(bytes_list: str) -> str:
    start = f"list_prepend(CAST(4294967295 AS BIGINT), {bytes_list})"
    return f"xor(list_reduce({start}, lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295)"


def _ascii_bytes(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: CAST(unicode(substr({text}, i, 1)) AS BIGINT))"


def _latin_bytes(text: str) -> str:
    """UTF-8 bytes of a text whose letters are ASCII or U+00C0 to U+00FF."""
    return (
        f"flatten(list_transform(range(1, length({text}) + 1), lambda i: CASE WHEN unicode(substr({text}, i, 1)) < 128 "
        f"THEN [CAST(unicode(substr({text}, i, 1)) AS BIGINT)] ELSE [195, CAST(unicode(substr({text}, i, 1)) AS BIGINT) - 64] END))"
    )


@query(
    "op12_spelling",
    rf"""
WITH RECURSIVE {_CRC},
r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT run, n, {_crc_of("list_concat(" + _ascii_bytes("(coalesce(CAST(doc_id AS VARCHAR), '') || ':')") + ", " + _latin_bytes("run") + ")")} AS h FROM c, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
 UNION SELECT a.word, v.word, v.n FROM x a JOIN v ON v.word = a.head || a.tail
 UNION SELECT v.word, a.word, a.n FROM x a JOIN v ON v.word = a.head || a.tail),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM e GROUP BY word),
g AS (SELECT b.word, b.n_near, b.m, min(e.other) AS other FROM b JOIN e ON b.word = e.word AND b.m = e.m GROUP BY ALL),
f AS (SELECT v.word, v.n, CASE WHEN g.m >= 2 * v.n THEN g.other END AS form, coalesce(g.n_near, 0) AS n_near,
  CASE WHEN g.m >= 2 * v.n THEN g.m END AS form_n FROM v LEFT JOIN g USING (word)),
q(word, goal) AS (SELECT word, word FROM f UNION ALL SELECT q.word, f.form FROM q JOIN f ON q.goal = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, q.goal AS root, f.n_near, f.form_n FROM f JOIN q USING (word) JOIN f k ON q.goal = k.word WHERE k.form IS NULL""",
)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words, some with a letter taken out, by their more frequent near words."""
    words = spelling.count_words(table(spark, sf_dir, "documents"), damage=97, least_length=5, least_count=3)
    return spelling.variants(words)


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(state: str, cost: str, letters: str, lines: str, allowed: str = "true") -> str:
    paid = f"CASE WHEN {allowed} THEN {state}.c + {cost} ELSE 1000000 END"
    return f"{{'c': least({paid}, 1000000), 'a': {state}.a || '{letters}', 'o': {state}.o || {lines}}}"


def _op13_sql() -> str:
    keep, user, helper = "(chr(10) || role || ':' || text)", "(chr(10) || 'user:' || text)", "(chr(10) || 'assistant:' || text)"
    new_user, new_helper = "(chr(10) || 'user:' || {})", "(chr(10) || 'assistant:' || {})"
    gone = lambda s: _way(s, "4", "D", "''")
    to_user, to_helper = [gone("u")], [gone("a")]
    for s in "esa":
        to_user += [_way(s, "stay", "K", keep, "free AND initial = 'u'"), _way(s, "stay + 3", "R", user, "free")]
        line = "(chr(10) || 'user:')"
        to_helper += [
            _way(s, "stay + 3", "IK", f"{line} || {keep}", "free AND initial = 'a'"),
            _way(s, "stay + 6", "IR", f"{line} || {helper}", "free"),
        ]
    to_helper += [_way("u", "stay", "K", keep, "free AND initial = 'a'"), _way("u", "stay + 3", "R", helper, "free")]
    line = "(chr(10) || 'assistant:')"
    to_user += [
        _way("u", "stay + 3", "IK", f"{line} || {keep}", "free AND initial = 'u'"),
        _way("u", "stay + 6", "IR", f"{line} || {user}", "free"),
    ]
    to_system = _best(gone("s"), _way("e", "stay", "K", keep, "free AND initial = 's'"))
    end = _best("e", "a", _way("u", "3", "I", "(chr(10) || 'assistant:')"), _way("s", "6", "II", "(chr(10) || 'user:' || chr(10) || 'assistant:')"))
    crc = _crc_of(_ascii_bytes("name"))
    return rf"""
WITH RECURSIVE {_CRC},
p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
k AS (SELECT *, {crc} % 20 AS kind FROM p, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
 CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
 unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM d),
m AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' END AS fault,
 lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
rows AS (SELECT *, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS stay FROM m),
z(conv_id, i, e, s, u, a) AS (
 SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 'o': ''}}, {{'c': 1000000, 'a': '', 'o': ''}}, {{'c': 1000000, 'a': '', 'o': ''}}, {{'c': 1000000, 'a': '', 'o': ''}}
 FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT z.conv_id, z.i + 1, {_best(gone("e"))}, {to_system}, {_best(*to_user)}, {_best(*to_helper)}
 FROM z JOIN rows ON rows.conv_id IS NOT DISTINCT FROM z.conv_id AND rows.i = z.i + 1),
g AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
 count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
 count(*) FILTER (WHERE fault = 'truncated') AS truncated,
 count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
l AS (SELECT conv_id, i, {end} AS w FROM z)
SELECT l.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit, sha256(substr(w.o, 2)) AS repaired_sha256
FROM l LEFT JOIN g ON l.conv_id IS NOT DISTINCT FROM g.conv_id WHERE l.i = coalesce(g.rows, 0)"""


@query("op13_conversation", _op13_sql())
def op13_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations, their faults and their cheapest repair."""
    return dialogue.summarise(dialogue.damage(table(spark, sf_dir, "conversations")))
