"""The corpus operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songfield.llm import archives, divergence, filteraudit, jaccard, lattice, mixing, nearest, personal, pieces, quality, sharding, substrings, tokencounts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(rows, 8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    return quality.quality(_table(spark, sf_dir, "documents")).select("doc_id", *quality.MEASURES, "fail_bits", "base_failed", "kept")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM v),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k, range(8) r(o) WHERE k.n > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN c USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
         + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
         + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
         + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept FROM b
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: its size times its copies."""
    plan = mixing.planned(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS filled, sum(weight) OVER rest AS open, sum(source_size) OVER () AS total
  FROM s WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                rest AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT max((total - filled) / open) AS level FROM o WHERE (total - filled) / open <= cap / weight),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM o, l),
r AS (
  SELECT doc_id, size, d.source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         ('0x' || md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size)[1:8])::BIGINT AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT source, draw, sum(size)::BIGINT AS held FROM r GROUP BY source, draw),
m AS (SELECT source, draw, coalesce(sum(held) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + held / 2.0::DOUBLE AS middle FROM u)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN rate > floor(rate) AND middle <= (rate - floor(rate)) * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN m ON r.draw = m.draw AND r.source IS NOT DISTINCT FROM m.source
"""


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50."""
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, list_dot_product(e, e) AS sq FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / sqrt(q.sq * c.sq) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents that repeat an earlier document's."""
    return substrings.find(_table(spark, sf_dir, "documents")).drop("digest").distinct()


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component that their near copies make."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a classifier that saw no held-out label. A row without
    an id has no label, so it isn't held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    model, bars = toxicity.train(docs, labels)
    found = toxicity.score(docs, model, bars)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "lang_threshold", "lang_toxic")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents."""
    found = lattice.encode(_table(spark, sf_dir, "documents"), settled=True)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


def sentencepiece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of what the ids of each document decode to."""
    found = lattice.decode(lattice.encode(_table(spark, sf_dir, "documents"), settled=True), into="decoded")
    return found.select("doc_id", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"))


ROUND_TRIP_SQL = f"SELECT doc_id, md5(replace(coalesce(text, ''), '{pieces.SPACE}', ' ')) AS decoded_md5 FROM documents"


def pieces_sql(model: str = pieces.DEFAULT_MODEL) -> str:
    """Common table expressions: ``p`` (t, id, cost), the unigram table of the model's
    pieces by its rule, and ``i`` (word, ids), the cheapest cut of each word of the
    documents. Words are parted at spaces and line ends only; no piece reaches across."""
    own = pieces.load(model, "rank")
    ids = list(own.id_of.values())
    if ids != list(range(ids[0], ids[0] + len(ids))) or own.byte_id != list(range(own.byte_id[0], own.byte_id[0] + 256)) or any("\n" in t for t in own.id_of):
        raise ValueError("pieces or bytes aren't numbered in a row")
    text = "\n".join(own.id_of).replace("'", "''")
    return rf"""
l AS (SELECT string_split('{text}', chr(10)) AS l),
p AS (SELECT unnest(l) AS t, generate_subscripts(l, 1) + {ids[0] - 1} AS id, round(1000000 * ln(generate_subscripts(l, 1)))::BIGINT AS cost FROM l),
x AS (SELECT max(cost) + 10000000 AS unknown FROM p),
d AS (SELECT doc_id, coalesce(text, '') AS text,
             CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(' ' || replace(text, '{pieces.SPACE}', ' '), ' *[^ 
]+|
| +') END AS words
      FROM documents),
v AS (SELECT DISTINCT unnest(words) AS word FROM d),
s AS (SELECT word, unnest(range(length(word)))::INTEGER AS s FROM v),
c AS (SELECT word, s, unnest(range(1, least({own.longest}, length(word) - s) + 1))::INTEGER AS n FROM s),
e AS (SELECT word, s, s + n AS e, coalesce(id, -1) AS id, coalesce(cost, unknown) AS cost FROM c CROSS JOIN x LEFT JOIN p ON t = substring(word, s + 1, n) WHERE id IS NOT NULL OR n = 1),
g AS (SELECT word, e, list({{'cost': cost, 's': s, 'id': id}}) AS into_e FROM e GROUP BY word, e),
r AS (SELECT word, 0 AS e, [{{'cost': 0::BIGINT, 's': 0, 'id': 0::BIGINT}}] AS states FROM v
      UNION ALL
      SELECT r.word, r.e + 1, list_append(states, list_min(list_transform(into_e, lambda y: {{'cost': states[y.s + 1].cost + y.cost, 's': y.s, 'id': y.id}})))
      FROM r JOIN g ON g.word = r.word AND g.e = r.e + 1),
b AS (SELECT word, states, e AS pos, []::BIGINT[] AS ids FROM r WHERE e = length(word)
      UNION ALL
      SELECT word, states, states[pos + 1].s,
             CASE WHEN states[pos + 1].id >= 0 THEN [states[pos + 1].id]
                  ELSE list_transform(range(strlen(word[pos:pos])), lambda k: ('0x' || hex(word[pos:pos])[2 * k + 1:2 * k + 2])::BIGINT + {own.byte_id[0]}) END || ids
      FROM b WHERE pos > 0),
i AS (SELECT word, ids FROM b WHERE pos = 0),
q AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM d),
o AS (SELECT doc_id, flatten(list(ids ORDER BY place)) AS ids FROM q JOIN i USING (word) GROUP BY doc_id)
"""


def _op3_sql() -> str:
    return f"""WITH RECURSIVE {pieces_sql()}
SELECT doc_id, len(coalesce(ids, []))::BIGINT AS n_ids, list_transform(coalesce(ids, []), lambda z: z::INTEGER) AS ids
FROM d LEFT JOIN o USING (doc_id)"""


def _op9_sql() -> str:
    return f"""WITH RECURSIVE {pieces_sql()}
SELECT doc_id, lang, source, len(coalesce(ids, []))::BIGINT AS n_tokens FROM documents LEFT JOIN o USING (doc_id)"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokencounts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to ARC files, converted to WARC and read back."""
    found = archives.archived(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           ((('0x' || sha1(h)[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT >> (5 * (3 - i % 4))) & 31) + 1]), '') AS payload_digest
  FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each language against each other, and the terms that each favours."""
    return divergence.divergence(_table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{divergence.UPPER}', '{divergence.LOWER}'), '{divergence.TERM}') AS w
  FROM documents),
e AS (SELECT lang, source, unnest(w) AS term FROM d),
o AS (SELECT lang, unnest(list_distinct(w)) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= {divergence.HELD}),
c AS (SELECT lang, source, term, count(*) AS n FROM e JOIN k USING (lang, term) GROUP BY lang, source, term),
z AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN z USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE C) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM s WHERE part = 'pair' OR rank <= {divergence.TERMS}
"""

def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: the base patterns' counts and digest, and all spans."""
    return personal.detect(_table(spark, sf_dir, "documents")).drop("added")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of five filters over all documents, by language."""
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
x AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS bits
  FROM w LEFT JOIN y USING (doc_id)),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY part, bits),
o AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS f
  UNION ALL
  SELECT filter_order || substring('ABCDE', i + 1, 1), step + 1, before + (CASE WHEN step > 0 THEN 1 << f ELSE 0 END), i::INTEGER
  FROM o, range(5) r(i) WHERE step < 5 AND filter_order NOT LIKE '%' || substring('ABCDE', i + 1, 1) || '%'),
whole AS (SELECT filter_order FROM o WHERE step = 5),
s AS (SELECT whole.filter_order, o.step, o.before, o.f FROM whole JOIN o ON o.step > 0 AND starts_with(whole.filter_order, o.filter_order)),
m AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (bits & (before | (1 << f)) = 0) AS kept,
         sum(n) FILTER (bits & before = 0 AND bits & (1 << f) <> 0) AS removed,
         sum(n) FILTER (bits & before <> 0 AND bits & (1 << f) <> 0) AS redundant,
         sum(n) FILTER (bits = 1 << f) AS unique_fails,
         sum(good) FILTER (bits & before = 0 AND bits & (1 << f) <> 0) AS good_lost,
         sum(toxic) FILTER (bits & before = 0 AND bits & (1 << f) <> 0) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM m
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_nearest": op4_nearest,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_jaccard": op7_jaccard,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_archives": op10_archives,
    "op11_divergence": op11_divergence,
    "op12_personal": op12_personal,
    "op13_filter_audit": op13_filter_audit,
    "sentencepiece_round_trip": sentencepiece_round_trip,
}
#: SQL that needs no more than the tables; ``oracle_sql`` adds what is made from a model's pieces.
ORACLE_SQL = {"op2_quality": OP2_SQL, "op4_nearest": OP4_SQL, "op5_mixing": OP5_SQL, "op7_jaccard": OP7_SQL, "op10_archives": OP10_SQL, "op11_divergence": OP11_SQL, "op13_filter_audit": OP13_SQL, "sentencepiece_round_trip": ROUND_TRIP_SQL}


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL | {"op3_sentencepiece": _op3_sql(), "op9_token_counts": _op9_sql()}
