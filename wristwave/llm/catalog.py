"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wristwave.llm import bpe, chat, decontamination, fingerprints, line_dedup, mixing, near_dedup, quality, resampling, sharding, spelling, toxicity, urls
from wristwave.llm.common import table, utf8_hex, word_count

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf, "documents"))


@query
def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"))


@query
def op3_sharding(spark: SparkSession, sf: str) -> DataFrame:
    dealt = sharding.shuffle(table(spark, sf, "documents").select("doc_id", "text"), 24)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    made = chat.format_chats(chat.with_probe(table(spark, sf, "conversations")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_back(made).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), utf8_hex(said).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), utf8_hex(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_CONTROL = r"([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|ANSWER\]|TURN\]|/?ROLE\]|END\])"
ORACLES["op4_chat_formatting"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), beside AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), sized AS (
  SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2\3', 'g'))
    + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 8 END END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 END END AS chars
  FROM beside
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, (3 + sum(chars))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


@query
def op5_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    bad = (F.coalesce("quality", F.lit(1)) < 1) | (F.coalesce("toxic", F.lit(0)) > 0)
    outcomes = labels.select(F.col("doc_id").alias("page"), bad.cast("int").alias("bad"))
    return urls.judge(table(spark, sf, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, groups: str) -> str:
    return f"""{name}_sum AS (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS k, sum(bad * (bad / n)) AS s2, sum(n * n)::DOUBLE AS nn FROM {groups} WHERE n > 0),
{name}_m AS (SELECT *, (bad + 0.5) / (n + 1.0) AS m FROM {name}_sum),
{name}_b AS (SELECT *, CASE WHEN k < 2 THEN 0 ELSE (s2 / n - (bad / n) * (bad / n) - m * (1 - m) * (k - 1) / n) / (1 - nn / (n * n)) END AS between FROM {name}_m),
{name}_fit AS (SELECT CASE WHEN n > 0 THEN m ELSE 0.5 END AS m, CASE WHEN n > 0 THEN CASE WHEN between > 0 THEN greatest(2.0, least(1000.0, m * (1 - m) / between - 1)) ELSE 1000.0 END ELSE 2.0 END AS k FROM {name}_b)"""


ORACLES["op5_url_filter"] = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), told AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) < 1 OR coalesce(toxic, 0) > 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM split LEFT JOIN told ON page_id = doc_id GROUP BY host
), parts AS (
  SELECT *, string_split(host, '.') AS labels FROM hosts
), one AS (
  SELECT host, n, bad, array_to_string(labels[-2:], '.') AS domain, labels[-1] AS suffix FROM parts
), domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM one GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
{_level('s', 'suffixes')}, {_level('d', 'domains')}, {_level('h', 'one')},
ps AS (SELECT suffix, (f.m * f.k + bad) / (n + f.k) AS above FROM suffixes, s_fit f),
pd AS (SELECT domain, (above * f.k + bad) / (n + f.k) AS above FROM domains JOIN ps USING (suffix), d_fit f),
ph AS (SELECT host, (above * f.k + bad) / (n + f.k) AS rate, n + f.k + 1 AS mass FROM one JOIN pd USING (domain), h_fit f),
verdicts AS (SELECT host, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / mass) > 0.5 THEN 'block' ELSE 'allow' END AS own FROM ph),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
)
SELECT page_id, r.host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' ELSE own END AS verdict
FROM ruled r JOIN verdicts v ON r.host = v.host"""


@query
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *[f"quality_rules.{c}" for c in (*quality.COUNTS, "base_failed", "kept")])


def _fence(name: str) -> str:
    floor = quality.FLOORS[name]
    a, b = (f"quantile_disc({name}, {q})" for q in (0.25, 0.75))
    room = f"{quality.REACH} * greatest({b} - {a}, {floor})"
    return f"{a} - {room} AS {name}_low, {b} + {room} AS {name}_high"


ORACLES["op6_quality_rules"] = rf"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeated AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), lined AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS p FROM words
), m AS (
  SELECT l.doc_id, lang, source, len(w)::BIGINT AS n_words, length(p)::BIGINT AS word_chars, length(regexp_replace(p, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(p, '\P{{Lu}}+', '', 'g')) AS n_upper
  FROM lined l LEFT JOIN repeated r ON l.doc_id = r.doc_id
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share,
    coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_share, coalesce(word_chars / nullif(n_words, 0), 0) AS word_length,
    coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share FROM m
), f AS (SELECT lang AS gl, source AS gs, {', '.join(_fence(k) for k in quality.FLOORS)} FROM s WHERE NOT base_failed GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({' AND '.join(f'{k} BETWEEN {k}_low AND {k}_high' for k in quality.FLOORS)}, false) AS kept
FROM s LEFT JOIN f ON lang IS NOT DISTINCT FROM gl AND source IS NOT DISTINCT FROM gs"""


@query
def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"))
    weighed = mixing.quality_weight(docs, table(spark, sf, "labels"))
    mixed = mixing.mix(weighed, F.col("words"), F.col("weight"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.epochs") * F.col("mix.size") + F.col("mix.part")).alias("taken"))


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    # a null doc_id is never held out: such a row is unlabelled text
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    learn = labels.filter(~held() & F.col("toxic").isNotNull())
    prior = learn.agg(F.avg("toxic")).first()[0] or 0.0
    model = toxicity.fit(docs.filter(~held()), learn.filter("toxic = 1"), prior)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    done = line_dedup.dedup(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select("doc_id", "line_dedup.n_lines", "line_dedup.n_repeated", "line_dedup.n_near", utf8_hex(F.col("line_dedup.text")).alias("kept_sha256"))


@query
def op10_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_dedup.components(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# CRC-32 of a text's UTF-8 bytes: its table made from the polynomial 0xEDB88320, then a fold over the bytes
_CRC_TABLE = """list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _crc32(text: str, rows: str) -> str:
    """(x, c) for every distinct ``text`` of ``rows``."""
    return f"""(SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS c
  FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT {text} AS x FROM {rows})), (SELECT {_CRC_TABLE} AS t))"""


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op12_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), utf8_hex(decontamination.joined(F.col("items"))).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
ORACLES["op11_spelling_variants"] = rf"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT doc_id || ':' || w AS x, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
hashed AS MATERIALIZED {_crc32('x', 'runs')},
slipped AS (SELECT CASE WHEN c % 97 = 0 THEN w[1:(c % length(w))::INT] || w[(c % length(w))::INT + 2:] ELSE w END AS word, n FROM runs JOIN hashed USING (x)),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, word[1:i] AS a, word[i + 2:] AS b FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT word, a || b FROM cut WHERE a || b IN (SELECT word FROM v) UNION SELECT a || b, word FROM cut WHERE a || b IN (SELECT word FROM v)),
counted AS (SELECT near.word, v.n, v.word AS other, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN v ON near.other = v.word),
best AS (SELECT word, other, n, n_near FROM counted QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
told AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 2 * v.n THEN other END AS form, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
way AS (SELECT word, word AS root FROM told UNION ALL SELECT way.word, told.form FROM way JOIN told ON told.word = way.root WHERE told.form IS NOT NULL)
SELECT told.word, told.form, r.root, told.n, n_near, form_n FROM told JOIN (SELECT way.word, way.root FROM way JOIN told ON told.word = way.root WHERE told.form IS NULL) r ON r.word = told.word"""


ORACLES["op12_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} FROM documents), i AS (SELECT item_id, {_WORDS} FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS g FROM (SELECT item_id, w[k0:k0 + 9] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k0 FROM i WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, k0, array_to_string(w[k0:k0 + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k0 FROM d, sizes)),
found AS MATERIALIZED (SELECT doc_id, k0, n, item_id FROM grams JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k0, k0 + n)) AS p FROM (SELECT DISTINCT doc_id, k0, n FROM found)) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN who ON d.doc_id = who.doc_id"""


@query
def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", *[f"resample.{c}" for c in ("n_features", "weight", "score", "rank")])


_CUT = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x"
ORACLES["op13_importance_resampling"] = f"""
WITH raw AS (SELECT doc_id, {_CUT} FROM documents), want AS (SELECT {_CUT} FROM benchmark),
every AS MATERIALIZED (SELECT x FROM raw UNION SELECT x FROM want),
hashed AS MATERIALIZED (SELECT x, c % 10000 AS k FROM {_crc32('x', 'every')}),
s AS (SELECT k, count(*) AS n FROM raw JOIN hashed USING (x) GROUP BY k), t AS (SELECT k, count(*) AS n FROM want JOIN hashed USING (x) GROUP BY k),
sizes AS (SELECT (SELECT count(*) FROM raw) AS s, (SELECT count(*) FROM want) AS t),
gains AS (SELECT s.k, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (sizes.s + 10000))::DOUBLE / ((s.n + 1) * (sizes.t + 10000))::DOUBLE))::BIGINT AS g FROM s LEFT JOIN t ON s.k = t.k, sizes),
d AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM raw JOIN hashed USING (x) JOIN gains USING (k) GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
p AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM p) // 100 THEN place END::BIGINT AS rank FROM r LEFT JOIN p USING (doc_id)"""
