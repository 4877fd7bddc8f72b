"""Registered queries of the text operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (ann, chat, exact, license, mix, near, negatives, pack, repeats, rules,
                          shards, toxic, trie)
from tickloom.llm.common import table, text_of, words_of
from tickloom.session import stage

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


# DuckDB's words of a text.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TURNS = """
t AS (SELECT conv_id, coalesce(turn // 256, -1) AS part, turn, coalesce(role, 'unknown') AS role,
             replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
      FROM conversations),
sp AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
seg AS (SELECT t.*, speaker, role = speaker AS train,
               CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                    ELSE '<|user name=' || regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g') || '|>'
               END || chr(10) AS head
        FROM t JOIN sp ON t.conv_id IS NOT DISTINCT FROM sp.conv_id),
pos AS (SELECT *, sum(length(head) + length(body)) OVER (
                 PARTITION BY conv_id, part, speaker ORDER BY turn NULLS FIRST, role, body
                 ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
        FROM seg)
"""


@query(f"""
WITH {_TURNS}
SELECT conv_id, speaker, part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY ends) AS rendered,
       coalesce(string_agg(CASE WHEN train THEN (ends - length(body))::VARCHAR || '-'
                                || ends::VARCHAR END, ',' ORDER BY ends), '') AS mask,
       coalesce(sum(CASE WHEN train THEN length(body) END), 0)::BIGINT AS n_trained
FROM pos GROUP BY conv_id, speaker, part
""")
def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues from the point of view of every participant."""
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    return found.withColumn("mask", F.array_join(F.transform(
        "mask", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


@query(r"""
WITH t AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))
                    AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256
                                          ORDER BY n_points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies up to white space; the longest of a group stays."""
    docs = table(spark, sf_dir, "documents")
    keys = stage(docs.select("doc_id", exact.text_key("text").alias("text_sha256"),
                             F.char_length(text_of("text")).cast("long").alias("n_points")),
                 "text-keys")
    found = exact.mark_copies(keys, "text_sha256", "doc_id", "n_points")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_LINES = rules.LineRules()
_NOISE_RE = r"[\x09-\x0D\x20-@\[-`{-~]"


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text,
                  {_WORDS} AS w FROM documents),
l AS (SELECT rid, host, text AS content, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM d),
k AS (SELECT *, regexp_replace(lower(line), '{_NOISE_RE}', '', 'g') AS plain,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
kk AS (SELECT *, md5(coalesce('h' || host, '') || chr(10) || plain)[1:16] AS key FROM k
       WHERE plain <> ''),
hosts AS (SELECT host, greatest({_LINES.min_docs}, floor(count(DISTINCT text) * {_LINES.share}))
                 AS most FROM d GROUP BY host),
often AS (SELECT key FROM kk JOIN hosts ON kk.host IS NOT DISTINCT FROM hosts.host
          GROUP BY key, most HAVING count(DISTINCT content) > most),
hit AS (SELECT DISTINCT host, content, ln, n, key FROM kk SEMI JOIN often USING (key)),
txt AS (SELECT host, content, min(key) AS low,
               sum(n) >= {_LINES.copied_share} * len(any_value(regexp_extract_all(
                   content, '[^\x20\x09-\x0D]+'))) AS copied
        FROM hit GROUP BY host, content),
freq AS (SELECT key FROM hit JOIN txt ON hit.host IS NOT DISTINCT FROM txt.host
                                      AND hit.content = txt.content
         JOIN hosts ON hit.host IS NOT DISTINCT FROM hosts.host
         GROUP BY key, most
         HAVING count(DISTINCT CASE WHEN copied THEN 'k' || low ELSE 't' || txt.content END) > most),
gone AS (SELECT rid, sum(n)::BIGINT AS n FROM kk SEMI JOIN freq USING (key) GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM k WHERE n > 0 GROUP BY rid),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS gram
      FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
rep AS (SELECT rid, sum(n)::BIGINT AS n FROM (
          SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS n
          FROM r) GROUP BY rid),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             coalesce(gone.n, 0)::BIGINT AS words_removed
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < {_LINES.min_words}
                OR 100 * n_repeat_words > {_LINES.repeat_percent} * n_words AS base_failed,
             words_removed > 0 AND (n_words - words_removed < {_LINES.min_left}
                OR n_words - words_removed < {_LINES.min_share}::DOUBLE * n_words) AS depleted
      FROM a)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM b
""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and cross-document line frequency."""
    return rules.judge(table(spark, sf_dir, "documents"), _LINES)


BIN_WORDS = 2048


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed by word count; a cluster is a text without white space."""
    return pack.pack(
        docs.select("doc_id", F.size(words_of(text_of("text"))).alias("n_tokens"), "source",
                    F.xxhash64(exact.text_key("text")).alias("cluster")),
        BIN_WORDS, "doc_id", "n_tokens", "source", "cluster").withColumnRenamed("id", "doc_id")


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words, no two documents of a source or of one text in a bin."""
    return packed(table(spark, sf_dir, "documents"))


DOMAINS = ["web", "books", "news", "forum"]
MIX = mix.Mix(percent=90, max_epochs=2, seed=7, weights={
    ("web",): 4, ("books",): 3, ("news",): 2, ("web", "en"): 3, ("books", "en"): 2})


def domain_of_source() -> Column:
    """A source's domain, by the number in its name."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return F.element_at(F.array(*map(F.lit, DOMAINS)),
                        F.when(number == "", 0).otherwise(
                            F.substring(number, -4, 4).cast("int") % 4) + 1)


def _weights_sql(path: list[str]) -> str:
    named = [(k, v) for k, v in MIX.weights.items() if len(k) == len(path)]
    cases = "".join(
        " WHEN " + " AND ".join(f"{c} = '{x}'" for c, x in zip(path, k)) + f" THEN {v}"
        for k, v in named)
    return f"(CASE{cases} ELSE 1 END)::HUGEINT" if named else "1::HUGEINT"


def _level_sql(out: str, parents: str, parent: list[str], path: list[str]) -> str:
    cols, part = ", ".join(path), ", ".join(parent) or "1"
    using = f"JOIN {parents} USING ({', '.join(parent)})" if parent else f"CROSS JOIN {parents}"
    return f"""
{out}_n AS (SELECT {cols}, sum(cap)::HUGEINT AS cap, {_weights_sql(path)} AS w
            FROM leaf GROUP BY {cols}),
{out}_j AS (SELECT n.*, b AS budget FROM {out}_n n {using}),
{out}_f AS (SELECT *, cap * sum(w) OVER (PARTITION BY {part} ORDER BY cap::DOUBLE / w::DOUBLE, {cols}
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                   <= (budget - coalesce(sum(cap) OVER (PARTITION BY {part}
                       ORDER BY cap::DOUBLE / w::DOUBLE, {cols}
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS filled
            FROM {out}_j),
{out} AS (SELECT {cols}, CASE WHEN filled THEN cap ELSE
            ((budget - coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY {part}), 0)) * w)
            // coalesce(sum(w) FILTER (NOT filled) OVER (PARTITION BY {part}), 1) END AS b
          FROM {out}_f)"""


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(CASE (CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = ''
                  THEN 0 ELSE right(regexp_extract(source, '([0-9]+)$', 1), 4)::INT % 4 END)
                  WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'news' WHEN 3 THEN 'forum'
                  END, '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  len({_WORDS})::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens,
                sum(n_tokens)::HUGEINT * {MIX.max_epochs} AS cap FROM d GROUP BY ALL),
total AS (SELECT least(sum(cap), sum(tokens) * {MIX.percent} // 100)::HUGEINT AS b FROM leaf),
{_level_sql('l1', 'total', [], ['domain'])},
{_level_sql('l2', 'l1', ['domain'], ['domain', 'lang'])},
{_level_sql('l3', 'l2', ['domain', 'lang'], ['domain', 'lang', 'source'])},
p AS (SELECT domain, lang, source, b, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS whole,
             CASE WHEN tokens > 0 THEN b % tokens ELSE 0 END AS rest
      FROM leaf JOIN l3 USING (domain, lang, source)),
o AS (SELECT d.*, b, whole, rest, sum(n_tokens) OVER (
               PARTITION BY domain, lang, source
               ORDER BY md5('{MIX.seed}:' || whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')),
                        doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN p USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens,
       (whole + CASE WHEN run <= rest THEN 1 ELSE 0 END)::BIGINT AS copies,
       b::BIGINT AS leaf_budget FROM o
""")
def op9_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """90 % of the tokens, mixed by domain, language and source; every document with its copies."""
    found = mix.mixed(table(spark, sf_dir, "documents"), MIX, domain_of_source())
    return found.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"),
                        F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "copies",
                        "leaf_budget")


@query()
def op10_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of nearly equal bytes; equal texts stay together."""
    return shards.shard(table(spark, sf_dir, "documents"), 16)


@query()
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by five-word shingles at 85 %."""
    return near.near_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept", "n_links")


_LICENSE_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), "
                  "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                  r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def _license_sql(rules: license.Scan) -> str:
    """Plain form of the scan: every place and every block is looked at."""
    text = lambda xs: "[" + ", ".join(f"'{x.decode()}'" for x in xs) + "]"
    phrases = ", ".join(f"({text(license.words_in(p))}, '{label}')"
                        for p, label in rules.phrases.items())
    templates = ", ".join(
        f"('{k}', {text(sorted(set(license.words_in(t))))}, {len(license.words_in(t))})"
        for k, t in rules.templates.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LICENSE_WORDS} AS w FROM documents),
ph(phrase, label) AS (VALUES {phrases}),
tp(label, words, step) AS (VALUES {templates}),
pos AS (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM d),
base AS (SELECT rid, i - 1 AS place, label FROM pos JOIN ph ON w[i] = phrase[1]
         AND w[i:i + len(phrase) - 1] = phrase),
b AS (SELECT rid, count(*) AS n, min(place) AS lo, max(place) AS hi,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
blk AS (SELECT rid, label, words, list_distinct(w[i:i + 2 * step - 1]) AS held
        FROM (SELECT rid, w, label, words, step,
                     unnest(generate_series(1, len(w), step)) AS i
              FROM d JOIN tp ON len(list_intersect(list_distinct(w), words)) * 100
                                >= {rules.percent} * len(words))),
c AS (SELECT rid, label, len(list_intersect(held, words)) AS n, len(words) AS m FROM blk),
hit AS (SELECT rid, label, max(n / m) AS c FROM c WHERE 100 * n >= {rules.percent} * m GROUP BY ALL),
alls AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
           SELECT rid, label FROM base UNION SELECT rid, label FROM hit) GROUP BY rid),
best AS (SELECT rid, max(c) AS c FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base,
       lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(alls.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE round(coalesce(best.c, 0.0)::DOUBLE, 6) END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN alls USING (rid) LEFT JOIN best USING (rid)
"""


@query(_license_sql(license.Scan()))
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices."""
    return license.scan(table(spark, sf_dir, "documents")).drop("blocks")


@query()
def op6_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    grammar = toxic.train(docs, table(spark, sf_dir, "labels"))
    return toxic.score(docs, grammar)


@query()
def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document has as well."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


_HEAD = """(4294967295 - list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''),
                                                    lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
                             lambda v, k: xor(v >> 1, 3988292384::BIGINT * (v & 1))))) % 6"""


@query(f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                      coalesce(role, ''), md5(length(coalesce(role, ''))::VARCHAR || ':'
                      || coalesce(role, '') || coalesce(text, ''))) AS r
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_HEAD} AS h
      FROM (SELECT DISTINCT conv_id FROM o)),
held AS (SELECT conv_id AS base, count(*) AS m FROM o GROUP BY conv_id),
t AS (SELECT c.conv_id, r AS pos, role, text FROM c JOIN o ON o.conv_id = c.base AND r <= h
      UNION ALL
      SELECT o.conv_id, r - h + least(h, coalesce(m, 0)), role, text
      FROM o JOIN c USING (conv_id) LEFT JOIN held USING (base) WHERE r > h),
p AS (SELECT conv_id, pos, length(text)::BIGINT AS pts,
             md5(string_agg(md5(length(role)::VARCHAR || ':' || role || text), '')
                 OVER (PARTITION BY conv_id ORDER BY pos)) AS k FROM t
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nd AS (SELECT pos AS depth, k, min(conv_id) AS conv_id, count(*) AS n, min(pts) AS pts
       FROM p GROUP BY pos, k),
anc AS (SELECT nd.*, a.pos AS up, a.k AS up_k FROM nd JOIN p a
        ON a.conv_id = nd.conv_id AND a.pos <= nd.depth),
kids AS (SELECT up AS depth, up_k AS k, count(*) AS n_children FROM anc WHERE up = depth - 1
         GROUP BY ALL),
sub AS (SELECT up AS depth, up_k AS k, sum((n - 1) * pts)::BIGINT AS saved_tokens,
               count(*) FILTER (n_children IS NULL) AS n_leaves
        FROM anc LEFT JOIN kids ON kids.depth = anc.depth AND kids.k = anc.k GROUP BY ALL),
e AS (SELECT pos AS depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
      FROM (SELECT *, max(pos) OVER (PARTITION BY conv_id) AS last FROM p) WHERE pos = last
      GROUP BY pos, k)
SELECT nd.conv_id, nd.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nd.n AS n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       coalesce(sha, sha256('')) AS ends_sha256
FROM nd JOIN sub ON sub.depth = nd.depth AND sub.k = nd.k
LEFT JOIN kids ON kids.depth = nd.depth AND kids.k = nd.k
LEFT JOIN e ON e.depth = nd.depth AND e.k = nd.k
LEFT JOIN anc ON anc.depth = nd.depth AND anc.k = nd.k AND anc.up = nd.depth - 1
LEFT JOIN nd up ON up.depth = anc.up AND up.k = anc.up_k
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of conversations whose first turns come from the first one of their hundred."""
    turns = trie.numbered_turns(table(spark, sf_dir, "conversations"))
    base = F.col("conv_id") - F.col("conv_id") % 100
    head = F.crc32(F.col("conv_id").cast("string")) % 6
    return trie.prefix_trie(*trie.grafted(turns, base, head, longest=5))


_MINING = negatives.Mining()


@query(f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id,
                  (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
                  list_transform(embedding, lambda x: floor({_MINING.scale} * x::DOUBLE)) AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.rid AS aid, a.vec_id AS anchor_id, v.rid, v.vec_id, v.label = a.label AS same,
             list_inner_product(a.e, v.e)::BIGINT AS score
      FROM a JOIN v ON len(a.e) = len(v.e) AND a.vec_id <> v.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id, rid) AS place
      FROM s WHERE same QUALIFY place <= {_MINING.positives}),
n AS (SELECT p.aid, p.rid, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
             p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.aid, p.rid
                                ORDER BY s.score DESC, s.vec_id)::INT AS rank
      FROM p JOIN s ON s.aid = p.aid AND NOT s.same
      AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= {_MINING.negatives}
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of an anchor's five positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 50 == 0,
                          _MINING)


@query()
def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
