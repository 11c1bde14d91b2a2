"""The registered queries of this subpackage, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import corpus_pipeline
from tripflow.llm import bpe, chat, collocations, exact_dedup, html_text, langid, line_dedup, mixing, packing, partenum, periodic, sharding, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_exact_dedup", f"""
    WITH t AS (SELECT doc_id, {LOWERED} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY t)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest_col="text_sha256")


@query("op5_interleaved_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sharding.interleaved(table(spark, sf_dir, "documents"), 40)
    return d.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "source")


@query("op6_line_dedup", r"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM d),
    nb AS (SELECT doc_id, i, trim(x, ' ' || chr(9) || chr(13)) AS x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j,
                  count(*) OVER (PARTITION BY doc_id) AS n
           FROM l WHERE trim(x, ' ' || chr(9) || chr(13)) <> ''),
    w AS (SELECT doc_id, j, n, [i, lead(i) OVER d, lead(i, 2) OVER d] AS covers, [x, lead(x) OVER d, lead(x, 2) OVER d] AS key
          FROM nb WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
    o AS (SELECT doc_id, covers, row_number() OVER (PARTITION BY key ORDER BY doc_id, j) AS r FROM w WHERE j <= n - 2 OR (n < 3 AND j = 1)),
    g AS (SELECT doc_id, list_distinct(flatten(list(covers))) AS gone FROM o WHERE r > 1 GROUP BY doc_id)
    SELECT d.doc_id, len(d.lines) AS n_lines, coalesce(len(g.gone), 0) AS n_removed,
           array_to_string([x FOR x, i IN d.lines IF NOT coalesce(list_contains(g.gone, i - 1), false)], chr(10)) AS text
    FROM d LEFT JOIN g USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


CONTROL = "</s>[INST] ok [/INST]"


@query("op7_chat_formatting", f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '{CONTROL}'), (-7, 1, 'assistant', '{CONTROL}'))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(29 + length(replace(replace(role, '\\', '\\b'), '<', '\\l')) + length(replace(replace(text, '\\', '\\b'), '<', '\\l')))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(f"SELECT -7L AS conv_id, turn, role, '{CONTROL}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"))
    each = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    events = rows.withColumns({"message": F.row_number().over(each), "seq": F.lit(0), "kind": F.lit("message")})
    r = chat.render(chat.fold(events))
    turns = F.array_join(F.transform(chat.parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    r = r.withColumn("learned", chat.masked(F.col("formatted"), F.col("loss_spans")))
    return r.select(F.col("conv").alias("conv_id"), F.size(chat.parsed(F.col("formatted"))).cast("long").alias("n_turns"),
                    F.sha2(F.encode(turns, "UTF-8"), 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
                    F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    model = langid.learn(d.select("doc_id", "text", "lang"))
    rows = d.select("doc_id", langid.held_out("doc_id").alias("held_out"), "text")
    return langid.predicted(rows, model).drop("text")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op2_top_k", """
    WITH e AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([a * c.v[i] FOR a, i IN q.v])::BIGINT AS score
          FROM e AS q JOIN e AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(e, e.filter("vec_id % 100 = 0"), 10)


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# DuckDB has no crc32: its table-free form, a step per bit, over the bytes of the decimal id.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])),
    lambda c, e: CASE WHEN e > 0 THEN xor(c, e) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END))"""


@query("op11_periodic_runs", rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32} AS h FROM documents),
    p AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
    r AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
    o AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN [CASE WHEN i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END FOR i IN range(n)] ELSE w END AS w FROM r),
    k AS (SELECT doc_id, i, md5(concat_ws(' ', w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5])) AS k
          FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM o WHERE len(w) >= 6)),
    m AS (SELECT a.doc_id, a.i, b.i - a.i AS q, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS island
          FROM k AS a JOIN k AS b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i),
    s AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS n FROM m GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
    u AS (SELECT * FROM s AS x WHERE NOT EXISTS (SELECT 1 FROM s AS y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.s + y.n >= x.s + x.n)),
    t AS (SELECT doc_id, count(*) AS n_runs, arg_min([s, n, q], [-n::DOUBLE / q, s, q]) AS best,
                 string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs,
                 list_distinct(flatten(list(range(s + q, s + n)))) AS gone FROM u GROUP BY doc_id),
    c AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM
          (SELECT t.doc_id, i, o.w[i + 1] AS x FROM (SELECT doc_id, unnest(range(len(w))) AS i FROM o SEMI JOIN t USING (doc_id)) AS e
           JOIN o USING (doc_id) JOIN t USING (doc_id) ANTI JOIN (SELECT doc_id, unnest(gone) AS i FROM t) AS g USING (doc_id, i)) GROUP BY doc_id)
    SELECT o.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, 1000 * best[2] // best[3] AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(CASE WHEN t.doc_id IS NULL THEN array_to_string(o.w, ' ') ELSE kept END) AS collapsed_sha256
    FROM o LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.size(F.array_remove(F.split("text", "[ \t-\r]+"), ""))
    # 10 % of the documents get a repetition in place of their words from a on
    g = F.floor(h / 10)
    start = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    text = F.when((h % 10 == 0) & (n > 0), periodic.rewritten(F.col("text"), start, period)).otherwise(F.col("text"))
    return periodic.periodic_runs(d.select("doc_id", text.alias("text")), keep=False).withColumnRenamed("id", "doc_id")


@query("op12_source_mix", r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                      concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS k FROM documents),
    h AS (SELECT *, [('0x' || substr(sha256('17:' || (i // 8) || ':' || k), 1 + 8 * (i % 8), 8))::BIGINT FOR i IN range(16)] AS draws FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INTEGER] AS w FROM d GROUP BY source),
    o AS (SELECT *, sum(s) OVER () AS everything, 2 * (sum(s) OVER b - s) AS before, sum(w) OVER () - (sum(w) OVER b - w) AS rest
          FROM s WINDOW b AS (ORDER BY s * (10 // w), source IS NULL, source ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, 2 * s * 2 * rest <= (3 * everything - 2 * before) * w AS held FROM o),
    l AS (SELECT 3 * any_value(everything) - 2 * coalesce(sum(2 * s) FILTER (held), 0) AS up, 2 * sum(w) FILTER (NOT held) AS down FROM c),
    t AS (SELECT source, s, CASE WHEN held THEN (2 * s)::DOUBLE ELSE (up * w)::DOUBLE / down::DOUBLE END AS target FROM c, l),
    r AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM t),
    x AS (SELECT h.*, r.s AS source_size, target, floor(rate)::BIGINT AS least, (rate - floor(rate)) * 4294967296 AS part FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source),
    y AS (SELECT source, i, sum(CASE WHEN draws[i] < part THEN size ELSE 0 END) + any_value(least * source_size) AS got, any_value(target) AS target
          FROM (SELECT *, unnest(range(1, 17)) AS i FROM x) GROUP BY source, i),
    z AS (SELECT source, arg_min(i, [abs(got - target), i]) AS draw FROM y GROUP BY source)
    SELECT doc_id, size, source_size, target, (size * (least + (draws[draw] < part)::BIGINT))::BIGINT AS taken
    FROM x JOIN z ON x.source IS NOT DISTINCT FROM z.source""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op13_collocations", r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT row, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
    w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    x AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS a
          FROM (SELECT *, unnest(range(1, 6)) AS m FROM g) WHERE i + m - 1 <= len(w) GROUP BY lang, m, phrase),
    n AS (SELECT lang, sum(a)::BIGINT AS n FROM x WHERE m = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS parts FROM x WHERE m > 1 AND a >= 100),
    k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
    s AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, l.a AS l, r.a AS r, n, ((1000::HUGEINT * k.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
          FROM k JOIN x AS l ON l.lang = k.lang AND l.m = k.k AND l.phrase = array_to_string(parts[1:k.k], ' ')
          JOIN x AS r ON r.lang = k.lang AND r.m = k.m - k.k AND r.phrase = array_to_string(parts[k.k + 1:], ' ') JOIN n ON n.lang = k.lang),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS weakest FROM s QUALIFY weakest = 1),
    q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
          WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
