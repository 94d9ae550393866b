"""The queries of the corpus operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import chat, contamination, divergence, fingerprints, html, language, lines, minhash, neighbours, packing, periodic, quality, toxicity
from cairn.llm.store import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, read(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    return language.identify(spark, docs, labelled).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.grade_texts(spark, docs, toxicity.labelled_texts(docs, read(spark, sf_dir, "labels"), "toxic"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark, read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(spark, rows.unionByName(own)))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, read(spark, sf_dir, "documents"), k=2, threshold=80)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(spark, read(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(spark, read(spark, sf_dir, "embeddings"), threshold=0.95)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(spark, read(spark, sf_dir, "documents"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """*docs* with some texts made periodic from a word on, by the checksum of doc_id."""
    ws = " \t\n\x0b\x0c\r"
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(ws))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when((h % 10 == 0) & (text != ""), F.split(text, f"[{ws}]+", -1)).alias("words"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast(1 + (n - a) div p as int)")))
    edited = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n"))
    return rows.select("doc_id", F.when(F.col("words").isNotNull(), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(spark, planted_periods(read(spark, sf_dir, "documents").select("doc_id", "text")), min_words=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n")))
    rows = found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return rows.withColumn("exponent_milli", F.expr("1000 * length div period"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, read(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.edited_likeness(spark, read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


#: Line dedup in SQL; strip and fold as the operator's keys.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keys AS (
  SELECT doc_id, text, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keys WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE c.key IS NOT NULL AND k.doc_id <> c.last) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL OR k.doc_id = c.last), '')) AS kept_sha256
FROM keys k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id, k.text
"""


#: Characters of an escaped text: one more for each place where a control string begins, for each backslash, a first > and a last <.
_ESCAPED = "(length({0}) + starts_with({0}, '>')::BIGINT + ends_with({0}, '<')::BIGINT + " + " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in [*chat.CONTROLS, "\\"]) + ")"

#: Chat digests in SQL, from the turns as they are; the template adds 13 characters a turn.
OP5_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) own(i, r)
)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({_ESCAPED.format('role')} + {_ESCAPED.format('text')} + 13)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

#: Components of links(u, v), both ways, by the smallest name that reaches each.
_REACHED = """
reached AS (
  SELECT id, id AS low FROM ids
  UNION
  SELECT l.v, r.low FROM reached r JOIN links l ON l.u = r.id WHERE r.low < l.v
), lows AS (SELECT id, min(low) AS low FROM reached GROUP BY id)
"""

#: MinHash near-duplicates in SQL: every two documents that share a shingle, by the sizes of their sets.
OP6_SQL = rf"""
WITH RECURSIVE ids AS (SELECT doc_id AS id FROM documents
), texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM texts)
  UNION ALL SELECT doc_id, w[1] FROM texts WHERE len(w) = 1
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), sized AS (SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), {_REACHED}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, low AS component_id, id = low AS kept FROM lows LEFT JOIN sizes ON sizes.doc_id = id
"""

#: Embedding near-duplicates in SQL: every two vectors.
OP9_SQL = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id FROM embeddings
), usable AS (
  SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), {_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE u = id)::BIGINT AS n_links, low AS component_id, id = low AS kept FROM lows
"""

#: Periodic runs in SQL.  Pairs of equal words give, for each distance, the stretches in which words that far apart are
#: identical; of equal runs the smallest period stays.  The checksum goes bit by bit over the digits of doc_id.
OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), sums AS (
  SELECT doc_id, coalesce(text, '') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, b: xor(crc >> 8, t[1 + (xor(crc, b) & 255)])), 4294967295) AS h
  FROM documents, crc_table
), split AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM sums
), sized AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM split
), placed AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized
), words AS (
  SELECT doc_id, i, CASE WHEN a IS NULL OR i < a THEN w[1 + i] ELSE w[1 + a + (i - a) % p] END AS word
  FROM (SELECT doc_id, w, a, p, unnest(range(n)) AS i FROM placed)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) >= q AND count(*) + q >= 12
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), texts AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS collapsed
  FROM words w LEFT JOIN dropped d ON w.doc_id = d.doc_id AND w.i = d.i WHERE d.i IS NULL GROUP BY w.doc_id
), longest AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
), listed AS (
  SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(r.n, 0)::BIGINT AS n_runs, l.start::BIGINT AS start, l.length::BIGINT AS length, l.period::BIGINT AS period,
       (1000 * l.length // l.period)::BIGINT AS exponent_milli, sha256(coalesce(r.text, '')) AS runs_sha256, sha256(coalesce(t.collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed r ON d.doc_id = r.doc_id LEFT JOIN longest l ON d.doc_id = l.doc_id LEFT JOIN texts t ON d.doc_id = t.doc_id
"""

#: Source divergence in SQL: every source's share of every kept term, pair by pair.
OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), terms AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM terms GROUP BY ALL HAVING count(DISTINCT doc) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), totals AS (
  SELECT c.lang, c.source, sum(c.n)::BIGINT AS total FROM counts c JOIN kept k USING (lang, term) GROUP BY ALL
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), over AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_formatting": OP5_SQL, "op6_minhash_dedup": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_embedding_dedup": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_source_divergence": OP12_SQL}
