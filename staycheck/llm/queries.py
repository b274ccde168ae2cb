"""One query per operator over its whole table, and the SQL each must agree with."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staycheck.llm import (bpe, chat, decontaminate, exact_dedup, fingerprint, language_id, periodic, pii, quality, secrets,
                           simhash, substring_dedup, whitening)
from staycheck.llm.common import doc_rows, persisted, table
from staycheck.llm.spans import span_list


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_history(table(spark, sf_dir, "documents"))
    names = ", ".join(f"'{b}'" for b in secrets.BASE)
    base = span_list(f"filter(spans, x -> x.kind IN ({names}))", "start rank")
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{b}')) AS bigint)").alias(f"n_{b}") for b in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(base).cast("binary"), 256).alias("base_sha256"),
                        F.expr(span_list("spans", "start rank")).alias("spans"))


def _either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_OP1_KINDS = (  # kind, pattern, what must hold of a match
    ("assign", f"({_either_case('password|passwd|secret|token|api_?key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
     "length(regexp_extract(found, pattern, 2)) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(found) >= 16"), ("hex", "[0-9a-f]{32,}", "true"),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "true"), ("hosting", "gh[opsu]_[A-Za-z0-9]{36,}", "true"))
_OP1_MATCHES = " UNION ALL ".join(f"""
  SELECT doc_id, '{kind}' AS kind, {n} AS rank, m[i] AS found, i, '{pattern}' AS pattern,
    list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS begin
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d))
  WHERE {keep}""" for n, (kind, pattern, keep) in enumerate(_OP1_KINDS))
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_OP1_MATCHES}),
j AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || CAST(begin AS BIGINT) || ':' || CAST(begin + length(found) AS BIGINT), ','
      ORDER BY begin, rank) AS spans,
    string_agg(kind || ':' || CAST(begin AS BIGINT) || ':' || CAST(begin + length(found) AS BIGINT), ','
      ORDER BY begin, rank) FILTER (rank < 3) AS base
  FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
"""

BPE_FILE = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[bpe.Vocabulary, str]:
    import public_tokenizers

    return bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path(BPE_FILE))), public_tokenizers.PATTERN


def round_trip(docs: DataFrame, ranks: bpe.Vocabulary, pattern: str) -> DataFrame:
    return bpe.round_trip(docs, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    return round_trip(table(spark, sf_dir, "documents"), ranks, pattern)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"),
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
firsts AS (SELECT k, min({'d': doc_id, 'i': i}) AS f FROM win GROUP BY k HAVING count(*) > 1),
marked AS (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE {'d': doc_id, 'i': i} <> f),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM marked, (SELECT unnest(range(20)) AS j)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row_key")


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

def learns_language():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is null for a null doc_id: such a row is scored, and neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    named = language_id.classify(docs, language_id.fit(docs, learns_language()))
    return named.select("doc_id", (~learns_language()).alias("held_out"), "lang_pred", "score", "rejected")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).drop("row_key")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and the item in it."""
    return decontaminate.find_items(table(spark, sf_dir, "documents"),
                                    table(spark, sf_dir, "benchmark")).drop("row_key")


def learns_quality():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is null for a null doc_id: such a row is scored, and neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learns_quality())
    return quality.score(docs, model).select("doc_id", (~learns_quality()).alias("held_out"), "score",
                                             (F.col("score") >= 0.3).cast("int").alias("predicted"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    back = chat.read_back(persisted(chat.format_conversations(rows.unionAll(planted))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("turns", lambda t: t["under_mask"]), lambda t: t["text"]), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
                       F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
s AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(length(role) + length(text) + length(regexp_extract_all(text, '<\\*\|')) + 24) AS formatted
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       cast(formatted AS bigint) AS formatted_chars
FROM s
"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_pii(docs, pii.fit(docs))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{b}')) AS bigint)").alias(f"n_{b}") for b in pii.BASE]
    return found.select("doc_id", *counts,
                        F.sha2(F.expr(span_list("base", "rank start")).cast("binary"), 256).alias("base_sha256"),
                        F.expr(span_list("spans", "rank start")).alias("spans"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against its own edit and against the next document, by the nodes of their trees."""
    rows = doc_rows(table(spark, sf_dir, "documents"))
    paired = fingerprint.with_next(rows, ["text", "nodes"], fingerprint.with_tree)
    paired = paired.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(left(text, int(n_chars - n_chars div 3)), left(next_text, int(n_chars div 3)))")
    paired = fingerprint.with_tree(paired.select("*", edited.alias("edited")), "edited", "edited_")
    return paired.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                         F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"),
                         fingerprint.likeness("nodes", "edited_nodes").alias("near_edited"),
                         fingerprint.likeness("nodes", "next_nodes").alias("near_next"))


def _tree_sql(text: str) -> str:
    pieces = f"list_transform(regexp_extract_all(p, '{fingerprint.PIECE}'), lambda x: sha256(x))"
    paragraphs = f"list_transform(regexp_extract_all(s, '{fingerprint.PARAGRAPH}'), lambda p: {pieces})"
    return f"list_transform(regexp_extract_all({text}, '{fingerprint.SECTION}'), lambda s: {paragraphs})"


_ROOT_SQL = ("sha256(array_to_string(list_transform({0}, lambda s: sha256(array_to_string(list_transform(s, "
             "lambda p: sha256(array_to_string(p, ''))), ''))), ''))")
_NODES_SQL = "list_distinct(list_transform(list_prepend({1}, flatten(flatten({0}))), lambda h: CAST('0x' || left(h, 15) AS BIGINT)))"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, length(t) // 3 AS k,
        coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM d),
e AS (SELECT *, left(t, n - k) || left(after, k) AS edited FROM n),
x AS (SELECT *, {_tree_sql("t")} AS a, {_tree_sql("edited")} AS b, {_tree_sql("after")} AS c FROM e),
r AS (SELECT *, {_ROOT_SQL.format("a")} AS ra, {_ROOT_SQL.format("b")} AS rb, {_ROOT_SQL.format("c")} AS rc FROM x),
s AS (SELECT *, {_NODES_SQL.format("a", "ra")} AS na, {_NODES_SQL.format("b", "rb")} AS nb,
        {_NODES_SQL.format("c", "rc")} AS nc FROM r)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, ra AS fingerprint, rb AS edited_fingerprint,
  2.0::DOUBLE * len(list_intersect(na, nb)) / (len(na) + len(nb)) AS near_edited,
  2.0::DOUBLE * len(list_intersect(na, nc)) / (len(na) + len(nc)) AS near_next
FROM s
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are null, not finite or, in 64ths, 9e15 and more (whole numbers no double holds exactly)
    leave their vector out."""
    x = "transform(embedding, c -> IF(abs(64 * cast(c AS double)) < 9e15D, floor(64 * cast(c AS double)) + 1000000, NULL))"
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.expr(x).alias("x"))
    return whitening.whiten(vectors, whitening.fit(vectors))


def with_repeats(docs: DataFrame) -> DataFrame:
    """docs with, in one document of ten, the words from some place on replaced by a period of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("*", h.alias("h")).select(
        "doc_id", "text", (F.col("h") / 10).cast("long").alias("g"),
        F.expr(f"IF(h % 10 = 0, regexp_extract_all(text, r'{periodic.WORD}', 0), NULL)").alias("words"))
    placed = chosen.select("doc_id", "text", "words", "g", F.expr("int(g % size(words))").alias("a"))
    placed = placed.select("doc_id", "text", "words", "a", F.expr("int(1 + (size(words) - a) div (3 + g % 8))").alias("p"))
    repeated = F.expr("array_join(transform(words, (w, i) -> IF(i >= a, words[a + (i - a) % p], w)), ' ')")
    return placed.select("doc_id", F.when(F.size("words") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, one document of ten with a planted period; the greatest run's columns are null
    where there is none."""
    found = periodic.find_runs(with_repeats(table(spark, sf_dir, "documents")))
    told = F.expr("array_join(transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\n')), '')")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), periodic.greatest().alias("best"),
                        F.sha2(told.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_bpe": op2_bpe,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_pii": op10_pii,
    "op11_fingerprints": op11_fingerprints,
    "op12_whitening": op12_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op1_secrets": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op9_chat": OP9_SQL,
    "op11_fingerprints": OP11_SQL,
}
