"""The queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import bpe, crf, lattice, layout, lines, mixing, periodic, pivots, postings, simhash, spans, whitening, wordpiece
from sourceloom.llm.common import crc32_mod
from sourceloom.session import written

QUALITY_THRESHOLD = 0.3
QUALITY_FOLDS, LM_FOLDS, LM_HELD_OUT = 5, 7, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what `bpe.round_trip` gives."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and back."""
    return digests(bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json")))


def op2_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors of a label."""
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a piece model of the training fold."""
    train = lattice.training_fold("doc_id", LM_FOLDS, LM_HELD_OUT)
    return lattice.score_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), train)


def op4_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    pages = layout.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of repeated three-line windows."""
    docs = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "n_removed")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near copies for every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


def op7_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document occurs in the benchmark."""
    found = postings.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of repeated runs of sentences."""
    return spans.dedup_spans(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_words")


def quality_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> crf.Model:
    return crf.fit(docs, table(spark, sf_dir, "labels"), crc32_mod("doc_id", QUALITY_FOLDS) != 0)


def op9_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = crf.with_quality(docs, quality_model(spark, sf_dir, docs))
    return scored.select("doc_id", (crc32_mod("doc_id", QUALITY_FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.piece_counts(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "n_words", "n_pieces")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of all, with unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth text, by the crc32 of its id, repeats a period from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(w):
        n, g = F.size(w), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")

    # A list of one lets the words be computed once and named.
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise("")), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, the one with the most periods, and what is left without the repeats."""
    found = periodic.with_runs(with_periods(table(spark, sf_dir, "documents")))
    runs = F.col("runs")
    # Runs come by start, then period, so of equal ones the first stays.
    most = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    found = found.withColumn("best", F.aggregate(runs, F.lit(None).cast(periodic.RUN), most))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count("text").alias("size"))
    mixed = mixing.mix(written(sized, "document-sizes"), prefer=mixing.longer_first("size"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
), comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""

_OP5_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
win AS (
  SELECT doc_id, i, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM win
  WHERE c IS NOT NULL AND (trim(a, ' ') <> '' OR trim(b, ' ') <> '' OR trim(c, ' ') <> '')
), gone AS (SELECT DISTINCT doc_id, i + x AS i FROM ranked, (SELECT unnest(range(3)) AS x) WHERE k > 1),
rest AS (
  SELECT line.doc_id, string_agg(CASE WHEN gone.i IS NULL THEN line ELSE NULL END, chr(10) ORDER BY line.i) AS text, count(gone.i) AS n_removed
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i GROUP BY line.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(rest.text, '') END AS text, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN rest ON d.doc_id = rest.doc_id
"""

_WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[s:s + 12], ' ') AS c, least(len(w), 13) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n
), hit AS (
  SELECT p.doc_id, p.s, p.n, win.item FROM place p JOIN win ON win.n = p.n AND win.c = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')
), words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), row_of AS (
  SELECT doc_id, source, size, CAST(length(bin(size)) AS BIGINT) AS pref,
    CAST(concat('0x', substr(md5(concat('0/', coalesce(CAST(doc_id AS VARCHAR), '-'), '/', CAST(size AS VARCHAR), '/', coalesce(source, '-'))), 1, 13)) AS BIGINT) AS draw FROM d
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), ratio AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source) AS k FROM src
), levels AS (
  SELECT k, source_size, weight, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
      - CAST(coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM ratio
), goal AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(level, k) FROM levels WHERE level * weight <= 2 * source_size)) AS target FROM src
), class AS (
  SELECT source, pref, sum(size) AS words, count(*) AS docs FROM row_of GROUP BY source, pref
), shared AS (
  SELECT class.*, target, CASE WHEN sum(words * pref) OVER low > 0 THEN (target - CAST(2 * coalesce(sum(words) OVER up, 0) AS DOUBLE)) / CAST(sum(words * pref) OVER low AS DOUBLE) ELSE 0 END AS c
  FROM class JOIN goal ON class.source IS NOT DISTINCT FROM goal.source
  WINDOW up AS (PARTITION BY class.source ORDER BY pref DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    low AS (PARTITION BY class.source ORDER BY pref DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), factor AS (SELECT source, arg_max(c, pref) FILTER (WHERE c * pref <= 2) AS c FROM shared GROUP BY source
), expected AS (
  SELECT shared.source, pref, words, docs, target, least(CAST(2 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce(factor.c, 2) * pref)) AS copies
  FROM shared JOIN factor ON shared.source IS NOT DISTINCT FROM factor.source
), plan AS (
  SELECT source, pref, floor(copies) AS whole, copies - floor(copies) AS p, floor(target - sum(floor(copies) * words) OVER s) AS room,
    least(24, length(bin(CAST(sum(CASE WHEN copies > floor(copies) THEN docs ELSE 0 END) OVER s AS BIGINT) // 512)) - 1) AS bits
  FROM expected WINDOW s AS (PARTITION BY source)
), u AS (
  SELECT r.*, whole, p, room, bits, (draw + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM row_of r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source AND r.pref = plan.pref
), z AS (SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) END AS z FROM u
), fine AS (SELECT *, CAST(floor(z * power(CAST(2 AS DOUBLE), bits)) AS BIGINT) AS fine FROM z
), bin AS (
  SELECT source, fine, room, words, coalesce(sum(words) OVER (PARTITION BY source ORDER BY fine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, fine, any_value(room) AS room, sum(size) AS words FROM fine WHERE size > 0 AND p > 0 GROUP BY source, fine)
), last AS (SELECT source, fine AS bin, CAST(room - before AS BIGINT) AS left_over FROM bin WHERE before <= room AND room < before + words
), unit AS (
  SELECT fine.source, draw, CAST(sum(size) AS BIGINT) AS words, any_value(left_over) AS left_over, row_number() OVER (PARTITION BY fine.source ORDER BY min(z), draw) AS k
  FROM fine JOIN last ON fine.source IS NOT DISTINCT FROM last.source AND fine.fine = last.bin WHERE size > 0 AND p > 0 GROUP BY fine.source, draw
), fill AS (
  SELECT source, CAST(0 AS BIGINT) AS k, left_over AS room, CAST(NULL AS BIGINT) AS draw FROM last
  UNION ALL
  SELECT f.source, unit.k, CASE WHEN words <= room THEN room - words ELSE room END, CASE WHEN words <= room THEN unit.draw END
  FROM fill f JOIN unit ON unit.source IS NOT DISTINCT FROM f.source AND unit.k = f.k + 1
)
SELECT r.doc_id, r.size, goal.source_size, goal.target, CAST(CASE WHEN r.size = 0 THEN 0 ELSE r.size * (whole + CASE
    WHEN p > 0 AND (CASE WHEN last.bin IS NULL THEN r.room > 0 ELSE fine < last.bin END OR fill.draw IS NOT NULL) THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM fine r JOIN goal ON r.source IS NOT DISTINCT FROM goal.source LEFT JOIN last ON r.source IS NOT DISTINCT FROM last.source
LEFT JOIN fill ON fill.source IS NOT DISTINCT FROM r.source AND fill.draw = r.draw
"""

QUERIES = {f.__name__: f for f in (op1_bpe, op2_pivots, op3_lattice, op4_layout, op5_lines, op6_simhash, op7_postings, op8_spans, op9_crf, op10_pieces, op11_whitening, op12_periods, op13_mixing)}
ORACLES = {"op2_pivots": _OP2_SQL, "op5_lines": _OP5_SQL, "op7_postings": _OP7_SQL, "op13_mixing": _OP13_SQL}
