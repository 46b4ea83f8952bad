"""The registered queries of the operators: each applies one to its whole
table and derives the columns that its contract names."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanalign.llm.chat import CONTROL
from spanalign.llm.common import table

REGISTRY: dict = {}
ORACLE: dict = {}


def register(sql=None):
    def keep(fn):
        REGISTRY[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return keep


def _escaped(column: str) -> str:
    pattern = r"([<\[])" + CONTROL.removeprefix(r"[<\[]")
    return f"regexp_replace({column}, '{pattern}', '\\1\\\\\\2\\3', 'g')"


# the windows by their definition: budget 1024, history 256, 3 tokens a turn besides its words, 23 characters of marks
SQL_WINDOWS = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w - 1 AS ord, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 3 AS tokens,
  {_escaped('role')} AS erole, {_escaped('text')} AS etext FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o),
s AS (SELECT conv_id, tokens AS st, text AS stext, etext AS setext FROM b WHERE ord = 0 AND role = 'system'),
t AS (SELECT b.*, st, st IS NOT NULL AND ord = 0 AS is_system, greatest(0, before - coalesce(st, 0)) AS frm,
  greatest(256, 768 - coalesce(st, 0)) AS room FROM b LEFT JOIN s ON s.conv_id = b.conv_id),
l AS (SELECT *, NOT is_system AND tokens > room // 4 AS lng, CAST(frm AS BIGINT) // greatest(1, room * 3 // 4) AS cell FROM t),
n AS (SELECT *, coalesce(sum(CAST(lng AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS longs FROM l),
p AS (SELECT conv_id, cell, longs, lng, min(ord) AS start, min(frm) AS at, sum(tokens) AS own, max(coalesce(st, 0)) AS head FROM n GROUP BY ALL),
pieces AS (
  SELECT conv_id, 23 + length(erole) + length(etext) AS k FROM n
  UNION ALL SELECT p.conv_id, 23 + length(erole) + length(etext) FROM p JOIN n ON n.conv_id = p.conv_id AND NOT is_system
    AND n.ord < p.start AND p.at - n.frm <= least(256, 1024 - own - head)
  UNION ALL SELECT p.conv_id, 23 + 6 + length(setext) FROM p JOIN s ON s.conv_id = p.conv_id AND p.start > 0),
f AS (SELECT conv_id, CAST(sum(k) AS BIGINT) AS formatted_chars FROM pieces GROUP BY conv_id)
SELECT o.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM o JOIN f ON f.conv_id = o.conv_id GROUP BY o.conv_id"""

# all pairs in double precision, and components by the smallest id that spreads over the links
SQL_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS low FROM embeddings UNION SELECT l.w, r.low FROM r JOIN l ON l.u = r.u),
c AS (SELECT u, min(low) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT x.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, x.vec_id = c.component_id AS kept
FROM embeddings x JOIN c ON c.u = x.vec_id LEFT JOIN n ON n.u = x.vec_id"""

# every document against every item, by the definition
SQL_SEARCH = r"""WITH words AS (SELECT doc_id, list_distinct(t) AS ts, t, len(t) AS n FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents)),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM words WHERE n > 0),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, n, unnest(t) AS term FROM words) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, g),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 50"""


@register()
def op5_systematic_mix(spark, sf_dir):
    from spanalign.llm.mixing import copies

    return copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@register()
def op8_length_buckets(spark, sf_dir):
    from spanalign.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@register()
def op10_sampled_splitters(spark, sf_dir):
    from spanalign.llm.sharding import place

    return place(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register()
def op9_deletion_variants(spark, sf_dir):
    from spanalign.llm.simhash import clusters

    return clusters(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@register()
def op2_importance_resampling(spark, sf_dir):
    from spanalign.llm.quality import sample

    rows, kept = sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    chosen = kept.select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_t"), F.lit(True).alias("_kept"))
    return rows.join(chosen, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("_tie")), "left").select("doc_id", "n_grams", "weight", F.col("_key").alias("sample_key"), F.coalesce("_kept", F.lit(False)).alias("kept"))


@register()
def op4_skip_chain(spark, sf_dir):
    from spanalign.llm.pii import detect

    found = detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@register()
def op3_subword_lattice(spark, sf_dir):
    from spanalign.llm.lattice import score

    return score(table(spark, sf_dir, "documents"))


@register()
def op7_multiset_hash(spark, sf_dir):
    from spanalign.llm.multiset import compare

    return compare(table(spark, sf_dir, "documents"))


@register(SQL_WINDOWS)
def op1_budgeted_windows(spark, sf_dir):
    from spanalign.llm.chat import digest, windows

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return digest(windows(rows.union(more)))




@register(SQL_LINKS)
def op6_pruned_graph(spark, sf_dir):
    from spanalign.llm.graph import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@register(SQL_SEARCH)
def op11_max_sketches(spark, sf_dir):
    from spanalign.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register()
def op12_bit_sliced_index(spark, sf_dir):
    from spanalign.llm.spelling import group

    return group(table(spark, sf_dir, "documents"), least=5, often=3, typos=97)


@register()
def op13_chain_field(spark, sf_dir):
    from spanalign.llm.secret_scan import scan

    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
