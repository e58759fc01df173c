"""The registered queries of the operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm import decontaminate, fingerprints, forest, mixing, negatives, packing, passages, prefixes, quality, suffixes, toxicity, urls, warc
from tripleloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url. A page of low quality or a toxic one is labelled as blocked."""
    labels = table(spark, sf_dir, "labels")
    blocked = labels.groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("blocked")
    )
    return urls.judge(table(spark, sf_dir, "pages"), blocked)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a response, and of each response its metadata and its plain text."""
    records = warc.responses(table(spark, sf_dir, "pages"))
    return warc.derive(records, keep="page_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["source"]))).alias("source_doc_ids"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all; of every seventh the label is moved on."""
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(vectors, number % 100 == 0, "vec_id", "embedding", "label")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefixes.trie(table(spark, sf_dir, "conversations"))
    found = trie.nodes.join(prefixes.ends_digest(trie.ends), prefixes.KEY, "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


QUERIES: dict[str, Query] = {
    "op1_url_filters": op1_url_filters,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_mixing": op11_mixing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

#: The part of the word rule that both engines read alike.
_DUCK_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"""

SQL: dict[str, str] = {
    "op7_decontamination": f"""
with d as (select doc_id, {_DUCK_WORDS.format('text')} as w from documents),
i as (select item_id, {_DUCK_WORDS.format('text')} as w from benchmark),
iw as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as p from i where len(w) > 0)
),
dw as (
  select doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') as gram
  from (select doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) as p from d, (select distinct m from iw))
),
hits as (select distinct doc_id, item_id, dw.m, p from dw join iw using (m, gram)),
covered as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + m)) as x from hits) group by doc_id),
found as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items
  from (select distinct doc_id, cast(item_id as varchar) as s from hits) group by doc_id
)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join covered using (doc_id) left join found using (doc_id)
""",
    "op10_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce("text", ''))) as h, octet_length(encode(coalesce("text", ''))) as n from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 100) as g from (select doc_id, h, unnest(range(0, n - 49)) as p from d where n >= 50)),
hits as (select doc_id, p from w join (select g, min(doc_id) as first from w group by g having min(doc_id) < max(doc_id)) using (g) where first < doc_id),
marked as (select doc_id, p, coalesce(p > lag(p) over (partition by doc_id order by p) + 50, true) as opens from hits),
spans as (
  select doc_id, min(p) as b, max(p) + 50 as e
  from (select doc_id, p, count_if(opens) over (partition by doc_id order by p) as island from marked) group by doc_id, island
),
kept as (
  select doc_id, string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' order by b) as h
  from (
    select s.doc_id, d.h, coalesce(lag(s.e) over (partition by s.doc_id order by s.b), 0) as b, s.b as e from spans s join d using (doc_id)
    union all select s.doc_id, any_value(d.h), max(s.e), any_value(d.n) from spans s join d using (doc_id) group by s.doc_id
  ) group by doc_id
)
select d.doc_id, n as n_bytes, cast(coalesce(r.removed, 0) as bigint) as n_removed, coalesce(r.n_spans, 0) as n_spans,
  sha256(from_hex(coalesce(kept.h, d.h))) as kept_sha256
from d left join kept using (doc_id) left join (select doc_id, sum(e - b) as removed, count(*) as n_spans from spans group by doc_id) r using (doc_id)
""",
    "op12_hard_negatives": """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select a.vec_id as anchor_id, c.vec_id as other_id, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score
  from e a join e c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
),
p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over w as integer) as rank, other_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by p.anchor_id, positive_id order by score desc, other_id)
qualify row_number() over w <= 10
""",
    "op13_prefix_trie": r"""
with t as (
  select conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce("text", '')) order by turn nulls first, coalesce(role, ''), coalesce("text", '')) as turns
  from conversations where conv_id is not null group by conv_id
),
h as (
  select conv_id, turns, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) % 4 as h
  from t
),
c as (
  select h.conv_id, list_concat(coalesce(b.turns, [])[:h.h], h.turns[h.h + 1:]) as turns
  from h left join t b on b.conv_id = h.conv_id - h.conv_id % 20
),
m as (select conv_id, len(turns) as total, depth, turns[:depth] as path from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from c)),
n as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = total), '')) as ends_sha256
  from m group by depth, path
),
w as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from n k where k.depth = n.depth + 1 and k.path[:n.depth] = n.path) as n_children,
    case when n.depth = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(n.path[n.depth].t, '[^\x20\x09-\x0D]+')) end as saved
  from n left join (select depth, path, conv_id from n) p on p.depth = n.depth - 1 and p.path = n.path[:n.depth - 1]
),
s as (
  select a.depth, a.path, sum(case when b.n_children = 0 then 1 else 0 end) as n_leaves, sum(b.saved) as saved_tokens
  from (select depth as at, unnest(range(0, depth + 1)) as depth, path as whole, n_children, saved from w) b join w a on a.depth = b.depth and a.path = b.whole[:b.depth]
  group by a.depth, a.path
)
select w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, w.ends_sha256
from w join s using (depth, path)
""",
}
