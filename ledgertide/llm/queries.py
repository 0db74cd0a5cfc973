"""The registered queries of this subpackage and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm import (
    archives, common, context_tree, conversations, decontamination, fingerprints, html_text, lexical_search, near_duplicates, quality, repeats, segmentations, simhash,
    vector_codes,
)
from ledgertide.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return register


OP2_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
windows as (select distinct item_id, least(len(w), 13) n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from windows),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
found as (select p.doc_id, p.n, p.i, x.item_id from places p join windows x on p.k = x.k and p.n = x.n),
hits as (select doc_id, count(distinct place) n_hit from (select doc_id, unnest(range(i, i + n)) place from (select distinct doc_id, n, i from found)) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) listed from (select distinct doc_id, cast(item_id as varchar) item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(listed, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""


@query("op2_decontamination", OP2_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


OP9_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) place, floor(coalesce(turn, 0) / 256.0) segment,
    coalesce(role, '') as shown_role, coalesce(text, '') as shown_text, md5(coalesce('r' || role, '-') || chr(1) || coalesce('t' || text, '-')) h from conversations where conv_id is not null),
p as (select *, md5(string_agg(h, '' order by place) over (partition by conv_id order by place rows unbounded preceding)) prefix from t),
e as (select conv_id, max(place) n_turns, max_by(prefix, place) whole from p group by conv_id),
u as (select min(conv_id) conv_id, n_turns, whole, count(*) n_equal from e group by n_turns, whole),
kept as (select u.* from u where not exists (select 1 from p join e using (conv_id) where p.place < e.n_turns and p.place = u.n_turns and p.prefix = u.whole))
select p.conv_id, cast(segment as bigint) segment, n_turns, n_equal, min(place) first_turn,
  string_agg('<|im_start|>' || shown_role || chr(10) || shown_text || '<|im_end|>' || chr(10), '' order by place) rendered
from p join kept using (conv_id) group by p.conv_id, segment, n_turns, n_equal
"""


@query("op9_chat_snapshots", OP9_SQL)
def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.collapsed_chats(table(spark, sf_dir, "conversations"))


@query("op7_near_duplicates")
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, rules).select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op10_layout_text")
def op10_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


OP5_SQL = """
with p as (select page_id, sha256(coalesce(html, '')) digest, cast(strlen(coalesce(html, '')) as bigint) size from pages),
f as (select digest, min(page_id) first from p where size >= 100 group by digest)
select page_id, size payload_bytes, digest payload_digest, case when first is null or page_id = first then 'response' else 'revisit' end record_type,
  case when page_id <> first then first end refers_to
from p left join f using (digest)
"""


@query("op5_arc_to_warc", OP5_SQL)
def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_repeated_passages")
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_minhash_fingerprints")
def op6_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.with_classes(docs)


@query("op4_context_tree")
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(table(spark, sf_dir, "documents"), common.remainder("doc_id", 10) == 0)


@query("op1_gumbel_segmentations")
def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentations.encoded(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with d as (select doc_id, row_number() over () row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
totals as (select count(*) n_docs, sum(len(w)) n_terms from d where len(w) > 0),
tf as (select doc_id, row, t, count(*) tf from (select doc_id, row, unnest(w) t from d) group by all),
weights as (select t, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / (2 * coalesce(df, 0) + 1))) as bigint) weight
  from (select distinct t from q) left join (select t, count(*) df from tf group by t) using (t), totals),
sizes as (select row, 10 + (90 * len(w) * n_docs) // n_terms m from d, totals where len(w) > 0),
scores as (select item_id, doc_id, row, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) score from q join tf using (t) join weights using (t) join sizes using (row) group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id, row) rank from scores where score > 0)
select item_id, cast(rank as integer) rank, doc_id, score from ranked where rank <= 10
"""


@query("op11_max_sketch_search", OP11_SQL)
def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op12_round(books: str, number: int) -> str:
    """Assignment of all parts to the entries of ``books`` (``m`` packs distance and index) and the means that follow."""
    return f"""
a{number} as (select row, part, min(gap * 64 + entry) m from (select row, x.part, entry, sum((x.val - c.val) * (x.val - c.val)) gap from x join {books} c on x.part = c.part and x.pos = c.pos group by all) group by all),
c{number} as (select c.part, c.entry, c.pos, coalesce(mean, c.val) val from {books} c left join (
  select x.part, m % 64 entry, pos, cast(floor(sum(val) / count(*)) as bigint) mean from x join a{number} using (row, part) group by all) s on c.part = s.part and c.entry = s.entry and c.pos = s.pos)"""


OP12_SQL = f"""
with kept as (select vec_id, label, row_number() over (order by vec_id nulls last, embedding) row, embedding v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda y: y is not null and isfinite(y))) = len(embedding)),
spread as (select row, unnest(v) val, unnest(range(len(v))) place, len(v) // 16 width from kept),
x as (select row, cast(place // width as integer) part, cast(place % width as integer) pos, cast(floor(256 * cast(val as double)) as bigint) val from spread),
c0 as (select part, cast(row - 1 as bigint) entry, pos, val from x where row <= 64),
{_op12_round("c0", 1)}, {_op12_round("c1", 2)}, {_op12_round("c2", 3)},
coded as (select row, string_agg(printf('%02x', m % 64), '' order by part) code, cast(sum(m // 64) as bigint) error from a3 group by row),
books as (select sha256(string_agg(cast(val as varchar), ',' order by part, entry, pos)) codebooks_sha256 from c2)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, codebooks_sha256 from kept join coded using (row), books
"""


@query("op12_gnat_codes", OP12_SQL)
def op12_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


@query("op13_simhash_groups")
def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
