"""The subpackage's queries over the given tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, divergence, embeddings, language, lines, mixing, packing, quality, search, sharding, simhash, substring, token_files, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return packing.pack_pieces(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))


def op3_embeddings(spark, sf_dir):
    return embeddings.embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_lines(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents")).drop("mark")


def op5_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents")).drop("mark")


def op7_token_files(spark, sf_dir):
    path = common.scratch_dir(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.token_digests(token_files.read_token_files(spark, path))


def op8_substring(spark, sf_dir):
    out = substring.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language.learn_and_identify(docs, docs.filter(F.col("doc_id").isNotNull() & ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_urls(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op11_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sharding(spark, sf_dir):
    out = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_divergence(spark, sf_dir):
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_packing, op2_simhash, op3_embeddings, op4_lines, op5_mixing, op6_quality, op7_token_files, op8_substring, op9_language, op10_urls, op11_search, op12_sharding, op13_divergence)}


# --- SQL -----------------------------------------------------------------------------------------------------------

OP3 = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings
  where embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x)
  where list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
comp as (select a, least(a, min(b)) as c from reach group by a),
n as (select a, count(*) as n from link group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(comp.c, e.vec_id)::bigint as component_id,
  coalesce(comp.c, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.a = e.vec_id left join comp on comp.a = e.vec_id
"""

OP5 = """
with recursive d as (select doc_id, source, (coalesce(length(text), 0) + 1)::bigint as size,
    ('0x' || md5(coalesce(doc_id::varchar, ''))[1:8])::bigint % 1024 as part from documents),
w as (select *, sum(size) over (partition by source order by part, doc_id, size rows unbounded preceding) - size as before from d),
p as (select *, (before // 65536)::bigint as block from w),
s0 as (select source, max(block) + 1 as blocks, pow(sum(size)::double, 0.7) as weight from p group by source),
s as (select row_number() over (order by source nulls first) - 1 as i, source, blocks,
    greatest(1, round(1000 * weight / (select sum(weight) from s0)))::bigint as share from s0),
arr as (select list(share order by i) as shares, list(blocks order by i) as blocks, sum(share)::bigint as period from s),
sim(position, t, done, pick, j) as (
  select -1::bigint, -1::bigint, list_transform(shares, lambda x: 0::bigint), -1::bigint, -1::bigint from arr
  union all
  select position + 1, now, list_transform(done, lambda d, i: case when i - 1 = q then d + 1 else d end), q, done[q + 1] from (
    select position, done, now, list_min(list_filter(list_transform(shares, lambda sh, i: case when done[i] < blocks[i] and done[i] * period // sh <= now
        then ((done[i] + 1) * period + sh - 1) // sh * 100000 + i - 1 end), lambda x: x is not null)) % 100000 as q
    from (select *, greatest(t + 1, list_min(list_filter(list_transform(shares, lambda sh, i: case when done[i] < blocks[i] then done[i] * period // sh end), lambda x: x is not null))) as now
      from sim, arr where list_sum(done) < list_sum(blocks))))
select p.doc_id, p.source, p.size, p.block, s.share, sim.position
from p join s on p.source is not distinct from s.source join sim on sim.pick = s.i and sim.j = p.block
"""

OP6 = r"""
with t as (select doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
win as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as k from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as c from win) where c > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
f as (select w.doc_id, lang, source, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
  from w left join rep using (doc_id)),
r as (select *, n_symbols / greatest(word_chars, 1) as a, n_dup_lines / greatest(n_lines, 1) as b, n_repeat_words / greatest(n_words, 1) as c,
    n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
fence as (select lang, source, grouping(lang) as gl, grouping(source) as gs, count(*) filter (a > 0) as na, count(*) filter (b > 0) as nb, count(*) filter (c > 0) as nc,
    quantile_disc(a, 0.9) filter (a > 0) as a, quantile_disc(b, 0.99) filter (b > 0) as b, quantile_disc(c, 0.99) filter (c > 0) as c
  from r where not base_failed group by grouping sets ((lang, source), (lang), ())),
wide as (select l.lang, coalesce((l.na * l.a + 20.0::double * e.a) / (l.na + 20.0::double), e.a) as a, coalesce((l.nb * l.b + 20.0::double * e.b) / (l.nb + 20.0::double), e.b) as b,
    coalesce((l.nc * l.c + 20.0::double * e.c) / (l.nc + 20.0::double), e.c) as c from fence l join fence e on e.gl = 1 where l.gl = 0 and l.gs = 1),
pick as (select g.lang, g.source, coalesce((g.na * g.a + 20.0::double * w.a) / (g.na + 20.0::double), w.a) as a, coalesce((g.nb * g.b + 20.0::double * w.b) / (g.nb + 20.0::double), w.b) as b,
    coalesce((g.nc * g.c + 20.0::double * w.c) / (g.nc + 20.0::double), w.c) as c from fence g join wide w on g.lang is not distinct from w.lang where g.gl = 0 and g.gs = 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (coalesce(r.a > pick.a, false) or coalesce(r.b > pick.b, false) or coalesce(r.c > pick.c, false)) as kept,
  pick.a as symbol_ratio_fence, pick.b as dup_line_ratio_fence, pick.c as repeat_ratio_fence
from r left join pick on r.lang is not distinct from pick.lang and r.source is not distinct from pick.source
"""

OP8 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
win as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as k from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w)),
cut as (select doc_id, i from (select *, min(doc_id) over (partition by k) as first from win) where doc_id > first),
gone as (select doc_id, list_distinct(list(p)) as gone from (select doc_id, unnest(range(i, i + 50)) as p from cut) group by doc_id),
kept as (select w.doc_id, words, gone, case when gone is null then words else
    list_filter(words, lambda x, i: not list_contains(gone, i)) end as kept from w left join gone using (doc_id))
select doc_id, len(words)::bigint as n_words, (len(words) - len(kept))::bigint as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from kept
"""

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = r"regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
with d as (select doc_id, row_number() over () as r, list_transform({_TERMS}, lambda x: translate(x, {_CAPITALS})) as terms from documents),
n as (select r, doc_id, len(terms)::bigint as n from d where len(terms) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from n),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from d) group by r, term),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term),
q as (select item_id, translate(unnest({_TERMS}), {_CAPITALS}) as term from benchmark),
m as (select item_id, term, count(*)::bigint as times from q group by all),
s as (select m.item_id, n.doc_id, n.r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n.n * docs) // terms))))::bigint as score
  from m join w using (term) join tf using (term) join n on n.r = tf.r, total group by all),
best as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from best where rank <= 20
"""

OP12 = """
with crc as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t),
d as (select doc_id, strlen(coalesce(text, ''))::bigint + 16 as size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
c as (select doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))::bigint as text_crc32 from d, crc),
h as (select *, list_transform(range(41), lambda s: ('0x' || md5(coalesce(doc_id::varchar, '') || '|' || (s // 4)::varchar)[8 * (s % 4) + 1 : 8 * (s % 4) + 8])::bigint) as h from c),
p as (select *, list_position(h[:40], list_max(h[:40])) - 1 as shard, list_position(h, list_max(h)) - 1 as grown_shard,
    ('0x' || md5(coalesce(doc_id::varchar, '') || '|' || size::varchar || '|' || text_crc32::varchar)[1:8])::bigint % 1024 as part from h)
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, grown_shard::int as grown_shard,
  row_number() over (partition by shard order by part, doc_id nulls first, size, text_crc32) - 1 as slot from p
"""

OP13 = rf"""
with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), {_CAPITALS}) as term from d),
keep as (select lang, term from t group by lang, term having count(distinct r) >= 3),
n as (select lang, source, term, count(*)::bigint as n from t join keep using (lang, term) group by all),
v as (select lang, count(*)::bigint as v from keep group by lang),
g as (select lang, source, coalesce(sum(n), 0)::bigint as total from (select distinct lang, source from d) left join n using (lang, source) group by all),
gl as (select lang, sum(total)::bigint as total, coalesce(any_value(v), 0) as v from g left join v using (lang) group by lang),
p as (select g.lang, g.source, keep.term, coalesce(n, 0) as n, 1 + ((1000000000::hugeint * (coalesce(n, 0) + 1)) // (g.total + gl.v))::bigint as p
  from g join gl using (lang) join keep using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = keep.term),
q as (select lang, term, 1 + ((1000000000::hugeint * (sum(n) + 1)) // (any_value(gl.total) + any_value(gl.v)))::bigint as q from n join gl using (lang) group by lang, term),
own as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from p join q using (lang, term) where n > 0 and p > q),
two as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::bigint as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join two on two.lang = a.lang and two.source = a.source and two.item = b.source),
out as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from own union all select * from pair))
select lang, source, part, item, value::bigint as value, rank::int as rank from out where part = 'pair' or rank <= 200
"""


def oracle_sql():
    return {"op3_embeddings": OP3, "op5_mixing": OP5, "op6_quality": OP6, "op8_substring": OP8, "op11_search": OP11, "op12_sharding": OP12, "op13_divergence": OP13}
