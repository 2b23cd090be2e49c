"""One query per corpus operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm.alignment import ByteLevel, Pieces, align_corpus, loaded
from attest.llm.chat import conversations_back, formatted_turns
from attest.llm.jaccard import similar_groups
from attest.llm.lines import judge, learn
from attest.llm.mixing import mix_plan
from attest.llm.packing import pack
from attest.llm.quality import classify
from attest.llm.runs import find_runs, strongest
from attest.llm.secrets import scan
from attest.llm.sharding import shard
from attest.llm.suffix_dedup import remove_repeats
from attest.llm.topk import top_k
from attest.llm.warc import archive_folder, read_archives, write_archives

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(_table(spark, folder, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"),
                        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("removed_spans"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_table(spark, folder, "documents"), ["doc_id"], TOKENIZER, marks=True)


def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return scan(_table(spark, folder, "documents"), {"doc_id": F.col("doc_id")})


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(_table(spark, folder, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    held_out = lambda c: F.crc32(c.cast("string").cast("binary")) % 4 == 2
    docs = _table(spark, folder, "documents").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    scored = classify(docs, _table(spark, folder, "labels"), ["doc_id", "held_out"], ~held_out(F.col("id")))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    plan = mix_plan(_table(spark, folder, "documents"))
    each = plan.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * (F.col("epochs") + (F.col("k") <= F.col("extra")).cast("long"))).alias("taken"))


def op7_line_labelling(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return judge(docs, ["doc_id"], learn(docs, _table(spark, folder, "labels")))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_archives(_table(spark, folder, "pages"), archive_folder(spark))
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(_table(spark, folder, "documents")).select("doc_id", "class_id", "n_links")


def _planted(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with the contract's runs: a tenth of the texts repeats a stretch of its own words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n = F.size("words")
    a = F.when(n > 0, F.col("g") % n).cast("int")
    docs = docs.withColumns({"n": n, "a": a})
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(block, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, F.col("n") - F.col("a"))), " ")
    return docs.select("doc_id", F.when(F.col("p").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(_planted(_table(spark, folder, "documents").select("doc_id", "text")), ["doc_id"])
    best = strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = rows.unionByName(more)
    back = conversations_back(formatted_turns(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.col("chars").alias("formatted_chars"))


def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align_corpus(_table(spark, folder, "documents"), ["doc_id"], lambda: (loaded(ByteLevel, TOKENIZER), loaded(Pieces, PIECES)))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_secret_scans": op3_secret_scans,
    "op4_sharding": op4_sharding,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing": op6_mixing,
    "op7_line_labelling": op7_line_labelling,
    "op8_warc": op8_warc,
    "op9_exact_topk": op9_exact_topk,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_OP1_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, i, md5(substr(h, 2 * i + 1, 800)) as m from (select r, h, unnest(range(0, greatest(0, length(h) // 2 - 399))) as i from d)),
g as (select m from w group by m having count(*) > 1),
s as (select r, i from w where m in (select m from g)),
n as (select r, i, case when i <= lag(i) over (partition by r order by i) + 400 then 0 else 1 end as fresh from s),
k as (select r, i, sum(fresh) over (partition by r order by i) as run from n),
spans as (select r, run, min(i) as b, max(i) + 400 as e from k group by r, run),
o as (select *, coalesce(lag(e) over (partition by r order by run), 0) as p from spans),
c as (select o.r, string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' order by run) as a, max(e) as last,
    sum(e - b)::bigint as n_removed, count(*) as n_spans, string_agg(b || '-' || e, ',' order by b) as told from o join d using (r) group by o.r),
k2 as (select doc_id, h, n_removed, n_spans, told, coalesce(a, '') || substr(h, 2 * coalesce(last, 0) + 1) as kept from d left join c using (r))
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(kept)) as kept_sha256, coalesce(told, '') as removed_spans,
  decode(unhex(array_to_string(list_filter(regexp_extract_all(kept, '[0-7].|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].|..'),
    lambda x: length(x) > 2 or x < '80'), ''))) as text
from k2
"""

_OP8_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as x from pages),
k as (select *, max(page_id) over (partition by x) as keeper from p),
b as (select *, list_transform(range(0, 8), lambda g: ('0x' || substr(x, 1 + 5 * g::int, 5))::int) as parts from k)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((parts[1 + (c::int // 4)] >> (15 - 5 * (c::int % 4))) & 31), 1)), '') as payload_digest,
  case when page_id is not distinct from keeper then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from keeper then keeper end as refers_to
from b
"""

_OP9_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r as qr, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on q.vec_id % 20 = 0 and c.r <> q.r and len(c.v) = len(q.v)),
r as (select *, row_number() over (partition by qr order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

_OP10_SQL = r"""
with recursive w as (select row_number() over () as r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct r, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3),
    lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select r, count(*) as n from s group by r),
e as (select a.r as a, b.r as b from s a join s b using (sh) where a.r <> b.r group by a.r, b.r
    having 9 * count(*) >= 4 * ((select n from n where n.r = a.r) + (select n from n where n.r = b.r))),
c as (select a, b from e union select c.a, e.b from c join e on c.b = e.a),
l as (select a, count(*) as n_links from e group by a),
m as (select c.a, min(w.doc_id) as class_id from c join w on w.r = c.b group by c.a)
select doc_id, least(doc_id, coalesce(class_id, doc_id)) as class_id, coalesce(n_links, 0)::bigint as n_links
from w left join l on l.a = w.r left join m on m.a = w.r
"""

_OP11_SQL = r"""
with d0 as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
    lambda w: w <> '') as ws, xor(4294967295::ubigint, list_reduce(list_prepend(4294967295::ubigint,
      list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::ubigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: 0::ubigint)),
        lambda x, k: case when x % 2 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)))::bigint as h from documents),
d1 as (select *, len(ws) as n, h // 10 as g from d0),
d2 as (select *, g % n as a, 1 + (n - g % n) // (3 + g % 8) as p from d1 where h % 10 = 0 and n > 0),
d as (select r, doc_id, n, ws from d1 where h % 10 <> 0 or n = 0 or h is null union all
  select r, doc_id, n, list_transform(range(n), lambda i: ws[1 + case when i >= a then a + (i - a) % p else i end]) from d2),
f as (select r, n, unnest(range(0, greatest(n - 4, 0))) as i, unnest(list_transform(range(1, greatest(n - 4, 0) + 1),
    lambda i: array_to_string(ws[i:i + 4], ' '))) as s from d),
m as (select x.r, y.i - x.i as p, x.i from f x join f y on x.r = y.r and x.s = y.s and y.i > x.i and 4 * (y.i - x.i) <= x.n),
k as (select r, p, i, i - row_number() over (partition by r, p order by i) as island from m),
s as (select r, p, min(i) as b, max(i) + 5 + p as e from k group by r, p, island having max(i) + 5 + p - min(i) >= greatest(6, 4 * p)),
runs as (select r, b, e, min(p) as p from s group by r, b, e),
t as (select r, count(*) as n_runs, string_agg(b || ',' || (e - b) || ',' || p || chr(10), '' order by b, p) as lines from runs group by r),
best as (select * from runs x where not exists (select 1 from runs y where y.r = x.r and ((y.e - y.b) * x.p > (x.e - x.b) * y.p
    or ((y.e - y.b) * x.p = (x.e - x.b) * y.p and (y.b, y.p) < (x.b, x.p))))),
gone as (select distinct r, unnest(range(b + p, e)) as i from runs),
w as (select r, unnest(range(0, n)) as i, unnest(ws) as w from d),
c as (select w.r, string_agg(w.w, ' ' order by w.i) as x from w anti join gone using (r, i) group by w.r)
select doc_id, coalesce(n_runs, 0) as n_runs, b as start, e - b as length, p as period, 1000 * (e - b) // p as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(x, '')) as collapsed_sha256
from d left join t using (r) left join (select r, b, e, p from best) using (r) left join c using (r)
"""

_OP12_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, k, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
s as (select *, 23 + length(role) + length(text) + (length(role || text) - length(replace(role || text, '\', '')))
    + (length(role) - length(replace(role, '<|', ''))) // 2 + (length(text) - length(replace(text, '<|', ''))) // 2 as size from t),
p as (select *, sum(size) over (partition by conv_id order by turn nulls last, role, text
    rows between unbounded preceding and current row) as chars from s)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (coalesce(sum(chars) filter (role = 'assistant'), 0) + max(chars) - coalesce(max(chars) filter (role = 'assistant'), 0))::bigint as formatted_chars
from p group by conv_id
"""

ORACLES: dict[str, str] = {
    "op1_suffix_dedup": _OP1_SQL,
    "op8_warc": _OP8_SQL,
    "op9_exact_topk": _OP9_SQL,
    "op10_jaccard_join": _OP10_SQL,
    "op11_periodic_runs": _OP11_SQL,
    "op12_chat_formatting": _OP12_SQL,
}
