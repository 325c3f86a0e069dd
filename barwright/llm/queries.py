"""The queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import mixing, neighbours, packing, quality, secrets, simhash, substring, token_store, toxicity, warc
from barwright.llm.tokens import default_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    files = token_store.write_ids(_table(spark, folder, "documents"), default_path("byte_bpe_50k.json"), end_id=2)
    return token_store.read_ids(files).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def packed(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), default_path("word_bpe_49k.json"), window=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    digest = F.sha2(F.encode(secrets.joined(base), "UTF-8"), 256)
    return found.select("doc_id", *map(count, secrets.BASE), digest.alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), k=20, every=20)


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    found = toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Words of a run from which op7 cuts it. Short lines and sentences recur in most texts (README).
PASSAGE_WORDS = 25


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document: the runs that were cut, as start:end, the text that is left, and all later
    occurrences of units, cut or not."""
    out = substring.without_repeats(_table(spark, folder, "documents"), least=PASSAGE_WORDS)

    def joined(name: str):
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")

    taken = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return out.select("doc_id", F.size("removed").cast("long").alias("n_removed"), taken.alias("removed_chars"), joined("removed").alias("spans"), "text", joined("later").alias("later_spans"))


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.placed(_table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.judge(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(_table(spark, folder, "pages")), payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_token_ids": token_ids,
    "op2_packing": packed,
    "op3_secrets": secret_scan,
    "op4_neighbours": nearest,
    "op5_simhash": near_duplicates,
    "op6_toxicity": toxic_scores,
    "op7_substring": repeated_passages,
    "op8_mixing": mixed,
    "op9_quality": quality_rules,
    "op10_warc": archives,
}

def _quality_sql() -> str:
    """The same counts and distances, by words as rows."""
    space = "[\\x20\\x09-\\x0D]"

    def count(pattern: str) -> str:
        return f"length(regexp_replace(t, '[^{pattern}]', '', 'g'))"

    failed = f"n_words<{quality.BASE_WORDS} or 100*n_repeat_words>{quality.REPEAT_PERCENT}*n_words"
    common = ", ".join(f"('{lang}', {i}, '{w}')" for lang, words in quality.COMMON.items() for i, w in enumerate(words))

    def distance(kind: str) -> str:
        part = "case when {0}>0 then {0}*log2(2*{0}/(p+q)) else 0 end"
        return (
            f"select key, sqrt(greatest(0, sum({part.format('p')}+{part.format('q')})/2)) dist from (select h.key, h.n/nullif(sum(h.n) over (partition by h.key),0) p, r.n/sum(r.n) over (partition by h.key) q"
            f" from {kind} h join (select {kind}.lang, bin, sum(n) n from {kind} join good using (key) group by all) r on r.lang=h.lang and r.bin=h.bin) group by key"
        )

    return f"""
with d as (select row_number() over () as key, doc_id, lang, coalesce(text, '') t from documents),
l as (select key, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x<>'') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
words as (select key, unnest(ws) w, generate_subscripts(ws, 1) i from l),
win as (select key, i, w, lead(w, 1) over x w2, lead(w, 2) over x w3 from words window x as (partition by key order by i)),
rep as (select key, i from (select key, i, count(*) over (partition by key, w, w2, w3) c from win where w3 is not null) where c>1),
cov as (select key, count(distinct j) n from (select key, unnest([i, i+1, i+2]) j from rep) group by key),
base as (select d.*, len(ws) n_words, {count("#*$%&|<>")} n_symbols, length(t)-length(regexp_replace(t, '{space}', '', 'g')) n_space, len(ls)-len(list_distinct(ls)) n_dup_lines, coalesce(cov.n, 0) n_repeat_words
 from d join l using (key) left join cov using (key)),
good as (select key from base where not ({failed}) qualify count(*) over (partition by lang)>={quality.LEAST_TEXTS}),
cls as (select key, lang, unnest([0,1,2,3,4,5]) bin, unnest([u, g, m, n_symbols, n_space, length(t)-u-g-m-n_symbols-n_space]) n from (
 select *, {count("A-Z")} u, {count("0-9")} g, length(t)-length(translate(t, '!"(),-./:;?[]{{}}' || chr(39), '')) m from base) where lang in ('en', 'de', 'fr', 'es')),
ref(lang, bin, word) as (values {common}),
hits as (select key, d.lang, bin, count(w) n from d join ref on ref.lang=d.lang left join words using (key) where w=word or w=upper(word[1])||word[2:] group by all),
com as (select d.key, d.lang, ref.bin, coalesce(hits.n, 0) n from d join ref on ref.lang=d.lang left join hits on hits.key=d.key and hits.bin=ref.bin
 union all select base.key, base.lang, 20, n_words-coalesce((select sum(n) from hits where hits.key=base.key), 0) from base where base.lang in ('en', 'de', 'fr', 'es')),
far as (select b.key, coalesce(n_words>={quality.CHAR_WORDS} and c.dist>{quality.CHAR_LIMIT}, false) or coalesce(n_words>={quality.COMMON_WORDS} and m.dist>{quality.COMMON_LIMIT}, false) far
 from base b left join ({distance("cls")}) c on c.key=b.key left join ({distance("com")}) m on m.key=b.key)
select doc_id, n_words::bigint n_words, (length(t)-n_space)::bigint word_chars, n_symbols::bigint n_symbols, n_dup_lines::bigint n_dup_lines, n_repeat_words::bigint n_repeat_words,
 {failed} base_failed, not ({failed}) and not far kept
from base join far using (key)
"""


def _passages_sql() -> str:
    """Units by the same pattern, told apart by their normalised text instead of its digest."""
    unit = substring.UNIT.replace("'", "''")
    least = PASSAGE_WORDS
    return f"""
with d as (select row_number() over () as key, doc_id, coalesce(text, '') t, text from documents),
docs as (select *, dense_rank() over (order by doc_id nulls last, t) place from d),
u0 as (select key, place, unnest(regexp_extract_all(t, '{unit}')) x, generate_subscripts(regexp_extract_all(t, '{unit}'), 1) i from docs),
u1 as (select key, place, i, x, trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) k, sum(length(x)) over (partition by key order by i) stop from u0),
u2 as (select *, stop-length(x) start, length(k)-length(replace(k, ' ', ''))+1 words, row_number() over (partition by key order by i) nr from u1 where k<>''),
u3 as (select *, place>min(place) over (partition by k) or i>min(i) over (partition by key, k) later from u2),
u4 as (select *, nr-row_number() over (partition by key order by nr) g from u3 where later),
r as (select key, min(start)::bigint s, max(stop)::bigint e, sum(words) words from u4 group by key, g),
cut as (select key, count(*) n, sum(e-s) chars, string_agg(s||':'||e, ',' order by s) spans from r where words>={least} group by key),
alls as (select key, string_agg(s||':'||e, ',' order by s) spans from r group by key),
edge as (select key, s, e from r where words>={least} union all select key, length(t), length(t) from d),
piece as (select key, s, t[coalesce(lag(e) over (partition by key order by s, e), 0)+1:s] x from edge join d using (key)),
left_ as (select key, string_agg(x, '' order by s) x from piece group by key)
select doc_id, coalesce(n, 0)::bigint n_removed, coalesce(chars, 0)::bigint removed_chars, coalesce(cut.spans, '') spans, case when text is not null then coalesce(left_.x, '') end as text, coalesce(alls.spans, '') later_spans
from d left join cut using (key) left join alls using (key) left join left_ using (key)
"""


def _archives_sql() -> str:
    """Base32 of a SHA-1 from its hexadecimal digits: each five of these make four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digit = f"'{letters}'[((('0x' || h[5*g+1:5*g+5])::bigint >> (15-5*k)) & 31) + 1]"
    return f"""
with p as (select page_id, sha1(coalesce(html, '')) h, octet_length(encode(coalesce(html, ''))) n from pages),
b as (select page_id, n, h, min(page_id) over (partition by h) first_id from p),
c as (select h, string_agg({digit}, '' order by g, k) payload_digest from (select distinct h from p), (select unnest(range(8)) g), (select unnest(range(4)) k) group by h)
select page_id, n::bigint payload_bytes, payload_digest, case when page_id=first_id then 'response' else 'revisit' end record_type, case when page_id<>first_id then first_id end refers_to from b join c using (h)
"""


def _apportion_sql(cells: str, group: str, key: str, weight: str, seats: str) -> str:
    """``quota`` of each cell: rounded shares of too few seats, then the highest quotients."""
    return f"""
 select c.*, low+coalesce(won, 0) quota from (select *, {seats}-sum(low) over (partition by {group}) rest_seats from (
  select *, greatest(0, floor(part*({seats}-n/2)+0.5))::bigint low, floor(part*({seats}+n/2)+0.5)::bigint+1 high from (
   select *, {weight}::double/nullif(sum({weight}::double) over (partition by {group}), 0) part, (count(*) over (partition by {group}))::double n from {cells}))) c
 left join (select {group} g0, {key} k0, count(*) won from (select {group}, {key}, rest_seats, row_number() over (partition by {group} order by {weight}::double/(2*s+1) desc, {key} nulls last, s) r
   from (select *, unnest(range(low, greatest(low, high)+1)) s from (select *, {seats}-sum(low) over (partition by {group}) rest_seats from (
    select *, greatest(0, floor(part*({seats}-n/2)+0.5))::bigint low, floor(part*({seats}+n/2)+0.5)::bigint+1 high from (
     select *, {weight}::double/nullif(sum({weight}::double) over (partition by {group}), 0) part, (count(*) over (partition by {group}))::double n from {cells}))))
   where {weight}>0) where r<=rest_seats group by all) v on g0 is not distinct from {group} and k0 is not distinct from {key}"""


def _mixing_sql() -> str:
    space, block, seed = "[\\x20\\x09-\\x0D]", mixing.BLOCK, mixing.SEED

    def picked(x: str) -> str:
        k = f"(({x})//{block})"

        def blocks(i: str) -> str:
            return f"(({i}*rest+lead)//n_blocks)"

        return f"(case when n_blocks>0 then {blocks(k)}*{block}+(({x})-{k}*{block})*({blocks(f'({k}+1)')}-{blocks(k)}) else 0 end)"

    return f"""
with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda x: x<>''))::bigint size, md5(concat_ws(':', '{seed}', doc_id)) h from documents),
s0 as (select *, 1 one, ([{', '.join(map(str, mixing.WEIGHTS))}])[(row_number() over (order by source nulls last)-1)%{len(mixing.WEIGHTS)}+1] w from (select source, sum(size)::bigint source_size from d group by source)),
s1 as (select *, source_size*{mixing.CAP}::double cap from s0),
s2 as (select *, (sum(source_size) over ()*{mixing.SHARE}::double-coalesce(sum(cap) over x, 0))/(sum(w) over ()-coalesce(sum(w) over x, 0)) lev from s1 window x as (order by cap/w, source nulls last rows between unbounded preceding and 1 preceding)),
s3 as (select one, source, source_size, case when cap/w<lev then cap else (max(lev) filter (not cap/w<lev) over ())*w end target from s2),
s4 as (select *, floor(sum(target) over ()/{block}+0.5)::bigint total from s3),
q1 as ({_apportion_sql("s4", "one", "source", "target", "total")}),
e as (select d.*, source_size, target, q1.quota source_quota, ('0x'||substr(h, 1, 8))::bigint % greatest(1, ceil(source_size/(select greatest({mixing.SHARD_WORDS}, ceil(sum(source_size)/{mixing.SHARDS})) from s0)))::bigint shard from d join q1 on q1.source is not distinct from d.source),
c0 as (select source, shard, sum(size)::bigint words, any_value(source_quota) source_quota from e group by source, shard),
q2 as ({_apportion_sql("c0", "source", "shard", "words", "source_quota")}),
c1 as (select source cs, shard cc, n_blocks, least(quota, {int(mixing.CAP)}*n_blocks)::bigint quota, case when n_blocks>0 then ('0x'||substr(md5('{seed}:'||coalesce(source, '')||':'||shard), 1, 8))::bigint % n_blocks else 0 end lead from (select *, ceil(words/{block})::bigint n_blocks from q2)),
c2 as (select *, case when n_blocks>0 then quota//n_blocks else 0 end passes, case when n_blocks>0 then quota%n_blocks else quota end rest from c1),
f as (select *, coalesce(sum(size) over (partition by source, shard order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint start from e)
select doc_id, size, source_size, target, (passes*size+{picked("start+size")}-{picked("start")})::bigint taken from f join c2 on cs is not distinct from source and cc=shard
"""


SQL: dict[str, str] = {"op7_substring": _passages_sql(), "op8_mixing": _mixing_sql(), "op9_quality": _quality_sql(), "op10_warc": _archives_sql()}
