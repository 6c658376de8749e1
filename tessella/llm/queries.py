"""The registered ``opN_`` queries, their digest columns and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import crc_mod, query, table
from tessella.runtime import scratch_path

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value of the encoding

# --- 5 WARC ------------------------------------------------------------------


@query("op5_warc_dictionary", f"""
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b) n, sha1(b) s from p),
m as (select *, max(page_id) over (partition by s, n) top from h)
select page_id, n::bigint as payload_bytes,
  list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
    lambda k: substr('{_BASE32}', (((('0x' || substr(s, (g * 5 + 1)::int, 5))::bigint) >> k) & 31)::int + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to
from m
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.warc import read_warc, write_warc

    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


# --- 7 mixing ----------------------------------------------------------------


@query("op7_mix_sources", """
with d as (select doc_id, source, text, length(coalesce(text, '')) n from documents),
s as (select source, sum(n) chars from d group by source),
r as (select source, (select sum(chars) from s) / (select count(*) from s)::double / chars rate from s where chars > 0),
k as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::bigint + 1)) k from r),
pmf as (select source, rate, k, exp(k * ln(rate) - rate - list_sum(list_transform(range(1, k + 1), lambda j: ln(j)))) p from k where k > 0
        union all select source, rate, 0, exp(-rate) from r),
cdf as (select source, rate, k, sum(p) over (partition by source order by k) f from pmf),
u as (select *, ('0x' || substr(md5('mix|' || doc_id::varchar), 1, 12))::bigint / 281474976710656.0::double u from d),
n as (select u.doc_id, u.source, u.text, cdf.rate, count(*) n from u join cdf on u.source is not distinct from cdf.source and cdf.f <= u.u group by all),
c as (select *, unnest(range(1, n + 1)) as copy from n)
select doc_id, source, text, copy::int as copy, round(rate, 9) as rate, md5('mix|order|' || doc_id::varchar || '|' || copy::varchar) as shuffle_key from c
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source is brought to the same share of all characters."""
    from tessella.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).withColumn("rate", F.round("rate", 9))


# --- 9 fingerprints ----------------------------------------------------------


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.fingerprints import likeness, with_fingerprint, with_next

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    near = with_next(docs, "doc_id", {"_t": "_next", "fingerprint": "_next_fp"}, derive=lambda x: with_fingerprint(x, F.col("_t"), "fingerprint"))
    n = F.char_length("_t")
    cut = F.floor(n / 3).cast("int")
    edited = near.withColumn("n_chars", n.cast("long")).withColumn("_e", F.concat(F.substr("_t", F.lit(1), n - cut), F.substr("_next", F.lit(1), cut))).drop("_t", "_next")
    out = with_fingerprint(edited, F.col("_e"), "edited_fingerprint")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next_fp")).alias("near_next"),
    )


# --- 10 decontamination ------------------------------------------------------

_WORDS10 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op10_decontaminate", f"""
with b as (select item_id, {_WORDS10} w from benchmark),
pat as (select item_id, array_to_string(list_slice(w, i, i + 9), ' ') g, least(len(w), 10) n
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from pat),
d as (select doc_id, {_WORDS10} w from documents),
win as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d cross join sizes where len(w) >= n)),
hit as (select win.doc_id, win.i, win.n, pat.item_id from win join pat on win.g = pat.g and win.n = pat.n),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) s from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.decontaminate import decontaminate

    hits = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# --- 6 near duplicates -------------------------------------------------------

_WORDS6 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


@query("op6_near_duplicates", f"""
with recursive d as (select doc_id, {_WORDS6} w from documents),
sh as (select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') s
       from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from d where len(w) > 0)),
size as (select doc_id, count(*) n from sh group by doc_id),
pairs as (select a.doc_id x, b.doc_id y, count(*) k from sh a join sh b using (s) where a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join size p on p.doc_id = x join size q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id r from documents union select reach.doc_id, y from reach join both_ways on r = x),
comp as (select doc_id, min(r) component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept
from d left join size using (doc_id) join comp using (doc_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.near_dups import near_duplicates

    near = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)
    return near.withColumn("kept", F.col("doc_id") == F.col("component_id"))


# --- 1 suffix-array dedup, 8 substring dedup ---------------------------------


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_substring_dedup", """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
win as (select doc_id, i, hash(array_to_string(list_slice(w, i, i + 12), ' ')) g from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
least as (select g, min(doc_id) lo from win group by g),
gone as (select doc_id, list(distinct p) ps from (select doc_id, unnest(range(i, i + 13)) p from win join least using (g) where lo < doc_id) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: ps is null or not list_contains(ps, i)), ' '), '')) as kept_sha256
from d left join gone using (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), length=13)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


# --- 2 toxicity --------------------------------------------------------------


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids with remainder 0 are held out."""
    from tessella.llm.toxicity import learn, score_texts

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = learn(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return score_texts(docs, index).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "neighbours", "similarities")


# --- 4 personal data ---------------------------------------------------------


@query("op4_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.pii import replace_entities

    return replace_entities(table(spark, sf_dir, "documents"), count_col="n_entities").select("doc_id", "text", "n_entities")


# --- 3 language-model scores -------------------------------------------------


@query("op3_class_lm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with remainder 2 are held out of training."""
    from tessella.llm.class_lm import score

    docs = table(spark, sf_dir, "documents")
    out = score(docs, crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 11 conversation repair ---------------------------------------------------

_STATES = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}
_GOES = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def _own_edit(s: int) -> str:
    """The best edit of a row in state ``s`` as (cost, audit, repaired lines), given those of the rest by state."""
    to, role = _GOES[s]
    keeps = " ".join(f"when ini = '{i}' then {{'c': extra + f[{t + 1}].c, 'a': 'K' || f[{t + 1}].a, 'r': list_prepend(role || ':' || text, f[{t + 1}].r)}}" for i, t in _STATES[s])
    return (
        f"list_min(list_filter([{{'c': 4 + f[{s + 1}].c, 'a': 'D' || f[{s + 1}].a, 'r': f[{s + 1}].r}}, case when must then null {keeps} end,"
        f" case when not must then {{'c': 3 + extra + f[{to + 1}].c, 'a': 'R' || f[{to + 1}].a, 'r': list_prepend('{role}:' || text, f[{to + 1}].r)}} end], lambda x: x is not null))"
    )


def _with_inserts(s: int) -> str:
    (one, first), (two, second) = _GOES[s], _GOES[_GOES[s][0]]
    return (
        f"list_min([g[{s + 1}], {{'c': 3 + g[{one + 1}].c, 'a': 'I' || g[{one + 1}].a, 'r': list_prepend('{first}:', g[{one + 1}].r)}},"
        f" {{'c': 6 + g[{two + 1}].c, 'a': 'II' || g[{two + 1}].a, 'r': list_prepend('{first}:', list_prepend('{second}:', g[{two + 1}].r))}}])"
    )


@query("op11_conversation_repair", f"""
with recursive poly as (select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) tab),
keyed as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') key from conversations),
coded as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i::int, 1))::bigint)), lambda a, b: xor(a >> 8, tab[((xor(a, b) & 255) + 1)::int])), 4294967295::bigint) % 20 f
  from keyed, poly),
hurt as (select conv_id c, turn t, case when f = 4 then 'user' else role end role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when f = 3 then 2 else 1 end)) from coded where f != 0),
placed as (select c, t, role, text, row_number() over (partition by c order by t nulls first, role, md5(text)) p, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) body from hurt),
marked as (select *, body = '' blank, body != '' and p > min(p) over (partition by c, role, text) again, lag(substr(role, 1, 1)) over (partition by c order by p) before, count(*) over (partition by c) n from placed),
lines as (select *, not blank and not again and right(body, 1) not in ('.', '!', '?') cut from marked),
facts as (select c, coalesce(max(t) - min(t) + 1 - count(distinct t), 0)::bigint gaps, count(*) filter (blank) blank, count(*) filter (again) duplicate, count(*) filter (cut) truncated,
  count(*) filter (before is not null and before || substr(role, 1, 1) not in ('su', 'ua', 'au')) illegal from lines group by c),
chain as (select c, n - p + 1 i, role, text, substr(role, 1, 1) ini, blank or again must, case when cut then 3 else 0 end extra, n from lines),
solved as (
  select c, 0::bigint i, [{{'c': 0, 'a': '', 'r': []::varchar[]}}, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}}, {{'c': 3, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': []::varchar[]}}] f, max(n) n from chain group by c
  union all
  select c, i, [{', '.join(_with_inserts(s) for s in range(4))}] f, n from (
    select s.c, x.i, s.n, [{', '.join(_own_edit(s) for s in range(4))}] g from solved s join chain x on s.c is not distinct from x.c and x.i = s.i + 1)),
best as (select c, f[1].c::bigint as cost, f[1].a as audit, sha256(array_to_string(f[1].r, chr(10))) h from solved where i = n)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts on o.conv_id is not distinct from facts.c left join best on o.conv_id is not distinct from best.c
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.conversation_repair import damage, repair_with_digest

    rows = table(spark, sf_dir, "conversations")
    out = repair_with_digest(damage(rows)).withColumnRenamed("conv_id", "_c")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = rows.select("conv_id").distinct().join(out, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
    return whole.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


# --- 13 best-fit packing ------------------------------------------------------


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the check sum of a piece's ids travels with its length."""
    from tessella.llm.packing import place, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


# --- 12 collocations ----------------------------------------------------------

_PIECES12 = "regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"
_CUT12 = "(2000000::hugeint * f // (l{0} + r{0}))::bigint"


def _scores12(n: int) -> str:
    cuts = ", ".join(f"{{'score': {_CUT12.format(k)}, 'k': {k}, 'l': l{k}, 'r': r{k}}}" for k in range(1, n))
    parts = ", ".join(f"l{k}.f l{k}, r{k}.f r{k}" for k in range(1, n))
    joins = " ".join(
        f"join grams l{k} on l{k}.lang = g.lang and l{k}.n = {k} and l{k}.p = array_to_string(list_slice(g.w, 1, {k}), ' ')"
        f" join grams r{k} on r{k}.lang = g.lang and r{k}.n = {n - k} and r{k}.p = array_to_string(list_slice(g.w, {k + 1}, {n}), ' ')"
        for k in range(1, n)
    )
    return f"select lang, n, p, w, f, list_min([{cuts}]) b from (select g.lang, g.n, g.p, g.w, g.f, {parts} from grams g {joins} where g.n = {n} and g.f >= 30)"


@query("op12_collocations", f"""
with pieces as (select coalesce(lang, 'und') lang, regexp_extract_all(unnest({_PIECES12}), '[^\x20\x09]+') w from documents),
grams as materialized (select lang, n, p, any_value(w) w, count(*) f from (
    select lang, n, list_slice(w, i, i + n - 1) w, array_to_string(list_slice(w, i, i + n - 1), ' ') p
    from (select lang, w, n, unnest(range(1, len(w) - n + 2)) i from pieces, (select unnest([1, 2, 3, 4]) n) where len(w) >= n)) group by lang, n, p),
cand as ({_scores12(2)} union all {_scores12(3)} union all {_scores12(4)}),
inner_phrases as (select lang, n, array_to_string(list_slice(w, i, i + m - 1), ' ') q, m, f from (select lang, n, w, f, m, unnest(range(1, n - m + 2)) i from cand, (select unnest([2, 3]) m) where m < n)),
around as (select lang, m, q, max(f) f from inner_phrases group by all),
kept as (select c.* from cand c left join around a on a.lang = c.lang and a.m = c.n and a.q = c.p where a.f is null or 100::hugeint * a.f < 80 * c.f),
ranked as (select *, row_number() over (partition by lang order by b.score desc, f desc, p) k from kept),
totals as (select lang, sum(f)::bigint n from grams where n = 1 group by lang)
select r.lang, k as rank, p as phrase, f as a, b.l as l, b.r as r, t.n as n, b.score as score from ranked r join totals t on t.lang = r.lang where k <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
