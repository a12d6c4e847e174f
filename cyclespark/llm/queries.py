"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .collocations import mine_collocations
from .common import table
from .lang_id import held_out, identify, train
from .license_scan import scan_licences
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pieces import decode_ids, encode_texts
from .quality import judge_quality
from .substring_dedup import drop_repeats
from .suffix_dedup import drop_seen
from .syncmers import fingerprint_documents
from .toxicity import score_toxicity
from .url_filter import judge_urls
from .whitening import whiten

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_sentencepiece(spark, sf_dir):
    """ids of every text, and whether they decode to it again."""
    import public_tokenizers as P

    model = P.path("piece_bpe_32k.model")
    encoded = encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    decoded = decode_ids(encoded, model)
    same = F.coalesce(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit(False))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


def op2_license_scan(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


def op3_substring_dedup(spark, sf_dir):
    return drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_quality(docs).drop("lang", "source")


def op6_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), ~held_out("doc_id", 4, 2))
    return scored.withColumn("held_out", held_out("doc_id", 4, 2))


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 5, 0))
    return identify(docs.drop("lang"), train(docs.filter("not held_out")))


def op9_order_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_syncmers(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark, sf_dir):
    return mine_collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_suffix_dedup(spark, sf_dir):
    return drop_seen(table(spark, sf_dir, "documents").select("doc_id", "text"), with_spans=False)


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_license_scan": op2_license_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_order_minhash": op9_order_minhash,
    "op10_syncmers": op10_syncmers,
    "op11_collocations": op11_collocations,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_whitening": op13_whitening,
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)

ORACLES = {
    "op4_url_filter": rf"""
with r(h, p, a) as (values {_RULE_ROWS}),
u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
x as (select row_number() over () k, page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
f as (select k, arg_max(h || p, length(h) + length(p)) rule, arg_max(a, length(h) + length(p)) a
  from x join r on (x.host = r.h or ends_with(x.host, '.' || r.h)) and starts_with(x.path, r.p) group by k)
select page_id, host, path, rule, coalesce(a, 'allow') verdict from x left join f using (k)""",
    "op5_quality_rules": r"""
with d as (select row_number() over () k, doc_id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from d),
g as (select k, i, hash(list_slice(w, i, i + 7)) h, list_slice(w, i, i + 7) s from (select k, w, unnest(range(1, len(w) - 6)) i from w)),
rep as (select k, i from (select k, i, count(*) over (partition by k, h, s) c from g) where c > 1),
cov as (select k, sum(least(8, coalesce(nx - i, 8)))::bigint n from (select k, i, lead(i) over (partition by k order by i) nx from rep) group by k),
c as (select w.k, doc_id, lang, source, len(w.w)::bigint n_words, length(array_to_string(w.w, ''))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words
  from w left join cov using (k)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from c),
m as (select k, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) me,
  unnest([word_chars * 100 // n_words, n_symbols * 1000 // n_words, n_dup_lines * 1000 // n_words, n_repeat_words * 1000 // n_words]) x from b where not base_failed),
f as (select lang, source, me, v, count(*) n from (select *, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) v from m) group by all),
fq as (select lang, source, me, max(t) t, min(v) filter (u * 4 >= t) q1, min(v) filter (u * 4 >= t * 2) q2, min(v) filter (u * 4 >= t * 3) q3 from (
  select *, sum(n) over (partition by lang, source, me) t, sum(n) over (partition by lang, source, me order by v) u from f) group by all),
cq as (select lang, me, min(v) filter (u * 4 >= t) w1, min(v) filter (u * 4 >= t * 2) w2, min(v) filter (u * 4 >= t * 3) w3 from (
  select *, sum(n) over (partition by lang, me) t, sum(n) over (partition by lang, me order by v) u from (select lang, me, v, sum(n) n from f group by all)) group by lang, me),
q as (select lang, source, me, case when t >= 200 then q1 else w1 end a, case when t >= 200 then q2 else w2 end b, case when t >= 200 then q3 else w3 end c
  from fq join cq using (lang, me)),
bad as (select distinct m.k from m join q using (lang, source, me) where abs(x - b) > greatest((c - a) * 4, 250))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.k is null kept from b left join bad using (k)""",
    "op11_collocations": r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, regexp_extract_all(x, '[^\x20\x09]+') w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) x from d)),
i as (select lang, w, unnest(range(1, len(w) + 1)) i from p),
f as (select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') phrase, count(*) f from i, (values (1), (2), (3), (4)) k(k) where i + k - 1 <= len(w) group by all),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as (select lang, k, phrase, string_split(phrase, ' ') w, f a from f where k > 1 and f >= 30),
s as (select lang, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') x, array_to_string(list_slice(w, j + 1, k), ' ') y from (select *, unnest(range(1, k)) j from c)),
v as (select s.lang, s.phrase, a, j, l.f l, r.f r, (2000000::hugeint * a) // (l.f + r.f) score from s join f l on l.lang = s.lang and l.phrase = s.x join f r on r.lang = s.lang and r.phrase = s.y),
b as (select lang, phrase, a, arg_min(l, score * 8 + j) l, arg_min(r, score * 8 + j) r, min(score)::bigint score from v group by all),
g as (select lang, array_to_string(list_slice(w, i, i + m - 1), ' ') phrase, max(a) most
  from (select *, unnest(range(1, k - m + 2)) i from c, (values (2), (3)) m(m) where m < k) group by all),
q as (select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) rank from b left join g using (lang, phrase) where most is null or 100 * most < 80 * a)
select lang, rank, phrase, a, l, r, n, score from q join n using (lang) where rank <= 2000""",
    "op12_suffix_dedup": r"""
with d as (select row_number() over () k, doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select k, doc_id, i, substr(h, 2 * i - 1, 100) s from (select *, unnest(range(1, len(h) // 2 - 48)) i from d)),
m as (select k, i from (select k, i, doc_id, min(doc_id) over (partition by s) m from w) where doc_id > m),
g as (select k, i, sum(new) over (partition by k order by i) g from (select k, i, case when i - lag(i) over (partition by k order by i) <= 50 then 0 else 1 end new from m)),
s as (select k, min(i) a, max(i) + 49 b from g group by k, g.g),
e as (select k, a, b, lead(a) over (partition by k order by a) nx, row_number() over (partition by k order by a) = 1 head from s),
t as (select k, sum(b - a + 1)::bigint removed, count(*) n, string_agg(case when head then substr(h, 1, 2 * a - 2) else '' end || substr(h, 2 * b + 1, case when nx is null then len(h) else 2 * (nx - b - 1) end), '' order by a) kept
  from e join d using (k) group by k)
select doc_id, (len(h) // 2)::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from d left join t using (k)""",
}
