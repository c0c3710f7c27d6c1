"""One query for each operator of this folder, over whole tables, with its checking SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarweave.llm import (
    chat, decontaminate, filter_audit, hard_negatives, html_main, langid, line_dedup, near_dedup, packing, pieces, quality_gam, repetition, suffix_dedup,
)
from scholarweave.llm.common import remainder, table

KEEP_FROM = 0.3


def quality_model(spark: SparkSession, sf_dir: str) -> quality_gam.Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(remainder("doc_id", 5) != 0)
    return quality_gam.train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_gam.score(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir), ["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(packing.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.main_text(pages, html_main.train(pages), ["page_id", "url"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(remainder("doc_id", 3) != 1))
    found = langid.predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = given.unionByName(added.select(*[F.col(f.name).cast(f.dataType) for f in given.schema]))
    made = chat.format_conversations(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    return made.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return filter_audit.audit(filter_audit.counters(spark, f"{sf_dir}/documents.parquet", labels, {"id": "doc_id", "part": "lang", "text": "text"}))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, ["doc_id"])
    decoded = pieces.decode(encoded, model, ["doc_id", "ids"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    given = table(spark, sf_dir, "embeddings").select(vec_id.alias("id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col("embedding").alias("v"))
    return hard_negatives.mine(hard_negatives.integers(given), F.col("id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_line_dedup, op3_best_fit_packing, op4_quality_rules, op5_html_extraction, op6_substring_dedup, op7_language_id, op8_chat_formatting,
        op9_benchmark_decontamination, op10_minhash_near_dedup, op11_filter_interaction_audit, op12_sentencepiece, op13_hard_negatives, pipeline,
    )
}

_BLANK = r"[\x20\x09-\x0D]+"
# words of each text, numbered from 1
_WORDS = """select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{sep}'), lambda x: x <> '') as w from {table}"""

SQL = {}

SQL["op2_line_dedup"] = r"""
with split as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as no from split),
used as (select *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t, row_number() over (partition by doc_id order by no) as i
         from lines where trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
two as (select a.doc_id, a.i, a.no as n0, b.no as n1, a.t || chr(10) || b.t as k from used a join used b on a.doc_id = b.doc_id and b.i = a.i + 1),
one as (select doc_id, i, no as n0, no as n1, t as k from used where length(t) >= 100 or (length(t) >= 19 and len(string_split_regex(t, '[ \t\r\x0b\x0c]+')) >= 10)),
ranked as (select *, row_number() over (partition by k order by doc_id, i) as r from (select * from two union all select * from one)),
gone as (select doc_id, n0 as no from ranked where r > 1 union select doc_id, n1 from ranked where r > 1),
counted as (select doc_id, count(*) as n_removed from gone group by doc_id),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.no) as text from lines l left join gone g on l.doc_id = g.doc_id and l.no = g.no where g.no is null group by l.doc_id)
select s.doc_id, case when s.text is null then null else coalesce(k.text, '') end as text, coalesce(len(s.ls), 0)::bigint as n_lines, coalesce(c.n_removed, 0)::bigint as n_removed
from split s left join kept k on s.doc_id = k.doc_id left join counted c on s.doc_id = c.doc_id
"""

SQL["op4_quality_rules"] = (
    "with d as ("
    + _WORDS.format(sep=_BLANK, table="documents")
    + r"""),
grams as (select doc_id, n, i, w[i:i + n - 1] as g from d, (values (3), (10)) v(n), unnest(range(1, greatest(len(w) - n + 2, 1))) u(i)),
repeated as (select doc_id, n, i from grams qualify count(*) over (partition by doc_id, n, g) > 1),
covered as (select doc_id, n, count(distinct i + k) as c from repeated, unnest(range(n)) u(k) group by doc_id, n),
-- the longest repeat: where two equal windows of three start, how far they go on together
pairs as (select a.doc_id, a.i as x, b.i as y from grams a join grams b on a.doc_id = b.doc_id and a.n = 3 and b.n = 3 and a.g = b.g and a.i < b.i),
runs as (select doc_id, x, y, x - row_number() over (partition by doc_id, y - x order by x) as run, y - x as gap from pairs),
longest as (select doc_id, max(c) as longest_repeat from (select doc_id, count(*) + 2 as c from runs group by doc_id, gap, run) group by doc_id),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
        where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
      length(regexp_replace(coalesce(t.text, ''), '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
      coalesce(c3.c, 0)::bigint as n_repeat_words, coalesce(c10.c, 0)::bigint as n_covered, coalesce(longest_repeat, 0)::bigint as longest_repeat
      from d join documents t on d.doc_id = t.doc_id left join dup on d.doc_id = dup.doc_id left join covered c3 on d.doc_id = c3.doc_id and c3.n = 3
      left join covered c10 on d.doc_id = c10.doc_id and c10.n = 10 left join longest l on d.doc_id = l.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (100 * n_covered > 30 * n_words) and not (longest_repeat > 100 and 100 * longest_repeat > 30 * n_words) as kept
from m
"""
)

SQL["op6_substring_dedup"] = (
    "with d as ("
    + _WORDS.format(sep=_BLANK, table="documents")
    + r"""),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g from d, unnest(range(1, greatest(len(w) - 48, 1))) u(i)),
later as (select doc_id, i from windows qualify doc_id > min(doc_id) over (partition by g)),
gone as (select distinct doc_id, i + k as i from later, unnest(range(50)) u(k)),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
kept as (select a.doc_id, string_agg(a.x, ' ' order by a.i) as t from words a left join gone g on a.doc_id = g.doc_id and a.i = g.i where g.i is null group by a.doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(c, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept k on d.doc_id = k.doc_id left join (select doc_id, count(*) as c from gone group by doc_id) g on d.doc_id = g.doc_id
"""
)

SQL["op8_chat_formatting"] = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::bigint as formatted_chars
from t group by conv_id
"""

SQL["op9_benchmark_decontamination"] = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id::varchar as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
      from benchmark where item_id is not null),
items as (select distinct item_id, n, w[i:i + n - 1] as g from (select item_id, w, least(len(w), 10) as n from b where len(w) > 0), unnest(range(1, len(w) - n + 2)) u(i)),
windows as (select doc_id, n, i, w[i:i + n - 1] as g from d, (select distinct n from items), unnest(range(1, greatest(len(w) - n + 2, 1))) u(i)),
hits as (select doc_id, i, h.n, item_id from windows h join items k on h.n = k.n and h.g = k.g),
words as (select doc_id, count(distinct i + k) as c from hits, unnest(range(n)) u(k) group by doc_id),
found as (select doc_id, count(*) as c, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(words.c, 0)::bigint as n_hit, coalesce(found.c, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(words.c, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join found on d.doc_id = found.doc_id
"""

SQL["op10_minhash_near_dedup"] = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (select distinct doc_id, hash(w[i:i + 3]) as g from d, unnest(range(1, greatest(len(w) - 2, 2))) u(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(x, y) as (select x, y from both_ways union select r.x, b.y from reach r join both_ways b on r.y = b.x),
least_id as (select x, least(x, min(y)) as m from reach group by x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(m, d.doc_id) as component_id, coalesce(m, d.doc_id) = d.doc_id as kept
from d left join sizes s on d.doc_id = s.doc_id left join least_id l on d.doc_id = l.x
"""

SQL["op11_filter_interaction_audit"] = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
known as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  [('A', len(w) < 100), ('B', 100 * len(list_distinct(w)) < 80 * len(w)), ('C', 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)),
   ('D', regexp_matches(t, '[#$%&*|]')), ('E', coalesce(d.doc_id > min(d.doc_id) over (partition by t), false))] as f
  from d left join known k on d.doc_id = k.doc_id),
fails as (select part, good, toxic, list_transform(list_filter(f, lambda x: x[2]), lambda x: x[1]) as f, count(*) as n from m group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e
  where length(list_aggregate(list_distinct([a.x, b.x, c.x, d.x, e.x]), 'string_agg', '')) = 5),
steps as (select filter_order, step::integer as step, filter_order[step:step] as own, string_split(filter_order[1:step - 1], '') as before from orders, unnest(range(1, 6)) u(step)),
each as (select part, filter_order, step, own, good, toxic, n, list_contains(f, own) as failed, list_has_any(f, before) as earlier, len(f) = 1 as only_one from fails, steps),
counted as (select part, filter_order, step, own, coalesce(sum(n) filter (not failed and not earlier), 0)::bigint as kept, coalesce(sum(n) filter (failed and not earlier), 0)::bigint as removed,
  coalesce(sum(n) filter (failed and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (failed and only_one), 0)::bigint as unique_fails,
  coalesce(sum(n) filter (failed and not earlier and good), 0)::bigint as good_lost, coalesce(sum(n) filter (failed and not earlier and toxic), 0)::bigint as toxic_lost from each group by all)
select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from counted
"""

SQL["op13_hard_negatives"] = r"""
with given as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id as id, list_sum(list_transform(list_zip(a.v, b.v), lambda x: coalesce(x[1], 0) * coalesce(x[2], 0)))::bigint as score
  from given a join given b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, id as positive_id, score as positive_score from scores where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.id)::integer as rank, n.id as negative_id, positive_score, n.score as negative_score
from positives p join scores n on p.anchor_id = n.anchor_id and not n.same and 50 * positive_score <= 100 * n.score and 100 * n.score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by n.score desc, n.id) <= 3
"""
