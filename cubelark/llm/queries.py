"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_rotation import rotated
from .decontaminate import contaminated
from .exact_dedup import duplicate_groups
from .kd_shards import kd_shards
from .license_scan import TEMPLATES, scan
from .line_templates import drop_recurring_lines
from .ngram_join import jaccard_components
from .quality_crf import classified
from .sentencepiece_viterbi import read_model, round_trips
from .simple8b import encode_to_index

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, prediction and fold of every document; see `classified`."""
    return classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the hash of the text that is left, of every document; see `drop_recurring_lines`."""
    out = drop_recurring_lines(_table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(text, 256).alias("text_sha256"))


def op3_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue once for each participant; see `rotated`."""
    return rotated(_table(spark, sf_dir, "conversations"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in documents; see `scan`."""
    return scan(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document; see `duplicate_groups`."""
    return duplicate_groups(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents; see `contaminated`."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of a token file of all documents, read back from it; see `encode_to_index`."""
    return encode_to_index(_table(spark, sf_dir, "documents"), read_model(tokenizer_file("word_bpe_49k.json")), end_id=2)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, class, component and number of links of every document; see `jaccard_components`."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids of every document and whether they decode to its text; see `round_trips`."""
    return round_trips(_table(spark, sf_dir, "documents"), read_model(tokenizer_file("piece_bpe_32k.model")))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among eight; see `kd_shards`."""
    return kd_shards(_table(spark, sf_dir, "documents"), shards=8)


#: From documents to `kept`: doc_id, n_lines, n_dropped and text after line dedup.
LINES_CTE = r"""
with raw as (
  select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as raw, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as line_no from documents
), flat as (
  select doc_id, line_no, trim(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') as line from raw
), lines as (
  select doc_id, line_no, string_split(regexp_replace(line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') as toks from flat
), cand as (
  select doc_id, line_no, toks, len(toks) as size, toks[1:3] as lead from lines where len(toks) >= 4
), once as (
  select toks, size, lead, count(distinct doc_id) as docs from cand group by all
), tokens as (
  select toks, size, lead, docs, unnest(toks) as token, unnest(range(len(toks))) as pos from once
), support as (
  select size, lead, pos, token, sum(docs) as support from tokens where token <> '<*>' group by all having sum(docs) >= 5
), marked as (
  select t.toks, t.size, t.pos, t.token, s.support, greatest(4, cast(ceil(0.5 * t.size) as bigint)) as least
  from tokens t left join support s on t.size = s.size and t.lead = s.lead and t.pos = s.pos and t.token = s.token
), floors as (
  select toks, any_value(least) as least, (list(support order by support desc) filter (where support is not null)) as best from marked group by toks
), shapes as (
  select m.toks, list(case when m.support >= 0.5 * f.best[f.least] then m.token else '<*>' end order by m.pos) as template
  from marked m join floors f using (toks) where len(f.best) >= f.least group by m.toks
), fit as (
  select 5 as need, cand.doc_id, cand.line_no, template as kind from cand join shapes using (toks)
  union all
  select 2, doc_id, line_no, [line] from flat where line <> ''
), heads as (
  select need, kind, min({'d': doc_id, 'l': line_no}) as head from fit group by need, kind having count(distinct doc_id) >= need
), gone as (
  select distinct fit.doc_id, fit.line_no from fit join heads using (need, kind) where {'d': fit.doc_id, 'l': fit.line_no} <> head
), kept as (
  select raw.doc_id, count(*) as n_lines, count(g.line_no) as n_dropped,
    string_agg(raw.raw, chr(10) order by raw.line_no) filter (where g.line_no is null) as text
  from raw left join gone g on raw.doc_id = g.doc_id and raw.line_no = g.line_no group by raw.doc_id
)
"""

OP2_SQL = LINES_CTE + "select doc_id, n_lines, n_dropped, sha256(coalesce(text, '')) as text_sha256 from kept"

OP3_SQL = r"""
with t as (
  select distinct conv_id, cast(turn as bigint) as turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
), numbered as (
  select *, (row_number() over (partition by conv_id order by turn nulls first, role, text) - 1) // 4096 as part from t
), views as (
  select n.*, p.perspective from numbered n join (select distinct conv_id, role as perspective from t where role <> 'system') p on n.conv_id is not distinct from p.conv_id
), pieces as (
  select *, role = perspective as own,
    '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then 'system'
      else 'user name=' || regexp_replace(regexp_replace(role, '[\r\n]', ' ', 'g'), '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g') end || chr(10) as head,
    regexp_replace(text, '<(\\*)\|im_(start|end)\|>', '<\\\1|im_\2|>', 'g') || '<|im_end|>' as body
  from views
), placed as (
  select *, coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, part, perspective order by turn nulls first, role, text
    rows between unbounded preceding and 1 preceding), 0) as begin_at from pieces
)
select conv_id, cast(part as bigint) as part, perspective, count(*) as n_turns, count(*) filter (where own) as n_targets,
  string_agg(head || body || chr(10), '' order by turn nulls first, role, text) as text,
  coalesce(string_agg(cast(cast(begin_at + length(head) as bigint) as varchar) || ':' || cast(cast(begin_at + length(head) + length(body) as bigint) as varchar), ',' order by begin_at) filter (where own), '') as loss_spans
from placed group by conv_id, part, perspective
"""

OP4_SQL = (
    """
with templates as (select * from (values """
    + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    + r""") v(license_id, text)
), words as (
  select 'd' as kind, doc_id, null as license_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') as w from documents where text is not null
  union all
  select 't', null, license_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') from templates
), shingles as (
  select kind, doc_id, license_id, i as pos, array_to_string(w[i + 1 : i + 5], ' ') as s from (select *, unnest(range(len(w) - 4)) as i from words where len(w) >= 5)
), target as (
  select license_id, s, count(*) over (partition by license_id) as n from (select distinct license_id, s from shingles where kind = 't')
), size as (
  select license_id, count(*) as n from shingles where kind = 't' group by 1
), hits as (
  select d.doc_id, t.license_id, t.n as distinct_n, size.n, d.s, unnest([d.pos // size.n, d.pos // size.n - 1]) as j
  from shingles d join target t on d.s = t.s join size on size.license_id = t.license_id where d.kind = 'd'
), shares as (
  select doc_id, license_id, j * n as start, count(distinct s) / any_value(distinct_n) as containment from hits where j >= 0 group by doc_id, license_id, j, n
), brief as (
  select license_id, len(w) as k, array_to_string(w, ' ') as s from words where kind = 't' and len(w) < 5 and w <> ['']
), runs as (
  select doc_id, k, i as pos, array_to_string(w[i + 1 : i + k], ' ') as s from (select doc_id, w, k, unnest(range(len(w) - k + 1)) as i from words, (select distinct k from brief) where kind = 'd' and len(w) >= k)
), found as (
  select * from shares where containment >= 0.8
  union all
  select doc_id, license_id, greatest(min(pos) - 1, 0), 1.0 from runs join brief using (k, s) group by doc_id, license_id
)
select doc_id, license_id, round(max(containment), 6) as containment, cast(arg_max(start, {'c': containment, 's': -start}) as bigint) as start
from found group by doc_id, license_id
"""
)

OP5_SQL = r"""
with n as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from n
"""


OP8_SQL = r"""
with recursive words as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] as w from documents
), sets as (
  select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i + 1 : i + 5], ' ') for i in range(len(w) - 4)] end)) as s from words
), placed as (
  select doc_id, len(s) as n, case when len(s) = 0 then doc_id else min(doc_id) over (partition by s) end as class_id, s from sets
), shingles as (
  select class_id, n, unnest(s) as x from placed where doc_id = class_id
), links as (
  select a.class_id as a, b.class_id as b from shingles a join shingles b on a.x = b.x and a.class_id <> b.class_id
  group by a.class_id, b.class_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach as (
  select class_id as a, class_id as b from placed where doc_id = class_id
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), component as (
  select a as class_id, min(b) as component_id from reach group by a
), counted as (
  select a as class_id, count(*) as n_links from links group by a
)
select doc_id, n as n_shingles, component_id, class_id, coalesce(n_links, 0) as n_links
from placed join component using (class_id) left join counted using (class_id)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_crf, op2_line_templates, op3_perspective_rotation, op4_license_scan, op5_exact_dedup, op6_benchmark_decontamination, op7_simple8b_tokens, op8_ngram_jaccard_join, op9_sentencepiece, op10_kd_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_templates": OP2_SQL, "op3_perspective_rotation": OP3_SQL, "op4_license_scan": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_ngram_jaccard_join": OP8_SQL}
